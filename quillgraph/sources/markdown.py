"""Markdown files: scanning folders, and parsing texts into sections and links.

The parser is a line scanner for the part of CommonMark that matters here: it
knows front matter, ATX and setext headings, fenced and indented code, code
spans, escapes, and paragraphs.  Files are parsed in Arrow batches, one row in,
one nested row out.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.paths import matches_globs
from quillgraph.functions.text import estimate_tokens_py
from quillgraph.schema import LINK_TYPES, PUBLIC_DOC_TYPES

MAX_TOKENS, MIN_TOKENS, AROUND = 256, 32, 50

# Two opening brackets, a target without bars and closing brackets, a label behind a bar if there is one, two closing brackets.
_WIKILINK = re.compile(r"\[\[(?P<target>[^|\]]+)(?:\|(?P<label>[^\]]+))?\]{2}")
_MDLINK = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_EXTERNAL = re.compile(r"^(https?://|mailto:|#)")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)

PARSED = (
    "filepath string, title string, doc_type string, source_refs array<string>, "
    "sections array<struct<heading:string,content:string,section_order:int,token_count:int>>, "
    "links array<struct<target:string,type:string,context:string,section_order:int,position:int>>, "
    "warnings array<string>, error string"
)


@dataclass
class Parsed:
    title: str
    doc_type: str | None
    source_refs: list[str] | None
    sections: list[dict]
    links: list[dict]
    warnings: list[str] = field(default_factory=list)


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """Front matter between a first line of three dashes and the next one, and the rest."""
    m = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", text, re.S)
    return (m[1], text[m.end() :]) if m else (None, text)


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        # Without the library only flat ``key: value`` and lists of strings are read.
        out, key = {}, None
        for line in text.splitlines():
            if m := re.match(r"^\s*-\s+(.*)$", line):
                if key is not None:
                    out[key] = [*(out[key] if isinstance(out[key], list) else []), m[1].strip().strip("'\"")]
            elif m := re.match(r"^(\w+):\s*(.*)$", line):
                key = m[1]
                out[key] = m[2].strip().strip("'\"") or None
            elif line.strip():
                raise ValueError(f"cannot read {line!r}") from None
        return out
    return yaml.safe_load(text)


def parse_frontmatter(text: str | None, filepath: str = "") -> tuple[dict, list[str]]:
    """title, doc_type and source_refs where given and usable, and warnings about the rest."""
    if text is None or not text.strip():
        return {}, []
    try:
        raw = _yaml(text)
    except Exception as e:  # noqa: BLE001  any fault in the YAML makes it no front matter
        return {}, [f"front matter of {filepath} cannot be read: {e}"]
    if not isinstance(raw, (dict, list)):
        return {}, [f"front matter of {filepath} is not a mapping"]
    data, warnings = {}, []
    raw = raw if isinstance(raw, dict) else {}
    if isinstance(raw.get("title"), str):
        data["title"] = raw["title"].strip()
    if "doc_type" in raw:
        known = isinstance(raw["doc_type"], str) and raw["doc_type"] in PUBLIC_DOC_TYPES
        data["doc_type"] = raw["doc_type"] if known else "spec"
        if not known:
            warnings.append(f"doc_type {raw['doc_type']!r} of {filepath} is unknown; spec is taken")
    if "source_refs" in raw:
        refs = raw["source_refs"]
        if not isinstance(refs, list):
            warnings.append(f"source_refs of {filepath} is not a list of strings")
        else:
            named = [r.strip() for r in refs if isinstance(r, str)]
            warnings += [f"source_ref {r!r} of {filepath} leaves the project and is ignored" for r in named if ".." in r]
            if kept := [r for r in named if ".." not in r]:
                data["source_refs"] = kept
    return data, warnings


def blocks(body: str) -> list[tuple[str, int, str, str]]:
    """(kind, level, shown text, source) of top-level blocks: heading, code or text."""
    out: list[tuple[str, int, str, str]] = []
    paragraph: list[str] = []

    def flush() -> None:
        if paragraph:
            source = "\n".join(paragraph)
            out.append(("text", 0, source, source))
            paragraph.clear()

    lines, i = body.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if fence := _FENCE.match(line):
            if "`" not in fence[2] or fence[1][0] == "~":
                flush()
                j, mark = i + 1, fence[1]
                while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j]):
                    j += 1
                out.append(("code", 0, "", "\n".join(lines[i : j + 1])))
                i = j + 1
                continue
        if not line.strip():
            flush()
        elif atx := _ATX.match(line):
            flush()
            shown = (atx[2] or "").strip()
            out.append(("heading", len(atx[1]), "" if re.fullmatch(r"#+", shown) else shown, line))
        elif paragraph and (setext := _SETEXT.match(line)):
            shown = "\n".join(p.strip() for p in paragraph)
            out.append(("heading", 1 if setext[1][0] == "=" else 2, shown, "\n".join([*paragraph, line])))
            paragraph.clear()
        elif not paragraph and re.match(r"^(?: {4}|\t)", line):
            j = i
            while j < len(lines) and (not lines[j].strip() or re.match(r"^(?: {4}|\t)", lines[j])):
                j += 1
            out.append(("code", 0, "", "\n".join(lines[i:j]).rstrip("\n")))
            i = j
            continue
        else:
            paragraph.append(line)
        i += 1
    flush()
    return out


def plain(text: str) -> str:
    """Heading text without inline marks."""
    text = _CODE_SPAN.sub(lambda m: m[2].strip(), text)
    text = re.sub(r"!?\[([^\]\[]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def split_sections(body: str, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS) -> list[dict]:
    """Sections at second and third level headings, large ones split, tiny ones merged into the one before."""
    raw: list[tuple[str | None, list[str]]] = []
    heading, content = None, []
    for kind, level, shown, source in blocks(body):
        if kind == "heading" and level in (2, 3):
            if content or heading is not None:
                raw.append((heading, content))
            heading, content = plain(shown), []
        else:
            content.append(plain(shown) if kind == "heading" and level == 1 else source)
    if content or heading is not None:
        raw.append((heading, content))
    if not raw:
        return [{"heading": None, "content": "", "section_order": 0, "token_count": 0}]
    sized: list[list] = []
    for heading, content in raw:
        text = "\n\n".join(content)
        tokens = estimate_tokens_py(text)
        sized += [[heading, t, n] for t, n in (split_paragraphs(text, max_tokens) if tokens > max_tokens else [(text, tokens)])]
    merged = merge_tiny(sized, min_tokens)
    return [{"heading": h, "content": t, "section_order": i, "token_count": estimate_tokens_py(t)} for i, (h, t, _) in enumerate(merged)]


def split_paragraphs(text: str, max_tokens: int = MAX_TOKENS) -> list[tuple[str, int]]:
    """Paragraphs packed in order up to the limit; a larger one stands alone."""
    packs: list[tuple[list[str], int]] = []
    for paragraph in re.split(r"\n\n+", text):
        tokens = estimate_tokens_py(paragraph)
        if packs and packs[-1][1] + tokens <= max_tokens:
            packs[-1] = ([*packs[-1][0], paragraph], packs[-1][1] + tokens)
        else:
            packs.append(([paragraph], tokens))
    return [("\n\n".join(p), n) for p, n in packs]


def merge_tiny(sections: list[list], min_tokens: int = MIN_TOKENS) -> list[list]:
    """Sections under the limit join the one before and lose their heading; the first stays."""
    out: list[list] = []
    for heading, text, tokens in sections:
        if out and tokens < min_tokens:
            out[-1] = [out[-1][0], f"{out[-1][1]}\n\n{text}", out[-1][2] + tokens]
        else:
            out.append([heading, text, tokens])
    return out


def masked(text: str) -> str:
    """The text with code and escaped brackets blanked out, same length."""
    out, at = [], 0
    for kind, _, _, source in blocks(text):
        start = text.find(source, at)
        if start < 0:
            continue
        out.append(re.sub(r"[^\n]", " ", text[at:start]) if text[at:start].strip() else text[at:start])
        part = re.sub(r"[^\n]", " ", source) if kind == "code" else _CODE_SPAN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
        out.append(part)
        at = start + len(source)
    out.append(text[at:])
    return re.sub(r"\\[\[\]]", "  ", "".join(out))


def wikilinks(text: str, shown: str | None = None) -> tuple[list[dict], list[str]]:
    """Double-bracket links outside code; an unknown type is a reference and a warning."""
    links, warnings = [], []
    for m in _WIKILINK.finditer(masked(text) if shown is None else shown):
        target, label = m["target"].strip(), (m["label"] or "").strip()
        if not target:
            continue
        if label and label not in LINK_TYPES:
            warnings.append(f"link type {label!r} of [[{target}]] is unknown; references is taken")
        links.append({"target": target, "type": label if label in LINK_TYPES else "references", "context": text[max(0, m.start() - AROUND) : m.end() + AROUND], "find": f"[[{target}"})
    return links, warnings


def mdlinks(text: str, filepath: str = "", shown: str | None = None) -> list[dict]:
    """Inline links to ``.md`` files inside the project, resolved from the file's folder."""
    links = []
    for m in _MDLINK.finditer(masked(text) if shown is None else shown):
        url = m[2][1:-1] if m[2].startswith("<") else m[2]
        if _EXTERNAL.match(url):
            continue
        bare = url.split("#")[0].split("?")[0]
        try:
            bare = unquote(bare, errors="strict")
        except UnicodeDecodeError:
            pass
        if not bare.endswith(".md"):
            continue
        target = posixpath.normpath(posixpath.join(posixpath.dirname(filepath), bare.lstrip("/") if bare.startswith("/") else bare))
        if target.startswith(".."):
            continue
        start = m.start()
        links.append({"target": target[: -len(".md")], "type": "references", "context": text[max(0, start - AROUND) : start + len(m[1]) + len(url) + 4 + AROUND], "find": f"]({url})"})
    return links


def _place(links: list[dict], sections: list[dict], full: str) -> list[dict]:
    """Links with the order of the section that holds the first place of their text, and their position."""
    spans, at = [], 0
    for s in sections:
        start = full.find(s["content"][:40], at)
        if start >= 0:
            at = start + len(s["content"])
            spans.append((start, at, s["section_order"]))
    out = []
    for i, link in enumerate(links):
        where = full.find(link["find"])
        order = next((o for a, b, o in spans if a <= where < b), 0) if where >= 0 else 0
        out.append({k: link[k] for k in ("target", "type", "context")} | {"section_order": order, "position": i})
    return out


def _link_key(target: str) -> str:
    import unicodedata

    return re.sub(r"\.md$", "", unicodedata.normalize("NFC", target).lower())


def parse(text: str, filepath: str) -> Parsed:
    """Everything one file holds.  A Markdown link to the target of a double-bracket link is left out."""
    front, body = split_frontmatter(text)
    data, warnings = parse_frontmatter(front, filepath)
    sections = split_sections(body)
    shown = " " * (len(text) - len(body)) + masked(body)
    wiki, more = wikilinks(text, shown)
    known = {_link_key(link["target"]) for link in wiki}
    inline = [link for link in mdlinks(text, filepath, shown) if _link_key(link["target"]) not in known]
    title = data.get("title") or re.sub(r"\.md$", "", filepath)
    return Parsed(title, data.get("doc_type"), data.get("source_refs"), sections, _place([*wiki, *inline], sections, text), warnings + more)


def parse_files(files: DataFrame) -> DataFrame:
    """(filepath, content) parsed, one nested row each; a file that fails has its error and no parts.

    A null content counts as empty.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["filepath"], batch["content"], strict=True):
                try:
                    p = parse(text or "", path)
                    rows.append((path, p.title, p.doc_type, p.source_refs, p.sections, p.links, p.warnings, None))
                except Exception as e:  # noqa: BLE001  one unreadable file must not stop the others
                    rows.append((path, None, None, None, [], [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filepath", "title", "doc_type", "source_refs", "sections", "links", "warnings", "error"])

    return files.select("filepath", "content").mapInPandas(work, PARSED)


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = ("**/node_modules/**", "**/.git/**")) -> DataFrame:
    """(filepath, content) of the Markdown files below ``root``, paths relative to it.

    A missing root gives no rows.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "filepath string, content string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/") + "/"
    path = F.substr(F.col("path"), F.instr(F.col("path"), base) + len(base))
    files = found.select(path.alias("filepath"), F.col("content").cast("string").alias("content"))
    hidden = F.col("filepath").rlike(r"(^|/)(node_modules|\.git)/")
    return files.filter(~hidden & matches_globs(F.col("filepath"), include, exclude))


def tables(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, sections, unresolved links and source references of parsed files.

    Ids are made from paths, so they survive changes of the text.
    """
    from quillgraph.schema import stored_doc_type

    ok = parsed.filter(F.col("error").isNull()).join(files.select("filepath", F.sha2(F.col("content").cast("binary"), 256).alias("body_hash")), "filepath").withColumn("id", document_id(F.col("filepath")))
    kind = F.when(F.col("doc_type").isNull(), F.lit("guide")).otherwise(stored_doc_type(F.col("doc_type")))
    documents = ok.select("id", "filepath", "title", kind.alias("doc_type"), "body_hash", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    s = ok.select(F.col("id").alias("doc_id"), F.explode("sections").alias("s")).select("doc_id", "s.*")
    sections = s.select(
        F.abs(F.xxhash64("doc_id", "section_order")).alias("section_id"), "doc_id", "heading", "section_order", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"), "token_count", F.current_timestamp().alias("updated_at"),
    )
    links = ok.select(F.col("id").alias("source_doc_id"), F.col("filepath").alias("source_path"), F.explode("links").alias("l")).select("source_doc_id", "source_path", "l.*")
    refs = ok.select(F.col("id").alias("doc_id"), F.explode("source_refs").alias("file_path")).distinct()
    return documents, sections, links, refs


def document_id(filepath):
    return F.substring(F.sha2(filepath.cast("binary"), 256), 1, 32)
