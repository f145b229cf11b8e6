"""Line deduplication with a log-template tree of fixed depth.

Method: every line walks down a tree as in log parsing.  The first level is its
number of tokens, where a token with a digit counts as a variable field; under it
templates leave further fields open.  Lines of ``MIN_TOKENS`` to ``MIN_OPEN`` - 1
tokens have a template for each choice of up to two open tokens, the leading ones
too.  Longer lines are cut into their ``LEADING`` tokens and ``SEGMENTS`` further
stretches, with a template for each choice of two open stretches.  Of what stays,
``MIN_CONSTANT`` tokens must hold a letter and no digit, and one more where two
are open; longer lines with fewer have one open stretch behind the leading tokens.

Leaves only spare work: a leaf is the number of tokens and a part of the line that
a template leaves whole, so lines that share a template share its leaf.

A template that occurs in at least ``MIN_DOCS`` documents recurs: its lines are
dropped from all documents but the one with the smallest id.  Templates are keys
of ordinary aggregations, so the result depends neither on order nor on how many
lines a leaf holds.  Lines of fewer than ``MIN_TOKENS`` tokens, and so all lines
without blanks, are templates without fields: they recur as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import attach, column, map_batches, materialize, record, with_text

LEADING = 3
SEGMENTS = 4
MIN_TOKENS = 3
MIN_CONSTANT = 2
MIN_OPEN = 12
MIN_DOCS = 5
_DIGIT = re.compile(rb"[0-9]").search
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search
_FIELD = b"<*>"
_MASK = (1 << 64) - 1
_FIELDS = [xxhash.xxh64_intdigest(_FIELD, k) for k in range(MIN_OPEN)]
# Any three of five stretches hold one of these pairs, so four leaves serve all choices of two open stretches.
_OPEN: dict[tuple[int, int], list[tuple[int, int]]] = {(0, 1): [], (2, 3): [], (2, 4): [], (3, 4): []}
for _i, _j in itertools.combinations(range(SEGMENTS + 1), 2):
    _OPEN[next(p for p in _OPEN if not {_i, _j} & set(p))].append((_i, _j))
_CHOICES = sum(map(len, _OPEN.values()))


def _hash(*parts: bytes) -> int:
    value = xxhash.xxh64_intdigest(b"\0".join(parts))
    return value - (1 << 64) if value >> 63 else value


def template_keys(line: bytes) -> tuple[int, list[int]] | None:
    """Leaf key and template keys of a line, or nothing if it has too few tokens."""
    tokens = line.split()
    n = len(tokens)
    if n < MIN_TOKENS:
        return None
    if _DIGIT(line):
        # A line that is nearly all fields, such as a row of numbers, says too little without them.
        shown = [_FIELD if _DIGIT(t) else t for t in tokens]
        if n - shown.count(_FIELD) >= MIN_CONSTANT:
            tokens = shown
    head = b"%d %s" % (n, b" ".join(tokens[:LEADING]))
    keys = [_hash(head, b" ".join(tokens[LEADING:]))]
    if n >= MIN_OPEN:
        cuts = [LEADING + (n - LEADING) * k // SEGMENTS for k in range(SEGMENTS + 1)]
        parts = [b" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        keys += [_hash(head, b"%d" % k, *parts[:k], *parts[k + 1 :]) for k in range(SEGMENTS)]
    return _hash(head), keys


def line_keys(line: bytes) -> list[tuple[int, list[int]]]:
    """Leaves of a line with the template keys under each; nothing for a line without a token."""
    tokens = line.split()
    n = len(tokens)
    if not n:
        return []
    if n < MIN_TOKENS:
        whole = _hash(b"%d" % n, b" ".join(tokens))
        return [(whole, [whole])]
    words = tokens
    if _DIGIT(line):
        shown = [_FIELD if _DIGIT(t) else t for t in tokens]
        if n - shown.count(_FIELD) >= MIN_CONSTANT:
            tokens = shown
    return _open_tokens(words, tokens) if n < MIN_OPEN else _open_stretches(line, words, tokens)


def _solid(words: list[bytes]) -> list[bool]:
    return [bool(_LETTER(t)) and not _DIGIT(t) for t in words]


def _signed(total: int) -> int:
    total &= _MASK
    return total - (1 << 64) if total >> 63 else total


@functools.lru_cache(4096)
def _tag(*numbers: int) -> int:
    return xxhash.xxh64_intdigest(b"%d " * len(numbers) % numbers)


def _open_tokens(words: list[bytes], tokens: list[bytes]) -> list[tuple[int, list[int]]]:
    """Keys with up to two open tokens, each under its first third without a field."""
    n, solid = len(tokens), _solid(words)
    # A key is a sum of one hash for each place, so opening a token adds a difference.
    own = [xxhash.xxh64_intdigest(t, i) for i, t in enumerate(tokens)]
    whole = _tag(n) + sum(own)
    cuts = [n * k // 3 for k in range(4)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    thirds = [None if _FIELD in tokens[a:b] else _signed(_tag(n, k) + sum(own[a:b])) for k, (a, b) in enumerate(spans)]
    bit = [1 << k for k, (a, b) in enumerate(spans) for _ in range(a, b)]
    leaf = [next((v for k, v in enumerate(thirds) if v is not None and not hit >> k & 1), None) for hit in range(8)]
    free = [(i, _FIELDS[i] - own[i], bit[i]) for i in range(n) if tokens[i] != _FIELD]
    found, total = [(whole, 0)], sum(solid)
    for at, (i, more, hit) in enumerate(free, 1):
        left = total - solid[i]
        if left >= MIN_CONSTANT:
            found.append((whole + more, hit))
        if left > MIN_CONSTANT:
            found += [(whole + more + again, hit | too) for j, again, too in free[at:] if left - solid[j] > MIN_CONSTANT]
    under: dict[int, list[int]] = {}
    for key, hit in found:
        key = _signed(key)
        under.setdefault(key if leaf[hit] is None else leaf[hit], []).append(key)
    return list(under.items())


def _open_stretches(line: bytes, words: list[bytes], tokens: list[bytes]) -> list[tuple[int, list[int]]]:
    """Keys with two open stretches, each under a pair of stretches that stay."""
    n = len(tokens)
    cuts = [0, *(LEADING + (n - LEADING) * k // SEGMENTS for k in range(SEGMENTS + 1))]
    spans = list(zip(cuts, cuts[1:], strict=False))
    parts = [xxhash.xxh64_intdigest(b" ".join(tokens[a:b]), k) for k, (a, b) in enumerate(spans)]
    whole, opening = _tag(n) + sum(parts), [f - p for f, p in zip(_FIELDS, parts, strict=False)]
    # Words of plain letters are counted first, which is quick and nearly always enough.
    for solid in (lambda: [t.isalpha() for t in words], lambda: _solid(words)):
        flags = solid()
        held = [sum(flags[a:b]) for a, b in spans]
        total = sum(held)
        under = {pair: [_signed(whole + opening[i] + opening[j]) for i, j in choices if total - held[i] - held[j] > MIN_CONSTANT] for pair, choices in _OPEN.items()}
        missing = _CHOICES - sum(map(len, under.values()))
        if not missing:
            break
    out = [(_signed(_tag(n, *pair) + parts[pair[0]] + parts[pair[1]]), keys) for pair, keys in under.items() if keys]
    # Whether a pair may be open hangs on what stays alone; if all may, they cover the templates of one open stretch.
    return [*out, template_keys(line)] if missing else out


def _lines(own: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, numbers, leaves, keys = [], [], [], []
            for i, text in enumerate(column(batch, "text")):
                for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n") if text else ()):
                    for leaf, under in line_keys(line):
                        rows.append(i)
                        numbers.append(k)
                        leaves.append(leaf)
                        keys.append(under)
            if not rows:
                return None
            take = pa.array(np.array(rows))
            return record(id=batch.column(0).take(take), text_key=batch.column(1).take(take), line=pa.array(numbers, pa.int32()), leaf=pa.array(leaves, pa.int64()), keys=pa.array(keys, pa.list_(pa.int64())))

        return work

    kind = own.schema["id"].dataType.simpleString()
    return map_batches(own, make, f"id {kind}, text_key long, line int, leaf long, keys array<long>")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_key, lines): numbers of the lines to drop, counted from 0."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    lines = materialize(_lines(own.filter(F.col("id").isNotNull())), "op8-lines")
    # A template needs min_docs documents, so its leaf needs as many lines; most leaves end here.
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    # Joins are between tables as they were written, so that a hot leaf or template can be split; sorted
    # ones at every size, as the leaves of a small table would be broadcast and those of a large one not.
    parsed = materialize(lines.join(materialize(leaves, "op8-leaves").hint("merge"), "leaf").select("id", "text_key", "line", F.explode("keys").alias("key")), "op8-keys")
    recurring = parsed.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs).select("key", "first")
    gone = parsed.join(materialize(recurring, "op8-recurring").hint("merge"), "key").filter(F.col("id") != F.col("first"))
    return gone.groupBy("id", "text_key").agg(F.collect_set("line").alias("lines"))


def _kept(text: str, lines: list[int]) -> tuple[str, int]:
    gone = set(lines)
    parts = text.split("\n")
    return "\n".join(p for i, p in enumerate(parts) if i not in gone), len(parts)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of what stays, UTF-8) for every row.

    A null text has no lines, an empty one has one.  Rows with a null id neither
    count nor lose lines; repeated rows of one id count as one document.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = attach(own, recurring_lines(own, "doc_id", "text", min_docs), "doc_id", "text", ["lines"])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, lines in zip(column(batch, "text"), column(batch, "__qg_lines"), strict=True):
                kept, n = (None, 0) if text is None else _kept(text, lines or [])
                rows.append((n, len(lines or []), hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows, strict=True))
            return record(doc_id=batch.column(0), n_lines=pa.array(cols[0], pa.int64()), n_dropped=pa.array(cols[1], pa.int64()), kept_sha256=pa.array(cols[2], pa.string()))

        return work

    kind = own.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, make, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of the documents, with recurring lines cut out of the texts.

    A document goes if it had words and every line with a word was dropped.
    """
    joined = attach(docs, recurring_lines(docs, id_col, text_col, min_docs), id_col, text_col, ["lines"])
    count = length_col if length_col in docs.columns else None

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, dropped = column(batch, text_col), column(batch, "__qg_lines")
            new = [t if t is None or not g else _kept(t, g)[0] for t, g in zip(texts, dropped, strict=True)]
            keep = [not g or bool((t or "").split()) for t, g in zip(new, dropped, strict=True)]
            batch = batch.drop_columns(["__qg_lines"])
            if any(dropped):
                batch = with_text(batch, text_col, new, count)
            return batch.filter(pa.array(keep, pa.bool_()))

        return work

    return map_batches(joined, make, docs.schema)
