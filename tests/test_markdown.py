import unicodedata

from quillgraph.functions.text import estimate_tokens_py
from quillgraph.operators import links
from quillgraph.sources import markdown as md

LONG = "Rivers that rise in the hills cross nine villages, two old mills and a railway bridge before they reach the flat land near the sea where herons stand in the reeds."


def test_token_estimate():
    assert estimate_tokens_py("Hello world this is a test") == 8
    assert estimate_tokens_py("これはテストです") == 12
    assert estimate_tokens_py("Hello 世界") == 5


def test_sections():
    text = f"{LONG}\n\n## One\n\n{LONG}\n\n### Two\n\n{LONG}\n\n#### Deep\n\nmore"
    got = md.split_sections(text)
    assert [s["heading"] for s in got] == [None, "One", "Two"] and "Deep" in got[2]["content"]
    assert [s["section_order"] for s in got] == [0, 1, 2]
    assert md.split_sections("")[0] == {"heading": None, "content": "", "section_order": 0, "token_count": 0}
    assert "Title" in md.split_sections("# Title\n\nIntro\n\n## A\n\nB")[0]["content"]
    big = "\n\n".join([LONG] * 12)
    parts = md.split_sections(f"## Big\n\n{big}")
    assert len(parts) > 1 and {p["heading"] for p in parts} == {"Big"}
    assert len(md.split_sections(f"## A\n\n{LONG}\n\n## Tiny\n\nOk")) == 1
    assert [s["heading"] for s in md.split_sections(f"```\n## no\n```\n\n{LONG}\n\nYes\n---\n\n{LONG}")] == [None, "Yes"]


def test_frontmatter():
    assert md.parse_frontmatter("title: T\ndoc_type: api\nsource_refs: [a.ts, ../b]\n") [0] == {"title": "T", "doc_type": "api", "source_refs": ["a.ts"]}
    assert md.parse_frontmatter("") == ({}, [])
    data, warnings = md.parse_frontmatter("doc_type: nope\nsource_refs: x")
    assert data == {"doc_type": "spec"} and len(warnings) == 2
    for bad in ("just a string", "a: [", "42"):
        data, warnings = md.parse_frontmatter(bad)
        assert data == {} and len(warnings) == 1


def test_wikilinks():
    found, warnings = md.wikilinks("[[A]] [[B|depends_on]] [[C|odd]] `[[D]]` [[ ]] [[日本 語]]\n\n```\n[[E]]\n```\n\n    [[F]]\n")
    assert [(x["target"], x["type"]) for x in found] == [("A", "references"), ("B", "depends_on"), ("C", "references"), ("日本 語", "references")]
    assert len(warnings) == 1
    assert found[0]["context"].startswith("[[A]]")


def test_markdown_links():
    text = "[a](x.md) [b](../up.md#h) [c](https://e.org/z.md) [d](mailto:a@b.md) [e](#x.md) [f](t.txt) [g](my%20file.md?q=1) `[h](code.md)` ![i](pic.md) [j](../../../out.md)"
    assert [x["target"] for x in md.mdlinks(text, "docs/sub/p.md")] == ["docs/sub/x", "docs/up", "docs/sub/my file"]


def test_wikilink_wins_over_markdown_link():
    p = md.parse("[[b]] and [x](b.md)", "a.md")
    assert [(x["target"], x["position"]) for x in p.links] == [("b", 0)]
    assert p.title == "a" and md.parse("# H\n", "dir/page.md").title == "dir/page"


def test_parse_files_keeps_bad_rows(spark):
    df = spark.createDataFrame([("a.md", "## X\n\n[[b]]"), ("b.md", None)], "filepath string, content string")
    rows = {r.filepath: r for r in md.parse_files(df).collect()}
    assert rows["a.md"].links[0].target == "b" and rows["b.md"].sections[0].content == "" and rows["a.md"].error is None


def test_resolution(spark):
    nfd = unicodedata.normalize("NFD", "ガイド")
    docs = spark.createDataFrame([("1", "a/x.md"), ("2", "a/b/x.md"), ("3", "c/y.md"), ("4", f"d/{nfd}.md"), ("5", "b/x.md")], "id string, filepath string")
    asked = spark.createDataFrame([(1, "X", "a/b/p.md"), (2, "x", "z/p.md"), (3, "b/x", "z/p.md"), (4, "ガイド", "p.md"), (5, "none", "p.md"), (6, "Y.md", "p.md")], "link_id long, target string, source_path string")
    got = {r.link_id: (r.target_doc_id, r.status, r.ambiguous) for r in links.resolve(asked, docs).collect()}
    assert got[1] == ("2", "resolved", True)
    assert got[2] == ("1", "resolved", True)
    assert got[3] == ("2", "resolved", False)
    assert got[4][0] == "4" and got[5] == (None, "dangling", False) and got[6] == ("3", "resolved", False)
