import math

import pytest
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.errors import DimensionMismatchError
from quillgraph.functions import text
from quillgraph.operators import fulltext, hybrid, vector

SECTIONS = "section_id long, doc_id string, section_order int, heading string, content string"


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.createDataFrame([("doc-1", "Design", "design", "d.md"), ("doc-2", "API", "api", "a.md")], "id string, title string, doc_type string, filepath string")
    rows = [(1, "doc-1", 0, "Overview", "The system uses microservices."), (2, "doc-1", 1, "Database Design", "SQLite in WAL mode."), (3, "doc-2", 0, None, "REST API endpoints for the system")]
    return docs, spark.createDataFrame(rows, SECTIONS)


def test_matches(texts):
    docs, sections = texts
    found = lambda q, **k: [r.section_id for r in fulltext.search(sections, docs, q, **k).collect()]
    assert found("microservices") == [1]
    assert found("database") == [2]
    assert found("REST API") == [3]
    assert sorted(found("SYSTEM")) == [1, 3]
    assert found("") == found("  ") == found("absent") == found("ab") == []
    assert found("ab system", doc_type="api") == [3]
    assert found('"quoted" OR') == []
    assert "<mark>microservices</mark>" in fulltext.search(sections, docs, "microservices").first().snippet


def test_rank_is_bm25(texts):
    docs, sections = texts
    got = {r.section_id: r.rank for r in fulltext.ranked(sections, "system").collect()}
    rows = {r.section_id: (r.heading or "", r.content) for r in sections.collect()}
    size = {i: sum(max(len(x) - 2, 0) for x in t) for i, t in rows.items()}
    mean = sum(size.values()) / 3
    idf = math.log((3 - 2 + 0.5) / 2.5)
    idf = idf if idf > 0 else 1e-6
    for i, r in got.items():
        assert r == pytest.approx(-idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size[i] / mean)))


def test_small_rules(spark):
    assert fulltext.quoted('a "b" OR') == '"a" """b""" "OR"' and text.pooling("BAAI/bge-m3") == "cls" and text.pooling("e5-large") == "mean"
    kinds = spark.createDataFrame([("api",), ("odd",), (None,)], "doc_type string")
    assert sorted(str(r.doc_type) for r in schema.violations(kinds, "doc_type", schema.STORED_DOC_TYPES).collect()) == ["None", "odd"]


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([("aaaa xx",)], "t string").select(fulltext.occurrences(F.col("t"), "aaa").alias("n"))
    assert df.first().n == 2


def corpus(spark, vectors, links, content="content here"):
    ids = sorted({v[0] for v in vectors})
    docs = spark.createDataFrame([(i, f"t {i}", "guide", f"{i}.md") for i in ids], "id string, title string, doc_type string, filepath string")
    sections = spark.createDataFrame([(n, v[0], 0, None, f"{content} {v[0]}") for n, v in enumerate(vectors)], SECTIONS)
    vecs = spark.createDataFrame([(n, v[0], [float(x) for x in v[1]]) for n, v in enumerate(vectors)], "section_id long, doc_id string, embedding array<double>")
    return hybrid.Corpus(docs, sections, spark.createDataFrame(links, "source_doc_id string, target_doc_id string, type string"), vecs)


def test_hybrid_order_and_parts(spark):
    c = corpus(spark, [("A", (1, 0)), ("B", (0.9, 0.1)), ("C", (0.1, 0.9))], [("A", "B", "references")])
    rows = hybrid.search(c, "zzz", [1.0, 0.0], 3).collect()
    assert rows[0].doc_id == "A" and rows[0].search_type == "hybrid"
    assert rows[0].score == pytest.approx(0.7 * 1.0 + 0.3 * rows[0].score_breakdown.graph)
    assert rows[0].sections[0].content == "content here A"


def test_text_weight_only_with_hits(spark):
    c = corpus(spark, [("A", (1, 0)), ("B", (0, 1))], [("A", "B", "references")])
    got = {r.doc_id: r for r in hybrid.scores(c, "content", [1.0, 0.0], 2).collect()}
    assert got["A"].score == pytest.approx(0.7 + 0.21 * 1 + 0.09 * got["A"].fts)
    assert got["B"].prox > 0


def test_limit_and_fallback(spark):
    c = corpus(spark, [(x, (1, 0)) for x in "ABCDE"], [("A", "B", "references")])
    assert hybrid.search(c, "content", [1.0, 0.0], 2).count() == 2
    assert {r.search_type for r in hybrid.search(c, "content", None, 2).collect()} == {"fulltext_fallback"}


def test_several_hits_of_a_document_are_blended(spark):
    hits = spark.createDataFrame([("A", 0.9), ("A", 0.5), ("A", 0.1), ("A", 0.0), ("B", -0.3)], "doc_id string, similarity double")
    got = {r.doc_id: r.vec for r in hybrid.vector_scores(hits).collect()}
    assert got["A"] == pytest.approx(0.8 * 0.9 + 0.2 * 0.5) and got["B"] == 0


def test_vectors(spark):
    def unit(seed):
        v = [math.sin(seed * (i + 1)) for i in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    df = spark.createDataFrame([(i, f"d{i}", unit(i + 1)) for i in range(5)] + [(9, "d9", [1.0]), (10, "d10", None)], "section_id long, doc_id string, embedding array<double>")
    rows = vector.topk(df, unit(1), 3, 8).collect()
    assert rows[0].section_id == 0 and rows[0].similarity == pytest.approx(1)
    assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)
    with pytest.raises(DimensionMismatchError):
        vector.topk(df, [1.0], 3, 8)
    assert [r.section_id for r in vector.wrong_dimension(df, 8).collect()] == [9]
