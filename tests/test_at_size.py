"""What keeps work and moved rows in proportion to larger tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.operators import fulltext, suggest, vector


def test_vectors_are_sent_to_few_blocks(spark):
    df = spark.range(100_000).select(F.col("id").alias("section_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert vector._cells(df, vector.BLOCK).count() <= 16 * 100_000


def test_cell_settles_what_single_precision_cannot():
    """Copies, copies but for the ninth digit, zeros, and rows far larger than others, above the columns from which groups are used."""
    rng = np.random.default_rng(2)
    n, dims, k = 2300, 8, 3
    x = rng.normal(size=(n, dims))
    x[100:400] = x[0]
    x[400:600] = x[1] * (1 + 1e-9 * np.arange(200))[:, None]
    x[600:700] = 0
    x[700:710] *= 1e6
    ids = rng.permutation(n)
    asks = np.repeat([True, False], n)
    flat = np.vstack([x, x])
    cell = pa.table({"section_id": np.r_[ids, ids], "embedding": pa.array(list(flat)), "as_query": asks})
    got = vector._cell_topk(k)(cell).to_pandas().groupby("query_id")["section_id"].agg(list)
    sims = np.zeros((n, n))
    for d in range(dims):
        sims += np.outer(x[:, d], x[:, d])
    best = np.lexsort((np.broadcast_to(ids, sims.shape), -np.round(sims, 12)), axis=1)[:, :k]
    assert len(got) == n
    assert all(got[ids[r]] == list(ids[best[r]]) for r in range(n))


SECTIONS = [(1, None, "Ab\n\U0001f600cab"), (2, "Head", "ead"), (3, "ab", "c"), (4, None, None), (5, "", "aaaa" * 50), (-6, None, "\u0130x\u00c4\u00df"), (7, "q", "")]


def test_trigrams_are_found_once_for_each_section(spark, monkeypatch):
    df = spark.createDataFrame(SECTIONS, "section_id long, heading string, content string").coalesce(1)
    low = {r[0]: (r[1] or "", r[2] or "") for r in df.select("section_id", F.lower("heading"), F.lower("content")).collect()}
    right = sorted((t[k : k + 3], i) for i, both in low.items() for t in both for k in range(len(t) - 2))
    assert sorted(map(tuple, fulltext.trigram_index(df).collect())) == sorted(set(right))
    for chars in (1, 7):
        monkeypatch.setattr(fulltext, "CHARS", chars)
        batch = pa.record_batch([[*low], [h for h, _ in low.values()], [c for _, c in low.values()]], names=["a", "b", "c"])
        out = [(r["gram"], i) for x in fulltext._indexed(iter([batch])) for r in x.to_pylist() for i in r["section_ids"]]
        assert sorted(out) == sorted(set(right))


def test_search_opens_only_the_lists_it_asks_for(spark, capsys):
    df = spark.createDataFrame(SECTIONS, "section_id long, heading string, content string")
    fulltext.indexed_matches(fulltext.trigram_index(df), df, "ead").explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate explode") < plan.index("(gram#") and "= ead" in plan[plan.index("Generate explode") :]


def test_suggestions_move_few_rows_for_each_vector(spark):
    n = 40_000
    i = F.col("id")
    rows = spark.range(n)
    vectors = rows.select(i.alias("section_id"), i.alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.sin(i * d * d * 0.37)).alias("embedding"))
    sections = rows.select(i.alias("section_id"), F.lit(0).alias("section_order"), F.lit("h").alias("heading"), F.lit("c").alias("content"))
    links = rows.limit(0).select(i.alias("source_doc_id"), i.alias("target_doc_id"))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: (lambda s: [s.apply(k) for k in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    suggest.suggest_links(rows.select("id", i.cast("string").alias("title")), sections, vectors, links, 0.5, 5).collect()
    # Cells, k rows of each section and block, and joins of k rows of each section.
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) < (16 + 80 + 60) * n


def test_blocks_do_not_multiply_with_vectors(spark):
    for n in (20_000, 600_000):
        df = spark.range(n).select(F.col("id").alias("section_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
        assert vector._cells(df, vector.BLOCK).count() == vector.SPREAD * n


def test_findings_move_to_their_target_and_their_pair_only(spark):
    n = 20_000
    i = F.col("id")
    rows = spark.range(n)
    vectors = rows.select(i.alias("section_id"), i.alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.sin(i * d * d * 0.37)).alias("embedding"))
    sections = rows.select(i.alias("section_id"), F.lit(0).alias("section_order"), F.lit("h").alias("heading"), F.lit("c").alias("content"))
    links = rows.limit(0).select(i.alias("source_doc_id"), i.alias("target_doc_id"))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: (lambda s: [s.apply(k) for k in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    suggest.suggest_links(rows.select("id", i.cast("string").alias("title")), sections, vectors, links, 0.5, 5).collect()
    # Cells and lists of 8 blocks, twice ten findings, and a few rows for what each section shows.
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) < (8 + 8 + 20 + 8) * n


def test_pairs_of_blocks_give_both_ways_whole(spark):
    """Copies, a vector that is not a number, zeros and blocks of unlike size; a least similarity takes nothing from above it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x[10:30] = x[0]
    x[40] = np.nan
    x[50:53] = 0
    ids = rng.permutation(90) * 7
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "section_id long, embedding array<double>")
    sims = np.zeros((90, 90))
    for d in range(4):
        sims += np.outer(x[:, d], x[:, d])
    key = np.where(np.isnan(sims), np.inf, np.round(sims, 12))
    best = np.lexsort((np.broadcast_to(ids, key.shape), -key), axis=1)[:, :4]
    for block, least in ((90, -np.inf), (7, -np.inf), (7, 1.5), (90, 1.5)):
        got = {(r.query_id, r["rank"]): r.section_id for r in vector.neighbours(df, 4, block, least).collect()}
        assert got == {(int(ids[r]), k + 1): int(ids[c]) for r in range(90) for k, c in enumerate(best[r]) if key[r, c] >= least}
