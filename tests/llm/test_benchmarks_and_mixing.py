import hashlib
import itertools
import random

import numpy as np
import pytest
from llm_helpers import make_docs
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import decontaminate, mixing

ITEMS = "item_id long, text string"


def brute_hits(items, text, window=13):
    w, hit, names = decontaminate.normal_words(text), set(), set()
    for i, t in items:
        own = decontaminate.normal_words(t)
        n = min(window, len(own))
        for g in {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == g:
                    hit.update(range(k, k + n))
                    names |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_automaton_finds_all_windows():
    rng = random.Random(5)
    for n in range(200):
        window, letters = rng.choice((3, 4, 5)), "abc" if n % 2 else "abcdefg"
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(12)))) for i in range(rng.randrange(8))]
        text = " ".join(rng.choice(letters + "z") for _ in range(rng.randrange(60)))
        spans, found = decontaminate.ItemAutomaton(items, window).compact().scan(decontaminate.normal_words(text))
        _, hit, names, *_ = brute_hits(items, text, window)
        assert sum(b - a for a, b in spans) == hit and len(found) == names


def cases(spark):
    rng = random.Random(7)
    item = " ".join(f"q{rng.randrange(500)}" for _ in range(40))
    items = [(1, item), (10, "Short item, only"), (2, None), (None, "nameless one two three four five six seven eight nine ten eleven twelve thirteen"), (1, item), (3, "...")]
    filler = lambda n: " ".join(f"f{rng.randrange(9999)}" for _ in range(n))
    rows = [
        (1, f"{filler(30)} {item.upper().replace(' ', ', ')} {filler(30)}", "en", "a"), (2, f"{filler(900)} {' '.join(item.split()[5:25])} {filler(400)}", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (5, f"{filler(100)} short ITEM... only! {filler(5)}", "en", "b"), (6, filler(300), "de", None), (6, filler(300), "de", None), (None, item, "en", "a"), (7, " ".join(item.split()[:12]), "en", "a"), (8, "Ünïcode_words ñ1 " + items[3][1], "en", "a"),
    ]
    return rows, items


def test_contamination(spark, none, monkeypatch):
    rows, items = cases(spark)
    docs, bench = make_docs(spark, rows), spark.createDataFrame(items, ITEMS)
    want = sorted((str(i), *brute_hits(items, t)) for i, t, *_ in rows)
    read = lambda b: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.hits(docs, b).collect())
    assert read(bench) == want
    monkeypatch.setattr(decontaminate.shards, "__defaults__", ("item_id", "text", 100))
    assert read(bench) == want
    # Several passes, whose hits meet by the text.
    monkeypatch.setattr(decontaminate, "SHARDS_PER_PASS", 1)
    assert read(bench) == want
    assert all(not r[5] for r in read(bench.filter("false"))) and decontaminate.hits(none, bench).count() == 0


def test_cleaning(spark):
    rows, items = cases(spark)
    docs, bench = make_docs(spark, rows), spark.createDataFrame(items, ITEMS)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
    assert sorted(str(i) for i, *_ in got) == ["2", "3", "4", "5", "6", "6", "7"]
    texts = {i: t for i, t, _ in got}
    assert brute_hits(items, texts[2])[1] == 0 and brute_hits(items, texts[5])[1] == 0 and len(texts[2].split()) == 1300
    assert all(t is None or n == len(t) for _, t, n in got)


@pytest.mark.parametrize("together", [1, 8])
def test_nested_hits_of_several_shards(spark, monkeypatch, together):
    monkeypatch.setattr(decontaminate, "SHARDS_PER_PASS", together)
    rng = random.Random(8)
    long = [f"q{k}" for k in range(30)]
    items = [(1, " ".join(long)), *((k, f"a{k} {' '.join(long[k : k + 13])} b{k}") for k in range(2, 9))]
    text = lambda n: " ".join([*(f"f{rng.randrange(9999)}" for _ in range(n)), *long, "end"])
    rows = [(1, text(569), "en", "a"), (2, text(570), "en", "a"), (3, text(40), "en", "a")]
    docs, bench = make_docs(spark, rows), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(decontaminate.shards, "__defaults__", ("item_id", "text", 60))
    assert sum(bool(s) for s in decontaminate.shards(bench)) > 3
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.hits(docs, bench).collect())
    assert got == sorted((str(i), *brute_hits(items, t)) for i, t, *_ in rows) and [r[2] for r in got] == [30, 30, 30]
    kept = {r.doc_id: r.text.split() for r in decontaminate.clean(docs, bench).collect()}
    assert set(kept) == {2} and kept[2] == [*rows[1][1].split()[:570], "end"]


def brute_targets(size, weights, cap=3):
    """The level is raised until all sizes are given out."""
    top, total = [cap * x for x in size], sum(size)
    low, high = 0.0, 10.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, mid * w) for t, w in zip(top, weights)) < total else (low, mid)
    return [min(t, high * w) for t, w in zip(top, weights)]


def test_targets(spark):
    rng = random.Random(4)
    for size in ([100, 100, 1000], [10, 10], [0, 10], [7], [0], [rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(100)]):
        names = sorted({f"s{rng.randrange(10**9)}é" for _ in size} | {f"z{k}" for k in range(len(size))})[: len(size) - 1]
        rows = list(zip([*names, None], size))
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "source string, source_size long")
        got = {r.source: (r.place, r.target) for r in mixing.with_targets(mixing.ranked(df).withColumn("again", F.col("place"))).withColumnRenamed("again", "place").collect()}
        want = brute_targets(size, [(5, 2, 1)[k % 3] for k in range(len(size))])
        assert [got[s][0] for s, _ in rows] == list(range(len(rows)))
        assert np.allclose([got[s][1] for s, _ in rows], want, rtol=1e-9)
    assert mixing.with_targets(mixing.ranked(df.filter("false"))).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    p, size = np.full(500, 0.37), rng.integers(1, 900, 500)
    out = mixing.flight(p, size, np.random.default_rng(3))
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-4
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    mean = np.mean([mixing.flight(np.full(12, 0.3), np.arange(1, 13), np.random.default_rng(k)) for k in range(1500)], 0)
    assert np.abs(mean - 0.3).max() < 0.06


def test_landing_is_the_best_of_all_choices():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 6, 9):
        p, size = rng.random(n), rng.integers(1, 900, n).astype(float)
        got = mixing.land(p, size)
        cost = lambda c: abs(c @ size - p @ size) + (over * size.mean() if (over := abs(c.sum() - p.sum())) >= 1 else 0)
        assert cost(got) == pytest.approx(min(cost(np.array(c)) for c in itertools.product((0.0, 1.0), repeat=n)), abs=1e-3)
    p, size = np.full(700, 0.37), np.sort(rng.integers(1, 3000, 700))[::-1]
    got = mixing.flight_and_landing(p, size, rng)
    assert set(got) == {0.0, 1.0} and abs(got.sum() - p.sum()) < 3 and abs(got @ size - p @ size) < 300


def test_mix(spark, odd, odd_rows, none):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "b", "c", None])) for i in range(900)] + [r for r in odd_rows if len(r[1] or "") < 10_000]
    docs = make_docs(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(["source_size", got.target.round(3)]).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 60).all() and abs(by.target.sum() - by["size"].sum()) < 1
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, again[key].astype(str).values))
    many = mixing.mix(docs, block=32).toPandas()
    by = many.groupby(["source_size", many.target.round(3)]).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 120).all()
    assert mixing.mix(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    word = {"en": "thelan", "de": "schbei"}
    text = lambda lang, n: " ".join("".join(rng.choice(word[lang]) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    item = text("en", 30)
    rows = [(i, "\n".join([text(lang, 60), "Posted by the editor of this page", text(lang, 50)]), lang, "ab"[i % 2]) for i in range(40) for lang in (("en", "de")[i % 2],)]
    rows += [(50, rows[3][1], "de", "a"), (51, rows[4][1].replace("Posted", "posted"), "en", "b"), (52, f"{item} {text('en', 20)}", "en", "a"), (53, "12 34", "en", "a"), (54, None, None, None)]
    docs, sf = make_docs(spark, rows), str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], ITEMS).write.parquet(f"{sf}/benchmark.parquet")
    current, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf)
        assert current.columns == docs.columns
        current.write.parquet(f"{sf}/out/{name}")
        current = spark.read.parquet(f"{sf}/out/{name}")
        ids.append({r.doc_id for r in current.select("doc_id").collect()})
    every = {i for i, *_ in rows}
    assert every - ids[0] == {53, 54} and ids[1] == ids[0] and ids[1] - ids[2] == {50, 51} and ids[2] - ids[3] == {52}
    last = corpus_pipeline.run(spark, sf).toPandas()
    assert set(last.doc_id) == ids[3] and (last.taken > 0).any()


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    sf = str(tmp_path)
    none.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{sf}/benchmark.parquet")
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"] and found.count() == 0


def test_pipeline_keeps_a_very_long_text(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: "\n".join(" ".join("".join(rng.choice("thelan") for _ in range(rng.randrange(3, 9))) for _ in range(12)) for _ in range(n))
    item = text(3)
    long = f"{text(20_000)}\n{item}\n{text(20_000)}"
    sf = str(tmp_path)
    make_docs(spark, [(1, long, "en", "a"), (2, text(30), "en", "a"), (3, long, "en", "b"), (4, f"{item}\n{text(1)}", "en", "b")]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], ITEMS).write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r["size"] for r in corpus_pipeline.run(spark, sf).collect()}
    # The copy and the contaminated document go; of the long text only the item's words are cut out.
    assert got == {1: 40_000 * 12, 2: 360}
