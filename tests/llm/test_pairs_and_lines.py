import itertools
import random
from collections import Counter, defaultdict

import pytest
from llm_helpers import make_docs, words

from quillgraph.llm import line_dedup, ngram_join


def shingle_set(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else None)


def brute_classes(rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            sets[shingle_set(t) or ("none", i)].append(i)
    keys = list(sets)
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for p in range(len(keys)):
        for q in range(p):
            a, b = keys[p], keys[q]
            if isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b):
                links[p] += 1
                links[q] += 1
                x, y = sorted((root(p), root(q)))
                up[y] = x
    low = {}
    for p, k in enumerate(keys):
        low[root(p)] = min([low.get(root(p), 1 << 60), *sets[k]])
    return sorted((i, low[root(p)], links[p]) for p, k in enumerate(keys) for i in sets[k])


def got_classes(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.class_report(df).collect() if r.doc_id is not None)


def test_classes_of_odd_rows(odd, odd_rows, none):
    assert got_classes(odd) == brute_classes(odd_rows)
    assert ngram_join.class_report(odd).count() == len(odd_rows)
    assert ngram_join.class_report(none).count() == 0
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c, _ in brute_classes(odd_rows)}) and ids.count(None) == 1


def test_large_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 20)
    rng = random.Random(2)
    base = words(rng, 150, 10_000)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(1000 + i, " ".join(words(rng, 80, 10_000)), "en", "b") for i in range(10)]
    assert got_classes(make_docs(spark, rows)) == brute_classes(rows)


def test_ids_that_stand_for_several_texts(spark):
    rng = random.Random(3)
    a, b = words(rng, 120, 10_000), words(rng, 120, 10_000)
    near = lambda w: [*w[:7], "other", *w[8:]]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near(a))), (3, " ".join(near(b)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.class_report(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted(r.text for r in ngram_join.drop_near_duplicates(df).collect()) == sorted((rows[0][1], rows[1][1]))
    named = spark.createDataFrame([(f"n{i}-{k}", t) for k, (i, t) in enumerate(rows)], "doc_id string, text string")
    assert sorted((r.doc_id, r.class_id) for r in ngram_join.class_report(named).collect()) == [("n1-0", "n1-0"), ("n1-1", "n1-1"), ("n2-2", "n1-0"), ("n3-3", "n1-1")]


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82, each of its own."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        w = words(rng, 97 + i % 9, 10**6)
        v = list(w)
        v[20], v[70 + i % 20] = "new", "words"
        rows += [(2 * i, " ".join(w), "en", "a"), (2 * i + 1, " ".join(v), "en", "a")]
    true = sum(n for _, _, n in brute_pairs(rows))
    found = sum(n for _, _, n in got_classes(make_docs(spark, rows)))
    assert true == 1200 and found <= true and found >= 0.99 * true


def brute_pairs(rows):
    for k in range(0, len(rows), 2):
        a, b = shingle_set(rows[k][1]), shingle_set(rows[k + 1][1])
        yield rows[k][0], rows[k + 1][0], 2 * (len(a & b) >= 0.8 * len(a | b))


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 501)]
    names = rng.sample(range(1000), 1000)
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in chain], "u long, v long")
    got = {r.node: r.root for r in ngram_join.components(edges, "test").collect()}
    groups = [range(0, 61), range(100, 300), (500, 501)]
    assert got == {names[i]: min(names[k] for k in g) for g in groups for i in g}
    with pytest.raises(RuntimeError):
        ngram_join.components(edges, "test", limit=1)


def test_band_choice():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 160


def brute_lines(rows, least):
    seen = defaultdict(set)
    per = {}
    for n, (i, t, *_) in enumerate(rows):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            if i is not None and (found := line_dedup.template_keys(line)):
                per[n, k] = found[1]
                for key in found[1]:
                    seen[key].add(i)
    out = []
    for n, (i, t, *_) in enumerate(rows):
        lines = [] if t is None else t.split("\n")
        gone = {k for k in range(len(lines)) if any(len(seen[x]) >= least and min(seen[x]) != i for x in per.get((n, k), ()))}
        out.append((str(i), len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out)


def log_rows():
    rng = random.Random(4)
    rows = []
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for i in range(30):
        own = [" ".join(name() for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        if i % 2:
            own.insert(1, f"Posted on 2024-01-{i:02d} by the editor")
        if i % 3 == 0:
            own.append("All rights are reserved by the owner of this very page and of all others, says " + rng.choice(("Ann", "Bob", "Eve")))
        rows.append((i, "\n".join(own), "en", "a"))
    return [*rows, (40, "All rights are reserved by the owner of this very page and of all others, says Zoe", "en", "b"), (41, None, None, None), (42, "", "en", "a"), (None, "Posted on 2024-01-01 by the editor", "en", "a"), (43, "a b\na b\n" * 3, "en", "a"), (44, "x" * 100_000 + " 1 y z", "en", "a")]


def test_recurring_lines(spark, none):
    import hashlib

    rows = log_rows()
    df = make_docs(spark, rows).repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(df).collect())
    want = brute_lines(rows, line_dedup.MIN_DOCS)
    assert got == sorted((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in want)
    assert sum(g for _, _, g, _ in want) == 24
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert 40 not in found and found[41].text is None and found[42].text == "" and None in found
    assert all(r.text is None or r.n_chars == len(r.text) for r in found.values())
    assert line_dedup.line_report(none).count() == 0


def test_templates():
    key = line_dedup.template_keys
    assert key(b"one two") is None and key(b"") is None
    assert key(b"id 17 was seen")[1][0] == key(b"id 99 was seen")[1][0]
    assert key(b"id 17 was seen")[0] != key(b"id 17 was seen again")[0]
    a, b = key(b"a b c d e f g h i j k l m n")[1], key(b"a b c d e f g h i j k l m X")[1]
    assert a[0] != b[0] and len(set(a) & set(b)) == 1
    assert key(b"1 2 3 4")[1] != key(b"1 2 3 5")[1]


def dropped_lines(df):
    """Pairs of document and line number that are dropped, without the report's hashes."""
    return {(r.id, k) for r in line_dedup.recurring_lines(df).collect() for k in r.lines}


def test_lines_of_one_or_two_tokens(spark):
    own = lambda i: "".join(chr(0x4E00 + 31 * i + k) for k in range(25))
    rows = [(i, f"Read more\n{own(i)}\n版权所有未经许可不得转载\n  Share\tthis \nPage {i}\n\n", "en", "a") for i in range(5)]
    rows += [(10 + i, "Seen four\n" * 3 + own(90 + i), "en", "a") for i in range(4)]
    assert dropped_lines(make_docs(spark, rows)) == {(i, k) for i in range(1, 5) for k in (0, 2, 3)}


def test_open_fields_anywhere(spark):
    name = lambda i, k: "".join("bcdfghjklm"[int(c)] for c in f"{i}{k}{7 * i + k}")
    tail = "has sent this page to all readers who asked for news of"
    templates = [
        lambda i: f"Posted by {name(i, 1)} in {name(i, 2)}", lambda i: f"{name(i, 3)} wrote this article", lambda i: f"{name(i, 4)} and {name(i, 5)} edited this page",
        lambda i: f"Seen by {name(i, 1) if i % 2 else i} and {name(i, 6)} this week", lambda i: f"{name(i, 7)} {tail} {name(i, 8)}", lambda i: f"From {name(i, 9)} who {tail} the town",
        lambda i: f"{i} {i + 1} {i + 2} {i * i}", lambda i: f"{name(i, 1)} | {name(i, 2)} | same", lambda i: f"{name(i, 1)} or {name(i, 2)} or {name(i, 3)} again",
    ]
    rows = [(i, "\n".join(t(i) for t in templates), "en", "a") for i in range(1, 8)] + [(20 + i, f"Found by {name(i, 1)} in {name(i, 2)}", "en", "a") for i in range(4)]
    assert dropped_lines(make_docs(spark, rows)) == {(i, k) for i in range(2, 8) for k in range(6)}


def brute_open(rows, least):
    """Lines to drop by comparing tokens in place: digits are fields, and up to two more tokens may differ."""
    seen, per = defaultdict(set), {}
    for i, text, *_ in rows:
        for k, line in enumerate(text.split("\n")):
            shown = [None if any(c.isdigit() for c in t) else t for t in line.split()]
            if len(shown) - shown.count(None) < 2:
                shown = line.split()
            for size in range(3):
                for opened in itertools.combinations([p for p, t in enumerate(shown) if t is not None], size):
                    left = tuple(None if p in opened else t for p, t in enumerate(shown))
                    if not size or sum(t is not None and t.isalpha() for t in left) >= size + 1:
                        per.setdefault((i, k), []).append(left)
                        seen[left].add(i)
    return {at for at, all_of in per.items() if any(len(seen[x]) >= least and min(seen[x]) != at[0] for x in all_of)}


def test_templates_of_middling_lines(spark):
    rng = random.Random(15)
    bases = [[rng.choice("abcdefghij") * 2 for _ in range(n)] for n in range(3, 12) for _ in range(4)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(("|", str(rng.randrange(99)), f"q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"))
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(6)), "en", "a") for i in range(60)]
    want = brute_open(rows, line_dedup.MIN_DOCS)
    assert dropped_lines(make_docs(spark, rows)) == want and 60 < len(want) < 330


@pytest.mark.parametrize("name", ["op3_ngram_join", "op8_line_dedup", "mixing_targets"])
def test_registered_query_equals_sql(spark, name):
    import duckdb

    from quillgraph.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
