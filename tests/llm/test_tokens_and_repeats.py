import hashlib
import random
from collections import defaultdict

import pytest
from llm_helpers import make_docs, words

from quillgraph.llm import substring_dedup, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_counts.tokenizer_path())


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.tokenizer_path())


def texts(n):
    rng = random.Random(5)
    parts = [*"abcdeéñ  \n\n\t'srtvlmd!?.123½²中文字😀\x1c\x85", "'ll", "'re", " the", "hello", "<|endoftext|>", "<|endo", "  ", " 's"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_counts_equal_the_library(counter, library):
    for t in texts(1500):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_every_prefix_equals_the_library(counter, library):
    for t in texts(250):
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == want, t


def test_table_of_counts(odd, odd_rows, none, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((str(i), len((t or "").encode()), n(t), n(t) > 1024) for i, t, *_ in odd_rows)
    assert token_counts.count_tokens(none).count() == 0


def test_cut_at_a_budget(library):
    counter = token_counts.PrefixCounter(token_counts.tokenizer_path())
    rng = random.Random(4)
    parts = ["The", " quick", " unbelievable", "\nnew", "'re", "  two", "\tx", " 12,345", "é😀", " zzqxj", "<|endoftext|>", " a"]
    for _ in range(150):
        text, budget = "".join(rng.choice(parts) for _ in range(rng.randrange(12))), rng.randrange(1, 12)
        fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= budget]
        assert counter.count_and_cut(text, budget) == (len(library.encode(text, add_special_tokens=False).ids), max(fits)), text


def test_budget_from_stored_prefixes(spark, library):
    df = token_counts.prefix_counts(make_docs(spark, [(1, "The quick brown fox's 12 jumps", "en", "a")]))
    cut = df.select(token_counts.longest_prefix(df.prefix_tokens, 4).alias("n")).first().n
    text = "The quick brown fox's 12 jumps"
    fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 4]
    assert cut == max(fits)


def brute_repeats(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_repeats(df, **k):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, **k).collect())


def test_repeats_of_odd_rows(odd, odd_rows, none):
    assert got_repeats(odd) == brute_repeats(odd_rows, 50)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_in_overlapping_texts(spark):
    rng = random.Random(8)
    pool = [words(rng, rng.randrange(10, 60), 30) for _ in range(12)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(1, 6)) for x in rng.choice(pool)), "en", "a") for i in range(60)]
    assert got_repeats(make_docs(spark, rows), window=15, seed=5) == brute_repeats(rows, 15)


def brute_maximal(rows, window):
    """Per document: each window's earliest other holder, joined along diagonals."""
    held = {}
    for i, t, *_ in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            held[g] = min(held.get(g, (i, k)), (i, k))
    out = []
    for i, t, *_ in rows:
        w, at = t.split(), {}
        for k in range(len(w) - window + 1):
            source, place = held[tuple(w[k : k + window])]
            if source < i:
                at.setdefault((source, place - k), []).append(k)
        for (source, diagonal), places in at.items():
            start = before = places[0]
            for k in [*places[1:], None]:
                if k is None or k > before + 1:
                    out.append((i, start, before + window, source, start + diagonal))
                    start = k
                before = k
    return sorted(out)


def test_maximal_repeats(spark):
    rng = random.Random(5)
    passage, other = words(rng, 40, 10_000), words(rng, 25, 10_000)
    body = lambda *parts: " ".join(x for p in parts for x in p)
    rows = [
        (1, body(words(rng, 30, 10_000), passage, words(rng, 9, 10_000)), "en", "a"),
        (2, body(passage, other), "en", "a"),
        (3, body(words(rng, 5, 10_000), passage[3:], other, passage[:30]), "en", "a"),
        (4, body(other, passage, passage), "en", "a"),
    ]
    found = substring_dedup.maximal_repeats(make_docs(spark, rows), window=15, seed=5).collect()
    assert sorted((r.doc_id, r.start, r.end, r.source, r.source_start) for r in found) == brute_maximal(rows, 15)
    assert substring_dedup.maximal_repeats(make_docs(spark, rows[:1]), window=15, seed=5).count() == 0


def test_hot_anchor_with_many_contexts(spark):
    """One ten-word seed in all documents, with contexts that differ, partly agree, or agree."""
    rng = random.Random(6)
    seed, lefts, rights = words(rng, 10, 10_000), [words(rng, 40, 10_000) for _ in range(5)], [words(rng, 40, 10_000) for _ in range(7)]
    rows = [(i, " ".join([*rng.choice(lefts)[rng.randrange(30) :], *seed, *rng.choice(rights)[: rng.randrange(5, 40)]]), "en", "a") for i in range(300)]
    assert got_repeats(make_docs(spark, rows), window=20, seed=10) == brute_repeats(rows, 20)
