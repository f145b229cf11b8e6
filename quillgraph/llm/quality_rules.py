"""Quality rules with a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The method compares two multinomials over hashed words and word pairs: one of
trusted target texts, one of the raw corpus.  The mean log ratio per n-gram says
how much more a text looks like the target.  Both count whole texts: the corpus all
documents, the target all trusted ones (labelled good and not toxic).  The ratio of
an n-gram counts in full only where the corpus has seen it often: with n
occurrences it weighs n / (n + ``RARE``), so that texts are not judged by what
nobody else says.

The threshold comes from the target itself: ``SPREAD`` standard deviations under the
mean of the trusted documents' ratios, from sums of whole millionths, which do not
depend on the order of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import HashMemo, bound_batches, column, compose, give_back, map_batches, materialize, mix, ngram_hashes, record, slices

BUCKETS_LOG2 = 17
# So many trusted ids go to every task; a longer list is sorted with the documents.
BROADCAST_IDS = 2_000_000
RARE = 20.0
SPREAD = 4.0
_MILLION = 1_000_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def hashed_ngrams(words: np.ndarray, log2: int = BUCKETS_LOG2) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words."""
    shift = np.uint64(64 - log2)
    return np.concatenate((mix(words) >> shift, compose(words, 2, 1, 11) >> shift)).astype(np.int64)


def base_counts(text: str | None, memo: HashMemo) -> tuple[np.ndarray, int, int, int, int]:
    """Word hashes, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return np.empty(0, np.uint64), 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = memo.array(raw.split())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = 0
    windows = ngram_hashes(words, 3, 12)
    if len(windows) > 1:
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[at] > 1
        if twice.any():
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeats = int(covered.sum())
    return words, len(text) - len(raw) + len(raw.translate(None, _SPACES)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats


def target_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted documents."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def _trusting(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = trusted.select(F.col("doc_id").alias("__qg_id"), F.lit(True).alias("__qg_good"))
    ids = F.broadcast(ids) if trusted.count() <= BROADCAST_IDS else ids
    return docs.select(F.col(f"`{id_col}`").alias("__qg_own"), F.col(f"`{text_col}`").alias("text")).join(ids, F.col("__qg_own") == F.col("__qg_id"), "left").select("text", F.col("__qg_good").isNotNull().alias("good"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log of target over raw probability of each bucket, add-one smoothed and shrunk where the corpus has little.

    Without any trusted document all ratios are 0.
    """
    marked = _trusting(docs, trusted, id_col, text_col)
    bound_batches(docs.sparkSession)
    size = 1 << BUCKETS_LOG2

    def count(batches):
        memo, raw, good = HashMemo(), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch):
                for into, keep in ((raw, None), (good, column(part, "good"))):
                    texts = [t for k, t in enumerate(column(part, "text")) if t and (keep is None or keep[k])]
                    if texts:
                        into += np.bincount(np.concatenate([hashed_ngrams(memo.array(t.encode("utf-8", "surrogatepass").split())) for t in texts]), minlength=size)
        some = np.flatnonzero(raw)
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            yield record(bucket=pa.array(own, pa.int32()), raw=pa.array(raw[own]), good=pa.array(good[own]))
        give_back()

    # At most 2^BUCKETS_LOG2 rows come to the driver, whatever the input.
    total = marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(size), np.zeros(size)
    at = total["bucket"].to_numpy()
    raw[at], good[at] = total["raw"].to_numpy(), total["good"].to_numpy()
    if not good.any():
        return no_ratios()
    ratio = np.log((good + 1) / (good.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    return (ratio * raw / (raw + RARE)).astype(np.float32)


def no_ratios() -> np.ndarray:
    """Ratios that speak for nothing."""
    return np.zeros(1 << BUCKETS_LOG2, np.float32)


def target_threshold(scored: DataFrame, trusted: DataFrame) -> float:
    """``SPREAD`` deviations under the mean ratio of the trusted documents that have words; minus infinity without any."""
    llr = F.round(F.col("llr") * _MILLION).cast("long")
    own = scored.filter("n_words > 0").select("doc_id", llr.alias("x")).join(trusted, "doc_id")
    found = own.agg(F.count("*").alias("n"), F.sum("x").alias("one"), F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).alias("two")).first()
    if not found.n:
        return float("-inf")
    mean = found.one / found.n
    return (mean - SPREAD * max(0.0, float(found.two) / found.n - mean * mean) ** 0.5) / _MILLION


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def apply_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rules: ``scores`` with ``kept``.

    Texts are read twice, to count and to score; the threshold is found among the
    scores, which are written first.
    """
    scored = materialize(scores(docs, log_ratios(docs, trusted, id_col, text_col), id_col, text_col), "op4-scores")
    return judged(scored, target_threshold(scored, trusted))


def scores(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr.

    A null or empty text has no words, an llr of 0, and fails the base rules.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        memo, table = HashMemo(), shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in column(batch, "text"):
                words, chars, symbols, lines, repeats = base_counts(text, memo)
                n = len(words)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                llr = float(table[hashed_ngrams(words)].mean()) if n else 0.0
                rows.append((n, chars, symbols, lines, repeats, failed, llr))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"])

        return work

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, make, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double")
