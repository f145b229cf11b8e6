"""Removal of repeated passages by seed and extend.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a
window covers it whose word sequence also starts in a document with a smaller id.

Seeds.  Of the ``WINDOW - SEED + 1`` seed grams inside a window, the one with the
smallest hash is the window's anchor (winnowing), so two equal windows always
share their anchor, at the same place.  Neighbouring windows with one anchor form
a run; a run is at most ``WINDOW - SEED + 1`` windows long.

Extension.  Occurrences join on anchors that several documents hold, and each
anchor is extended to both sides: a run that equals an earlier document's run of
the anchor matches over its whole length, and a run that is the first of its kind
is extended place by place (so many words to the left, the rest to the right)
against all other kinds of its anchor.  Each match names the smallest document
that holds the words and a place there (in a text that repeats itself any of
several).  No pair of documents is formed, so the work is
linear in the occurrences, however many documents share a passage.

Maximal repeats.  Matches of neighbouring anchors with the same source on the same
diagonal are one repeat, which ends where the words to both sides differ (or go on
with another source).  Its length is ``WINDOW`` words or more by construction; the
words of all repeats go.

Words have 64-bit hashes, and so have grams made of them.  Runs and windows are
only ever compared under one anchor, so a wrong match takes a chance collision
among the texts that share ten words in a row.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import HashMemo, column, compose, map_batches, materialize, mix, nested, record, signed, split_words

WINDOW = 50
SEED = 10
_FIVE = 5


def _grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of n-grams for n a multiple of five, from hashes of five words."""
    return compose(compose(words, _FIVE, 1, seed), n // _FIVE, _FIVE, seed + 1)


def runs_of(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, run hash, first window and number of windows of each run, and all window hashes."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64), none
    seeds = _grams(words, seed, 21)
    width = window - seed + 1
    at = np.empty(n, np.int64)
    for start in range(0, n, 1 << 15):
        part = sliding_window_view(seeds[start : start + (1 << 15) + width - 1], width)[: n - start]
        at[start : start + len(part)] = part.argmin(1) + np.arange(start, start + len(part))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    windows = _grams(words, window, 31)
    # A run's hash sums its windows with their places, so it stands for all its words.
    place = np.arange(n, dtype=np.uint64) - np.repeat(first, count).astype(np.uint64)
    total = np.add.reduceat(mix(windows + place * np.uint64(0x9E3779B97F4A7C15)), first)
    return seeds[at[first]], mix(total + count.astype(np.uint64)), first, count, windows


def _fingerprints(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def make():
        memo = HashMemo()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for i, text in enumerate(column(batch, "text")):
                anchor, run, first, count, _ = runs_of(memo.array(split_words(text)), window, seed)
                if len(first):
                    out.append((np.full(len(first), i), signed(anchor), signed(run), first, count))
            if not out:
                return None
            row, anchor, run, first, count = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            return record(id=batch.column(0).take(take), text_key=batch.column(1).take(take), anchor=pa.array(anchor), run=pa.array(run), first=pa.array(first, pa.int32()), count=pa.array(count, pa.int32()))

        return work

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, make, f"id {kind}, text_key long, anchor long, run long, first int, count int")


def _extended(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Windows (id, anchor, run, place, start, hash) of runs that are to be extended."""
    lists = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "run", "first", "count")).alias("runs"))

    def make():
        memo = HashMemo()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for i, (text, runs) in enumerate(zip(column(batch, "text"), nested(batch, "runs"), strict=True)):
                windows = signed(_grams(memo.array(split_words(text)), window, 31))
                count = runs["count"].astype(np.int64)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(runs["first"], count) + place
                out.append((np.full(len(place), i), np.repeat(runs["anchor"], count), np.repeat(runs["run"], count), place, start, windows[start]))
            if not out:
                return None
            row, anchor, run, place, start, found = (np.concatenate(x) for x in zip(*out, strict=True))
            return record(id=batch.column(0).take(pa.array(row)), anchor=pa.array(anchor), run=pa.array(run), place=pa.array(place, pa.int32()), start=pa.array(start, pa.int32()), hash=pa.array(found))

        return work

    kind = docs.schema["id"].dataType.simpleString()
    joined = docs.join(lists, ["id", "text_key"]).select("id", "text", "runs")
    return map_batches(joined, make, f"id {kind}, anchor long, run long, place int, start int, hash long")


def matches(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, text_key, first, mask, source, source_first) of matched runs.

    Bit k of mask is set if window ``first + k`` equals window ``source_first + k``
    of the earlier document ``source``.
    """
    found = materialize(_fingerprints(docs, window, seed), "op2-seeds").filter(F.col("id").isNotNull())
    several = lambda df: df.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor")
    # Joins are between tables as they were written, which can be split where an anchor is hot; those with an aggregate cannot.
    seeds = materialize(found.join(materialize(several(found), "op2-anchors"), "anchor"), "op2-shared")
    kinds = materialize(seeds.groupBy("anchor", "run").agg(F.min(F.struct("id", "text_key", "first", "count")).alias("m")).select("anchor", "run", "m.*"), "op2-kinds")
    wanted = materialize(kinds.join(materialize(several(kinds), "op2-spread"), "anchor"), "op2-wanted")
    windows = materialize(_extended(wanted, docs, window), "op2-windows")
    lowest = windows.groupBy("anchor", "hash").agg(F.min(F.struct("id", "start")).alias("m"), F.max("id").alias("high")).filter("m.id < high").select("anchor", "hash", F.col("m.id").alias("source"), F.col("m.start").alias("at"))
    partly = windows.join(materialize(lowest, "op2-lowest"), ["anchor", "hash"]).filter("source < id")
    partly = materialize(partly.groupBy("anchor", "run", "source", (F.col("at") - F.col("place")).alias("source_first")).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask")), "op2-partly")
    # Of a run, windows that a still earlier document holds under another kind have that source; the rest has the run's first document.
    taken = partly.groupBy("anchor", "run").agg(F.bit_or("mask").alias("taken"))
    rest = F.expr("(shiftleft(1L, count) - 1) & ~coalesce(taken, 0L)")
    whole = kinds.join(taken, ["anchor", "run"], "left").select("anchor", "run", F.col("id").alias("source"), F.col("first").alias("source_first"), rest.alias("mask")).filter("mask <> 0")
    known = materialize(whole.unionByName(partly.select(*whole.columns)), "op2-matches")
    joined = seeds.select("id", "text_key", "anchor", "run", "first").join(known, ["anchor", "run"])
    return joined.filter("id > source").select("id", "text_key", "first", "mask", "source", "source_first")


def _per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "mask", "source_first")).alias("runs"), F.collect_list("source").alias("sources"))


def maximal(first: np.ndarray, mask: np.ndarray, source: np.ndarray, source_first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, source and source start of the maximal repeats of one document, in order.

    Windows in a row with one source on one diagonal are one repeat.
    """
    bits = np.unpackbits(np.ascontiguousarray(mask, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    run, place = np.nonzero(bits)
    at, diagonal, source = first[run].astype(np.int64) + place, (source_first - first)[run].astype(np.int64), source[run]
    order = np.lexsort((at, diagonal, source))
    at, diagonal, source = at[order], diagonal[order], source[order]
    new = np.concatenate(([True], (np.diff(source) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) > 1)))[: len(at)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    start, end = at[head], at[tail[: len(head)]] + window
    by_place = np.lexsort((source[head], end, start))
    return start[by_place], end[by_place], source[head][by_place], (start + diagonal[head])[by_place]


def _repeats(batch: pa.RecordBatch, window: int):
    """The maximal repeats of each row; sources as places in the batch's list of sources."""
    runs, sources = nested(batch, "runs"), batch.column(batch.schema.get_field_index("sources"))
    coded = sources.flatten().dictionary_encode()
    codes, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
    for r in runs:
        n = len(r["first"])
        yield (*maximal(r["first"], r["mask"], codes[at : at + n], r["source_first"], window), coded.dictionary)
        at += n


def _checked(window: int, seed: int) -> None:
    if not 0 < window - seed + 1 <= 63 or window % _FIVE or seed % _FIVE:
        raise ValueError("window and seed must be multiples of five, the seed shorter by less than 63 words")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))


def maximal_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, source, source_start): every maximal repeat of an earlier document, in words.

    Rows with a null id have none; repeated rows of one id are one.
    """
    _checked(window, seed)
    found = _per_document(matches(_keyed(docs, id_col, text_col), window, seed)).select("id", "runs", "sources")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts, names = [], None
            for i, (start, end, source, source_start, names) in enumerate(_repeats(batch, window)):
                parts.append((np.full(len(start), i), start, end, source, source_start))
            if names is None:
                return None
            i, start, end, source, source_start = (np.concatenate(x) for x in zip(*parts, strict=True))
            return record(doc_id=batch.column(0).take(pa.array(i)), start=pa.array(start), end=pa.array(end), source=names.take(pa.array(source)), source_start=pa.array(source_start))

        return work

    kind = found.schema["id"].dataType.simpleString()
    return map_batches(found, make, f"doc_id {kind}, start long, end long, source {kind}, source_start long").distinct()


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row.

    A null text has no words; the digest of no words is that of the empty
    string.  Rows with a null id, and rows of one id among each other, are never
    repeats of one another: only documents with a smaller id count.  Repeated
    rows are judged alike.
    """
    _checked(window, seed)
    own = _keyed(docs, id_col, text_col)
    joined = own.join(_per_document(matches(own, window, seed)), ["id", "text_key"], "left").select("id", "text", "runs", "sources")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, (start, end, *_) in zip(column(batch, "text"), _repeats(batch, window), strict=True):
                words = split_words(text)
                n, kept = len(words), words
                if len(start):
                    edges = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    kept = list(itertools.compress(words, (np.cumsum(edges[:n]) == 0).tolist()))
                whole = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "replace") if keep_text else None))
            cols = list(zip(*rows, strict=True))
            out = {"doc_id": batch.column(0), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())}
            if keep_text:
                out["kept_text"] = pa.array(cols[3], pa.string())
            return record(**out)

        return work

    kind = own.schema["id"].dataType.simpleString()
    return map_batches(joined, make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
