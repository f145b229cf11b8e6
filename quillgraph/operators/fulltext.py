"""Full-text search: literal phrases over headings and contents, BM25 rank, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rank: saturation, length weight, floor of the inverse frequency, trigram length.
K1, B, LEAST_IDF, TRIGRAM = 1.2, 0.75, 1e-6, 3
# Characters whose trigrams are sorted at once.
CHARS = 1 << 21
MARK_OPEN, MARK_CLOSE, ELLIPSIS, SNIPPET_TRIGRAMS = "<mark>", "</mark>", "...", 64


def query_tokens(query: str) -> list[str]:
    """Blank-separated literals; those shorter than a trigram match nothing and are dropped."""
    return [t.lower() for t in query.split() if len(t) >= TRIGRAM]


def quoted(query: str) -> str:
    """The query as literal phrases, all of which must occur."""
    return " ".join('"' + t.replace('"', '""') + '"' for t in query.split())


def _overlaps_itself(token: str) -> bool:
    return any(token.startswith(token[i:]) for i in range(1, len(token)))


def occurrences(text: Column, token: str) -> Column:
    """Occurrences of a lower-case token in lower-cased text, overlapping ones included."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if _overlaps_itself(token):
        # Quoted for Java as a whole; every start position counts.
        return F.regexp_count(low, F.lit("(?=" + "\\Q" + token.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(token), F.lit("")))) / len(token)).cast("int")


def _size(text: Column) -> Column:
    return F.greatest(F.length(F.coalesce(text, F.lit(""))) - (TRIGRAM - 1), F.lit(0))


def ranked(sections: DataFrame, query: str) -> DataFrame:
    """section_id, doc_id, heading, content, rank for all matching sections; lower ranks are better.

    One pass counts documents and lengths, one scores.  The counts are one row.
    """
    tokens = query_tokens(query)
    base = sections.select("section_id", "doc_id", "heading", "content")
    if not tokens:
        return base.filter(F.lit(False)).withColumn("rank", F.lit(0.0))
    hits = [(occurrences(F.col("heading"), t) + occurrences(F.col("content"), t)).alias(f"f{i}") for i, t in enumerate(tokens)]
    counted = base.select("*", (_size(F.col("heading")) + _size(F.col("content"))).alias("size"), *hits)
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(tokens))])
    found = counted
    for i in range(len(tokens)):
        found = found.filter(F.col(f"f{i}") > 0)
    joined = found.crossJoin(F.broadcast(stats))
    rank = F.lit(0.0)
    for i in range(len(tokens)):
        idf = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        f = F.col(f"f{i}")
        rank = rank - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return joined.select("section_id", "doc_id", "heading", "content", rank.alias("rank"))


def snippet(content: Column, query: str) -> Column:
    """Content around the first hit, hits marked; without a hit in the content its beginning."""
    tokens = query_tokens(query)
    width = SNIPPET_TRIGRAMS + TRIGRAM - 1
    low = F.lower(content)
    places = [F.nullif(F.instr(low, t), F.lit(0)) for t in tokens]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], *places, F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.least(first - width // 4, F.length(content) - width + 1), F.lit(1))
    cut = F.substr(content, start, F.lit(width))
    pattern = "(?i)(" + "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)) + ")" if tokens else None
    marked = F.regexp_replace(cut, pattern, f"{MARK_OPEN}$1{MARK_CLOSE}") if pattern else cut
    return F.concat(F.when(start > 1, F.lit(ELLIPSIS)).otherwise(F.lit("")), marked, F.when(start + width <= F.length(content), F.lit(ELLIPSIS)).otherwise(F.lit("")))


def search(sections: DataFrame, documents: DataFrame, query: str, limit: int = 10, doc_type: str | None = None) -> DataFrame:
    """Best sections with their documents; the type filter comes after the first 2 * limit hits.

    ``total_found`` is how many of these hits pass the filter.
    """
    top = ranked(sections, query).join(documents.select(F.col("id").alias("doc_id"), "title", "doc_type"), "doc_id").orderBy("rank", "section_id").limit(2 * limit)
    if doc_type is not None:
        top = top.filter(F.col("doc_type") == doc_type)
    shown = snippet(F.col("content"), query)
    # At most 2 * limit rows, so a window over all of them is small.
    top = top.withColumn("total_found", F.count("*").over(Window.partitionBy(F.lit(0))))
    return top.orderBy("rank", "section_id").limit(limit).select("section_id", "doc_id", "title", "doc_type", "heading", shown.alias("snippet"), "rank", "total_found")


def _postings(texts: list[str], rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of texts, where the rows of each begin, and these rows, each once; ``rows`` names the row of a text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = text[:-2] == text[2:]
    keys = pa.array(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[whole]).dictionary_encode()
    n = int(rows.max(initial=0)) + 1
    both = keys.indices.to_numpy() * np.int64(n) + rows[text[:-2][whole]]
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    names = ["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in keys.dictionary.to_pylist()]
    starts = np.searchsorted(both, np.arange(len(names) + 1) * np.int64(n))
    return names, starts, both - np.repeat(np.arange(len(names)) * np.int64(n), np.diff(starts))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """section_id, heading, content, both in lower case, to lists of sections by trigram, for about CHARS characters at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = [[x or "" for x in batch.column(i).to_pylist()] for i in (1, 2)]
        pieces = np.cumsum([len(h) + len(c) for h, c in zip(*texts, strict=True)]) // CHARS
        cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(ids)]
        for x, y in pairwise(cuts):
            names, starts, rows = _postings(texts[0][x:y] + texts[1][x:y], np.tile(np.arange(y - x), 2))
            yield pa.record_batch([pa.array(names, pa.string()), pa.ListArray.from_arrays(starts.astype(np.int32), ids[x:y][rows])], names=["gram", "section_ids"])


def trigram_index(sections: DataFrame) -> DataFrame:
    """(gram, section_id): every three characters in a row of heading or content, lower-cased, once for each section.

    Lists of sections are made by trigram in each batch; they are taken apart last, so a search opens only those it asks for.
    """
    lists = sections.select("section_id", F.lower("heading"), F.lower("content")).mapInArrow(_indexed, "gram string, section_ids array<bigint>")
    return lists.select("gram", F.explode("section_ids").alias("section_id"))


def synced_index(index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after sections were added, changed or removed; only these are read again."""
    gone = changed.select("section_id").unionByName(removed.select("section_id")).distinct()
    return index.join(gone, "section_id", "left_anti").select("gram", "section_id").unionByName(trigram_index(changed))


def indexed_matches(index: DataFrame, sections: DataFrame, query: str) -> DataFrame:
    """section_id of the sections that hold every token; candidates come from the index, only they are read."""
    tokens = query_tokens(query)
    if not tokens:
        return sections.select("section_id").filter(F.lit(False))
    asked = sorted({t[k : k + TRIGRAM] for t in tokens for k in range(len(t) - TRIGRAM + 1)})
    found = index.filter(F.col("gram").isin(asked)).groupBy("section_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select("section_id")
    near = sections.join(found, "section_id")
    for t in tokens:
        near = near.filter(occurrences(F.col("heading"), t) + occurrences(F.col("content"), t) > 0)
    return near.select("section_id")


def document_scores(top: DataFrame) -> DataFrame:
    """Per document the best |rank| over the best |rank| of all; 0 if that is 0."""
    best = top.agg(F.max(F.abs("rank")).alias("best"))
    share = F.when(F.col("best") > 0, F.abs("rank") / F.col("best")).otherwise(F.lit(0.0))
    return top.crossJoin(F.broadcast(best)).groupBy("doc_id").agg(F.max(share).alias("fts"))
