"""Exact vector search: one query, and all rows against all rows in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.errors import DimensionMismatchError

# Most rows and values of a block; blocks that small tables are spread over, and rows worth one.
BLOCK, VALUES, SPREAD, LEAST, TASKS = 1 << 17, 1 << 23, 8, 2048, 4096
# Pairs that are scored at once; groups of columns whose largest values bound the best of a row.
PAIRS, GROUPS = 1 << 22, 256


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def topk(vectors: DataFrame, query: list[float], k: int = 5, dims: int | None = None) -> DataFrame:
    """The k sections most similar to a query, best first; ties by section id.

    A scan with a running top k in each task; nothing is sorted as a whole.
    """
    if dims is not None and len(query) != dims:
        raise DimensionMismatchError(dims, len(query))
    q = F.lit([float(x) for x in query])
    scored = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)))
    return scored.select("section_id", "doc_id", dot(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "section_id").limit(k)


def wrong_dimension(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector does not have the index's dimension."""
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dims))


def latest(index: DataFrame, updates: DataFrame) -> DataFrame:
    """The index after upserts: an update replaces the entry of its section."""
    return index.join(updates.select("section_id"), "section_id", "left_anti").unionByName(updates.dropDuplicates(["section_id"]))


def without(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index without the documents or sections in ``gone``."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as a matrix."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise DimensionMismatchError(sizes[0], sizes[1])
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first of which names groups, and the place within its group of each row so ordered."""
    order = np.lexsort(keys[::-1])
    group = keys[0][order]
    start = np.r_[True, group[1:] != group[:-1]][: len(group)]
    at = np.arange(len(group))
    return order, at - np.maximum.accumulate(np.where(start, at, 0))


def _first_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k smallest ids of each vector stand; its other copies are never among the k nearest."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    if not width:
        return np.argsort(ids)[:k]
    known = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)])
    order, place = _place(known.dictionary_encode().indices.to_numpy(), ids)
    return order[place < k]


def _near(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and of right that may be among the k best of the left row, by single precision and its largest error."""
    sims, n, groups = left @ right.T, len(right), max(GROUPS, 8 * k)
    if n <= k:
        return np.divmod(np.arange(len(left) * n), n)
    grouped = n // groups * groups if n >= 4 * groups else 0
    parts = sims[:, :grouped].reshape(len(left), -1, groups)
    # The k-th best of the largest of each group of columns is at most the k-th best of all.
    best = parts.max(axis=1) if grouped else sims
    least = (np.partition(best, -k, axis=1)[:, -k] - (left.shape[1] + 8) * 2.0**-22).astype(np.float32)
    rest_q, rest_c = np.nonzero(~(sims[:, grouped:] < least[:, None]))
    if not grouped:
        return rest_q, rest_c
    q, g = np.nonzero(~(best < least[:, None]))
    found = [(rest_q, rest_c + grouped)]
    # By pieces: many equal values would ask for all of them at once.
    size = max(1, PAIRS // parts.shape[1])
    for x in range(0, len(q), size):
        pair, row = np.nonzero(~(parts[q[x : x + size], :, g[x : x + size]] < least[q[x : x + size], None]))
        found.append((q[x : x + size][pair], row * groups + g[x : x + size][pair]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _dots(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of left with rows b of right, added up in double precision from the first value on, as ``dot`` does."""
    out = np.zeros(len(a))
    for part in (slice(x, x + PAIRS) for x in range(0, len(a), PAIRS)):
        for d in range(left.shape[1]):
            out[part] += left[a[part], d].astype(float) * right[b[part], d]
    return out


def _cell_topk(k: int):
    def work(cell: pa.Table) -> pa.Table:
        asks, ids, rows = cell["as_query"].to_numpy(), cell["section_id"].to_numpy(), _rows(cell["embedding"])
        own, left, ids, right = ids[asks], rows[asks], ids[~asks], rows[~asks]
        kept = _first_copies(right, ids, k)
        ids, right = ids[kept], right[kept]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        with np.errstate(all="ignore"):
            # Scaled by row on one side and as a whole on the other, which changes no row's order.
            size = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))
            norms = size(right)
            whole = max(norms[np.isfinite(norms)], default=0.0) or 1.0
            each = size(left)
            scaled, others = (left / np.where(each == 0, 1.0, each)[:, None]).astype(np.float32), (right / whole).astype(np.float32)
            step = max(1, PAIRS // max(1, len(right)))
            for x in range(0, len(left) if len(right) else 0, step):
                q, c = _near(scaled[x : x + step], others, k)
                sims = _dots(left[x : x + step], right, q, c)
                order, place = _place(q, -np.where(np.isnan(sims), np.inf, np.round(sims, 12)), ids[c])
                best = order[place < k]
                found.append((own[x : x + step][q[best]], ids[c[best]], sims[best]))
        return pa.table(dict(zip(("query_id", "section_id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return work


def _pair_topk(k: int, least: float):
    """Both ways of a pair of blocks, or a block against itself: the best of each row that asks, as two lists."""
    one_way = _cell_topk(k)

    def work(cell: pa.Table) -> pa.Table:
        rows, first = cell.select(["section_id", "embedding"]), cell["first"]
        if cell["i"][0] == cell["j"][0]:
            ways = [pa.concat_tables(rows.append_column("as_query", pa.array(np.full(len(rows), x))) for x in (True, False))]
        else:
            ways = [rows.append_column("as_query", x) for x in (first, pc.invert(first))]
        found = pa.concat_tables(map(one_way, ways))
        # Not less, so that NaN stays; the margin leaves rounding to the caller.
        found = found.filter(pc.invert(pc.less(found["similarity"], least - 1e-11))).combine_chunks()
        asks = found["query_id"].to_numpy()
        start = np.flatnonzero(np.r_[True, asks[1:] != asks[:-1]][: len(asks)])
        ends = pa.array(np.r_[start, len(asks)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(found[x].to_numpy())) for x in ("section_id", "similarity")]
        return pa.table([pa.array(asks[start]), *lists], names=["query_id", "section_ids", "similarities"])

    return work


def _cells(vectors: DataFrame, block: int) -> DataFrame:
    """section_id, embedding, i, j, first: each pair of blocks i <= j with the rows of both; every vector is in one cell for each block."""
    known = vectors.filter(F.col("embedding").isNotNull()).select("section_id", "embedding")
    n, dims = known.agg(F.count("*"), F.max(F.size("embedding"))).first()
    full = max(1, min(block, VALUES // max(1, dims or 1)))
    blocks = max(1, -(-n // full), min(SPREAD, -(-n // LEAST)))
    dealt = known.withColumn("own", F.pmod(F.xxhash64("section_id"), F.lit(blocks)).cast("int"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = cells.select("section_id", "embedding", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"))
    # Small rows for much work: more tasks than cells, not as few as the bytes would fill, so that few cells share one.
    return cells.repartition(min(2 * blocks * (blocks + 1), TASKS), "i", "j")


def neighbours(vectors: DataFrame, k: int = 10, block: int = BLOCK, least: float = -np.inf) -> DataFrame:
    """(query_id, section_id, similarity, rank): the k nearest of every section, itself included; of them those of similarity ``least`` or more.

    Sections are dealt into blocks of at most ``block`` rows and about VALUES
    values; each pair of blocks meets in one task, which compares both ways and
    keeps k rows per section.  What moves is the input times the number of
    blocks, which stays at SPREAD until blocks are full.  A task finds candidates
    in single precision, with a margin beyond its error, and compares only these
    in double precision.
    """
    best = _cells(vectors, block).groupBy("i", "j").applyInArrow(_pair_topk(k, least), "query_id long, section_ids array<long>, similarities array<double>")
    # Moved as lists, taken apart where they arrive.
    rows = best.repartition("query_id").select("query_id", F.inline(F.arrays_zip(F.col("section_ids").alias("section_id"), F.col("similarities").alias("similarity"))))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "section_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.round("similarity", 12) >= least))
