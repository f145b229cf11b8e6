"""N-gram Jaccard join by MinHash banding, with exact verification.

Documents are sets of five-word shingles (a shorter text is one shingle of all
its words).  Two texts are linked if the Jaccard similarity of their sets is at
least ``THRESHOLD``.

1.  Texts with one and the same set are one member (named by a 128-bit key of the
    set), so copies cost nothing further.
2.  ``choose_bands`` takes the fewest hashes that reach ``RECALL`` at the
    threshold.  Band hashes are shuffled; members that share one are candidates.
    No pair is formed here: a bucket of m members gives m rows.
3.  A member's home is the smallest member of all its buckets.  Members of one home
    are verified together, so a group of near copies, which share most of their
    buckets, moves once and not once for each band.  Candidates of different homes
    are verified in the first bucket that they share.  Every candidate pair is thus
    verified exactly once.  Homes are one step wide: chains of ever less similar
    texts do not grow together.
4.  Homes and buckets are dealt into blocks of bounded size.  Every pair of blocks
    meets in one task, which holds two blocks at most and counts common shingles
    on the full sets.  A task returns the number of links and a spanning forest
    for its members, never the pairs.
5.  Components of the verified links are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import HashMemo, _odd, attach, column, map_batches, materialize, mix, ngram_hashes, record, signed, split_words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 400_000
ROUNDS = 60
_COLUMNS = 8192


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): of all choices with the recall at the threshold and at most ``most`` hashes, the most selective."""
    best = None
    for rows in range(1, 13):
        miss = 1 - threshold**rows
        bands = 1 if miss == 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def shingles(text: str | None, memo: HashMemo) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; none without words."""
    words = memo.array(split_words(text))
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(SHINGLE, len(words)), 41))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a shingle set."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def band_hashes(s: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of the MinHash signature."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(factors))
    for at in range(0, len(s), step):
        low = np.minimum(low, (s[at : at + step, None] * factors[None, :]).min(0))
    rows = low.reshape(bands, -1)
    weights = _odd(43, rows.shape[1])
    return mix((mix(rows) * weights[None, :]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _signatures(own: DataFrame, bands: int, rows: int) -> DataFrame:
    def make():
        memo, factors = HashMemo(), _odd(42, bands * rows)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in column(batch, "text"):
                s = shingles(text, memo)
                out.append((*set_key(s), len(s), signed(band_hashes(s, factors, bands)) if len(s) else []))
            a, b, n, h = zip(*out, strict=True)
            return record(id=batch.column(0), text_key=batch.column(1), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), n=pa.array(n, pa.int64()), bands=pa.array(h, pa.list_(pa.int64())))

        return work

    kind = own.schema["id"].dataType.simpleString()
    return map_batches(own, make, f"id {kind}, text_key long, a long, b long, n long, bands array<long>")


def components(edges: DataFrame, name: str, limit: int = ROUNDS) -> DataFrame:
    """(node, root): the smallest node of each component; nodes without edges do not appear.

    Alternates the two star operations on edges (high, low) until nothing changes;
    each round is written to the shared folder.  A round emits at most one row
    per edge, and components shrink to stars in a logarithmic number of rounds.
    Edges and lowest neighbours are joined as they were written, so the edges of a
    hub can be split over tasks.  Raises if ``limit`` rounds do not suffice.
    """
    current = materialize(edges.select(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).filter("high <> low").distinct(), f"{name}-edges")
    state = current.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    for _ in range(limit):
        # Large star: what hangs on a node goes to the node's lowest neighbour; a node without a lower one keeps its edges.
        below = materialize(current.groupBy(F.col("high").alias("low")).agg(F.min("low").alias("to")), f"{name}-below")
        large = materialize(current.join(below.hint("merge"), "low", "left").select("high", F.coalesce("to", "low").alias("low")).distinct(), f"{name}-large")
        # Small star: all lower neighbours of a node, and the node itself, go to the lowest of them.
        below = materialize(large.groupBy("high").agg(F.min("low").alias("to")), f"{name}-below")
        small = large.join(below.hint("merge"), "high").filter("low <> to").select(F.col("low").alias("high"), F.col("to").alias("low"))
        current = materialize(small.unionByName(below.select("high", F.col("to").alias("low"))).distinct(), f"{name}-round")
        before, state = state, current.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(current.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {limit} rounds")


def _linked(sets: list[np.ndarray], split: int, threshold: float, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < split <= j (or i < j if split is 0), that are wanted and reach the threshold.

    ``wanted(i)`` marks the partners of i among the right-hand sets.  Each set is a
    row of bits, one for each shingle that several sets hold.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[at] > 1
    owner, at = owner[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    parts = []
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        a, b = np.searchsorted(at, (start, start + _COLUMNS))
        some = np.zeros((n, _COLUMNS), bool)
        some[owner[a:b], at[a:b] - start] = True
        packed = np.packbits(some, axis=1).view(np.uint64)
        parts.append(packed[:, : -(-(int(at[b - 1]) - start + 1) // 64)])
    bits = np.hstack(parts) if parts else np.zeros((n, 1), np.uint64)
    left, right = (range(n), np.arange(n)) if not split else (range(split), np.arange(split, n))
    out_i, out_j = [], []
    for i in left:
        j = right[wanted(i)]
        j = j[j > i]
        # Sets whose sizes differ too much cannot reach the threshold.
        j = j[(np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i]) - 1e-6)]
        for k in range(0, len(j), 256):
            some = j[k : k + 256]
            common = np.bitwise_count(bits[some] & bits[i]).sum(1, dtype=np.int64)
            hit = some[common >= threshold * (sizes[some] + sizes[i] - common) - 1e-6]
            out_i.append(np.full(len(hit), i))
            out_j.append(hit)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64),) * 2


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i


def _verify(threshold: float):
    def work(cell: pa.Table) -> pa.Table:
        order = np.lexsort((cell["member"].to_numpy(), cell["block"].to_numpy()))
        cell = cell.take(pa.array(order))
        members, homes, blocks = (cell[c].to_numpy() for c in ("member", "home", "block"))
        low, high, band = (cell[c][0].as_py() for c in ("low", "high", "band"))
        sets = [np.asarray(x.values.to_numpy()) for x in cell["shingles"]]
        bands = np.stack([x.values.to_numpy() for x in cell["bands"]])
        split = 0 if low == high else int((blocks == low).sum())
        right = slice(split, None)

        def wanted(i: int) -> np.ndarray:
            if band < 0:
                return np.ones(len(members) - split, bool)
            same = bands[right] == bands[i]
            # Only what shares no earlier band, and has another home.
            return same[:, band] & ~same[:, :band].any(1) & (homes[right] != homes[i])

        i = j = np.empty(0, np.int64)
        if len(sets) > 1 and (low == high or split not in (0, len(sets))):
            i, j = _linked(sets, split, threshold, wanted)
        links = np.bincount(np.concatenate((i, j)), minlength=len(sets))
        forest = _Forest(len(sets))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            forest.join(a, b)
        some = np.flatnonzero(links)
        roots = np.array([forest.root(k) for k in some.tolist()], np.int64)
        return pa.table({"member": pa.array(members[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(members[roots] if len(roots) else roots, pa.int64())})

    return work


def _blocks(count: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(BLOCK_MEMBERS)), F.ceil(weight / F.lit(BLOCK_SHINGLES))).cast("int")


def _cells(members: DataFrame) -> DataFrame:
    """(band, grp, low, high, block, member, home): which members meet where.

    A home group has band -1, a bucket its own band.
    """
    buckets = members.select("member", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("member").alias("lowest"), F.max("member").alias("highest")).filter("lowest < highest").select("bucket", "lowest")
    placed = materialize(buckets.join(materialize(shared, "op3-shared"), "bucket"), "op3-placed")
    homes = materialize(placed.groupBy("member").agg(F.min("lowest").alias("home"), F.max("n").alias("n")), "op3-homes")
    homed = materialize(placed.drop("lowest", "n").join(homes, "member"), "op3-homed")
    ticket = [F.bit_xor(F.xxhash64("member", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    mixed = homed.groupBy("bucket", "band").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("home").alias("first"), F.max("home").alias("last"), *ticket).filter("first < last")
    # Of buckets with the same members the first band is enough.
    mixed = mixed.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "bucket", "weight")).alias("b")).select("b.band", "b.bucket", _blocks(F.col("m"), F.col("b.weight")).alias("blocks"))
    whole = homes.groupBy("home").agg(F.count("*").alias("m"), F.sum("n").alias("weight")).filter("m > 1").select("home", _blocks(F.col("m"), F.col("weight")).alias("blocks"))
    names = ["band", "grp", "blocks", "member", "home"]
    dealt = homes.join(materialize(whole, "op3-whole"), "home").select(F.lit(-1).alias("band"), F.col("home").alias("grp"), "blocks", "member", "home").select(*names)
    dealt = dealt.unionByName(homed.join(materialize(mixed, "op3-mixed"), ["band", "bucket"]).select("band", F.col("bucket").alias("grp"), "blocks", "member", "home").select(*names))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("band", "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "member", "home")


def _sets(own: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(member, bands, shingles) of the members that meet others."""

    def make():
        memo = HashMemo()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [signed(shingles(t, memo)) for t in column(batch, "text")]
            return record(member=batch.column(0), bands=batch.column(1), shingles=pa.array(sets, pa.list_(pa.int64())))

        return work

    named = members.join(wanted, "member", "left_semi").select("member", "bands", F.col("m.id").alias("id"), F.col("m.text_key").alias("text_key"))
    texts = own.join(named.hint("merge"), ["id", "text_key"]).select("member", "bands", "text")
    # Rows repeated with id and text give a member several times.
    return map_batches(texts, make, "member long, bands array<long>, shingles array<long>").dropDuplicates(["member"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, text_key, class_id, class_key, n_links, n_shingles) for each row with an id.

    ``class_id`` is the smallest id of the class and ``class_key`` the text_key of
    its text; ``n_links`` counts the other shingle sets linked to the document's
    own.  A text without words is in a class by itself with no links.
    """
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text")).filter(F.col("id").isNotNull())
    marked = materialize(_signatures(own, bands, rows), "op3-signatures")
    members = marked.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("id", "text_key")).alias("m"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    members = materialize(members.withColumn("member", F.monotonically_increasing_id()), "op3-members")
    cells = materialize(_cells(members), "op3-cells")
    sets = materialize(_sets(own, members, cells.select("member").distinct()), "op3-sets")
    met = cells.join(sets.hint("merge"), "member")
    found = materialize(met.groupBy("band", "grp", "low", "high").applyInArrow(_verify(threshold), "member long, links long, root long"), "op3-links")
    links = found.groupBy("member").agg(F.sum("links").alias("n_links"))
    joined = components(found.select(F.col("member").alias("u"), F.col("root").alias("v")), "op3-classes").withColumnRenamed("node", "member")
    named = members.select("member", "a", "b", "m").join(joined, "member", "left").join(links, "member", "left")
    named = materialize(named.select("a", "b", "m", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "member").alias("root")), "op3-named")
    first = materialize(named.groupBy("root").agg(F.min("m").alias("c")), "op3-first")
    by_set = materialize(named.join(first, "root").select("a", "b", "n_links", "c"), "op3-sets-named")
    out = marked.select("id", "text_key", "a", "b", "n").join(by_set, ["a", "b"], "left")
    alone = (F.col("n") == 0) | F.col("c").isNull()
    pick = lambda whole, own_: F.when(alone, F.col(own_)).otherwise(F.col(whole))
    return out.select("id", "text_key", pick("c.id", "id").alias("class_id"), pick("c.text_key", "text_key").alias("class_key"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def class_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_shingles for every row.

    Rows with a null id are classes of their own (null class, no links).
    """
    found = near_classes(docs, id_col, text_col).withColumnRenamed("id", "doc_id").drop("text_key", "class_key")
    null = F.lit(None).cast(docs.schema[id_col].dataType)
    blank = docs.filter(F.col(f"`{id_col}`").isNull()).select(null.alias("doc_id"), null.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("n_shingles"))
    return found.unionByName(blank)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents, one document of each class: the one that names it.

    Of repeated rows of that document one stays; rows with a null id stay.
    """
    found = near_classes(docs, id_col, text_col)
    keep = found.filter((F.col("id") == F.col("class_id")) & (F.col("text_key") == F.col("class_key"))).select("id", "text_key").distinct()
    known = attach(docs.filter(F.col(f"`{id_col}`").isNotNull()), keep, id_col, text_col, [], "inner", once=True)
    return known.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
