"""Mixing sources to target weights by the cube method.

Every source gets a target size from its weight, at most ``MAX_REPEATS`` times
its own size; what a capped source cannot take is shared anew by weight.  A
source with ratio target / size is taken ``floor(ratio)`` times as a whole, and
the rest is a sample of its documents with equal inclusion probabilities.

The sample is drawn by the cube method, balanced on tokens and on documents.
The probabilities of a block move along the null space of the two constraints
until each but two of its units is 0 or 1 (fast flight: three units at a time
always leave one direction free).  The one or two fractional units of each block
go on to the next, smaller round of blocks, so totals are kept exactly through
all rounds.  A source's last block keeps ``LANDING`` units, the largest and some of all sizes, back from
the flight; with the two that it leaves open they are the landing problem, small
enough to be solved as a whole: of all choices the one nearest both totals, where
a document too many or too few beyond one weighs as a mean unit's tokens.

Blocks are dealt by a hash of the document, so reruns agree whatever the
partitioning, and a source of any size is spread over as many blocks as it needs.
Sources are a table like any other: they are ranked, weighed and joined without
a list of them in the driver or in the plan.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD_PATTERN, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK = 4096
LANDING = 14
_TINY = 1e-9


def ranked(sources: DataFrame, column: str = "source") -> DataFrame:
    """The sources with ``place``, their number from 0 in code point order, null last.

    A range partitioning orders them; only the sizes of its parts come to the driver.
    """
    order = F.col(column).asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before, offsets = 0, []
    for r in sorted(parts.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(r.part), F.lit(before)]
        before += r.n
    if not offsets:
        return parts.withColumn("place", F.lit(0).cast("long")).drop("part")
    number = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("place", (F.element_at(F.create_map(*offsets), F.col("part")) + number - 1).cast("long")).drop("part")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, place) with ``target``: shares of all sizes by weight, none above ``cap`` times its size.

    Sources are full in the order of cap over weight, so one number, the level,
    tells which are; each round is one aggregate that raises it.
    """
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(sources.withColumn("weight", weight).withColumn("top", F.col("source_size") * cap), "mix-weights")
    decimal = lambda c: F.sum(c.cast("decimal(38,6)"))
    total, most = table.agg(F.sum("source_size"), F.sum("top")).first()
    level, full = 0.0, -1
    while True:
        open_ = (F.col("top") > 0) & (F.col("top") > F.col("weight") * level * (1 + 1e-12))
        n, taken, share = table.agg(F.count_if(~open_), decimal(F.when(~open_, F.col("top"))), decimal(F.when(open_, F.col("weight")))).first()
        if n == full or not share:
            break
        full, level = n, (float(min(total or 0, most or 0)) - float(taken or 0)) / float(share)
    return table.withColumn("target", F.least(F.col("top").cast("double"), F.col("weight") * level) if level else F.col("top").cast("double")).drop("weight", "top", "place")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fast flight phase: sum(p) and sum(p * size) stay; at most two entries end between 0 and 1."""
    p = p.copy()
    queue = [i for i in range(len(p)) if _TINY < p[i] < 1 - _TINY]
    held: list[int] = []
    at = 0
    draws = rng.random(len(queue) + 3)
    while True:
        while len(held) < 3 and at < len(queue):
            held.append(queue[at])
            at += 1
        if len(held) < 2:
            break
        a, b = held[0], held[1]
        if len(held) == 2:
            if size[a] != size[b]:
                break
            move = {a: 1.0, b: -1.0}
        else:
            c = held[2]
            sa, sb, sc = float(size[a]), float(size[b]), float(size[c])
            move = {a: sb - sc, b: sc - sa, c: sa - sb} if not sa == sb == sc else {a: 1.0, b: -1.0}
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in move.items() if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in move.items() if v)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        for i, v in move.items():
            p[i] += step * v
        draws[at % len(draws)] = rng.random()
        held = [i for i in held if _TINY < p[i] < 1 - _TINY]
    p[p <= _TINY] = 0.0
    p[p >= 1 - _TINY] = 1.0
    return p


def _seed(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([int(x) & 0xFFFFFFFF for x in parts]))


_STATE = "unit long, extra long, source string, known boolean, size long, p double, blocks long"


def _fly(batch: pd.DataFrame) -> pd.DataFrame:
    # Large units first, so that what stays open at the end is small.
    batch = batch.drop(columns="block", errors="ignore").sort_values(["size", "unit", "extra"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    batch["p"] = flight(batch["p"].to_numpy(), batch["size"].to_numpy(), _seed(int(batch["unit"].iat[0]), len(batch), int(batch["size"].sum())))
    return batch


@functools.cache
def _choices(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(np.float32)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best 0 or 1 for a few units: near sum(p * size), and within one of sum(p) unless a mean unit's tokens speak for more."""
    choices = _choices(len(p))
    over = np.abs(choices.sum(1) - p.sum())
    off = np.abs(choices.astype(float) @ size - (p * size).sum()) + np.where(over < 1, 0.0, over) * (size.mean() if len(size) else 0.0)
    return choices[int(off.argmin())].astype(float)


def flight_and_landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each unit of a source's last block, which comes by size: the largest ones and some of all sizes land."""
    between = np.flatnonzero((p > 0) & (p < 1))
    back = between if len(between) <= LANDING + 2 else between[np.concatenate((np.arange(LANDING // 2), np.linspace(LANDING // 2, len(between) - 1, LANDING - LANDING // 2).round().astype(int)))]
    rest = np.setdiff1d(np.arange(len(p)), back)
    out = p.copy()
    out[rest] = flight(p[rest], size[rest], rng)
    open_ = np.flatnonzero((out > 0) & (out < 1))
    out[open_] = land(out[open_], size[open_].astype(float))
    return out


def _last(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values(["size", "unit", "extra"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    batch["p"] = flight_and_landing(batch["p"].to_numpy(), batch["size"].to_numpy(), _seed(int(batch["unit"].iat[0]), len(batch), int(batch["size"].sum())))
    return batch


def cube_sample(units: DataFrame, blocks: int, block: int = BLOCK) -> DataFrame:
    """Columns unit, extra and p (0 or 1) for units with fractional p; totals are kept per source.

    ``units`` has unit, extra (ids that tell rows apart), source, known, size, p and
    blocks, over how many blocks its source is dealt; ``blocks`` is the most of them.
    """
    fixed, current = [], units
    while blocks > 1:
        # Sources that fit one block wait for the landing.
        dealt = current.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")))
        flown = materialize(dealt.groupBy("source", "known", "block").applyInPandas(_fly, _STATE), "mix-flight")
        between = (F.col("p") > 0) & (F.col("p") < 1)
        fixed.append(flown.filter(~between))
        current = current.filter("blocks <= 1").unionByName(flown.filter(between).withColumn("blocks", F.ceil(2 * F.col("blocks") / block)))
        blocks = -(-2 * blocks // block)
    out = current.groupBy("source", "known").applyInPandas(_last, _STATE)
    for f in fixed:
        out = out.unionByName(f)
    return out.select("unit", "extra", "p")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken counts repeats.

    A null text has size 0 and is taken 0 times; a null source is a source of its
    own.  Equal rows (same id and text) are told apart by their number, so one of
    them may be taken more often than another by one repeat.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("unit"),
    )
    sized = materialize(sized.withColumn("extra", F.monotonically_increasing_id()), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = with_targets(ranked(sources), weights, cap).withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + _TINY).cast("long"))
    plan = materialize(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("ratio") - F.col("whole")).alias("part"), F.ceil(F.col("units") / block).alias("blocks")), "mix-plan")
    # Joined by size: a short table of sources is broadcast, a long one sorted, and a hot source split.
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    part = rows.filter((F.col("part") > _TINY) & (F.col("size") > 0))
    units = part.select("unit", "extra", "source", F.col("source").isNotNull().alias("known"), "size", F.col("part").alias("p"), "blocks")
    drawn = cube_sample(units, plan.agg(F.max("blocks")).first()[0] or 0, block)
    out = rows.join(drawn.withColumnRenamed("p", "picked"), ["unit", "extra"], "left")
    times = F.col("whole") + F.coalesce("picked", F.lit(0.0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))
