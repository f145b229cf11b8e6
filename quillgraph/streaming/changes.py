"""File changes as a stream: debounce, and micro-batches of incremental indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.schema import CHANGES

QUIET, LATE = "500 milliseconds", "1 minute"


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change events written as JSON lines below a folder.

    Spark's file sources do not report deletions, so a watcher or a snapshot
    comparison (``snapshot_changes``) writes events.
    """
    return spark.readStream.schema(CHANGES).json(folder)


def inside(changes: DataFrame) -> DataFrame:
    """Events whose path stays in the project."""
    return changes.filter(~F.col("filepath").rlike(r"(^/|(^|/)\.\.(/|$))"))


def debounced(changes: DataFrame, gap: str = QUIET, late: str = LATE, key: str = "filepath") -> DataFrame:
    """One event per path and burst: the last type, once ``gap`` has passed without another.

    Works on static and streaming frames; on a stream, state is kept for ``late``.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    burst = F.session_window("ts", gap)
    return changes.groupBy(key, burst.alias("burst")).agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("ts"), F.count("*").alias("events")).drop("burst")


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(type, filepath) between two listings of (filepath, body_hash)."""
    b, n = before.select("filepath", F.col("body_hash").alias("old")), now.select("filepath", F.col("body_hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "unlink").when(F.col("old") != F.col("new"), "change")
    return b.join(n, "filepath", "full_outer").select(kind.alias("type"), "filepath").filter(F.col("type").isNotNull())


def last_of_each(batch: DataFrame) -> DataFrame:
    """One event per path: the last type."""
    return batch.groupBy("filepath").agg(F.max_by("type", "ts").alias("type"))


def start(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Runs ``apply(changed, removed)`` on the paths of every micro-batch.

    A micro-batch is a burst: the trigger is the quiet time, and of the events of a
    path the last one counts.  Nothing is held back for later events.  A batch that
    fails is reported by the query and tried again from the checkpoint.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = last_of_each(batch)
        apply(last.filter("type <> 'unlink'").select("filepath"), last.filter("type = 'unlink'").select("filepath"))

    writer = inside(changes).writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def poll(spark: SparkSession, look: Callable[[], None], checkpoint: str, every: str = QUIET) -> StreamingQuery:
    """Runs ``look`` at every trigger; it compares the files with what is stored."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda *_: look()).start()
