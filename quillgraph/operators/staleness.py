"""Source references: rechecking, levels, reasons and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "__NOT_FOUND__"
_GLOB = re.compile(r"([{}\[\]*?\\])")


def recheck(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References with ``is_stale`` set anew and the hash found now.

    ``files`` has file_path and hash of what can be read; a path that is not
    there counts as changed.  A reference without a stored hash is not stale.
    """
    now = refs.drop("is_stale").join(files.select("file_path", F.col("hash").alias("current_hash")).dropDuplicates(["file_path"]), "file_path", "left")
    now = now.withColumn("current_hash", F.coalesce("current_hash", F.lit(MISSING)))
    return now.withColumn("is_stale", F.coalesce(F.col("last_synced_hash") != F.col("current_hash"), F.lit(False)))


def levels(documents: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, staleness) of every document that has references; others are fresh."""
    marked = refs.groupBy("doc_id").agg(
        F.max(F.col("is_stale") & (F.coalesce("last_synced_hash", F.lit("")) != "")).alias("changed"),
        F.max(F.col("is_stale") & (F.coalesce("last_synced_hash", F.lit("")) == "")).alias("unknown"),
    )
    return marked.select("doc_id", F.when(F.col("changed"), "stale").when(F.col("unknown"), "untracked").otherwise("fresh").alias("staleness"))


def reason():
    """Why a checked reference is stale."""
    return F.when(F.coalesce("last_synced_hash", F.lit("")) == "", "not_found").when(F.col("current_hash") == MISSING, "deleted").otherwise("modified")


def stale_documents(documents: DataFrame, checked: DataFrame) -> DataFrame:
    """Documents with stale references: level, and (file_path, reason) of each in path order."""
    stale = checked.filter("is_stale").select("doc_id", F.struct("file_path", reason().alias("reason")).alias("ref"))
    grouped = stale.groupBy("doc_id").agg(F.array_sort(F.collect_list("ref")).alias("stale_refs"))
    named = documents.select(F.col("id").alias("doc_id"), "title", "filepath")
    return grouped.join(named, "doc_id").join(levels(documents, checked), "doc_id").select("doc_id", "title", "filepath", "staleness", "stale_refs")


def stale_paths(refs: DataFrame, doc_id) -> DataFrame:
    return refs.filter((F.col("doc_id") == doc_id) & F.col("is_stale")).select("file_path")


def summary(refs: DataFrame) -> DataFrame:
    """One row: fresh, stale and all references; zeros for an empty table."""
    stale = F.coalesce(F.sum(F.when(F.col("is_stale"), 1).otherwise(0)), F.lit(0))
    return refs.agg((F.count("*") - stale).alias("fresh"), stale.alias("stale"), F.count("*").alias("total"))


def source_hashes(spark, refs: DataFrame, root: str) -> DataFrame:
    """(file_path, hash) of the referenced files below ``root`` that can be read.

    The folder is listed first, without contents; only the files that a reference
    names are opened.  Their paths, as many as references, come to the driver.
    """
    prefix = root.rstrip("/") + "/"
    own = F.substr("path", F.instr("path", prefix) + len(prefix))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", own.alias("file_path"))
    wanted = refs.filter(~F.col("file_path").rlike(r"(^|/)\.\.(/|$)")).select("file_path").distinct()
    there = [r.path for r in listed.join(wanted, "file_path", "left_semi").select("path").collect()]
    if not there:
        return spark.createDataFrame([], "file_path string, hash string")
    # Names come back as text; a glob mark in one would be read as a pattern.
    return spark.read.format("binaryFile").load([_GLOB.sub(r"\\\1", p) for p in there]).select(own.alias("file_path"), F.sha2("content", 256).alias("hash"))


def with_flags(refs: DataFrame, checked: DataFrame) -> DataFrame:
    """The stored references with the flags that a check found."""
    found = checked.select("doc_id", "file_path", F.col("is_stale").alias("__found")).dropDuplicates(["doc_id", "file_path"])
    return refs.join(found, ["doc_id", "file_path"], "left").withColumn("is_stale", F.coalesce("__found", "is_stale")).select(*refs.columns)
