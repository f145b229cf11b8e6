"""Link resolution by name and by path, deduplication, re-resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import paths


def file_index(documents: DataFrame) -> DataFrame:
    """(id, filepath, name, path, folder, depth) with normal names and paths."""
    return documents.select(
        "id", "filepath",
        paths.normal_name(paths.file_name(F.col("filepath"))).alias("name"),
        paths.normal_name(F.col("filepath")).alias("path"),
        paths.directory(F.col("filepath")).alias("folder"),
        paths.path_depth(F.col("filepath")).alias("depth"),
    )


def ambiguous_names(index: DataFrame) -> DataFrame:
    """Names that several files bear, with their paths."""
    return index.groupBy("name").agg(F.array_sort(F.collect_list("filepath")).alias("filepaths")).filter(F.size("filepaths") > 1)


def resolve(targets: DataFrame, documents: DataFrame) -> DataFrame:
    """(link_id, target, source_path) with status, target_doc_id, filepath, ambiguous.

    A target with a slash is a path: the file with that path, or whose path ends
    in it, of several the first path; such a link is never ambiguous.  Any other
    target is a name: files in the source's folder come first, then shallow ones,
    then by path.

    The best file of each name, of each name in a folder and of each trailing part
    of a path is found first, so a link joins one row however many files there are.
    """
    index = file_index(documents)
    best = F.struct("depth", "filepath", "id")
    by_name = index.groupBy(F.col("name").alias("key")).agg(F.min(best).alias("anywhere"), F.count("*").alias("n"))
    by_folder = index.groupBy(F.col("name").alias("key"), "folder").agg(F.min(best).alias("near"))
    by_suffix = index.select("depth", "filepath", "id", F.explode(paths.suffixes(F.col("path"))).alias("key")).groupBy("key").agg(F.min(F.struct("filepath", "id")).alias("at"))
    by_suffix = by_suffix.withColumn("by_path", F.lit(True))
    asked = targets.withColumns({"key": paths.normal_name(F.col("target")), "by_path": F.instr("target", "/") > 0, "folder": paths.directory(F.col("source_path"))})
    names = by_name.withColumn("by_path", F.lit(False))
    found = asked.join(names, ["key", "by_path"], "left").join(by_folder.withColumn("by_path", F.lit(False)), ["key", "by_path", "folder"], "left").join(by_suffix, ["key", "by_path"], "left")
    pick = lambda c: F.coalesce(F.col(f"at.{c}"), F.col(f"near.{c}"), F.col(f"anywhere.{c}"))
    return found.select(
        *targets.columns,
        F.when(pick("id").isNotNull(), "resolved").otherwise("dangling").alias("status"),
        pick("id").alias("target_doc_id"), pick("filepath").alias("filepath"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"),
    )


def deduplicated(links: DataFrame, position: str = "position") -> DataFrame:
    """The first link of each source, target and type; all dangling ones of a type are one."""
    order = Window.partitionBy("source_doc_id", F.coalesce(F.col("target_doc_id").cast("string"), F.lit("")), "type").orderBy(position)
    return links.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def dangling(links: DataFrame) -> DataFrame:
    return links.filter(F.col("target_doc_id").isNull())


def reresolved(links: DataFrame, added: DataFrame) -> DataFrame:
    """Links where dangling ones now point to added documents of that title or file name.

    Of several candidates the smallest id is taken.
    """
    name = F.regexp_replace(paths.file_name(F.col("filepath")), r"\.md$", "")
    keys = added.select("id", F.explode(F.array_distinct(F.array("title", name))).alias("target_title")).groupBy("target_title").agg(F.min("id").alias("found"))
    return links.join(keys, "target_title", "left").withColumn("target_doc_id", F.coalesce("target_doc_id", "found")).select(*links.columns)


def counts(links: DataFrame) -> DataFrame:
    """One row: total, resolved, dangling."""
    return links.agg(F.count("*").alias("total"), F.count("target_doc_id").alias("resolved"), F.count_if(F.col("target_doc_id").isNull()).alias("dangling"))


def with_sections(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with the id of the section they stand in, by document and order."""
    keyed = sections.select(F.col("doc_id").alias("source_doc_id"), "section_order", F.col("section_id").alias("source_section_id"))
    return links.join(keyed, ["source_doc_id", "section_order"], "left")
