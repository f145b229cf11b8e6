"""Link suggestions from section similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import vector

NEIGHBOURS, LABEL_CHARS = 10, 100


def linked(links: DataFrame) -> DataFrame:
    """(low, high) of every pair of documents that a resolved link joins, in either direction."""
    known = links.filter(F.col("target_doc_id").isNotNull())
    return known.select(*_ends("source_doc_id", "target_doc_id")).distinct()


def _ends(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("low"), F.greatest(a, b).alias("high")


def suggest_links(documents: DataFrame, sections: DataFrame, vectors: DataFrame, links: DataFrame, threshold: float = 0.7, limit: int = 20) -> DataFrame:
    """Pairs of unlinked documents with similar sections, best first.

    Every section looks at its ten nearest, itself and its own document
    included.  Of a pair of documents the first finding counts: by title of the
    source, section order, then rank, which need not be the most similar.
    What a section shows is put together once; findings then move twice, to
    their target and to their pair of documents.
    """
    near = vector.neighbours(vectors, NEIGHBOURS, least=threshold)
    text = sections.select("section_id", "section_order", F.coalesce("heading", F.substring("content", 1, LABEL_CHARS)).alias("label"))
    shown = vectors.select("section_id", "doc_id").join(text, "section_id").join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    # Changes no finding, but keeps all columns on both sides below, so that Spark reads and moves the sections once for both.
    shown = shown.distinct()
    source = shown.select(F.col("section_id").alias("query_id"), F.col("doc_id").alias("a"), "section_order", F.col("label").alias("source_label"), F.col("title").alias("source_title"))
    target = shown.select("section_id", F.col("doc_id").alias("b"), F.col("label").alias("target_label"), F.col("title").alias("target_title"))
    pairs = near.join(source, "query_id").join(target, "section_id").filter(F.col("a") != F.col("b"))
    out = pairs.select("*", *_ends("a", "b")).join(linked(links), ["low", "high"], "left_anti")
    first = Window.partitionBy("low", "high").orderBy("source_title", "section_order", "rank", "query_id")
    chosen = out.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return chosen.select(F.col("a").alias("source_doc_id"), F.col("b").alias("target_doc_id"), "source_title", "target_title", "source_label", "target_label", "similarity").orderBy(F.desc(F.round("similarity", 12)), "source_doc_id", "target_doc_id").limit(limit)
