"""Bounded traversals of the link graph, proximity, structure and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT, IN, CENTER = "outgoing", "incoming", "center"


def _step_edges(links: DataFrame, forward: bool, link_types: list[str] | None) -> DataFrame:
    edges = links.filter(F.col("target_doc_id").isNotNull())
    if link_types:
        edges = edges.filter(F.col("type").isin(*link_types))
    a, b = ("source_doc_id", "target_doc_id") if forward else ("target_doc_id", "source_doc_id")
    # Parallel links add nothing to a walk; each step's grouping drops them without a shuffle of all links.
    return edges.select(F.col(a).alias("from"), F.col(b).alias("to"), "type")


def traverse(links: DataFrame, seeds: DataFrame, depth: int = 2, link_types: list[str] | None = None, forward: bool = True) -> DataFrame:
    """(seed, node, depth, link_type, direction) of all nodes within ``depth`` hops of each seed.

    Breadth first, one join per level; nodes seen before leave the frontier, so
    dense graphs do not multiply walks.  A node has the smallest depth and, among
    the links that reach it there, the smallest type.  The seed is left out.  A
    depth below one still takes one hop.
    """
    edges = _step_edges(links, forward, link_types)
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct()
    seen, levels = frontier, None
    for level in range(1, max(1, depth) + 1):
        step = frontier.join(edges, frontier["node"] == edges["from"]).groupBy("seed", F.col("to").alias("node")).agg(F.min("type").alias("link_type"))
        step = step.join(seen, ["seed", "node"], "left_anti")
        found = step.select("seed", "node", F.lit(level).alias("depth"), "link_type")
        levels = found if levels is None else levels.unionByName(found)
        frontier = step.select("seed", "node")
        seen = seen.unionByName(frontier)
    return levels.withColumn("direction", F.lit(OUT if forward else IN))


def traverse_both(links: DataFrame, seeds: DataFrame, depth: int = 2, link_types: list[str] | None = None) -> DataFrame:
    """Descendants and ancestors together; a node in both keeps the nearer way, outgoing on ties."""
    both = traverse(links, seeds, depth, link_types, True).unionByName(traverse(links, seeds, depth, link_types, False))
    order = F.struct("depth", (F.col("direction") == IN).alias("second"))
    best = both.groupBy("seed", "node").agg(F.min_by(F.struct("depth", "link_type", "direction"), order).alias("b"))
    return best.select("seed", "node", "b.depth", "b.link_type", "b.direction")


def with_documents(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes that are documents, with title and type."""
    return nodes.join(documents.select(F.col("id").alias("node"), "title", "doc_type"), "node")


def proximity(depth: Column) -> Column:
    """1/hops, and 0 for no hops."""
    return F.when(depth > 0, 1.0 / depth).otherwise(F.lit(0.0))


def proximity_scores(nodes: DataFrame) -> DataFrame:
    """Best proximity of each node over all ways to it, best first."""
    return nodes.groupBy("node").agg(F.max(proximity(F.col("depth"))).alias("proximity"), F.min("depth").alias("depth")).orderBy(F.desc("proximity"), "node")


def full_structure(documents: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents with their degrees over resolved links, and all resolved links."""
    edges = links.filter(F.col("target_doc_id").isNotNull()).select("source_doc_id", "target_doc_id", "type")
    return _with_degrees(documents.select(F.col("id").alias("node"), "title", "doc_type", F.lit(0).alias("depth")), edges), edges


def centered_structure(documents: DataFrame, links: DataFrame, center, depth: int = 2, link_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The center and what it reaches both ways, with all links among these nodes."""
    seeds = documents.filter(F.col("id") == center).select(F.col("id").alias("seed"))
    reached = traverse_both(links, seeds, depth, link_types).select("node", "depth")
    nodes = with_documents(seeds.select(F.col("seed").alias("node"), F.lit(0).alias("depth")).unionByName(reached), documents)
    ids = nodes.select("node")
    edges = links.filter(F.col("target_doc_id").isNotNull()).join(ids.withColumnRenamed("node", "source_doc_id"), "source_doc_id", "left_semi").join(ids.withColumnRenamed("node", "target_doc_id"), "target_doc_id", "left_semi")
    edges = edges.select("source_doc_id", "target_doc_id", "type")
    return _with_degrees(nodes, edges), edges


def _with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("source_doc_id").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("target_doc_id").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])


def in_display_order(nodes: DataFrame) -> DataFrame:
    """By depth, then title in locale order."""
    return nodes.orderBy("depth", F.collate("title", "UNICODE"), "node")
