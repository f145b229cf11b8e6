"""Hybrid search: vectors, graph proximity and full text in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import fulltext, graph, staleness, vector

CANDIDATES, SEEDS, SHOWN_SECTIONS, FALLBACK_CHARS = 10, 2, 3, 500
# Fixed values of the score: the text share of what the vectors leave, and the blend of best and mean hits.
TEXT_SHARE, BEST, MEAN = 0.3, 0.8, 0.2


@dataclass
class Corpus:
    """The tables a search reads."""

    documents: DataFrame
    sections: DataFrame
    links: DataFrame
    vectors: DataFrame
    refs: DataFrame | None = None


def few(rows: DataFrame) -> DataFrame:
    """A short result, limited by its plan, as a local table, so that later branches do not compute it again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def vector_scores(hits: DataFrame) -> DataFrame:
    """Per document the best hit, never below 0; with several hits blended with the mean of its three best."""
    best = F.greatest(F.max("similarity"), F.lit(0.0))
    three = F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, 3)
    grouped = hits.groupBy("doc_id").agg(best.alias("best"), F.count("*").alias("hits"), three.alias("three"))
    mean = F.aggregate("three", F.lit(0.0), lambda acc, x: acc + x) / F.size("three")
    return grouped.select("doc_id", F.when(F.col("hits") > 1, BEST * F.col("best") + MEAN * mean).otherwise(F.col("best")).alias("vec"))


def scores(corpus: Corpus, query: str, query_vector: list[float], limit: int = 5, depth: int = 1, link_types: list[str] | None = None, alpha: float = 0.7) -> DataFrame:
    """(doc_id, score, vec, prox, fts) of all candidates: documents with vector hits or in reach of the first ones.

    Full-text hits raise candidates but add none.  The text weight is given back
    to the graph when the text matches nowhere.
    """
    return _scores(corpus, few(vector.topk(corpus.vectors, query_vector, CANDIDATES * limit)), query, limit, depth, link_types, alpha)


def _scores(corpus: Corpus, hits: DataFrame, query: str, limit: int, depth: int, link_types: list[str] | None, alpha: float) -> DataFrame:
    seeds = few(hits.orderBy(F.desc("similarity"), "section_id").limit(SEEDS * limit).select(F.col("doc_id").alias("seed")).distinct())
    reached = graph.traverse_both(corpus.links, seeds, depth)
    if link_types:
        reached = reached.filter(F.col("link_type").isin(*link_types))
    reached = reached.join(corpus.documents.select(F.col("id").alias("node")), "node", "left_semi")
    prox = reached.groupBy(F.col("node").alias("doc_id")).agg(F.max(graph.proximity(F.col("depth"))).alias("prox"))
    prox = prox.unionByName(seeds.select(F.col("seed").alias("doc_id"), F.lit(1.0).alias("prox"))).groupBy("doc_id").agg(F.max("prox").alias("prox"))
    top = few(fulltext.ranked(corpus.sections, query).select("section_id", "doc_id", "rank").join(corpus.documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").orderBy("rank", "section_id").limit(CANDIDATES * limit))
    fts = fulltext.document_scores(top)
    weights = top.agg(F.when(F.count("*") > 0, TEXT_SHARE * (1 - alpha)).otherwise(0.0).alias("gamma"))
    merged = vector_scores(hits).join(prox, "doc_id", "full_outer").join(fts, "doc_id", "left").crossJoin(F.broadcast(weights))
    merged = merged.select("doc_id", "gamma", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vec", "prox", "fts")])
    score = alpha * F.col("vec") + (1 - alpha - F.col("gamma")) * F.col("prox") + F.col("gamma") * F.col("fts")
    return merged.select("doc_id", score.alias("score"), "vec", "prox", "fts")


def reason():
    """Which signals speak for a result, in words."""
    said = [F.when(F.col(c) > 0, F.format_string(f"{name}: %.3f", F.col(c))) for c, name in (("vec", "vector similarity"), ("prox", "graph proximity"), ("fts", "fulltext"))]
    return F.coalesce(F.nullif(F.concat_ws(", ", *said), F.lit("")), F.lit("graph-connected"))


def search(corpus: Corpus, query: str, query_vector: list[float] | None, limit: int = 5, depth: int = 1, link_types: list[str] | None = None, doc_type: str | None = None, alpha: float = 0.7) -> DataFrame:
    """The best documents with score, parts, reason, staleness and matching sections.

    The type filter applies to ranked candidates, before the limit.
    """
    if query_vector is None:
        return fallback(corpus, query, limit, doc_type)
    docs = corpus.documents.select(F.col("id").alias("doc_id"), "title", "filepath", "doc_type")
    hits = few(vector.topk(corpus.vectors, query_vector, CANDIDATES * limit))
    ranked = _scores(corpus, hits, query, limit, depth, link_types, alpha).join(docs, "doc_id")
    if doc_type is not None:
        ranked = ranked.filter(F.col("doc_type") == doc_type)
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    best = few(ranked.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(limit))
    total = ranked.count()
    ranked.unpersist()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "section_id"))
    shown = hits.withColumn("r", place).filter(F.col("r") <= SHOWN_SECTIONS).join(best.select("doc_id"), "doc_id", "left_semi")
    shown = corpus.sections.select("section_id", "heading", "content").join(shown, "section_id")
    shown = shown.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "heading", "content", F.col("similarity").alias("score")))), lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"), s["score"].alias("score"))).alias("sections"))
    opening_part = F.struct("heading", F.substring("content", 1, FALLBACK_CHARS).alias("content"), F.lit(0.0).alias("score"))
    first = corpus.sections.join(best.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(opening_part, "section_order").alias("opening"))
    out = best.join(shown, "doc_id", "left").join(first, "doc_id", "left")
    sections = F.coalesce("sections", F.when(F.col("opening").isNotNull(), F.array("opening")), F.array().cast("array<struct<heading:string,content:string,score:double>>"))
    level = staleness.levels(corpus.documents, corpus.refs) if corpus.refs is not None else None
    if level is not None:
        out = out.join(level, "doc_id", "left")
    state = F.coalesce("staleness", F.lit("fresh")) if level is not None else F.lit("fresh")
    parts = F.struct(F.col("vec").alias("vector"), F.col("prox").alias("graph"))
    return out.orderBy(F.desc(F.round("score", 12)), "doc_id").select("doc_id", "title", "filepath", "doc_type", "score", parts.alias("score_breakdown"), reason().alias("relevance_reason"), state.alias("staleness"), sections.alias("sections"), F.lit("hybrid").alias("search_type"), F.lit(total).cast("long").alias("total_found"))


def fallback(corpus: Corpus, query: str, limit: int = 5, doc_type: str | None = None) -> DataFrame:
    """Full text alone: the first hit of each document among the first ``limit`` hits, so fewer rows may come."""
    top = fulltext.search(corpus.sections, corpus.documents, query, limit, doc_type)
    names = corpus.documents.select(F.col("id").alias("doc_id"), "filepath")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "section_id"))
    one = top.withColumn("r", place).filter("r = 1")
    one = one.join(names, "doc_id", "left")
    return one.orderBy("rank", "section_id").select("doc_id", "title", "filepath", "doc_type", "section_id", "total_found", F.abs("rank").alias("score"), F.lit("fulltext_fallback").alias("search_type"))


def linked_pages(results: DataFrame, corpus: Corpus, chars: int = 500) -> DataFrame:
    """Direct neighbours of the results with link type and the beginning of their content (opt-in)."""
    links = corpus.links.filter(F.col("target_doc_id").isNotNull())
    both = links.select(F.col("source_doc_id").alias("doc_id"), F.col("target_doc_id").alias("page"), "type").unionByName(links.select(F.col("target_doc_id").alias("doc_id"), F.col("source_doc_id").alias("page"), "type")).distinct()
    near = results.select("doc_id").join(both, "doc_id")
    pages = corpus.documents.select(F.col("id").alias("page"), "title", "filepath")
    summary = corpus.sections.join(near.select(F.col("page").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("page")).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "content"))), lambda s: s["content"]), "\n\n"), 1, chars).alias("summary"))
    return near.join(pages, "page").join(summary, "page", "left")


def with_linked_pages(results: DataFrame, corpus: Corpus) -> DataFrame:
    """The results with ``linked_pages``: their direct neighbours as an array."""
    near = linked_pages(results, corpus)
    listed = near.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("title", "filepath", "type", "page", "summary"))).alias("linked_pages"))
    order = [F.desc(F.round("score", 12)), "doc_id"]
    return results.join(listed, "doc_id", "left").withColumn("linked_pages", F.coalesce("linked_pages", F.array().cast(listed.schema["linked_pages"].dataType))).orderBy(*order)
