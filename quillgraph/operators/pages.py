"""Pages, lists, contexts under a size budget, and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph, staleness

SUMMARY_CHARS, DEFAULT_BUDGET = 500, 50_000


def joined_content(sections: DataFrame, headings: bool = False) -> DataFrame:
    """(doc_id, content): sections in order, separated by blank lines; headings on request."""
    text = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("## "), "heading", F.lit("\n\n"), "content")).otherwise(F.col("content")) if headings else F.col("content")
    parts = F.array_sort(F.collect_list(F.struct("section_order", text.alias("t"))))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("content"))


def neighbours(documents: DataFrame, links: DataFrame, incoming: bool) -> DataFrame:
    """(doc_id, links): the documents a page links to, or that link to it, as an array."""
    own, other = ("target_doc_id", "source_doc_id") if incoming else ("source_doc_id", "target_doc_id")
    named = documents.select(F.col("id").alias(other), "title", "filepath")
    found = links.join(named, other).select(F.col(own).alias("doc_id"), F.struct("title", "filepath", "type", "context", F.col(other).alias("doc_id")).alias("link"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list("link")).alias("backlinks" if incoming else "links"))


def _with_links(pages: DataFrame, documents: DataFrame, links: DataFrame, ids: DataFrame, every: DataFrame | None = None) -> DataFrame:
    out = links.join(ids.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id", "left_semi")
    into = links.join(ids.withColumnRenamed("doc_id", "target_doc_id"), "target_doc_id", "left_semi")
    names = every if every is not None else documents
    return pages.join(neighbours(names, out, False), "doc_id", "left").join(neighbours(names, into, True), "doc_id", "left")


def _with_staleness(pages: DataFrame, documents: DataFrame, refs: DataFrame | None) -> DataFrame:
    if refs is None:
        return pages.withColumn("staleness", F.lit("fresh"))
    stale = refs.filter("is_stale").groupBy("doc_id").agg(F.array_sort(F.collect_list("file_path")).alias("stale_refs"))
    out = pages.join(staleness.levels(documents, refs), "doc_id", "left").join(stale, "doc_id", "left")
    return out.withColumn("staleness", F.coalesce("staleness", F.lit("fresh")))


def pages(documents: DataFrame, chosen: DataFrame, sections: DataFrame, links: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """One row per chosen document: content, sections, links both ways (dangling ones left out), staleness and stale paths."""
    ids = chosen.select(F.col("id").alias("doc_id"))
    own = sections.join(ids, "doc_id", "left_semi")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section_order", "heading", "content"))), lambda p: F.struct(p["heading"].alias("heading"), p["content"].alias("content")))
    out = chosen.withColumnRenamed("id", "doc_id").join(joined_content(own, True), "doc_id", "left").join(own.groupBy("doc_id").agg(parts.alias("sections")), "doc_id", "left")
    return _with_staleness(_with_links(out, documents, links, ids, documents), documents, refs)


def get_page(documents: DataFrame, sections: DataFrame, links: DataFrame, filepath: str, refs: DataFrame | None = None) -> DataFrame:
    return pages(documents, documents.filter(F.col("filepath") == filepath), sections, links, refs)


def by_title(documents: DataFrame, title: str) -> DataFrame:
    """Documents whose title has the given part, in either case; % and _ stand for any characters, as in LIKE."""
    return documents.filter(F.col("title").ilike(f"%{title}%"))


def list_pages(documents: DataFrame, links: DataFrame, doc_type: str | None = None, sort: str = "title", order: str = "asc") -> DataFrame:
    """Documents with the number of their outgoing links, dangling ones included.

    Unknown sort keys, and the path, sort by title.
    """
    if doc_type is not None:
        documents = documents.filter(F.col("doc_type") == doc_type)
    counts = links.groupBy(F.col("source_doc_id").alias("id")).agg(F.count("*").alias("link_count"))
    out = documents.join(counts, "id", "left").fillna(0, ["link_count"])
    key = F.col(sort if sort in ("title", "created_at", "updated_at") and sort in documents.columns else "title")
    return out.orderBy(key.desc() if order == "desc" else key.asc(), "id")


def within_budget(items: Column, start: Column, most: int) -> Column:
    """Greedy choice in order: (total, truncated, taken).

    An item that does not fit is skipped and counted; later ones may still fit.
    Items have ``size`` and any other fields.
    """
    kind = "array<int>"

    def step(acc: Column, x: Column) -> Column:
        fits = acc["total"] + x["size"] <= most
        return F.struct(
            F.when(fits, acc["total"] + x["size"]).otherwise(acc["total"]).alias("total"),
            F.when(fits, acc["truncated"]).otherwise(acc["truncated"] + 1).alias("truncated"),
            F.when(fits, F.array_append(acc["taken"], x["place"])).otherwise(acc["taken"]).alias("taken"),
        )

    zero = F.struct(start.cast("long").alias("total"), F.lit(0).alias("truncated"), F.array().cast(kind).alias("taken"))
    return F.aggregate(items, zero, step)


def contexts(documents: DataFrame, sections: DataFrame, links: DataFrame, centers: DataFrame, depth: int = 2, most: int = DEFAULT_BUDGET) -> DataFrame:
    """Per center: its content, the related documents that fit the budget, sizes and the number left out.

    ``centers`` has one column, ``seed``.  Related documents come by depth, then
    title; each counts with its summary, the first ``SUMMARY_CHARS`` characters.  The
    center always counts in full.
    """
    content = joined_content(sections).withColumn("size", F.length("content").cast("long"))
    related = graph.with_documents(graph.traverse_both(links, centers, depth), documents)
    sized = related.join(content.select(F.col("doc_id").alias("node"), F.least("size", F.lit(SUMMARY_CHARS).cast("long")).alias("size")), "node", "left").fillna(0, ["size"])
    packed = F.struct("depth", "title", "node", "size", "link_type", F.when(F.col("direction") == graph.OUT, "outlink").otherwise("backlink").alias("direction"))
    lists = sized.groupBy("seed").agg(F.array_sort(F.collect_list(packed)).alias("related"))
    own = centers.join(content.select(F.col("doc_id").alias("seed"), F.col("size").alias("center_size")), "seed", "left").fillna(0, ["center_size"])
    out = own.join(lists, "seed", "left")
    items = F.transform(F.coalesce("related", F.array().cast(lists.schema["related"].dataType)), lambda r, i: F.struct(r["size"].alias("size"), i.alias("place")))
    out = out.withColumn("chosen", within_budget(items, F.col("center_size"), most))
    taken = F.transform("chosen.taken", lambda i: F.get(F.col("related"), i))
    return out.select("seed", "center_size", F.col("chosen.total").alias("total_size"), F.col("chosen.truncated").alias("truncated"), taken.alias("related"))


def get_context(documents: DataFrame, sections: DataFrame, links: DataFrame, filepath: str, depth: int = 2, most: int = DEFAULT_BUDGET) -> DataFrame:
    """The context of one document with the summaries of what was chosen."""
    center = documents.filter(F.col("filepath") == filepath).select(F.col("id").alias("seed"))
    chosen = contexts(documents, sections, links, center, depth, most)
    one = chosen.select("seed", "total_size", "truncated", F.explode_outer("related").alias("r"))
    ids = one.select(F.col("r.node").alias("doc_id")).unionByName(center.withColumnRenamed("seed", "doc_id")).distinct()
    texts = joined_content(sections.join(ids, "doc_id", "left_semi"))
    own = texts.select(F.col("doc_id").alias("seed"), F.col("content").alias("center_content"))
    return one.join(own, "seed", "left").join(texts.select(F.col("doc_id").alias("node"), "content"), F.col("r.node") == F.col("node"), "left").select("seed", "center_content", "total_size", "truncated", "r.*", F.substring("content", 1, SUMMARY_CHARS).alias("summary"))


def status(documents: DataFrame, sections: DataFrame, links: DataFrame, vectors: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """One row of counts over all tables; ``stale_refs`` counts references, not documents."""
    parts = [
        documents.agg(F.count("*").alias("documents")),
        sections.agg(F.count("*").alias("sections")),
        links.agg(F.count("*").alias("links"), F.count("target_doc_id").alias("resolved_links"), F.count_if(F.col("target_doc_id").isNull()).alias("dangling_links")),
    ]
    if vectors is not None:
        parts.append(vectors.agg(F.count("embedding").alias("embedded_sections")))
    if refs is not None:
        parts.append(staleness.summary(refs).select(F.col("total").alias("refs"), F.col("stale").alias("stale_refs")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
