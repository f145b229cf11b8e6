"""Registered queries over the test tables, one per operator or operation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import paths, text
from quillgraph.operators import fulltext, graph, hybrid, links, pages, staleness, suggest, vector
from quillgraph.plans import views
from quillgraph.sources import embeddings, markdown, migrations, sinks, store
from quillgraph.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CENTER, TOP, WORDS, NO_WORDS = 7, 10, "than the", "zzqzzq"
FILTERED_TYPES = ["references", "depends_on"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _corpus(spark: SparkSession, sf: str) -> hybrid.Corpus:
    return hybrid.Corpus(views.documents(spark, sf), views.sections(spark, sf), views.links(spark, sf), views.vectors(spark, sf))


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vector.topk(views.vectors(spark, sf), views.query_vector(spark, sf), TOP), "similarity")


@query
def vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vector.neighbours(views.vectors(spark, sf), 3), "similarity")


@query
def fulltext_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(fulltext.ranked(views.sections(spark, sf), WORDS), "rank").select("section_id", "doc_id", "rank")


@query
def fulltext_doc_type_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    found = fulltext.search(views.sections(spark, sf), views.documents(spark, sf), WORDS, TOP, "guide")
    return _rounded(found, "rank").select("section_id", "doc_id", "title", "doc_type", "heading", "rank")


def _all_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return views.documents(spark, sf).select(F.col("id").alias("seed"))


@query
def graph_forward(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_documents(graph.traverse(views.links(spark, sf), _all_seeds(spark, sf), 2), views.documents(spark, sf))


@query
def graph_backward(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_documents(graph.traverse(views.links(spark, sf), _all_seeds(spark, sf), 2, forward=False), views.documents(spark, sf))


@query
def graph_bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_documents(graph.traverse_both(views.links(spark, sf), _all_seeds(spark, sf), 2), views.documents(spark, sf))


@query
def graph_link_types(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_documents(graph.traverse(views.links(spark, sf), _all_seeds(spark, sf), 3, FILTERED_TYPES), views.documents(spark, sf))


@query
def graph_full_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.full_structure(views.documents(spark, sf), views.links(spark, sf))[0]


@query
def graph_full_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.full_structure(views.documents(spark, sf), views.links(spark, sf))[1]


@query
def graph_centered_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.centered_structure(views.documents(spark, sf), views.links(spark, sf), CENTER, 2)[0]


@query
def graph_centered_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.centered_structure(views.documents(spark, sf), views.links(spark, sf), CENTER, 2)[1]


@query
def graph_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.proximity_scores(graph.traverse_both(views.links(spark, sf), _all_seeds(spark, sf), 2))


@query
def hybrid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.scores(_corpus(spark, sf), WORDS, views.query_vector(spark, sf), TOP, 2), "score", "vec", "prox", "fts")


@query
def hybrid_no_fts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.scores(_corpus(spark, sf), NO_WORDS, views.query_vector(spark, sf), TOP, 1), "score", "vec", "prox", "fts")


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = hybrid.search(_corpus(spark, sf), WORDS, views.query_vector(spark, sf), 5, 2)
    return _rounded(found, "score").select("doc_id", "title", "doc_type", "score", "relevance_reason")


@query
def fts_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.fallback(_corpus(spark, sf), WORDS, TOP), "score")


@query
def hybrid_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    found = hybrid.search(_corpus(spark, sf), WORDS, views.query_vector(spark, sf), 5, 2, doc_type="guide")
    return _rounded(found, "score").select("doc_id", "score", "total_found")


@query
def hybrid_link_types(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.scores(_corpus(spark, sf), WORDS, views.query_vector(spark, sf), TOP, 2, FILTERED_TYPES), "score", "vec", "prox", "fts")


@query
def hybrid_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = hybrid.search(_corpus(spark, sf), WORDS, views.query_vector(spark, sf), 20, 2)
    shown = found.select("doc_id", "filepath", F.posexplode("sections").alias("place", "s")).select("doc_id", "filepath", "place", "s.*")
    return _rounded(shown, "score").withColumn("place", F.col("place").cast("long"))


@query
def hybrid_linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with their direct neighbours both ways and what they begin with."""
    corpus = _corpus(spark, sf)
    found = hybrid.linked_pages(corpus.documents.select(F.col("id").alias("doc_id")), corpus)
    return found.select("doc_id", "page", "type", "title", "filepath", "summary")


@query
def fulltext_snippets(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sections(spark, sf)
    return s.filter(F.col("content").isNotNull()).select("section_id", fulltext.snippet(F.col("content"), WORDS).alias("snippet"))


@query
def title_search(spark: SparkSession, sf: str) -> DataFrame:
    return pages.by_title(views.documents(spark, sf), "DOC 0_0000").select("id", "title")


@query
def list_pages_of_type(spark: SparkSession, sf: str) -> DataFrame:
    return pages.list_pages(views.documents(spark, sf), views.links(spark, sf), "guide", "filepath", "desc").select("id", "title", "link_count")


@query
def page_payload(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    checked = staleness.recheck(views.refs(spark, sf), views.files(spark, sf))
    found = pages.pages(docs, docs, views.sections(spark, sf), views.links(spark, sf).withColumn("context", F.lit(None).cast("string")), checked)
    ends = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["doc_id"], x["type"])), ","), F.lit(""))
    return found.select("doc_id", "title", F.sha2("content", 256).alias("content_hash"), F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("sections"), ends(F.col("links")).alias("outgoing"), ends(F.col("backlinks")).alias("incoming"), "staleness", F.coalesce(F.array_join("stale_refs", ","), F.lit("")).alias("stale_refs"))

@query
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    content = pages.joined_content(views.sections(spark, sf), True)
    return content.select("doc_id", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@query
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    found = views.links(spark, sf).withColumn("context", F.lit(None).cast("string"))
    both = docs.select(F.col("id").alias("doc_id")).join(pages.neighbours(docs, found, False), "doc_id", "left").join(pages.neighbours(docs, found, True), "doc_id", "left")
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["title"], x["type"])), ","), F.lit(""))
    return both.select("doc_id", names(F.col("links")).alias("outgoing"), names(F.col("backlinks")).alias("incoming"))


@query
def list_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.list_pages(views.documents(spark, sf), views.links(spark, sf)).select("id", "filepath", "title", "doc_type", "link_count")


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    checked = staleness.recheck(views.refs(spark, sf), views.files(spark, sf))
    return pages.status(views.documents(spark, sf), views.sections(spark, sf), views.links(spark, sf), views.vectors(spark, sf), checked)


@query
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.contexts(views.documents(spark, sf), views.sections(spark, sf), views.links(spark, sf), _all_seeds(spark, sf), 1, 8000)
    return found.select("seed", "center_size", "total_size", "truncated", F.array_join(F.transform("related", lambda r: r["node"].cast("string")), ",").alias("taken"))


@query
def stale_documents(spark: SparkSession, sf: str) -> DataFrame:
    checked = staleness.recheck(views.refs(spark, sf), views.files(spark, sf))
    found = staleness.stale_documents(views.documents(spark, sf), checked)
    return found.select("doc_id", "title", "staleness", F.array_join(F.transform("stale_refs", lambda r: F.concat_ws(":", r["file_path"], r["reason"])), ",").alias("stale_refs"))


@query
def stale_summary(spark: SparkSession, sf: str) -> DataFrame:
    return staleness.summary(staleness.recheck(views.refs(spark, sf), views.files(spark, sf)))


@query
def suggest_links(spark: SparkSession, sf: str) -> DataFrame:
    found = suggest.suggest_links(views.documents(spark, sf), views.sections(spark, sf), views.vectors(spark, sf), views.links(spark, sf), 0.3, 50)
    return _rounded(found, "similarity")


def _targets(spark: SparkSession, sf: str, by_path: bool) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("n"), ((i * 3) % 101).cast("string"))
    target = F.concat_ws("/", F.coalesce("lang", F.lit("")), name) if by_path else name
    own = views.nested_documents(spark, sf).select(F.col("id").alias("doc_id"), F.col("filepath").alias("source_path"))
    return views.table(spark, sf, "documents").join(own, "doc_id").select(i.alias("link_id"), target.alias("target"), "source_path")


@query
def link_resolution_name(spark: SparkSession, sf: str) -> DataFrame:
    return links.resolve(_targets(spark, sf, False), views.nested_documents(spark, sf)).select("link_id", "status", "target_doc_id", "filepath", "ambiguous")


@query
def link_resolution_path(spark: SparkSession, sf: str) -> DataFrame:
    return links.resolve(_targets(spark, sf, True), views.nested_documents(spark, sf)).select("link_id", "status", "target_doc_id", "filepath", "ambiguous")


@query
def ambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    found = links.ambiguous_names(links.file_index(views.nested_documents(spark, sf)))
    return found.select("name", F.size("filepaths").cast("long").alias("files"))


@query
def link_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return links.deduplicated(views.links(spark, sf))


@query
def link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return links.counts(views.links(spark, sf))


@query
def dangling_reresolve(spark: SparkSession, sf: str) -> DataFrame:
    return links.reresolved(views.links(spark, sf), views.documents(spark, sf))


def _next_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A second parse: some sections are gone, some changed, some new."""
    s = views.sections(spark, sf)
    i = F.col("section_id")
    kept = s.filter(i % 11 != 0).withColumn("content", F.when(i % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    new = s.filter(i % 13 == 0).withColumn("section_order", F.col("section_order") + 50_000)
    return kept.unionByName(new).withColumn("content_hash", text.content_hash(F.col("content")))


@query
def section_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = views.sections(spark, sf).withColumn("content_hash", text.content_hash(F.col("content")))
    return store.diff_sections(old, _next_sections(spark, sf))


@query
def doc_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")
    old = views.documents(spark, sf).filter(F.col("id") % 9 != 0).withColumns({"created_at": stamp(1), "updated_at": stamp(1)})
    new = views.documents(spark, sf).withColumns({"body_hash": F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("body_hash")), "created_at": stamp(2), "updated_at": stamp(2)})
    return store.upsert_documents(old, new).select("id", "body_hash", "created_at", "updated_at", "changed")


@query
def delete_missing_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs, refs = views.documents(spark, sf), views.refs(spark, sf)
    gone = store.missing_documents(docs, docs.filter(F.col("id") % 10 != 0))
    left = store.delete_documents(gone, docs, views.sections(spark, sf), views.links(spark, sf), refs)
    out = None
    for name, df in zip(("documents", "sections", "links", "refs"), left, strict=True):
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    docs, p = views.nested_documents(spark, sf), F.col("filepath")
    return docs.select("id", paths.file_name(p).alias("name"), paths.directory(p).alias("folder"), paths.title_of(F.lit(None).cast("string"), p).alias("title"), paths.normal_name(p).alias("normal"), paths.resolved_path(paths.directory(p), F.lit("../x/./y.md")).alias("linked"), F.size(paths.suffixes(p)).cast("long").alias("depth"))


@query
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.documents(spark, sf).filter(paths.matches_globs(F.col("filepath"), ("src1*/**/*.md",), ("**/de/**",))).select("filepath")


def _linked_files(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    s = i.cast("string")
    body = F.concat(F.lit("# Page\n\nSee [[page "), s, F.lit("|implements]] and `[[code]]`, [[other|odd]] or [text](../b/p%20"), s, F.lit(".md#part) and [web](https://example.org/x.md).\n\n```\n[[fenced]]\n```\n"))
    return views.table(spark, sf, "documents").select(F.concat(F.lit("a/"), s, F.lit(".md")).alias("filepath"), body.alias("content"))


@query
def markdown_links(spark: SparkSession, sf: str) -> DataFrame:
    found = markdown.parse_files(_linked_files(spark, sf))
    return found.select("filepath", F.explode("links").alias("l")).select("filepath", "l.target", "l.type", "l.position")


@query
def markdown_link_contexts(spark: SparkSession, sf: str) -> DataFrame:
    found = markdown.parse_files(_linked_files(spark, sf))
    return found.select("filepath", F.explode("links").alias("l")).filter("l.position = 0").select("filepath", "l.context", "l.section_order")


@query
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Generated files with a first, a middling, a tiny and a long section."""
    i = F.col("doc_id")
    words = lambda name, n: F.concat(F.repeat(F.lit(f"{name} "), n), F.lit(name))
    long = F.concat_ws("\n\n", *[words(f"d{k}", F.lit(79)) for k in range(5)])
    body = F.concat(F.lit("## A\n\n"), words("a", (i % 60).cast("int")), F.lit("\n\n## B\n\n"), words("b", (i % 45).cast("int")), F.lit("\n\n### C\n\ntiny one\n\n#### deep\n\n## D\n\n"), long)
    files = views.table(spark, sf, "documents").select(i.cast("string").alias("filepath"), body.alias("content"))
    return markdown.parse_files(files).select("filepath", F.explode("sections").alias("s")).select("filepath", "s.section_order", "s.heading", "s.token_count")


@query
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter of generated files: titles, types and references."""
    i = F.col("doc_id")
    front = F.concat(F.lit("---\ntitle: Page "), i.cast("string"), F.lit("\ndoc_type: "), F.when(i % 2 == 0, "api").otherwise("unheard"), F.lit("\nsource_refs: [src/a.ts, ../b.ts]\n---\n\nText\n"))
    files = views.table(spark, sf, "documents").select(i.cast("string").alias("filepath"), front.alias("content"))
    return markdown.parse_files(files).select("filepath", "title", "doc_type", F.array_join("source_refs", ",").alias("source_refs"), F.size("warnings").cast("long").alias("warnings"))


@query
def debounce_events(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("user_id"), F.col("event_type").alias("type"), "ts", "event_id")
    found = changes.debounced(e.withColumn("type", F.struct("event_id", "type")), "10 minutes", key="user_id")
    return found.select("user_id", F.col("ts"), "events")


@query
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    before, now = docs.filter(F.col("id") % 4 != 0), docs.filter(F.col("id") % 5 != 0).withColumn("body_hash", F.when(F.col("id") % 3 == 0, "changed").otherwise(F.col("body_hash")))
    return changes.snapshot_changes(before, now)


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with the vectors they have; every third vector is of an older model."""
    v = views.vectors(spark, sf).select("section_id", F.col("embedding").cast("array<double>").alias("embedding"))
    model = F.when(F.col("embedding").isNotNull(), F.when(F.col("section_id") % 3 == 0, "old").otherwise("new"))
    return views.sections(spark, sf).join(v, "section_id", "left").withColumn("embedding_model", model)


@query
def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return store.pending_embeddings(_embedded(spark, sf)).select("section_id", "doc_id")


@query
def other_model_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return store.other_model(_embedded(spark, sf), "new").select("section_id", "doc_id")


@query
def embedding_sink(spark: SparkSession, sf: str) -> DataFrame:
    new = views.vectors(spark, sf).filter(F.col("section_id") % 2 == 0).select((F.col("section_id") + 1).alias("section_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    found = store.set_embeddings(_embedded(spark, sf), new, "newest")
    return found.select("section_id", F.size("embedding").alias("dims"), "embedding_model").filter("dims > 0")


@query
def embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    whole = text.embedding_text(F.col("heading"), F.col("content"))
    return views.sections(spark, sf).filter(F.col("content").isNotNull()).select("section_id", text.model_input(whole, "e5-small", False, 60).alias("passage"), text.model_input(F.col("content"), "e5-small", True, 40).alias("query"), text.model_input(whole, "bge", False, 50).alias("plain"))


@query
def embedding_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = views.table(spark, sf, "events").select(F.col("user_id").alias("section_id"), "event_type", F.col("event_id").alias("position"))
    return embeddings.latest_jobs(jobs)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return views.vectors(spark, sf).select("section_id", "doc_id", F.get("embedding", 0).cast("double").alias("x"))


@query
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    moved = index.filter(F.col("section_id") % 4 == 0).select(F.col("section_id") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1), "doc_id", F.lit(9.0)).toDF("section_id", "doc_id", "x")
    return _rounded(vector.latest(index, moved), "x")


@query
def vector_remove(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vector.without(_index(spark, sf), views.documents(spark, sf).filter(F.col("id") % 3 == 0).select(F.col("id").alias("doc_id")), "doc_id"), "x")


@query
def dangling_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.dangling(views.links(spark, sf)).select("source_doc_id", "type", "target_title")


@query
def link_sections(spark: SparkSession, sf: str) -> DataFrame:
    placed = views.links(spark, sf).withColumn("section_order", (F.col("position") - 1).cast("int"))
    return links.with_sections(placed, views.sections(spark, sf)).select("source_doc_id", "position", "source_section_id")


@query
def link_detach(spark: SparkSession, sf: str) -> DataFrame:
    placed = views.links(spark, sf).withColumn("source_section_id", F.col("source_doc_id") * views.PLACES + F.col("position") - 1)
    left = views.sections(spark, sf).filter(F.col("section_id") % 2 == 0)
    return store.detach_sections(placed, left).select("source_doc_id", "position", "source_section_id")


@query
def link_replace(spark: SparkSession, sf: str) -> DataFrame:
    old = views.links(spark, sf)
    parsed = views.documents(spark, sf).filter(F.col("id") % 4 == 0).select("id")
    new = old.filter((F.col("source_doc_id") % 4 == 0) & (F.col("position") < 3)).withColumn("type", F.lit("extends"))
    return store.replace_by_document(old, new, parsed, "source_doc_id").select("source_doc_id", "position", "type")


@query
def section_replace(spark: SparkSession, sf: str) -> DataFrame:
    old = _embedded(spark, sf).withColumn("content_hash", text.content_hash(F.col("content"))).drop("embedding_model")
    new = _next_sections(spark, sf).drop("section_id").join(views.documents(spark, sf).filter(F.col("id") % 2 == 0).select(F.col("id").alias("doc_id")), "doc_id")
    found = store.replace_sections(old, new)
    return found.select("doc_id", "section_order", "content_hash", F.col("embedding").isNotNull().alias("embedded"))


@query
def refs_sync(spark: SparkSession, sf: str) -> DataFrame:
    read = views.refs(spark, sf).select("doc_id", "file_path").join(views.files(spark, sf), "file_path", "left")
    return store.synced_refs(read).drop("last_synced_at")


@query
def stale_flags(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.refs(spark, sf)
    return staleness.with_flags(refs, staleness.recheck(refs, views.files(spark, sf))).select("doc_id", "file_path", "is_stale")


@query
def stale_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Stale references of the one document that is asked for."""
    return staleness.stale_paths(staleness.recheck(views.refs(spark, sf), views.files(spark, sf)), CENTER)


@query
def skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    new = docs.withColumn("body_hash", F.when(F.col("id") % 6 == 0, "changed").otherwise(F.col("body_hash")))
    return store.to_process(docs.filter(F.col("id") % 5 != 0), new).select("filepath", "body_hash")


@query
def path_guard(spark: SparkSession, sf: str) -> DataFrame:
    p = F.concat(F.when(F.col("id") % 3 == 0, "../").when(F.col("id") % 3 == 1, "/").otherwise("a..b/"), F.col("filepath"), F.when(F.col("id") % 5 == 0, "/..").otherwise(""))
    return changes.inside(views.documents(spark, sf).select(p.alias("filepath")))


@query
def change_bursts(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("filepath"), F.col("event_type").alias("type"), F.struct("ts", "event_id").alias("ts"))
    return changes.last_of_each(e)


@query
def fulltext_index_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches through the index, after a third of the sections changed and some were removed."""
    s = views.sections(spark, sf).filter(F.col("content").isNotNull())
    old = s.withColumn("content", F.when(F.col("section_id") % 3 == 0, F.lit("stale words than the")).otherwise(F.col("content")))
    index = fulltext.synced_index(fulltext.trigram_index(old), s.filter(F.col("section_id") % 3 == 0), s.filter(F.col("section_id") % 10 == 1))
    return fulltext.indexed_matches(index, s, WORDS)


@query
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_lines(views.documents(spark, sf).select("id", "title", "doc_type"))


@query
def schema_version(spark: SparkSession, sf: str) -> DataFrame:
    steps = views.table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("version"))
    return migrations.current_version(steps)
