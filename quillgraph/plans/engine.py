"""The facade: one project folder, its tables, and all operations on them."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config as configuration
from quillgraph import schema
from quillgraph.errors import ConcurrentWriteError, DocumentNotFoundError, IndexNotReadyError, InvalidInputError
from quillgraph.operators import fulltext, graph, hybrid, pages, staleness, suggest
from quillgraph.operators import links as linking
from quillgraph.shipping import ship
from quillgraph.sources import embeddings, markdown, migrations, store
from quillgraph.streaming import changes as streaming

# Limits of the interface (least, most, default).
LIMITS = {"search_limit": (1, 20, 5), "search_depth": (1, 3, 1), "fulltext_limit": (1, 50, 10), "context_depth": (1, 3, 1), "context_size": (1, 51200, 51200), "graph_depth": (1, 5, 2)}
TABLES = {"documents": schema.DOCUMENTS, "sections": schema.SECTIONS, "links": schema.LINKS, "refs": schema.SOURCE_REFS}


def checked(name: str, value: int | None) -> int:
    """The value, or its default; raises outside the interface's bounds."""
    low, high, default = LIMITS[name]
    value = default if value is None else value
    if not isinstance(value, int) or not low <= value <= high:
        raise InvalidInputError(f"{name} must be a whole number from {low} to {high}")
    return value


@dataclass
class IndexResult:
    files: int
    processed: int
    sections: int
    links: int
    unresolved: int
    deleted: int = 0


class Engine:
    """Operations on a project; every result is a DataFrame unless it is a single count."""

    def __init__(self, spark: SparkSession, root: str, provider: embeddings.EmbeddingProvider | None = None):
        self.spark, self.root = ship(spark), root
        self.provider = provider or embeddings.NoProvider()
        self.config = configuration.load(root) if configuration.exists(root) else configuration.Config()
        self._watch = None
        self.embedding_events = embeddings.EmbeddingEvents()

    # Tables: each write makes new versions of the tables it changes; a pointer file names the current ones.

    def _base(self) -> str:
        return os.path.join(self.root, configuration.FOLDER, "tables")

    def _pointer(self) -> str:
        return os.path.join(self._base(), "CURRENT")

    def ready(self) -> bool:
        return os.path.exists(self._pointer())

    def _versions(self) -> dict[str, str]:
        if not self.ready():
            return {}
        with open(self._pointer(), encoding="utf-8") as f:
            return json.load(f)

    def table(self, name: str) -> DataFrame:
        version = self._versions().get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self._base(), name, version))

    def _commit(self, tables: dict[str, DataFrame], seen: dict[str, str]) -> None:
        """Writes new versions and makes them current, unless another writer came between.

        A table keeps its version before, which open results may still read; older
        ones go.
        """
        now = dict(seen)
        for name, table in tables.items():
            names = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema.fields]
            now[name] = uuid.uuid4().hex
            table.select(*names).write.parquet(os.path.join(self._base(), name, now[name]))
        if self._versions() != seen:
            raise ConcurrentWriteError("the tables were changed by another writer")
        with open(f"{self._pointer()}.new", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(f"{self._pointer()}.new", self._pointer())
        for name in tables:
            folder = os.path.join(self._base(), name)
            for version in os.listdir(folder):
                if version not in (now[name], seen.get(name)):
                    shutil.rmtree(os.path.join(folder, version), ignore_errors=True)

    def _lock_file(self) -> str:
        return os.path.join(self.root, configuration.FOLDER, "serve.lock")

    def acquire_lock(self) -> tuple[bool, int | None]:
        """(True, None) if the project is now this process's, or (False, the process that has it)."""
        os.makedirs(os.path.dirname(self._lock_file()), exist_ok=True)
        for _ in range(2):
            try:
                with open(self._lock_file(), "x", encoding="utf-8") as f:
                    f.write(str(os.getpid()))
                return True, None
            except FileExistsError:
                with open(self._lock_file(), encoding="utf-8") as f:
                    owner = f.read().strip()
                if owner.isdigit() and os.path.exists(f"/proc/{owner}"):
                    return False, int(owner)
                self.release_lock()
        return False, None

    def release_lock(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self._lock_file())

    def close(self) -> None:
        self.stop_watching()
        self.release_lock()

    # Ingest

    def create_project(self) -> None:
        os.makedirs(self._base(), exist_ok=True)
        os.makedirs(os.path.join(self.root, self.config.docs_path), exist_ok=True)
        configuration.save(self.root, self.config)

    def initialize(self) -> IndexResult:
        self.create_project()
        migrations.run(self.spark, self._base(), [migrations.Migration(schema.SCHEMA_VERSION, "tables", lambda: None)])
        return self.reindex(force=True)

    def reindex(self, force: bool = False, target_file: str | None = None) -> IndexResult:
        """Indexes new and changed files; without ``target_file`` also removes what is gone.

        Links are resolved when all documents are known, so a link may point to a
        file that is read later.
        """
        os.makedirs(self._base(), exist_ok=True)
        files = self._files().cache()
        try:
            return self._index(files, files if target_file is None else files.filter(F.col("filepath") == target_file), force, target_file is None)
        finally:
            files.unpersist()

    def _files(self) -> DataFrame:
        return markdown.scan(self.spark, os.path.join(self.root, self.config.docs_path), self.config.include, self.config.exclude)

    def _index(self, files: DataFrame, chosen: DataFrame, force: bool, drop_missing: bool, removed: DataFrame | None = None) -> IndexResult:
        seen, old = self._versions(), {n: self.table(n) for n in TABLES}
        hashed = chosen.withColumn("body_hash", F.sha2(F.col("content").cast("binary"), 256))
        todo = store.to_process(old["documents"], hashed, force).select("filepath", "content").cache()
        parsed = markdown.parse_files(todo).cache()
        docs, sections, links, refs = markdown.tables(parsed, todo)
        gone = store.missing_documents(old["documents"], files) if drop_missing else old["documents"].filter(F.lit(False))
        if removed is not None:
            gone = old["documents"].join(removed, "filepath", "left_semi").select(*old["documents"].columns)
        deleted = gone.count()
        d, s, li, r = store.delete_documents(gone, old["documents"], old["sections"], old["links"], old["refs"])
        documents = store.upsert_documents(d, docs).drop("changed")
        ids = docs.select("id")
        resolved = linking.resolve(links.withColumn("link_id", F.concat_ws(":", "source_doc_id", "position")), documents)
        new_links = linking.deduplicated(resolved.withColumnRenamed("target", "target_title"))
        placed = linking.with_sections(new_links, sections.select("doc_id", "section_order", "section_id")).withColumn("created_at", F.current_timestamp())
        all_links = linking.reresolved(store.replace_by_document(li, placed, ids, "source_doc_id"), docs)
        all_sections = store.replace_sections(s, sections)
        hashes = staleness.source_hashes(self.spark, refs, self.root) if refs.limit(1).count() else self.spark.createDataFrame([], "file_path string, hash string")
        synced = store.synced_refs(refs.join(hashes, "file_path", "left"))
        all_refs = store.replace_by_document(r, synced, ids, "doc_id")
        if self.provider.dims:
            wanted = store.pending_embeddings(all_sections)
            vectors = embeddings.embed(wanted, self.provider, self.config.embedding.batch_size).cache()
            self.embedding_events.report(vectors)
            all_sections = store.set_embeddings(all_sections, vectors.filter("error is null"), self.provider.model)
        self._commit({"documents": documents, "sections": all_sections, "links": all_links, "refs": all_refs}, seen)
        count = linking.counts(self.table("links")).first()
        result = IndexResult(files.count(), todo.count(), self.table("sections").count(), count.total, count.dangling, deleted)
        todo.unpersist()
        parsed.unpersist()
        return result

    def start_watching(self, events: str | None, checkpoint: str, trigger: str | None = None):
        """Follows changes; each micro-batch is one incremental index.

        With ``events``, a folder of change events, only files that an event names
        are read.  Without, the files themselves are compared with what is stored
        at every trigger.
        """
        if events is None:
            self._watch = streaming.poll(self.spark, lambda: self.reindex() if self.pending_changes().limit(1).count() else None, checkpoint, trigger or streaming.QUIET)
            return self._watch

        def apply(changed: DataFrame, removed: DataFrame) -> None:
            files = self._files().join(changed, "filepath", "left_semi").cache()
            try:
                self._index(files, files, False, False, removed)
            finally:
                files.unpersist()

        self._watch = streaming.start(streaming.read_changes(self.spark, events), apply, checkpoint, trigger)
        return self._watch

    def pending_changes(self) -> DataFrame:
        """(type, filepath) of files that differ from what is stored."""
        now = self._files().select("filepath", F.sha2(F.col("content").cast("binary"), 256).alias("body_hash"))
        return streaming.snapshot_changes(self.table("documents"), now)

    def stop_watching(self) -> None:
        if self._watch is not None:
            self._watch.stop()
            self._watch = None

    # Queries

    def _corpus(self) -> hybrid.Corpus:
        if not self.ready():
            raise IndexNotReadyError("the project has not been indexed")
        sections = self.table("sections")
        return hybrid.Corpus(self.table("documents"), sections, self.table("links"), sections.filter(F.col("embedding").isNotNull()).select("section_id", "doc_id", "embedding"), self.table("refs"))

    def _document(self, name: str):
        found = self.table("documents").filter((F.col("id") == name) | (F.col("filepath") == name)).first()
        if found is None:
            raise DocumentNotFoundError(name)
        return found

    def search(self, query: str, limit: int | None = None, doc_type: str | None = None, depth: int | None = None, link_types: list[str] | None = None, include_linked: bool = False) -> DataFrame:
        """Results with ``total_found``, how many there would be without a limit; with linked pages on request."""
        limit, depth = checked("search_limit", limit or self.config.search.default_limit), checked("search_depth", depth or self.config.search.max_depth)
        corpus = self._corpus()
        if not self.provider.dims or not corpus.vectors.limit(1).count():
            found = hybrid.fallback(corpus, query, limit, doc_type)
        else:
            found = hybrid.search(corpus, query, self.provider.embed_query(query), limit, depth, link_types, doc_type, self.config.search.alpha)
        return hybrid.with_linked_pages(found, corpus) if include_linked else found

    def fulltext_search(self, query: str, limit: int | None = None, doc_type: str | None = None) -> DataFrame:
        return fulltext.search(self.table("sections"), self.table("documents"), query, checked("fulltext_limit", limit or self.config.search.default_limit), doc_type)

    def get_page(self, filepath: str) -> DataFrame:
        self._document(filepath)
        return pages.get_page(self.table("documents"), self.table("sections"), self.table("links"), filepath, self.table("refs"))

    def get_context(self, filepath: str, depth: int | None = None, max_size: int | None = None) -> DataFrame:
        self._document(filepath)
        depth, size = checked("context_depth", depth or self.config.search.max_depth), checked("context_size", max_size or pages.DEFAULT_BUDGET)
        return pages.get_context(self.table("documents"), self.table("sections"), self.table("links"), filepath, depth, size)

    def find_by_title(self, title: str) -> DataFrame:
        return pages.by_title(self.table("documents"), title)

    def list_pages(self, doc_type: str | None = None, sort: str = "title", order: str = "asc") -> DataFrame:
        return pages.list_pages(self.table("documents"), self.table("links"), doc_type, sort, order)

    def get_graph(self, center: str | None = None, depth: int | None = None, link_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        depth = checked("graph_depth", depth)
        if center is None:
            nodes, edges = graph.full_structure(self.table("documents"), self.table("links"))
        else:
            nodes, edges = graph.centered_structure(self.table("documents"), self.table("links"), self._document(center).id, depth, link_types)
        return graph.in_display_order(nodes), edges

    def get_status(self) -> DataFrame:
        return pages.status(self.table("documents"), self.table("sections"), self.table("links"), self.table("sections"), self.table("refs"))

    def get_stale_documents(self) -> DataFrame:
        """Checks all references against the files, stores what was found, and reports it."""
        seen, refs = self._versions(), self.table("refs")
        checked_refs = staleness.recheck(refs, staleness.source_hashes(self.spark, refs, self.root)).cache()
        if seen:
            self._commit({"refs": staleness.with_flags(refs, checked_refs)}, seen)
        return staleness.stale_documents(self.table("documents"), checked_refs)

    def suggest_links(self, threshold: float = 0.7, limit: int = 20) -> DataFrame:
        corpus = self._corpus()
        return suggest.suggest_links(corpus.documents, corpus.sections, corpus.vectors, corpus.links, threshold, limit)
