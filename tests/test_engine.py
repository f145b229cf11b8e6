import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import config, logs
from quillgraph.errors import ConcurrentWriteError, ConfigNotFoundError, DocumentNotFoundError, InvalidInputError, PathTraversalError
from quillgraph.functions.paths import contained
from quillgraph.operators import staleness
from quillgraph.plans.engine import Engine
from quillgraph.sources import embeddings, migrations, sinks, store
from quillgraph.streaming import changes


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("project"))
    write(root, "docs/intro.md", "---\ntitle: Intro\ndoc_type: guide\nsource_refs: [src/a.ts, src/gone.ts]\n---\n\nWelcome to the widget system. See [[設計 書|depends_on]] and [[missing]].\n")
    write(root, "docs/sub/設計 書.md", "---\ntitle: Design\ndoc_type: design\n---\n\nThe widget design (draft) lives here. Back to [intro](../intro.md).\n")
    write(root, "docs/node_modules/x.md", "hidden")
    write(root, "src/a.ts", "one")
    engine = Engine(spark, root, embeddings.HashingProvider(16))
    return engine, engine.initialize()


def test_index_counts(project):
    engine, result = project
    assert (result.files, result.processed, result.links, result.unresolved) == (2, 2, 3, 1)
    row = engine.get_status().first()
    assert (row.documents, row.links, row.dangling_links, row.refs) == (2, 3, 1, 2)


def test_pages_and_graph(project):
    engine, _ = project
    page = engine.get_page("intro.md").first()
    assert "Welcome" in page.content and [x.title for x in page.backlinks] == ["Design"] and page.links[0].type == "depends_on"
    assert [s.content for s in page.sections] == [page.content] and page.links[0].doc_id == page.backlinks[0].doc_id and page.updated_at is not None
    assert [r.title for r in engine.find_by_title("INTR").collect()] == ["Intro"] and engine.find_by_title("x_y").count() == 0
    assert [r.title for r in engine.list_pages().collect()] == ["Design", "Intro"]
    assert engine.list_pages("guide").count() == 1
    nodes, edges = engine.get_graph("intro.md", 1)
    assert nodes.count() == 2 and edges.count() == 2
    assert {r.title for r in engine.get_context("intro.md").collect()} == {"Design"}
    with pytest.raises(DocumentNotFoundError):
        engine.get_page("nope.md")
    with pytest.raises(InvalidInputError):
        engine.search("x", limit=99)


def test_searches(project):
    engine, _ = project
    rows = engine.search("widget design", include_linked=True).collect()
    assert len(rows) == 2 and {r.total_found for r in rows} == {2} and all([p.title for p in r.linked_pages] != [r.title] and r.linked_pages for r in rows)
    assert engine.search("widget design", limit=1).first().total_found == 2
    assert [r.title for r in engine.fulltext_search("draft").collect()] == ["Design"]
    assert engine.fulltext_search("draft", doc_type="api").count() == 0


def test_staleness_of_files(project):
    engine, _ = project
    assert engine.get_stale_documents().count() == 1
    write(engine.root, "src/a.ts", "two")
    assert engine.get_page("intro.md").first().staleness == "untracked"
    row = engine.get_stale_documents().first()
    # What the check found is stored, so pages and searches show it.
    page = engine.get_page("intro.md").first()
    assert page.staleness == "stale" and page.stale_refs == ["src/a.ts", "src/gone.ts"] and engine.get_status().first().stale_refs == 2
    assert {r.title: r.staleness for r in engine.search("widget design").collect()} == {"Intro": "stale", "Design": "fresh"}
    assert row.staleness == "stale" and {(r.file_path, r.reason) for r in row.stale_refs} == {("src/a.ts", "modified"), ("src/gone.ts", "not_found")}


def test_incremental_index(project, spark):
    engine, _ = project
    before = {r.filepath: r.id for r in engine.table("documents").collect()}
    write(engine.root, "docs/missing.md", "Now it exists.\n")
    result = engine.reindex()
    assert (result.files, result.processed, result.unresolved, result.deleted) == (3, 1, 0, 0)
    os.remove(os.path.join(engine.root, "docs/missing.md"))
    result = engine.reindex()
    assert (result.processed, result.deleted) == (0, 1)
    assert {r.filepath: r.id for r in engine.table("documents").collect()} == before


def test_watching(project, spark, tmp_path):
    engine, _ = project
    write(engine.root, "docs/new.md", "Fresh page.\n")
    events = tmp_path / "events"
    write(str(events), "1.json", '{"type":"add","filepath":"new.md","ts":"2024-01-01T00:00:00Z"}\n')
    q = engine.start_watching(str(events), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    engine.stop_watching()
    assert "new.md" in {r.filepath for r in engine.table("documents").collect()}
    write(str(events), "2.json", '{"type":"change","filepath":"new.md","ts":"2024-01-01T00:00:01Z"}\n{"type":"unlink","filepath":"new.md","ts":"2024-01-01T00:00:02Z"}\n')
    os.remove(os.path.join(engine.root, "docs/new.md"))
    engine.start_watching(str(events), str(tmp_path / "cp")).awaitTermination(120)
    assert "new.md" not in {r.filepath for r in engine.table("documents").collect()}


def test_watching_the_files_themselves(project, spark, tmp_path):
    engine, _ = project
    assert engine.pending_changes().count() == 0
    write(engine.root, "docs/seen.md", "Seen by looking.\n")
    assert [(r.type, r.filepath) for r in engine.pending_changes().collect()] == [("add", "seen.md")]
    q = engine.start_watching(None, str(tmp_path / "cp"))
    deadline = time.time() + 90
    while time.time() < deadline and engine.pending_changes().count():
        time.sleep(0.5)
    engine.stop_watching()
    assert q.exception() is None and engine.pending_changes().count() == 0 and engine.find_by_title("seen").count() == 1


def test_lock_and_concurrent_writes(project, spark):
    engine, _ = project
    other = Engine(spark, engine.root, embeddings.HashingProvider(16))
    assert engine.acquire_lock() == (True, None) and other.acquire_lock() == (False, os.getpid())
    engine.close()
    write(engine.root, ".quillgraph/serve.lock", "999999999")
    assert other.acquire_lock() == (True, None)
    other.close()
    seen = engine._versions()
    other._commit({"refs": other.table("refs")}, seen)
    with pytest.raises(ConcurrentWriteError):
        engine._commit({"refs": engine.table("refs")}, seen)
    assert len(os.listdir(os.path.join(engine._base(), "documents"))) <= 2


def test_only_named_source_files_are_read(spark, tmp_path):
    root = str(tmp_path)
    write(root, "src/a[1].ts", "one")
    write(root, "src/b.ts", "two")
    write(root, "secret.bin", "x")
    refs = spark.createDataFrame([("d", "src/a[1].ts"), ("d", "../up"), ("e", "src/none.ts")], "doc_id string, file_path string")
    found = staleness.source_hashes(spark, refs, root).collect()
    assert [(r.file_path, r.hash) for r in found] == [("src/a[1].ts", hashlib.sha256(b"one").hexdigest())]
    assert staleness.source_hashes(spark, refs.filter("false"), root).count() == 0


def test_embedding_events_and_caches(spark, tmp_path):
    events = embeddings.EmbeddingEvents()
    seen, broken = [], lambda *_: 1 / 0
    listener = lambda name, data: seen.append((name, data))
    events.on(broken)
    events.on(listener)
    rows = spark.createDataFrame([(1, None), (2, "bad")], "section_id long, error string")
    events.report(rows)
    events.report(rows.filter("false"))
    events.off(listener)
    events.report(rows)
    assert seen == [("progress", {"completed": 1, "total": 2}), ("error", {"failed": 1}), ("complete", {"completed": 1, "total": 2}), ("empty", {})]
    write(str(tmp_path), "a/b/weights.bin", "12345")
    assert embeddings.is_model_cached(str(tmp_path), "a/b") and not embeddings.is_model_cached(str(tmp_path), "a/c")
    assert embeddings.cache_size(str(tmp_path)) == 5 and embeddings.cache_size(str(tmp_path / "none")) == 0
    assert embeddings.expand_tilde("~/x") == os.path.expanduser("~/x") and embeddings.expand_tilde("a~") == "a~"


def test_migrations_json_and_logs(spark, tmp_path):
    base, done = str(tmp_path), []
    steps = [migrations.Migration(2, "two", lambda: done.append(2)), migrations.Migration(1, "one", lambda: done.append(1))]
    assert migrations.run(spark, base, steps) == done == [1, 2] and migrations.run(spark, base, steps) == []
    with pytest.raises(migrations.MigrationError) as error:
        migrations.run(spark, base, [*steps, migrations.Migration(3, "three", lambda: 1 / 0)])
    assert error.value.version == 3 and migrations.current_version(migrations.applied(spark, base)).first().version == 2
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string").orderBy("a")
    assert json.loads(sinks.printed(df)) == [{"a": 1, "b": "é"}, {"a": 2}]
    with pytest.raises(ValueError):
        sinks.printed(df, 1)
    logs.configure("info", str(tmp_path / "out.log"))
    logs.logger("x").info("seen")
    logs.logger("x").debug("not seen")
    logs.close()
    text = (tmp_path / "out.log").read_text()
    assert "seen" in text and "not seen" not in text


def test_config(tmp_path):
    root = str(tmp_path)
    with pytest.raises(ConfigNotFoundError):
        config.load(root)
    config.save(root, config.merged({"docs_path": "d", "search": {"alpha": 0.5, "odd": 1}, "embedding": None}))
    got = config.load(root)
    assert got.docs_path == "d" and got.search.alpha == 0.5 and got.search.max_depth == 2 and got.embedding.dimensions == 1024
    assert config.clean(root) and not config.exists(root) and not config.clean(root)


def test_containment():
    assert contained("a/../b.md", "/root/x") == "/root/x/b.md"
    for bad in ("../y", "/etc/passwd"):
        with pytest.raises(PathTraversalError):
            contained(bad, "/root/x")


def test_levels(spark):
    docs = spark.createDataFrame([("a",)], "id string")
    refs = spark.createDataFrame([("a", "x", "h", False), ("b", "x", "h", True), ("c", "x", "", True), ("d", "x", "", True), ("d", "y", "h", True)], "doc_id string, file_path string, last_synced_hash string, is_stale boolean")
    assert {r.doc_id: r.staleness for r in staleness.levels(docs, refs).collect()} == {"a": "fresh", "b": "stale", "c": "untracked", "d": "stale"}
    assert staleness.summary(refs).first().asDict() == {"fresh": 1, "stale": 4, "total": 5}
    assert staleness.summary(refs.filter("false")).first().asDict() == {"fresh": 0, "stale": 0, "total": 0}


def test_section_replacement_drops_old_embeddings(spark):
    kind = "section_id long, doc_id string, heading string, section_order int, content string, content_hash string, embedding array<double>"
    old = spark.createDataFrame([(1, "a", None, 0, "x", "hx", [1.0]), (2, "a", None, 1, "y", "hy", [2.0]), (3, "a", None, 2, "z", "hz", [3.0]), (4, "b", None, 0, "w", "hw", [4.0])], kind)
    new = spark.createDataFrame([("a", "H", 0, "x", "hx"), ("a", None, 1, "y2", "hy2"), ("a", None, 3, "n", "hn")], "doc_id string, heading string, section_order int, content string, content_hash string")
    actions = {r.section_order: r.action for r in store.diff_sections(old.filter("doc_id = 'a'"), new).collect()}
    assert actions == {0: "keep", 1: "update", 2: "delete", 3: "insert"}
    got = {(r.doc_id, r.section_order): r for r in store.replace_sections(old, new).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 3), ("b", 0)}
    assert got["a", 0].heading is None and got["a", 0].embedding == [1.0]
    assert got["a", 1].section_id == 2 and got["a", 1].embedding is None and got["a", 1].content == "y2"


def test_embedding_retries_singly(spark):
    class Flaky:
        model, dims = "flaky", 1

        def embed_batch(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "h", "good"), (2, None, "bad"), (3, "", "fine")], "section_id long, heading string, content string")
    got = {r.section_id: (r.embedding, r.error) for r in embeddings.embed(rows, Flaky()).collect()}
    assert got == {1: ([6.0], None), 2: (None, "bad text"), 3: ([4.0], None)}
    jobs = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "section_id long, content string, position int")
    assert [r.content for r in embeddings.latest_jobs(jobs).collect()] == ["b"]


def test_debounce(spark):
    rows = spark.createDataFrame([("a", "add", "2024-01-01 00:00:00.0"), ("a", "change", "2024-01-01 00:00:00.3"), ("a", "unlink", "2024-01-01 00:00:02.0"), ("b", "add", "2024-01-01 00:00:00.1")], "filepath string, type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.filepath, r.type, r.events) for r in changes.debounced(rows).collect()) == [("a", "change", 2), ("a", "unlink", 1), ("b", "add", 1)]
    assert changes.inside(rows.withColumn("filepath", F.lit("../x"))).count() == 0
