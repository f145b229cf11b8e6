"""Document-graph views over the test tables, as DataFrames and as DuckDB SQL.

The tables hold no Markdown graph, so one is derived by fixed rules: every
document is a page, every line a section, every document links to three others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.schema import LINK_TYPES, STORED_DOC_TYPES

PLACES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(i.cast("string"), F.lit(".md")))
    kind = F.get(F.array(*map(F.lit, STORED_DOC_TYPES)), (i % 6).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("id"), path.alias("filepath"), F.concat(F.lit("doc "), F.lpad(i.cast("string"), 8, "0")).alias("title"), kind.alias("doc_type"), F.sha2(F.col("text").cast("binary"), 256).alias("body_hash"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_order", "content"))
    heading = F.when(F.col("section_order") > 0, F.concat(F.lit("Part "), F.col("section_order").cast("string")))
    return lines.select((F.col("doc_id") * PLACES + F.col("section_order")).alias("section_id"), "doc_id", "section_order", heading.alias("heading"), "content")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    rows = docs.select("doc_id", k).crossJoin(F.broadcast(n))
    i, k = F.col("doc_id"), F.col("k")
    target = F.when((i + k) % 11 != 0, (i * (2 * k + 1) + 7 * k) % F.col("n"))
    kind = F.get(F.array(*map(F.lit, LINK_TYPES)), ((i + k) % 5).cast("int"))
    return rows.select(i.alias("source_doc_id"), target.alias("target_doc_id"), kind.alias("type"), k.alias("position"), F.concat(F.lit("doc "), F.lpad(((i + k) % F.col("n")).cast("string"), 8, "0")).alias("target_title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((F.floor(v / 3) * PLACES + v % 3).alias("section_id"), F.floor(v / 3).alias("doc_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that searches ask for: that of the first row of the table by id."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first().embedding


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("src/"), i, F.lit(".ts")).alias("file_path"), F.when(F.col("quality") == 0, "").otherwise(F.sha2(i.cast("binary"), 256)).alias("last_synced_hash"), F.lit(False).alias("is_stale"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as found now: every seventh is gone, those of toxic rows have changed."""
    i = F.col("doc_id").cast("string")
    now = F.when(F.col("toxic") == 1, F.concat(F.lit("new"), i)).otherwise(i)
    return table(spark, sf_dir, "labels").filter(F.col("doc_id") % 7 != 0).select(F.concat(F.lit("src/"), i, F.lit(".ts")).alias("file_path"), F.sha2(now.cast("binary"), 256).alias("hash"))


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in folders of one to three levels, 97 file names for all of them."""
    i = F.col("doc_id")
    s, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    folder = F.when(i % 3 == 0, s).when(i % 3 == 1, F.concat_ws("/", s, lang)).otherwise(F.concat_ws("/", s, lang, (i % 5).cast("string")))
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(folder, F.lit("/N"), (i % 97).cast("string"), F.lit(".md")).alias("filepath"))


_TYPES = "['" + "', '".join(STORED_DOC_TYPES) + "']"
_LINKS = "['" + "', '".join(LINK_TYPES) + "']"

#: The same views for DuckDB, to stand behind WITH.
SQL = f"""
docs_v AS (
  SELECT doc_id AS id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.md' AS filepath,
    'doc ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS title, {_TYPES}[CAST(doc_id % 6 + 1 AS INT)] AS doc_type, sha256(text) AS body_hash FROM documents),
sections_v AS (
  SELECT doc_id * {PLACES} + pos - 1 AS section_id, doc_id, CAST(pos - 1 AS INT) AS section_order,
    CASE WHEN pos > 1 THEN 'Part ' || (pos - 1) END AS heading, lines[pos] AS content
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
links_v AS (
  SELECT doc_id AS source_doc_id, CASE WHEN (doc_id + k) % 11 <> 0 THEN (doc_id * (2 * k + 1) + 7 * k) % n END AS target_doc_id,
    {_LINKS}[CAST((doc_id + k) % 5 + 1 AS INT)] AS type, k AS position, 'doc ' || lpad(CAST((doc_id + k) % n AS VARCHAR), 8, '0') AS target_title
  FROM documents, (SELECT unnest([1, 2, 3]) AS k), (SELECT count(*) AS n FROM documents)),
vectors_v AS (SELECT (vec_id // 3) * {PLACES} + vec_id % 3 AS section_id, vec_id // 3 AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
query_v AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
refs_v AS (SELECT doc_id, 'src/' || doc_id || '.ts' AS file_path, CASE WHEN quality = 0 THEN '' ELSE sha256(CAST(doc_id AS VARCHAR)) END AS last_synced_hash FROM labels),
files_v AS (SELECT 'src/' || doc_id || '.ts' AS file_path, sha256(CASE WHEN toxic = 1 THEN 'new' || doc_id ELSE CAST(doc_id AS VARCHAR) END) AS hash FROM labels WHERE doc_id % 7 <> 0),
checked_v AS (
  SELECT r.*, coalesce(f.hash, '__NOT_FOUND__') AS current_hash, r.last_synced_hash <> coalesce(f.hash, '__NOT_FOUND__') AS is_stale
  FROM refs_v r LEFT JOIN files_v f USING (file_path)),
nested_v AS (
  SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN coalesce(source, '') WHEN 1 THEN coalesce(source, '') || '/' || coalesce(lang, '')
    ELSE coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id % 5) END || '/N' || (doc_id % 97) || '.md' AS filepath FROM documents)
"""
