"""Set-based table maintenance: upserts, diffs, replacements, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE, KEEP = "insert", "update", "delete", "keep"


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All documents after an upsert, with ``changed``.

    The same body hash leaves a document as it is; otherwise the new row is
    taken with the old creation time.
    """
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(n, old["id"] == n["n_id"], "full_outer")
    same = F.col("n_id").isNull() | F.coalesce(F.col("body_hash") == F.col("n_body_hash"), F.lit(False))
    kept = [
        (F.coalesce("created_at", "n_created_at") if c == "created_at" else F.when(same, F.col(c)).otherwise(F.col(f"n_{c}"))).alias(c)
        for c in old.columns if f"n_{c}" in n.columns
    ]
    return both.select(*kept, ((~same) | F.col("id").isNull()).alias("changed"))


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New files whose path and body hash are known already."""
    return new.join(old.select("filepath", "body_hash"), ["filepath", "body_hash"], "left_semi")


def to_process(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    return new if force else new.join(old.select("filepath", "body_hash"), ["filepath", "body_hash"], "left_anti")


def diff_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, section_order, action): what a new parse does to stored sections.

    Only the content hash decides; a changed heading alone changes nothing.
    """
    o = old.select("doc_id", "section_order", F.col("content_hash").alias("old_hash"))
    n = new.select("doc_id", "section_order", F.col("content_hash").alias("new_hash"))
    action = F.when(F.col("new_hash").isNull(), DELETE).when(F.col("old_hash").isNull(), INSERT).when(F.col("old_hash") != F.col("new_hash"), UPDATE).otherwise(KEEP)
    return o.join(n, ["doc_id", "section_order"], "full_outer").select("doc_id", "section_order", action.alias("action"))


def replace_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sections after a new parse of the documents in ``new``.

    Kept sections keep id and embedding; changed ones keep the id and lose the
    embedding, which would describe another text.
    """
    docs = new.select("doc_id").distinct()
    others = old.join(docs, "doc_id", "left_anti")
    mine = old.join(docs, "doc_id", "left_semi")
    names = [c for c in old.columns if c not in ("doc_id", "section_order")]
    n = new.select("doc_id", "section_order", *[F.col(c).alias(f"n_{c}") for c in new.columns if c in names])
    both = mine.withColumn("__old", F.lit(True)).join(n, ["doc_id", "section_order"], "right")
    same = F.coalesce(F.col("content_hash") == F.col("n_content_hash"), F.lit(False))

    def value(c: str):
        fresh = F.col(f"n_{c}") if f"n_{c}" in n.columns else F.lit(None)
        if c == "section_id":
            return F.coalesce(F.col(c), fresh) if f"n_{c}" in n.columns else F.coalesce(F.col(c), F.abs(F.xxhash64("doc_id", "section_order")))
        return F.when(same, F.col(c)).otherwise(fresh)

    return others.unionByName(both.select(*[(F.col(c) if c in ("doc_id", "section_order") else value(c).alias(c)) for c in old.columns]))


def replace_by_document(old: DataFrame, new: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """All rows of the given documents go, the new ones come (links, source references)."""
    return old.join(documents.select(F.col("id").alias(key)), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def missing_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file is gone; without any file, all."""
    return documents.join(files.select("filepath"), "filepath", "left_anti").select(*documents.columns)


def delete_documents(gone: DataFrame, documents: DataFrame, sections: DataFrame, links: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the documents in ``gone`` (column id) and what hangs on them.

    Links go with either end; sections that go leave no section id behind.
    """
    ids = gone.select("id").distinct()
    as_ = lambda name: ids.withColumnRenamed("id", name)
    left = links.join(as_("source_doc_id"), "source_doc_id", "left_anti").join(as_("target_doc_id"), "target_doc_id", "left_anti").select(*links.columns)
    return documents.join(ids, "id", "left_anti"), sections.join(as_("doc_id"), "doc_id", "left_anti").select(*sections.columns), left, refs.join(as_("doc_id"), "doc_id", "left_anti").select(*refs.columns)


def detach_sections(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links whose section no longer exists lose its id."""
    known = sections.select(F.col("section_id").alias("source_section_id"), F.lit(True).alias("__there"))
    return links.join(known, "source_section_id", "left").withColumn("source_section_id", F.when(F.col("__there"), F.col("source_section_id"))).select(*links.columns)


def synced_refs(doc_hashes: DataFrame) -> DataFrame:
    """Fresh source references: (doc_id, file_path, hash) as just read; an unreadable file has an empty hash."""
    return doc_hashes.select("doc_id", "file_path", F.coalesce("hash", F.lit("")).alias("last_synced_hash"), F.current_timestamp().alias("last_synced_at"), F.lit(False).alias("is_stale"))


def set_embeddings(sections: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Sections with the embeddings that were computed; ids that are gone are ignored."""
    new = embedded.select("section_id", F.col("embedding").alias("__new"))
    out = sections.join(new, "section_id", "left")
    there = F.col("__new").isNotNull()
    return out.withColumn("embedding", F.coalesce("__new", "embedding")).withColumn("embedding_model", F.when(there, F.lit(model)).otherwise(F.col("embedding_model"))).select(*sections.columns)


def pending_embeddings(sections: DataFrame, limit: int | None = None) -> DataFrame:
    out = sections.filter(F.col("embedding").isNull())
    return out if limit is None else out.limit(limit)


def other_model(sections: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    out = sections.filter(F.col("embedding").isNotNull() & (F.col("embedding_model") != model))
    return out if limit is None else out.limit(limit)
