"""Table schemas, enumerations and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types as parsed and as stored, link types, staleness levels.
PUBLIC_DOC_TYPES = ("spec", "design", "adr", "guide", "api", "meeting", "todo", "other")
STORED_DOC_TYPES = ("spec", "design", "db-schema", "api", "config", "guide")
LINK_TYPES = ("references", "depends_on", "implements", "extends", "conflicts_with")
STALENESS = ("fresh", "possibly_stale", "stale", "untracked")

DOCUMENTS = "id string, filepath string, title string, doc_type string, body_hash string, created_at timestamp, updated_at timestamp"
SECTIONS = "section_id long, doc_id string, heading string, section_order int, content string, content_hash string, embedding array<float>, embedding_model string, token_count int, updated_at timestamp"
LINKS = "source_doc_id string, target_doc_id string, type string, context string, source_section_id long, target_title string, created_at timestamp"
SOURCE_REFS = "doc_id string, file_path string, last_synced_hash string, last_synced_at timestamp, is_stale boolean"
CHANGES = "type string, filepath string, ts timestamp"

SCHEMA_VERSION = 1


def stored_doc_type(parsed: Column) -> Column:
    """What storage keeps of a parsed type: anything it does not know becomes a guide."""
    return F.when(parsed.isin(*STORED_DOC_TYPES), parsed).otherwise(F.lit("guide"))


def violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not allowed (null counts as not allowed)."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
