"""Versions of the stored tables: what has been applied, and what is to be."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.errors import QuillgraphError

SCHEMA = "version int, name string, applied_at timestamp"


class MigrationError(QuillgraphError):
    """A step failed; earlier ones stay applied."""

    def __init__(self, version: int, cause: Exception):
        super().__init__(f"migration {version} failed: {cause}")
        self.version = version


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    up: Callable[[], None]


def applied(spark: SparkSession, base: str) -> DataFrame:
    """(version, name, applied_at) of what was applied; empty where nothing was."""
    folder = os.path.join(base, "schema_version")
    return spark.read.schema(SCHEMA).parquet(folder) if os.path.isdir(folder) else spark.createDataFrame([], SCHEMA)


def current_version(versions: DataFrame) -> DataFrame:
    """One row: the highest version, 0 without any."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def run(spark: SparkSession, base: str, migrations: list[Migration]) -> list[int]:
    """Applies what is newer than the current version, in order; each step is noted when it is done."""
    done, version = [], current_version(applied(spark, base)).first().version
    for m in sorted((m for m in migrations if m.version > version), key=lambda m: m.version):
        try:
            m.up()
        except Exception as e:
            raise MigrationError(m.version, e) from e
        note = spark.range(1).select(F.lit(m.version).alias("version"), F.lit(m.name).alias("name"), F.current_timestamp().alias("applied_at"))
        note.write.mode("append").parquet(os.path.join(base, "schema_version"))
        done.append(m.version)
    return done
