"""JSON output of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls left out; written by any text sink."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def printed(df: DataFrame, most: int = 1000) -> str:
    """A short result as one indented JSON array; raises if it has more than ``most`` rows."""
    rows = json_lines(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write json_lines to a folder instead")
    return json.dumps([json.loads(r.value) for r in rows], indent=2, ensure_ascii=False)
