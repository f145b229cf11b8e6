"""Paths and names: globs, normal forms, containment, suffixes."""

from __future__ import annotations

import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillgraph.errors import PathTraversalError


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob.

    ``**/`` is any number of folders, ``**`` anything, ``*`` anything within a
    folder.  A question mark stays a quantifier, as in the original patterns.
    """
    tokens = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "?"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    return "^" + "".join(tokens[p] if p in tokens else re.escape(p) for p in parts) + "$"


def matches_globs(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Exclusion wins; otherwise any inclusion is enough."""

    def any_of(patterns):
        out = F.lit(False)
        for p in patterns:
            out = out | path.rlike(glob_to_regex(p))
        return out

    return ~any_of(exclude) & any_of(include)


@pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))




def strip_md(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def normal_name(value: Column) -> Column:
    """Lower case, no ``.md``, composed."""
    return nfc(strip_md(F.lower(value)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Folder of a path; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def title_of(frontmatter_title: Column, path: Column) -> Column:
    """The given title, or else the path without ``.md``; headings do not count."""
    return F.coalesce(F.nullif(frontmatter_title, F.lit("")), F.regexp_replace(path, r"\.md$", ""))


def resolved_path(folder: Column, url: Column) -> Column:
    """folder/url with ``.`` and ``..`` worked out; a path that leaves the top keeps its ``..``."""
    parts = F.split(F.when(folder == "", url).otherwise(F.concat_ws("/", folder, url)), "/")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        can_pop = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last).otherwise(F.lit("..")) != "..")
        return F.when(p.isin("", "."), acc).when((p == "..") & can_pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def suffixes(path: Column) -> Column:
    """All trailing parts of a path, the whole one first: a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def contained(path: str, base: str) -> str:
    """The normal form of ``path`` under ``base``; raises if it leaves it."""
    base = posixpath.normpath(base)
    full = posixpath.normpath(posixpath.join(base, path.replace("\\", "/")))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise PathTraversalError(path)
    return full
