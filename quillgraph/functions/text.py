"""Text functions: token estimates, hashes, excerpts, formatting."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that count one and a half tokens each (Hangul is not among them).
CJK = r"[　-鿿豈-﫿]"
CJK_WEIGHT, WORD_WEIGHT = 1.5, 1.3


def estimate_tokens(text: Column) -> Column:
    """ceil(1.5 * CJK characters + 1.3 * words of the rest)."""
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.size(F.filter(F.split(F.regexp_replace(text, CJK, " "), r"(?U)\s+"), lambda w: w != ""))
    return F.ceil(cjk * CJK_WEIGHT + words * WORD_WEIGHT).cast("int")


def estimate_tokens_py(text: str) -> int:
    """The same estimate for single strings on the parsing path."""
    return math.ceil(len(re.findall(CJK, text)) * CJK_WEIGHT + len(re.sub(CJK, " ", text).split()) * WORD_WEIGHT)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def embedding_text(heading: Column, content: Column) -> Column:
    """Heading and content, or the content alone."""
    return F.concat_ws("\n", F.nullif(heading, F.lit("")), content)


def model_input(text: Column, model: str, is_query: bool, limit: int = 2048) -> Column:
    """What an embedding model is given: its prefix, then the text, cut after prefixing."""
    prefix = ("query: " if is_query else "passage: ") if "e5-" in model else ""
    return F.substring(F.concat(F.lit(prefix), text), 1, limit)


def pooling(model: str) -> str:
    return "cls" if "bge" in model.lower() else "mean"


def excerpt(text: Column, start: Column, length: Column, around: int = 50) -> Column:
    """The match with up to ``around`` characters on both sides; ``start`` counts from 0."""
    first = F.greatest(start - around, F.lit(0))
    return F.substr(text, first + 1, start + length + around - first)
