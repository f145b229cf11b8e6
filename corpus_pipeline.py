"""The training corpus from the raw documents, in five stages.

Each stage takes what its predecessor kept, as a table of its own, and its
decisions take effect: rejected rows are gone and cut texts stay cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from quillgraph.llm.common import discard, docs_of, materialize, scratch_freed


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the models learn from the labelled rows of the same table."""
    return language_id.keep_known(docs, language_id.fit(docs))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates stay only in the first document that has them."""
    return line_dedup.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents, no benchmark passages in the others."""
    return decontaminate.clean(docs, docs_of(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, repeats counted."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_recurring_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmarks),
    ("mixing", mixed),
]

# The language models and the cube sampler have no SQL form; tests hold each stage's operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        # What a stage wrote on its way goes as soon as its result is there; so does its input.
        before = docs
        with scratch_freed(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not first:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
