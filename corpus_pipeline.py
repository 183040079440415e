"""Cleaning of a document table in stages, each by one of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archidex.llm import stages
from archidex.llm.common import table
from archidex.session import cut_lineage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stages.known_language),
    ("lines", stages.without_repeated_lines),
    ("near_duplicates", stages.one_of_each_group),
    ("benchmark", stages.without_benchmark),
    ("tokens", stages.encoded),
]

#: The stages learn models and compare texts within edit distances, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
