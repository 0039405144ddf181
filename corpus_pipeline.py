"""Pipeline over ``documents``: keep known languages, good quality, one of each near copy, no personal data; then pack.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import language_kernel, packing, pii_spans, quality_rules, shingle_forest
from almanac.plans.staging import write_once
from almanac.session import tune


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences.

    A null or empty text is its end mark alone, rows that repeat are packed each, null ids stay null, an empty table has no
    pieces, other columns are not read.
    """
    return packing.pieces(docs)


def _stage(function):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(tune(spark), docs, sf_dir)

    return stage


STAGES = [
    ("language", _stage(language_kernel.keep_known)),
    ("quality", _stage(quality_rules.keep_good)),
    ("near_duplicates", _stage(shingle_forest.one_of_each)),
    ("personal_data", _stage(pii_spans.without_personal_data)),
    ("packing", _stage(pack)),
]

ORACLE_SQL = None  # learnt models; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
