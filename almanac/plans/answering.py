"""Asking a model for good (M6): a ledger of answers, so that no settled prompt is asked, or paid for, a second time.

The ledger is a folder of Parquet files (``schemas.RESPONSES``).  Prompts are asked in waves of a bounded number.  A wave is one job, whose
answers are added to the ledger when the whole of it has succeeded; Spark's commit moves its files there and
leaves nothing behind of a wave that failed.  So a run that is broken off loses one wave at most, and the
next run, or any other plan that meets the same prompts, starts from what is settled.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac import schemas
from almanac.operators.models import run_model
from almanac.operators.sieve import passing
from almanac.plans.staging import read_stored, write_once

WAVE = 50_000  # prompts that are asked, and at worst lost, together


def settled(spark: SparkSession, ledger: str) -> DataFrame:
    """The answers of a ledger, as recorded ones (``schemas.RESPONSES``); none if there is no ledger yet."""
    return read_stored(spark, ledger, schemas.RESPONSES)


def open_prompts(prompts: DataFrame, answers: DataFrame, kind: str, retry_failed: bool = False) -> DataFrame:
    """``prompt_key, prompt`` of the different prompts that have no answer of this kind yet, stored.

    A failed call is an answer too, unless ``retry_failed``.  Of the ledger, which grows without end, only keys that
    may be among the prompts' are moved.
    """
    unique = write_once(prompts.groupBy("prompt_key").agg(F.first("prompt").alias("prompt")))
    known = answers.filter(F.col("kind") == kind)
    if retry_failed:
        known = known.filter(F.col("status") == "ok")
    known = passing(known.select(F.col("key").alias("prompt_key")), unique.select("prompt_key"), ["prompt_key"])
    return unique.join(known, "prompt_key", "left_anti")


def ask_once(
    prompts: DataFrame,
    model: Callable[[list[str]], list[str | Exception]],
    kind: str,
    ledger: str,
    wave: int = WAVE,
    partitions: int | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """Answers to all ``prompts`` (``prompt_key, prompt``), of which only those that the ledger lacks are asked.

    ``model`` is that of ``run_model``.  Within a wave a task that is lost asks its own prompts again, as its answers were
    nowhere yet: choose ``wave`` by what that may cost.  Two runs at the same time do not know of each other.
    """
    spark = prompts.sparkSession
    rest = open_prompts(prompts, settled(spark, ledger), kind, retry_failed)
    waves = -(-rest.count() // wave)
    if waves:
        number = F.pmod(F.xxhash64("prompt_key"), F.lit(waves)).cast("int")
        rest = write_once(rest.withColumn("wave", number), by="wave")
        for n in range(waves):
            asked = run_model(rest.filter(F.col("wave") == n).drop("wave"), model, kind, partitions)
            asked.write.mode("append").parquet(ledger)
    wanted = write_once(prompts.select(F.col("prompt_key").alias("key")).distinct())
    answers = passing(settled(spark, ledger).filter(F.col("kind") == kind), wanted, ["key"])
    return answers.join(wanted, "key", "left_semi").select(*[f.name for f in answers.schema])
