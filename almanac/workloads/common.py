"""Shared between the query modules."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.plans.staging import write_once
from almanac.session import spread, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(tune(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table of pages written out of a supplied table, stored once per session and read by all queries.

    Queries then meet pages the way they do in earnest, as a table, and not as the expressions that made them.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = write_once(build())
    return _DERIVED[key]


def text(expression: str) -> str:
    """A value as text, in both dialects."""
    return f"CAST({expression} AS STRING)"


def day(expression: str, plus: int = 0) -> str:
    """``YYYY-MM-DD`` of a timestamp, some days later."""
    shift = f" + {plus}" if plus > 0 else f" - {-plus}" if plus < 0 else ""
    return f"CAST(CAST({expression} AS DATE){shift} AS STRING)"


def script(block: str) -> str:
    """HTML of a structured-data script around an SQL text expression."""
    return f"'<script type=\"application/ld+json\">' || {block} || '</script>'"


def flat_location() -> list:
    """The parts of a location as columns of their own."""
    return [
        F.col("location.kind").alias("location_kind"),
        F.col("location.text").alias("location_text"),
        F.col("location.place.name").alias("place_name"),
        F.col("location.place.address").alias("place_address"),
    ]
