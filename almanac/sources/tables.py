"""Readers and writers.  Every reader states its schema; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac import schemas


def read_pages(spark: SparkSession, path: str, extra: list[str] = ()) -> DataFrame:
    """Fetched pages from Parquet, only the columns that are used (``rendered`` and others on request)."""
    return spark.read.parquet(path).select("page_id", "url", "html", *extra)


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extraction requests from JSON lines: the usable ones, and those without a URL or unreadable."""
    rows = spark.read.schema(schemas.REQUESTS + ", _corrupt STRING").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    good = F.col("url").isNotNull() & F.col("_corrupt").isNull()
    rejected = rows.filter(~good).select(
        F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise("url is missing").alias("reason"),
        F.coalesce("_corrupt", F.to_json(F.struct("extraction_hints", "schema_requirements"))).alias("content"),
    )
    return rows.filter(good).drop("_corrupt"), rejected


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """S3: log of pages whose following pages were not found, JSON lines."""
    return spark.read.schema(schemas.FAILURES).json(path)


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Crawl summary, one JSON document per file: its header, and one row per listed source."""
    document = spark.read.schema(schemas.SUMMARY).option("multiLine", True).json(path)
    return document.drop("sources_for_improvement"), document.select(F.inline("sources_for_improvement"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model answers from Parquet or, by file name, JSON lines."""
    reader = spark.read.schema(schemas.RESPONSES)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Events as Parquet, one folder per method.  Hosts are skewed, methods are few and wanted apart;
    tasks write their own files, so nothing is shuffled for it."""
    events.write.mode(mode).partitionBy("method").parquet(path)
