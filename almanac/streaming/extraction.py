"""The whole extraction, frames, month pages, detail pages and model answers included, as a stream of arriving pages.

Every batch is stored, and the pages extracted that it can change: its own, and stored ones that need an address which
has just arrived, be it for the first time or anew.  What the extraction of a page needs is known from when it was extracted
last.  Everything a batch writes goes to folders of its number, which a repeated batch writes over, and the status of its pages
goes last; a reader takes of every page what its last status says.  So a batch that is killed and
run again leaves no trace of its first attempt, and the events are those of one extraction over all pages that arrived.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from almanac import schemas
from almanac.functions import urls as U
from almanac.functions.joins import lookup
from almanac.operators.sieve import passing
from almanac.plans.extract import extract
from almanac.plans.staging import read_stored, write_once

NEEDS = "page_id BIGINT, address STRING, batch INT"
STATUS = "page_id BIGINT, page_url STRING, success BOOLEAN, extraction_method STRING, page_title STRING, total_found BIGINT, jsonld_failed BOOLEAN, batch INT"


def _put(df: DataFrame, store: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")


def take_up(
    arrived: DataFrame, batch: int, store: str, as_of: Column, answers: DataFrame | None = None, hints: DataFrame | None = None, **options,
) -> None:
    """One batch of pages (``page_id, url, html``; a ``page_id`` arrives once).  ``options`` are those of ``extract``."""
    spark = arrived.sparkSession
    _put(arrived.select("page_id", "url", "html"), store, "pages", batch)
    pages = read_stored(spark, f"{store}/pages", schemas.PAGES + ", batch INT").filter(F.col("batch") <= batch)
    new = write_once(pages.filter(F.col("batch") == batch).select("page_id", U.address(F.col("url")).alias("address")))
    needs = _latest(spark, store, "needs", NEEDS, batch - 1)
    waiting = passing(needs.select("page_id", "address"), new, ["address"]).join(new.select("address").distinct(), "address", "left_semi")
    ids = write_once(new.select("page_id").unionByName(waiting.select("page_id")).distinct())
    found = extract(pages.drop("batch"), as_of, answers, hints, of=ids, **options)
    _put(found.events, store, "events", batch)
    _put(found.needs, store, "needs", batch)
    _put(found.pages, store, "status", batch)


def _last_batches(spark: SparkSession, store: str, until: int | None) -> DataFrame:
    status = read_stored(spark, f"{store}/status", STATUS)
    status = status if until is None else status.filter(F.col("batch") <= until)
    return status.groupBy("page_id").agg(F.max("batch").alias("batch"))


def _latest(spark: SparkSession, store: str, name: str, schema: str, until: int | None = None) -> DataFrame:
    """Rows of each page from the last batch that extracted it."""
    rows = read_stored(spark, f"{store}/{name}", schema)
    return lookup(rows, _last_batches(spark, store, until), ["page_id", "batch"], "left_semi")


def current_status(spark: SparkSession, store: str) -> DataFrame:
    """How every page fared that has arrived so far."""
    return _latest(spark, store, "status", STATUS).drop("batch")


def current_events(spark: SparkSession, store: str) -> DataFrame:
    """The events of all pages that have arrived so far."""
    rows = spark.read.parquet(f"{store}/events")
    return lookup(rows, _last_batches(spark, store, None), ["page_id", "batch"], "left_semi").drop("batch")


def extraction_stream(
    arrivals: DataFrame, store: str, checkpoint: str, as_of: Column, answers: DataFrame | None = None, hints: DataFrame | None = None, **options,
) -> DataStreamWriter:
    """A query to ``start()`` that takes up each batch of ``arrivals`` that is there, then ends."""
    def batch_of(df: DataFrame, number: int) -> None:
        take_up(df, number, store, as_of, answers, hints, **options)

    return arrivals.writeStream.foreachBatch(batch_of).option("checkpointLocation", checkpoint).trigger(availableNow=True)
