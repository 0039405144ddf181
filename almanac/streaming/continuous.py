"""The extraction as a stream of arriving page files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from almanac import schemas
from almanac.operators.jsonld import page_events

ARRIVALS = schemas.PAGES + ", fetched_at TIMESTAMP"


def arriving_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def continuous_events(arrivals: DataFrame, on_error: str = "page") -> DataFrame:
    """Events of arriving pages.  Stateless, the same columns as in batch."""
    return page_events(arrivals, on_error)


def without_repeats(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop events whose id was seen within ``delay``; arrivals behind the watermark are dropped.

    State holds one small row per id, not the events.
    """
    return events.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["external_id"])


def write_available(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; run again for more.

    The file sink keeps its own log of finished batches, so a batch repeated after a failure is not
    written twice.
    """
    return (
        events.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
