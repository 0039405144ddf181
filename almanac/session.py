"""Settings the library relies on, applied to a session that already exists."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Only settings that may change while a session runs; cluster sizing stays with whoever starts it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",            # texts keep offsets, timestamps are instants
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",  # splits the hot side of a join, e.g. one much-embedded frame
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # web pages are large rows, and a page takes many times its size while it is parsed
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # what a stream remembers outgrows the heap, and the default store copies all of it in each batch; a stream that has begun keeps its store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",       # for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # a look-up for each row, for a metric
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few files: reading events out of pages costs far more than moving them.

    An input with as many splits as the session has cores, which any large one has, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
