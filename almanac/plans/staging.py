"""Writing an intermediate result once, so that several consumers read it instead of recomputing it."""
from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for such files.  Only a local session may fall back to one of its own."""
    folder = spark.conf.get(_FOLDER, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_FOLDER} to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="almanac-")


def write_once(df: DataFrame, by: str | None = None) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it back.

    The result survives the loss of executors, has no lineage into the HTML, and each consumer reads
    only the columns it needs.  ``by`` names a column of few values to make folders of.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/almanac/{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files that may not be there yet; then no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
