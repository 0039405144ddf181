"""Arrays of structs to rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def each(df: DataFrame, keep: list, array: str, pos: str | None = None) -> DataFrame:
    """One row per element of an array of structs: the columns ``keep``, ``pos`` if named, then the fields.

    Written as an outer explode whose empty rows are dropped afterwards.  A plain explode makes the
    optimizer test the array for emptiness further down, which evaluates an expensive array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", "_e")).filter(F.col("_pos").isNotNull())
    return rows.select(*rows.columns[:-2], *([F.col("_pos").alias(pos)] if pos else []), "_e.*")
