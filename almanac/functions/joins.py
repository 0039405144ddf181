"""Joins that stay balanced when a large part of the rows has one key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``per_key``, which has one row per key, so that a hot key of ``rows`` is split.

    Adaptive execution splits a skewed join only where both sides were shuffled for that join.  A side
    that comes out of an aggregate over the same key is joined where it lies instead, and the hot key
    then stays in one task.  Joining on a hash of the key as well makes both sides move; the aggregated
    one is small by comparison.
    """
    (name,) = unused([*rows.columns, *per_key.columns], "code")
    code = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    return rows.withColumn(name, code).join(dealt(per_key.withColumn(name, code)), [*keys, name], how).drop(name)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt out by its keys and never sent whole through the driver.

    For tables that grow with the pages.  A stored table counts with the size of its compressed files where Spark decides what to
    send to all tasks; narrow rows of addresses take thirty times that and more in memory.
    """
    return df.hint("merge")


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name one like it that is not among ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
