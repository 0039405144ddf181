"""Shared by the operators: reading the tables, columns of Arrow batches, hash splits, caches of bounded size."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.functions import joins
from almanac.session import tune

CACHE_ENTRIES = 100_000  # of a worker's cache of words; it starts again from nothing beyond that


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as a list; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of ``df`` has."""
    return joins.unused(df.columns, *names)


def slices(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i:i + size]


def groups(rows: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal ``by``, each group whole, out of sorted batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in by]
        start, values = 0, list(zip(*columns))
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    kept.append(batch.slice(start, i - start))
                if kept:
                    yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, start, last = [], i, value
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a stated schema; none for no rows."""
    if rows:
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """``doc_id, text`` and the label as ``wanted`` of at most ``rows`` documents that may be learnt from.

    They are chosen by a hash of their ids; a document with several labels counts by the greatest.  The
    chosen ids are at most ``rows``, so they are small enough to be sent to all executors.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("wanted"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
