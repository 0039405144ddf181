"""A uniform shuffle of a table into shards of exact sizes, by a communication matrix.

How many rows every input partition sends to every target is drawn first, from the law that a uniformly random
permutation of all rows would give: a matrix whose rows sum to the partitions' counts and whose columns sum to the
targets' sizes.  Then each partition deals its own rows out in random order, the rows are exchanged, and each target
puts what it got into random order.  Every permutation of the table is equally likely (as far as the generator goes),
and the sizes hold exactly.

A shard is a run of targets, so no task ever holds a shard.  The matrix is never held as a whole: partitions are halved
again and again, each half's share of the targets being hypergeometric, and a task follows the halves down to its own
partition.  Each node of that tree has its own seed, so all tasks, and tasks that run again, agree on it.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from almanac.llm import common
from almanac.plans.staging import write_once

SHARDS = 16
SEED = 20_240
TARGET_ROWS = 20_000   # of a target, at most, while the targets do not outnumber the next
TARGETS = 32_768       # beyond that targets grow; at 100 TB one holds 3 GB, which a sort spills
NUMPY_BOUND = 10**9    # of numpy's own hypergeometric draws

DEALT = T.StructType([T.StructField("target", T.LongType()), T.StructField("key", T.LongType())])


def even(total: int, parts: int) -> np.ndarray:
    """Sizes at most one apart that sum to ``total``, larger ones first."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def drawn(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` out of ``good + bad`` are good; also where numpy's own draw stops, beyond a thousand million.

    There the probabilities are carried on from the mode by their exact ratios, over twelve standard deviations.
    """
    if max(good, bad, draws) < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    low, high = max(low, mode - int(12 * spread) - 50), min(high, mode + int(12 * spread) + 50)

    def ratios(k: np.ndarray) -> np.ndarray:  # of k + 1 to k
        return (good - k) / (k + 1) * (draws - k) / (bad - draws + k + 1)

    up = np.cumprod(ratios(np.arange(mode, high, dtype=np.float64)))
    down = np.cumprod(1 / ratios(np.arange(mode - 1, low - 1, -1, dtype=np.float64)))
    weights = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def shares(room: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Draws from columns with ``room`` rows each: multivariate hypergeometric, columns halved where they are too large for numpy."""
    total = int(room.sum())
    if draws == 0:
        return np.zeros_like(room)
    if total < NUMPY_BOUND:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    if len(room) == 1:
        return np.array([draws], np.int64)
    half = len(room) // 2
    left = drawn(int(room[:half].sum()), int(room[half:].sum()), draws, rng)
    return np.concatenate([shares(room[:half], left, rng), shares(room[half:], draws - left, rng)])


class Matrix:
    """The communication matrix of input partitions with ``counts`` rows and targets of ``sizes``, row by row when asked."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, seed: int):
        assert counts.sum() == sizes.sum()
        self.sizes, self.seed = sizes.astype(np.int64), seed
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self._left = lru_cache(maxsize=64)(self._draw)  # neighbouring partitions share most of their way

    def _draw(self, low: int, middle: int, high: int, room: bytes) -> np.ndarray:
        rng = np.random.default_rng([self.seed, low, high])
        return shares(np.frombuffer(room, np.int64), int(self.before[middle] - self.before[low]), rng)

    def row(self, part: int) -> np.ndarray:
        """Rows of partition ``part`` by target."""
        low, high, room = 0, len(self.before) - 1, self.sizes
        while high - low > 1:
            middle = (low + high) // 2
            left = self._left(low, middle, high, room.tobytes())
            low, high, room = (low, middle, left) if part < middle else (middle, high, room - left)
        return room

    def labels(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Target of each row of a partition, in the order of its rows: its share of each target, permuted; and random keys."""
        rng = np.random.default_rng([self.seed, 1, part])
        row = self.row(part)
        return rng.permutation(np.repeat(np.arange(len(row)), row)), rng.integers(-(1 << 63), (1 << 63) - 1, int(row.sum()))


def layout(rows: int, shards: int, target_rows: int, targets: int) -> tuple[int, np.ndarray]:
    """Targets of each shard, and the sizes of all targets: even in a shard, and shards are even among each other."""
    each = max(1, min(-(-rows // (shards * target_rows)), targets // shards))
    return each, np.concatenate([even(int(n), each) for n in even(rows, shards)])


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, target_rows: int = TARGET_ROWS, targets: int = TARGETS) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Shards differ by one row at most, and rows come in uniformly random order.  Values do not matter: nulls, empty and long
    texts, ties and repeated rows are rows like any other; an empty table gives an empty one; ``shard`` and ``slot`` of
    the input are replaced, other names are free.  The rows are stored once, which fixes their partitions and order, and
    shuffled once.  The driver and each task hold eight bytes for every input partition.
    """
    docs = docs.drop("shard", "slot")
    part, at, dealt = common.unused(docs, "part", "at", "dealt")
    stored = write_once(docs.select(
        "*", F.spark_partition_id().alias(part),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at)))
    counted = stored.groupBy(part).agg(F.count("*").alias("rows")).toPandas()  # a row for each partition
    counts = np.zeros(int(counted[part].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted[part].to_numpy(np.int64)] = counted["rows"].to_numpy(np.int64)
    total = int(counts.sum())
    each, sizes = layout(total, shards, target_rows, targets)

    @F.pandas_udf(DEALT)
    def deal(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matrix, known, target, key = Matrix(counts, sizes, seed), -1, None, None
        for parts, places in frames:
            out = np.zeros((2, len(parts)), np.int64)
            parts, places = parts.to_numpy(np.int64), places.to_numpy(np.int64)
            starts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for start, end in zip(starts, starts[1:]):
                if start < end and parts[start] != known:
                    known = int(parts[start])
                    target, key = matrix.labels(known)
                out[0, start:end], out[1, start:end] = target[places[start:end]], key[places[start:end]]
            yield pd.DataFrame({"target": out[0], "key": out[1]})

    target = F.col(dealt)["target"]
    shard, chunk = F.floor(target / each).cast("long"), target % each
    size = F.lit(total // shards) + (shard < total % shards).cast("long")  # of the shard, by the rule of ``even``
    chunk_size, larger = F.floor(size / each).cast("long"), size % each
    order = Window.partitionBy(target).orderBy(F.col(dealt)["key"], part, at)
    slot = chunk * chunk_size + F.least(chunk, larger) + F.row_number().over(order) - 1
    return stored.withColumn(dealt, deal(part, at)).select(
        *[F.col(f"`{c}`") for c in docs.columns], shard.cast("int").alias("shard"), slot.alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
