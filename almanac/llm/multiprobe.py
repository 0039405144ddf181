"""Nearest vectors by inner product through multiprobe p-stable hashing.

Each table floors a few Gaussian projections to a grid; a bucket is a cell.  With one coordinate more, which
makes all candidates equally long, the largest inner product is the least distance.  A neighbour at a given
distance lies in a perturbed bucket with a probability that follows from where the query lies in its own cell.
A query visits the buckets of a table in the order of that probability until the neighbours are found often
enough and there are enough candidates, the candidates of all tables are scored exactly, and the best are merged.

Buckets are put together, in order, to blocks of bounded size, a larger one is split; queries go to the blocks
that hold buckets they visit.  So work is matrix products of bounded blocks, whatever the buckets' sizes.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from almanac.llm import common
from almanac.plans.staging import write_once

TABLES = 2
FUNCTIONS = 4         # projections of a table
WIDTH = 0.9           # of a cell, in units of the neighbours' distance
LEVELS = 8            # cells of a projection; the outer ones are open
SUCCESS = 0.96        # of meeting a neighbour in some table
NEAREST = 20
BLOCK = 16_384        # vectors scored together
QUERIES = 4_096       # queries of a block, at most; beyond, the block is read again
SAMPLE = 4_096        # vectors from which those are taken that ask for their neighbours' distance
ASKERS = 256          # of these, each against the whole table
ASKED = 0.9           # of them have their last wanted neighbour within the estimated distance


@dataclass
class Index:
    """Grids of one dimension, fitted on a sample: every vector is hashed by them."""

    dimension: int
    longest: float
    reach: float            # estimated distance of the last wanted neighbour
    width: float
    directions: np.ndarray  # dimension + 1 by all projections
    shifts: np.ndarray

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates on a sphere: scaled by the longest vector, and the rest as one more coordinate."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.column_stack([scaled, rest])

    def directed(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))])

    def places(self, points: np.ndarray) -> np.ndarray:
        """Coordinates on the grids in cells: rows by tables by functions."""
        return (points @ self.directions / self.width + self.shifts).reshape(len(points), TABLES, FUNCTIONS)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Numbers of the buckets: rows by tables."""
        cells = np.clip(np.floor(self.places(self.lifted(vectors))) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)
        return cells @ LEVELS ** np.arange(FUNCTIONS)[::-1]

    def visited(self, vectors: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        """Rows by tables by buckets: whether a query visits it.

        The likeliest come first, until the success wanted of a table and ``least`` vectors are reached; ``held`` has the
        vectors of each bucket, by tables.
        """
        z = self.places(self.directed(vectors))
        edges = np.arange(1, LEVELS) - LEVELS // 2
        spread = self.reach / self.width
        below = normal((edges - z[..., None]) / spread)
        below = np.concatenate([np.zeros((*z.shape, 1)), below, np.ones((*z.shape, 1))], axis=-1)
        chance = np.diff(below, axis=-1)
        joint = chance[:, :, 0]
        for k in range(1, FUNCTIONS):
            joint = (joint[..., :, None] * chance[:, :, k][..., None, :]).reshape(len(z), TABLES, -1)
        order = np.argsort(-joint, axis=-1)
        ranked = np.take_along_axis(joint, order, -1)
        wanted = 1 - (1 - SUCCESS) ** (1 / TABLES)
        members = np.take_along_axis(np.broadcast_to(held, joint.shape), order, -1)
        visit = (np.cumsum(ranked, -1) - ranked < wanted) | (np.cumsum(members, -1) - members < least)
        out = np.zeros_like(visit)
        np.put_along_axis(out, order, visit, -1)
        return out


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


_erf = np.vectorize(math.erf, otypes=[float])


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and of finite components only."""
    infinite = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~infinite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def last_neighbours(vectors: DataFrame, asking: dict[int, tuple[Index, np.ndarray]]) -> dict[int, np.ndarray]:
    """By dimension, the distance of each asking vector to its last wanted neighbour, equal vectors counted once.

    One pass over all vectors; a task gives out no more than the nearest of each that asks.  One with fewer neighbours
    has the distance of its last one, one without any has none.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(asking)

    def hashes(x: np.ndarray) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest((row + 0.0).tobytes()) >> 1 for row in x], np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {d: hashes(asks) for d, (_, asks) in shared.value.items()}
        for batch in batches:
            by: dict[int, list] = {}
            for v in batch.column("vector").to_pylist():
                by.setdefault(len(v), []).append(v)
            for d, raw in by.items():
                index, asks = shared.value[d]
                x = np.array(raw, np.float64)
                hashed, first = np.unique(hashes(x), return_index=True)
                gaps = np.sqrt(np.maximum(2 - 2 * index.directed(asks) @ index.lifted(x[first]).T, 0))
                gaps[own[d][:, None] == hashed[None, :]] = np.inf
                if d in kept:
                    before, known = kept[d]
                    new = np.argsort(gaps, axis=1)[:, :NEAREST]
                    names, gaps = hashed[new], np.take_along_axis(gaps, new, 1)
                    gaps[(names[:, :, None] == known[:, None, :]).any(2)] = np.inf
                    names, gaps = np.column_stack([known, names]), np.column_stack([before, gaps])
                else:
                    names = np.broadcast_to(hashed, gaps.shape)
                order = np.argsort(gaps, axis=1, kind="stable")[:, :NEAREST]
                kept[d] = (np.take_along_axis(gaps, order, 1), np.take_along_axis(names, order, 1))
        schema = pa.schema([("dimension", pa.int32()), ("ask", pa.int32()), ("name", pa.int64()), ("gap", pa.float64())])
        for d, (gaps, names) in kept.items():
            rows, places = np.nonzero(np.isfinite(gaps))
            yield from common.batches([(d, int(i), int(names[i, j]), float(gaps[i, j])) for i, j in zip(rows, places)], schema)

    found = vectors.select("vector").mapInArrow(near, "dimension int, ask int, name long, gap double")
    found = found.groupBy("dimension", "ask", "name").agg(F.min("gap").alias("gap"))
    turn = F.row_number().over(Window.partitionBy("dimension", "ask").orderBy("gap", "name"))
    found = found.withColumn("turn", turn).where(F.col("turn") <= NEAREST).groupBy("dimension", "ask").agg(F.max("gap").alias("gap"))
    out: dict[int, list[float]] = {}
    for row in found.collect():
        out.setdefault(row["dimension"], []).append(row["gap"])
    return {d: np.array(gaps) for d, gaps in out.items()}


def fit(vectors: DataFrame) -> dict[int, Index]:
    """An index per dimension.

    Of at most ``ASKERS`` different vectors of a dimension each finds its own last wanted neighbour in the whole table,
    where equal vectors count once, and the neighbours' distance is a high quantile of theirs.  So copies, however
    many, do not make it smaller for the others.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = vectors.groupBy(F.size("vector").alias("dimension")).agg(F.max(norm).alias("longest")).collect()
    turn = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vec_id"), "vec_id")
    chosen = vectors.select("vec_id", "vector").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SAMPLE)
    sample: dict[int, dict[tuple, None]] = {}
    for row in chosen.orderBy("turn").select("vector").toPandas()["vector"]:
        sample.setdefault(len(row), {})[tuple(np.asarray(row, np.float64).tolist())] = None
    found = {}
    for row in sizes:
        rng = np.random.default_rng(row["dimension"])
        directions = rng.standard_normal((row["dimension"] + 1, TABLES * FUNCTIONS))
        found[row["dimension"]] = Index(row["dimension"], row["longest"], 1.0, 1.0, directions, rng.random(TABLES * FUNCTIONS))
    gaps = last_neighbours(vectors, {d: (index, np.array(list(sample[d])[:ASKERS])) for d, index in found.items()})
    for d, index in found.items():
        if d in gaps:
            index.reach = max(float(np.quantile(gaps[d], ASKED)), 1e-3)
        index.width = WIDTH * index.reach
    return found


def split(counts: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """For each bucket (dimension, table, number) its first block and the number of its blocks.

    Neighbouring buckets share a block up to ``BLOCK`` vectors; a larger one has blocks of its own.
    """
    out, block, held, before = {}, -1, BLOCK, None
    for bucket in sorted(counts):
        n = counts[bucket]
        parts = -(-n // BLOCK)
        if held + n > BLOCK or bucket[:2] != before or parts > 1:
            block, held = block + 1, 0
        out[bucket] = (block, parts)
        if parts > 1:
            block, held = block + parts - 1, BLOCK
        held, before = held + n, bucket[:2]
    return out


def best_of(scores: np.ndarray, exact, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of one query by exact score, then id; ``scores`` may be off by rounding."""
    k = min(k + 1, len(scores))
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= floor - 1e-9 * max(1.0, abs(floor)))
    near = near[ids[near] != own]
    true = exact(near)
    order = np.lexsort((ids[near], -true))[:k]
    return ids[near][order], true[order]


def nearest(vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row that ``asks``, its own left out.

    ``vectors`` has ``vec_id`` and ``vector``.  Nearness is the inner product in double precision, ties go to the smaller
    id; vectors of another dimension are no candidates.  Rows without an id, and vectors that are null, empty, zero or not finite, take no
    part; of rows that repeat an id the least vector counts.  A query with fewer candidates gets all of them.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vector").alias("vector"))
    vectors = write_once(vectors)
    indexes = fit(vectors)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, d, t, int(b)) for i, d, found in of_dimension(batch) for t, b in enumerate(found)]
            yield from common.batches(rows, pa.schema([("vec_id", pa.int64()), ("dimension", pa.int32()), ("table", pa.int32()), ("bucket", pa.int64())]))

    def of_dimension(batch: pa.RecordBatch):
        ids, raw = batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()
        for d in sorted({len(v) for v in raw}):
            at = [i for i, v in enumerate(raw) if len(v) == d]
            for i, found in zip(at, indexes[d].buckets(np.array([raw[i] for i in at], np.float64))):
                yield ids[i], d, found

    keys = write_once(vectors.mapInArrow(hashed, "vec_id long, dimension int, table int, bucket long"))
    # at most TABLES * LEVELS ** FUNCTIONS buckets of a dimension
    counts = {(r["dimension"], r["table"], r["bucket"]): r["count"] for r in keys.groupBy("dimension", "table", "bucket").count().collect()}
    where = spark.sparkContext.broadcast(split(counts))
    members = {d: np.zeros((TABLES, LEVELS**FUNCTIONS), np.int64) for d in indexes}
    for (d, t, b), n in counts.items():
        members[d][t, b] = n
    members = spark.sparkContext.broadcast(members)
    asking = vectors.where(asks)
    parts = -(-asking.count() // QUERIES)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("bucket", pa.int64()), ("vector", pa.list_(pa.float64()))])
        for batch in batches:
            ids, raw, rows = batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), []
            of = dict(zip(ids, raw))
            for vec_id, d, found in of_dimension(batch):
                for t, b in enumerate(found.tolist()):
                    block, n = where.value[d, t, b]
                    block += xxhash.xxh3_64_intdigest(str(vec_id)) % n
                    rows += [(block, part, vec_id, b, of[vec_id]) for part in range(parts)]
            yield from common.batches(rows, schema)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("visits", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64()))])
        blocks: dict[tuple[int, int], dict[int, list[int]]] = {}
        for (d, t, b), (block, n) in where.value.items():
            for i in range(n):
                blocks.setdefault((d, t), {}).setdefault(block + i, []).append(b)
        for batch in batches:
            ids, raw = batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()
            for d in sorted({len(v) for v in raw}):
                at = [i for i, v in enumerate(raw) if len(v) == d]
                for some in common.slices(at, 256):
                    visits, rows = indexes[d].visited(np.array([raw[i] for i in some], np.float64), members.value[d], k + 1), []
                    for t in range(TABLES):
                        for block, held in blocks.get((d, t), {}).items():
                            held = np.array(held)
                            for row, i in enumerate(some):
                                chosen = held[visits[row, t, held]]
                                if len(chosen):
                                    rows.append((block, xxhash.xxh3_64_intdigest(str(ids[i])) % parts, ids[i], chosen.tolist(), raw[i]))
                    yield from common.batches(rows, schema)

    def scored(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, buckets = (candidates.column(c).to_numpy() for c in ("vec_id", "bucket"))
        out: list[tuple] = []
        if len(ids) and queries.num_rows:
            x = matrix(candidates.column("vector"))
            held, group = np.unique(buckets, return_inverse=True)
            for some in common.slices(list(range(queries.num_rows)), 256):
                part = queries.take(pa.array(some))
                q = matrix(part.column("vector"))
                products = q @ x.T
                for row, (own, visits) in enumerate(zip(part.column("vec_id").to_pylist(), part.column("visits").to_pylist())):
                    seen = np.flatnonzero(np.isin(held, visits)[group])
                    if len(seen):
                        found, score = best_of(products[row, seen], lambda near: (x[seen[near]] * q[row]).sum(1), ids[seen], own, k)
                        if len(found):
                            out.append((own, found.tolist(), score.tolist()))
        return pa.Table.from_batches(common.batches(out, BEST), schema=BEST)

    left = vectors.mapInArrow(placed, "block long, part int, vec_id long, bucket long, vector array<double>")
    right = asking.mapInArrow(probing, "block long, part int, vec_id long, visits array<long>, vector array<double>")
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(scored, "query_id long, ids array<long>, scores array<double>")
    pairs = best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a candidate of several tables counts once
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


BEST = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, F.col("vec_id") % 20 == 0)
