"""Shards: the communication matrix against its law, exact sizes, gapless slots, all rows there."""
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from almanac.llm import uniform_shards as shards


def whole(matrix, parts):
    return np.array([matrix.row(p) for p in range(parts)])


def test_matrix_sums():
    rng = np.random.default_rng(1)
    for seed in range(30):
        counts = rng.integers(0, 9, int(rng.integers(1, 12)))
        sizes = shards.even(int(counts.sum()), int(rng.integers(1, 7)))
        found = whole(shards.Matrix(counts, sizes, seed), len(counts))
        assert (found.sum(1) == counts).all() and (found.sum(0) == sizes).all() and (found >= 0).all()


def test_matrix_is_that_of_a_uniform_permutation():
    """All dealings of five rows to targets of two, two and one, as often as among all permutations."""
    counts, sizes = np.array([2, 1, 2]), np.array([2, 2, 1])
    owner, slot = np.repeat(np.arange(3), counts), np.repeat(np.arange(3), sizes)
    law = Counter()
    for order in permutations(range(5)):
        found = np.zeros((3, 3), int)
        for place, row in enumerate(order):
            found[owner[row], slot[place]] += 1
        law[found.tobytes()] += 1
    runs = 6000
    seen = Counter(whole(shards.Matrix(counts, sizes, s), 3).astype(int).tobytes() for s in range(runs))
    assert set(seen) == set(law)
    chi = sum((seen[k] - runs * n / 120) ** 2 / (runs * n / 120) for k, n in law.items())
    assert chi < 2.5 * len(law)


def test_large_draws(monkeypatch):
    """The sampler for large tables has the law of the small one, and the moments where numpy has none."""
    monkeypatch.setattr(shards, "NUMPY_BOUND", 0)
    rng = np.random.default_rng(5)
    own = np.bincount([shards.drawn(6, 9, 7, rng) for _ in range(4000)], minlength=8)
    theirs = np.bincount(np.random.default_rng(6).hypergeometric(6, 9, 7, 40_000), minlength=8) / 10
    assert all(abs(a - b) < 6 * (b + 4) ** 0.5 for a, b in zip(own, theirs))
    assert shards.shares(np.array([3, 0, 4, 5]), 12, rng).tolist() == [3, 0, 4, 5]
    good, bad, draws = 3 * 10**9, 5 * 10**9, 10**9
    got = np.array([shards.drawn(good, bad, draws, rng) for _ in range(40)], float)
    deviation = (draws * 3 / 8 * 5 / 8 * 7 / 8) ** 0.5
    assert abs(got.mean() - draws * 3 / 8) < 5 * deviation / 40**0.5 and 0.6 < got.std() / deviation < 1.5


def check(rows, n, parts):
    by = Counter(r["shard"] for r in rows)
    assert [by[s] for s in range(parts)] == shards.even(n, parts).tolist()
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))


@pytest.mark.parametrize("target_rows", [7, 1000])
def test_sizes_and_slots(spark, target_rows):
    docs = spark.range(1003).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(9, "doc_id")
    rows = shards.sharded(docs, 16, target_rows=target_rows).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(i, f"text {i}") for i in range(1003)]
    check(rows, 1003, 16)
    again = shards.sharded(docs, 16, seed=8, target_rows=target_rows).collect()
    same = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}.items() & {r["doc_id"]: (r["shard"], r["slot"]) for r in again}.items()
    assert len(same) < 20  # another seed is another order
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(1003))[0, 1]) < 0.15


def test_odd_rows(spark, odd, none):
    clashing = odd.withColumnsRenamed({"words": "slot", "score": "_part", "class_id": "_at"}).withColumn("_dealt", odd["doc_id"])
    rows = shards.sharded(clashing, 5).collect()
    assert len(rows) == odd.count()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    check(rows, len(rows), 5)
    assert set(rows[0].asDict()) == set(clashing.columns) | {"shard", "slot"}
    assert shards.sharded(none).count() == 0


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import zlib

    rows = shards.query(spark, sf_dir).collect()
    check(rows, len(docs), 16)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 for r in rows)
    assert all(r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)} and len(rows) == len(docs)
