"""Near duplicates and vector search against brute force."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from almanac.llm import multiprobe, shingle_forest


def brute(rows):
    """Links and classes of (id, text) rows by all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").split()
        size = min(5, len(words))
        sets.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if words else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        names[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return [(doc_id, least[find(i)] if sets[i] else doc_id, links[i]) for i, (doc_id, _) in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def test_links_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = shingle_forest.query(spark, sf_dir).collect()
    assert in_order(map(tuple, found)) == in_order(brute([tuple(r) for r in docs]))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A group larger than the blocks, among others: no link is lost or counted twice, and nothing is a pair."""
    monkeypatch.setattr(shingle_forest, "BLOCK", 8)
    monkeypatch.setattr(shingle_forest, "NARROW_BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        words = list(base)
        if i:
            words[int(rng.integers(60))] = f"other{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(20))) for i in range(20)] + [(200, rows[7][1]), (201, rows[8][1] + " end")]
    found = shingle_forest.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert in_order(map(tuple, found)) == in_order(brute(rows))


def test_odd_documents(spark, odd, odd_rows, none):
    found = shingle_forest.linked(odd).collect()
    assert in_order(map(tuple, found)) == in_order(brute([r[:2] for r in odd_rows]))
    assert shingle_forest.linked(none).count() == 0
    kept = shingle_forest.one_of_each(spark, odd, "")
    assert kept.columns == odd.columns
    assert in_order((r["doc_id"],) for r in kept.collect()) == in_order((i,) for i in [None, 1, 2, 3, 4, 6, 7, 8, 9, 10])


def test_one_id_on_two_texts(spark):
    """Every class keeps one document, also where its least id has another text, or several texts, of another class."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (6, a + " end"), (8, c), (8, c + " end"), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in shingle_forest.one_of_each(spark, docs, "").collect()]
    assert sorted(r for r in kept if r[0] != 8) == [(3, b), (5, a)]
    assert len(kept) == 3 and set(kept) <= set(rows)


def test_depth_reaches_the_recall():
    depth = shingle_forest.matched_depth(0.8)
    miss = [(1 - 0.8**d) ** shingle_forest.TREES for d in (depth, depth + 1)]
    assert 1 - miss[0] >= shingle_forest.RECALL > 1 - miss[1]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_exact_scores(spark, sf_dir, scale):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    if scale:
        x *= np.random.default_rng(1).uniform(0.5, 2, (len(x), 1))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<double>")
    found = defaultdict(list)
    for r in multiprobe.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = wanted = 0
    place = {int(i): k for k, i in enumerate(ids)}
    for q in (int(i) for i in ids if i % 20 == 0):
        scores = x @ x[place[q]]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        assert len(found[q]) == 20 and all(abs(s - scores[place[v]]) < 1e-12 for v, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
        hits += len(set(order) & {v for v, _ in found[q]})
        wanted += 20
    assert hits / wanted >= 0.9


def test_recall_beside_copies(spark, sf_dir):
    """Copies of one vector, a third of all rows, cost the other queries no neighbours."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    more = np.array([i for i in range(int(ids.max()) + 1, int(ids.max()) + 2 * len(ids)) if i % 20][:len(ids) // 2])
    ids, x = np.concatenate([ids, more]), np.concatenate([x, np.repeat(x[1:2], len(more), 0)])
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<double>")
    found = defaultdict(set)
    for r in multiprobe.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        scores = np.where(ids == ids[k], -np.inf, x @ x[k])
        want = {int(i) for i in ids[np.lexsort((ids, -scores))[:20]]}
        assert len(found[int(ids[k])]) == 20
        hits.append(len(want & found[int(ids[k])]) / 20)
    assert np.mean(hits) >= 0.9


def test_odd_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("score", T.StringType())])
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0], "s"), (21, [1.0, 0.0], "s"), (22, [1.0, 0.0], "s"), (23, [0.5, 0.5], "s"), (24, None, "s"), (25, [0.0, 0.0], "s"),
            (26, [nan, 1.0], "s"), (27, [inf, 1.0], "s"), (28, [None, 1.0], "s"), (29, [], "s"), (None, [1.0, 1.0], "s"), (40, [1.0, 2.0, 3.0], "s"),
            (30, [-1.0, 0.0], "s"), (30, [-1.0, 0.0], "s")]
    vectors = spark.createDataFrame(rows, schema)
    found = [tuple(r) for r in multiprobe.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert [r for r in found if r[2] != 30] == [(20, 1, 21, 1.0), (20, 2, 22, 1.0), (20, 3, 23, 0.5)]
    assert multiprobe.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_keep_every_bucket_together_or_split():
    counts = {(2, 0, b): n for b, n in enumerate([5, multiprobe.BLOCK * 3 + 1, 7, multiprobe.BLOCK, 1])} | {(2, 1, 0): 3}
    placed = multiprobe.split(counts)
    used = defaultdict(int)
    for bucket, (first, parts) in placed.items():
        for k in range(parts):
            used[first + k] += counts[bucket] / parts
    assert max(used.values()) <= multiprobe.BLOCK and placed[2, 0, 1][1] == 4
    assert len({b[:2] for b, (first, _) in placed.items() if first == placed[2, 1, 0][0]}) == 1
