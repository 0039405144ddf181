"""Components of graphs, and clusters of events by both rules, against union-find."""
import random

import pytest
from pyspark.sql import functions as F

from almanac import schemas
from almanac.operators import ledger
from almanac.operators.components import components


def roots_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def check(spark, edges):
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    real = [e for e in edges if None not in e]
    assert found == roots_of({n for e in real for n in e}, real)


def named(i):
    return f"{i:06d}"


def test_chains(spark):
    """A chain in order, one against it, and one in random order."""
    order = list(range(700, 1000))
    random.Random(1).shuffle(order)
    edges = [(named(i), named(i + 1)) for i in range(300)] + [(named(700 - i), named(699 - i)) for i in range(300)]
    check(spark, edges + [(named(a), named(b)) for a, b in zip(order, order[1:])])


def test_hub_and_random_graph(spark):
    r = random.Random(2)
    edges = [("hub", named(i)) for i in range(3000)] + [(named(r.randrange(5000, 9000)), named(r.randrange(5000, 9000))) for _ in range(1800)]
    check(spark, edges + [("x", "x"), ("y", "z"), ("z", "y"), ("y", "z"), (None, "q"), ("q", None)])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def events_of(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, external_id string, title string, start_time string, place string, source_id int")
    place = F.struct(F.lit("text").alias("kind"), F.col("place").alias("text"), F.lit(None).cast(schemas.PLACE).alias("place"))
    return df.withColumn("location", place).drop("place")


def clusters_of(rows):
    """The least id of all events that ids, or title, start and place, connect."""
    nodes, edges = list(range(len(rows))), []
    seen = {}
    for i, (ident, title, start, place, _) in enumerate(rows):
        keys = [("id", ident)] if ident is not None else []
        if (title or "").strip() and start:
            keys.append((" ".join(title.lower().split()), start, (place or "").strip().lower()))
        for k in keys:
            edges.append((seen.setdefault(k, i), i))
    root = roots_of(nodes, edges)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return [least.get(root[i]) for i in nodes]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_events(spark, seed):
    r = random.Random(seed)
    titles, starts = ["Fair", " fair ", "Talk", "Concert", "Walk", "", None, "Play  of the day", "play of The Day"], ["2025-01-01", "2025-01-02", "", None]
    rows = [(r.choice([None, *map(named, range(40 * seed))]), r.choice(titles) or "", r.choice(starts), r.choice(["Hall", "hall ", None]), r.randrange(5)) for _ in range(60)]
    rows += [(named(500 + i // 2), f"step {(i + 1) // 2}", "2025", "x", i) for i in range(80)]           # one chain
    rows += [("hot", f"own {i}", "2025", "x", 0) for i in range(300)] + [(named(900 + i), "hot", "2025", "x", 0) for i in range(300)]
    expected = clusters_of(rows)
    found = ledger.same_events(events_of(spark, rows)).orderBy("n").collect()
    assert [f.cluster_id for f in found] == expected
    assert {expected[i] for i in range(60, 140)} == {named(500)}
    summary = {s.cluster_id: s for s in ledger.same_event_clusters(events_of(spark, rows)).collect()}
    assert set(summary) == {c for c in expected if c is not None}
    assert sum(s.copies for s in summary.values()) == sum(c is not None for c in expected)
    assert summary["hot"].ids == 1 and summary["hot"].variants == 300 and summary[named(900)].ids == 300


def test_events_without_anything(spark):
    rows = [(None, "", "2025", "a", 1), (None, None, None, None, None), (None, "t", "2025", "", 1), (None, "T ", "2025", None, 2), ("", "t", None, None, 1)]
    assert [r.cluster_id for r in ledger.same_events(events_of(spark, rows)).orderBy("n").collect()] == [None, None, None, None, ""]
    assert ledger.same_events(events_of(spark, rows).limit(0)).count() == 0
