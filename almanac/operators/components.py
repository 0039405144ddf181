"""Connected components of a graph given as a table of edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.functions.joins import lookup
from almanac.plans.staging import write_once


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every end of ``edges`` (``a, b``): the least node of its connected component.

    A node takes the least root among its neighbours', then the root of its root, so what it knows reaches twice as far
    with every round and a chain of n edges takes some log n rounds.  Each round is a stored table; rounds end when no root
    changes.  Edges in either direction, repeated ones and loops may occur; an edge with a NULL end is none.  A node of very
    many edges is hot in joins that adaptive execution splits, and its neighbours are reduced on the map side.
    """
    real = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = write_once(real.select("a", "b").unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = write_once(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("root")))
    while True:
        around = lookup(both, roots.withColumnRenamed("node", "b"), ["b"])
        nearest = around.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        hooked = write_once(roots.join(nearest, "node").select(
            "node", F.least("root", "_near").alias("root"), (F.col("_near") < F.col("root")).alias("moved")))
        further = hooked.select(F.col("node").alias("root"), F.col("root").alias("_further"))
        stepped = write_once(lookup(hooked, further, ["root"]).select(
            "node", F.col("_further").alias("root"), (F.col("moved") | (F.col("_further") < F.col("root"))).alias("moved")))
        roots = stepped.select("node", "root")
        if stepped.filter("moved").isEmpty():
            return roots
