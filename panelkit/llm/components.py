"""Connected components of an edge table, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the least node that it reaches. Self-loops and repeats are allowed.

    Alternates two steps until nothing changes: each node links its larger neighbours to the least node around it,
    then each node links its smaller neighbours and itself to the least of them. The number of rounds grows with the
    logarithm of the nodes; every round writes a checkpoint, so the plan stays short and survives lost executors.
    Neighbour lists are never gathered: a node of very many edges is a join key that adaptive execution can split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = cut(e), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every u now has smaller neighbours only
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
