"""Connected components of a link table, by alternating stars (each round is two aggregations; rounds grow with the logarithm
of the largest component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.sources.scratch import Scratch

_ROUNDS = 60


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node that can be reached. Nulls and loops are no links.

    Nodes are of any type that has an order. The result is a stored table of ``scratch`` (components)."""
    scratch = scratch or Scratch(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, last = scratch.put("edges_0", edges), "edges_0"
    for i in range(1, _ROUNDS):
        # large star: larger neighbours of a node move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.put("large", both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = scratch.put(f"edges_{i}", small)
        scratch.drop("large", last)
        # done when every node has one parent and no parent has one
        settled = not small.groupBy("u").count().where("count > 1").take(1) and not small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").take(1)
        edges, last = small, f"edges_{i}"
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = scratch.put("components", pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    scratch.drop(last)
    return out
