"""Connected components by alternating large-star and small-star joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, saved


def starred(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v). Large: every node hands the smallest of its neighbours and itself to its larger
    neighbours; small: to its smaller ones and itself. Only minima are aggregated, so a node's degree is no task's."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    moved = near.join(least, near["u"] == least["node"])
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge of ``edges`` (columns u, v of one ordered type): root is the smallest
    node of its component. Self-loops, repeated edges and both directions are fine; null ends are left out. Rounds go on
    until nothing changes: edges only ever move to smaller nodes, so they end."""
    now = saved(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        after = saved(starred(starred(now, True), False), "edges")
        dropped(now)
        now, before = after, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    roots = now.select(F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("root").alias("node"), "root"))
