"""Stored distinct counts: a sketch for each day and group, merged for any span of days.

A sketch is made where the rows are and merged by shuffling one sketch for each group and task, so neither many rows nor a
hot group matter. Days are partitions of the table: one is written anew without the others, and a span of days reads
its own. With 2**LG registers the standard error is 1.04 / sqrt(2**LG), 0.8 %; counts that a sketch can hold as a list
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG = 14


def daily(rows: DataFrame, at: str, group: str, item: str) -> DataFrame:
    """(day, group, n, sketch) of the distinct items; null items count as rows but not as items."""
    sketch = F.hll_sketch_agg(F.col(item).cast("string"), F.lit(LG))
    return rows.groupBy(F.to_date(at).alias("day"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("sketch"))


def stored(sketches: DataFrame, path: str) -> None:
    """Writes days, each as a whole; other days stay as they are."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None, before: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if since is None else rows.where(F.col("day") >= F.to_date(F.lit(since)))
    return rows if before is None else rows.where(F.col("day") < F.to_date(F.lit(before)))


def estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., n, items): rows and about how many distinct items, over the days that are there."""
    rows = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return rows.select(*by, "n", estimate(F.col("sketch")).alias("items"))
