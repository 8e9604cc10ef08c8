"""A page index: rows in the order of their keys, in ranges that are stored apart, with the number of rows in each.

Ranges are dealt by samples of the keys and hold about ``ROWS`` rows. A page at any offset reads the ranges that it
lies in, one or two, and the total is the sum of the stored numbers. An index is of the rows at the time it was made.

Defined results: the order is total only if the keys are; equal keys lie in one range, so a key that a third of all rows
have makes a large range, which add a unique column to the keys avoids; nulls stand where the order puts them; an
offset behind the last row gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = 100_000


def ordered(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]


class Pages:
    """At ``path``: rows/range=<n>, counts (range, n) and the keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        told = json.loads(spark.read.text(f"{self.path}/keys").first().value)
        self.keys, self.schema = [tuple(x) for x in told["keys"]], StructType.fromJson(told["schema"])
        before, self.ranges = 0, []
        for r in spark.read.parquet(f"{self.path}/counts").orderBy("range").collect():  # one row for each range
            self.ranges.append((r.range, before, r.n))
            before += r.n
        self.total = before

    @classmethod
    def build(cls, rows: DataFrame, path: str, keys: list[tuple[str, bool]], per_range: int = ROWS) -> Pages:
        """keys: (column, ascending)."""
        spark, order, path = rows.sparkSession, ordered(keys), path.rstrip("/")
        dealt = rows.repartitionByRange(max(1, -(-rows.count() // per_range)), *order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
        spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
        spark.createDataFrame([(json.dumps({"keys": keys, "schema": dealt.schema.jsonValue()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/keys")
        return cls(spark, path)

    def page(self, offset: int, limit: int) -> DataFrame:
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit can't be negative")
        own = [(r, before) for r, before, n in self.ranges if before < offset + limit and before + n > offset]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col("range").isin([r for r, _ in own])).drop("range")
        return rows.orderBy(*ordered(self.keys)).offset(offset - own[0][1] if own else 0).limit(limit)
