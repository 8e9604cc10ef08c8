"""Change tokens: snapshots of keyed items, what changed since a token, and a range of time where a token has expired.

A snapshot is a table of (href, etag, and the item's columns); its token is its number. What changed since a token is
the difference of two snapshots by href: items that are new or have another etag, and those that are gone. Of the snapshots
the last ``keep`` stay, so older tokens expire. A synchronisation with an expired or unknown token reads the items of
a range of time instead, as a client would that has lost its place: removals can't be seen in it.

Defined results: a null etag differs from every other; hrefs are unique in a snapshot, of repeated ones the greatest
etag counts; a token of the last snapshot has no changes; without a snapshot there is nothing to read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.durable import Files

KEEP, YEARS = 10, 10


class TokenExpired(ValueError):
    """There is no snapshot of this token any more."""


@dataclass
class Delta:
    """items: (href, kind upserted or removed, and the columns of a snapshot, null where removed)."""

    items: DataFrame
    token: str
    by_token: bool


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.files, self.keep = spark, Files(spark, path), keep

    def tokens(self) -> list[str]:
        """Those of whole snapshots, in order."""
        return [n.removeprefix("token=") for n in self.files.names("snapshots") if self.files.names(f"snapshots/{n}").count("_SUCCESS")]

    def put(self, items: DataFrame) -> str:
        """items: (href, etag, ...), all that there are now. Returns their token; one that is cut off is no snapshot."""
        known = self.files.names("snapshots")
        token = f"{int(known[-1].removeprefix('token=')) + 1 if known else 0:012d}"
        rows = items.groupBy("href").agg(F.max_by(F.struct(*items.columns), F.struct(F.col("etag").isNotNull(), "etag")).alias("x")).select("x.*")
        rows.write.parquet(f"{self.files.path}/snapshots/token={token}")
        for old in self.tokens()[: -self.keep]:
            self.files.drop(f"snapshots/token={old}")
        return token

    def at(self, token: str) -> DataFrame:
        if token not in self.tokens():
            raise TokenExpired(token)
        return self.spark.read.parquet(f"{self.files.path}/snapshots/token={token}")

    def since(self, token: str) -> Delta:
        """What changed between a token and the last snapshot."""
        last = self.tokens()[-1]
        now, old = self.at(last), self.at(token).select(F.col("href").alias("_href"), F.col("etag").alias("_etag"), F.lit(True).alias("_there"))
        both = now.withColumn("_now", F.lit(True)).join(old, F.col("href") == F.col("_href"), "full_outer")
        changed = both.where("_now IS NULL OR _there IS NULL OR etag IS NULL OR NOT (etag <=> _etag)")
        kind = F.when(F.col("_now").isNull(), "removed").otherwise("upserted").alias("kind")
        return Delta(changed.select(F.coalesce("href", "_href").alias("href"), kind, *[c for c in now.columns if c != "href"]), last, True)

    def sync(self, token: str | None, since: str | None, start: str = "start", end: str = "end") -> Delta:
        """Changes since the token; where that has expired, the items that end after the time ``since`` and start within
        YEARS of it (columns start and end: ISO timestamps); without token and time, all items."""
        if token is not None:
            try:
                return self.since(token)
            except TokenExpired:
                pass
        tokens = self.tokens()
        if not tokens:
            raise ValueError("there is no snapshot yet")
        now = self.at(tokens[-1])
        if since is not None:
            at = F.to_timestamp(F.lit(since))
            begins, ends = F.try_to_timestamp(F.col(start)), F.try_to_timestamp(F.coalesce(F.col(end), F.col(start)))
            now = now.where((ends >= at) & (begins < at + F.make_ym_interval(F.lit(YEARS), F.lit(0))))
        return Delta(now.select("href", F.lit("upserted").alias("kind"), *[c for c in now.columns if c != "href"]), tokens[-1], False)
