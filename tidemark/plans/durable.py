"""A store on disk that grows by what changes: each batch writes its own rows, and buckets are folded now and then.

Layout under a path: ``delta/<table>/batch=<n>`` holds the rows that batch n made or changed, and as rows with ``gone``
those that it took away; ``base/<table>/fold=<n>/bucket=<b>`` holds whole buckets as they were after batch n, a bucket
being a part of the keys by hash. A manifest names the batches and the buckets that count; it is written aside and
renamed, so a batch counts as a whole or not at all, and one that is run again after a crash either finds itself done or
overwrites what it had left. Of several rows of a key the one of the latest batch counts.

A batch is worked on the rows of its sources alone: those of their buckets are read, filtered, changed by the operations
of Store, and compared with what they were. So what is written follows the batch, not the store. After ``MOST`` batches
the buckets that they touched are rewritten (each is a ``BUCKETS``-th of the store) and the batches' own files go, with
the buckets that were replaced; they go one fold later, so that a reader of the manifest before isn't cut off.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.plans.store import SCHEMAS, Store, empty
from tidemark.plans.tables import by_source, dealt_at, deleted, owned, saved, unnamed
from tidemark.plans.tables import dealt as dealt_to

#: Of each table the columns that tell its rows apart; the first is the one that buckets are made by.
KEYS = {
    "adapters": ("adapter_id",), "sources": ("source_id",), "versions": ("source_id", "version"), "chunks": ("source_id", "source_version", "chunk_hash"), "entity_links": ("source_chunk_hash", "target_chunk_hash", "link_type"),
    "sync_log": ("chunk_hash", "operation"), "dead_letters": ("source_id", "adapter_id", "error_type"), "vectors": ("source_id", "chunk_hash"),
}
BY_SOURCE = [t for t, key in KEYS.items() if key[0] == "source_id"]
BUCKETS, MOST = 64, 16


def bucket_of(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEYS[table][0]), F.lit(buckets)).cast("int")


class Files:
    """Small files and folders through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.Path = spark, path.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []

    def put(self, name: str, text: str) -> None:
        """Aside, then renamed; what is there already stays."""
        aside, to = self.Path(f"{self.path}/{name}.tmp"), self.Path(f"{self.path}/{name}")
        out = self.system.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.system.rename(aside, to) and not self.system.exists(to):
            raise OSError(f"can't write {name}")

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value

    def size(self, folder: str) -> int:
        at = self.Path(f"{self.path}/{folder}")
        return self.system.getContentSummary(at).getLength() if self.system.exists(at) else 0

    def drop(self, folder: str) -> None:
        deleted(self.spark, f"{self.path}/{folder}")


class DurableStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most: int = MOST):
        self.spark, self.files, self.most = spark, Files(spark, path), most
        found = [n for n in self.files.names("manifests") if n.endswith(".json")]
        #: batches: not folded yet; dealt: the parts that a batch's rows are dealt into by source; done: the last; base: of each table and bucket the fold; gone: what goes with the next fold
        self.manifest = json.loads(self.files.text(f"manifests/{found[-1]}")) if found else {"buckets": buckets, "done": -1, "batches": [], "wrote": {}, "dealt": {}, "base": {t: {} for t in SCHEMAS}, "gone": []}
        self.buckets = self.manifest["buckets"]

    # Reading

    def table(self, name: str, buckets: list[int] | None = None, keys: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
        """The rows of a table as they are now; of some buckets; of the keys (first key column) in a table, which is of few, or
        dealt by them into so many parts, as the rows are then."""
        columns, key = StructType.fromDDL(SCHEMAS[name]).fieldNames(), list(KEYS[name])
        base = {b: n for b, n in self.manifest["base"][name].items() if buckets is None or int(b) in buckets}
        paths, parts = [f"{self.files.path}/base/{name}/fold={n}/bucket={b}" for b, n in sorted(base.items())], []
        batches = self.changed(name)
        spread = (lambda df: df) if dealt is None else (lambda df: df.repartition(dealt, key[0]))
        within = (lambda df: df) if keys is None else (lambda df: df.join(keys, key[0], "left_semi"))
        if batches:
            if name in BY_SOURCE and dealt is not None and self.dealt_alike(batches, dealt):
                each = [dealt_at(self.spark, f"{self.files.path}/delta/{name}/batch={n}", f"{SCHEMAS[name]}, gone boolean", dealt).withColumn("batch", F.lit(n).cast("bigint")) for n in batches]
                rows = within(reduce(DataFrame.unionByName, [unnamed(each[0]), *each[1:]]))
            else:
                rows = within(spread(self.spark.read.schema(f"{SCHEMAS[name]}, gone boolean, batch bigint").option("basePath", f"{self.files.path}/delta/{name}").parquet(*[f"{self.files.path}/delta/{name}/batch={n}" for n in batches])))
            if buckets is not None:
                rows = rows.where(bucket_of(name, self.buckets).isin(buckets))
            # a batch has a key once
            newest = rows if len(batches) == 1 else rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))).where("_n = 1")
            parts.append(newest.where("NOT gone").select(columns))
        if paths:
            rows = within(spread(self.spark.read.schema(SCHEMAS[name]).parquet(*paths)))
            parts.append(rows.alias("b").join(newest.select(key).alias("d"), reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]), "left_anti") if batches else rows)
        return reduce(DataFrame.unionByName, parts) if parts else empty(self.spark, name)

    def changed(self, name: str) -> list[int]:
        """The batches that changed a table and aren't folded yet."""
        return [n for n in self.manifest["batches"] if name in self.manifest["wrote"][str(n)]]

    def dealt_alike(self, batches: list[int], dealt: int) -> bool:
        return all(self.manifest.get("dealt", {}).get(str(n)) == dealt for n in batches)

    def as_written(self, name: str, dealt: int) -> bool:
        """Whether a table is what one batch wrote, dealt so, or nothing yet: its rows are read as they are."""
        batches = self.changed(name)
        return not self.manifest["base"][name] and len(batches) < 2 and self.dealt_alike(batches, dealt)

    def store(self) -> Store:
        return Store(**{t: self.table(t) for t in SCHEMAS})

    def of_sources(self, sources: DataFrame, dealt: int | None = None) -> Store:
        """The store of some sources (source_id), whose buckets are read; with all adapters, links and pending operations.
        Sources and their rows are dealt into so many parts."""
        buckets = sorted(r.bucket for r in sources.select(bucket_of("sources", self.buckets).alias("bucket")).distinct().collect())  # BUCKETS at most
        ids = sources.select("source_id").distinct()
        return Store(**{t: self.table(t, buckets, ids, dealt) if t in BY_SOURCE else self.table(t) for t in SCHEMAS})

    # Writing

    def apply(self, batch: int, sources: DataFrame, change: Callable[[Store], Store], dealt: int | None = None) -> bool:
        """Runs an operation on the rows of the sources that it touches and commits what it changed as a batch. False,
        without doing anything, for a batch that has been committed before. dealt: the rows that the operation works on are
        dealt by source into so many parts; where it keeps to them, neither it nor what is written moves texts and chunks."""
        if batch <= self.manifest["done"]:
            return False
        with owned(self.spark):
            ids = sources.select("source_id")
            ids = ids.distinct() if dealt is None else ids.repartition(dealt, "source_id").distinct()
            before = self.of_sources(saved(ids, "touched", dealt), dealt)
            if dealt is None:
                before = replace(before, **{t: saved(getattr(before, t), f"before-{t}") for t in ("sources", "versions", "chunks", "dead_letters")})
            else:
                before = replace(before, **{t: unnamed(saved(getattr(before, t), f"before-{t}", dealt)) for t in ("sources", "versions", "chunks") if not self.as_written(t, dealt)})
                before = replace(before, dead_letters=saved(before.dead_letters, "before-dead_letters"))
            after = change(before)
            wrote = [t for t in SCHEMAS if getattr(after, t) is not getattr(before, t) and self.written(t, batch, getattr(before, t), getattr(after, t), dealt if t in BY_SOURCE else None)]
        manifest = {**self.manifest, "done": batch, "batches": [*self.manifest["batches"], batch], "wrote": {**self.manifest["wrote"], str(batch): wrote}}
        manifest["dealt"] = {**self.manifest.get("dealt", {}), **({} if dealt is None else {str(batch): dealt})}
        self.commit(manifest)
        if len(manifest["batches"]) >= self.most:
            self.fold()
        return True

    def written(self, name: str, batch: int, before: DataFrame, after: DataFrame, dealt: int | None = None) -> bool:
        """Writes the rows that differ, dealt by source if they are so. Rows of a table are told apart by their key, compared
        by all their columns."""
        key, columns = list(KEYS[name]), before.columns
        told = lambda df: df.select(*key, F.struct(*columns).alias("row"))

        def differing(old: DataFrame, new: DataFrame, first: Callable[[Column, Column], Column]) -> DataFrame:
            on = [(first if k == key[0] else Column.eqNullSafe)(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in key]
            both = told(new).alias("a").join(told(old).alias("b"), reduce(lambda a, b: a & b, on), "full_outer").where("NOT (a.row <=> b.row)")
            return both.select(F.coalesce("a.row", "b.row").alias("row"), F.col("a.row").isNull().alias("gone")).select("row.*", "gone")

        if dealt is None:
            rows = differing(before, after, Column.eqNullSafe)
        else:
            # of the first column of the key it takes a plain comparison to know that rows are dealt by it; nulls are apart
            null = F.col(key[0]).isNull()
            rows = differing(before.where(~null), after.where(~null), Column.__eq__).unionByName(differing(before.where(null), after.where(null), Column.eqNullSafe))
        path = f"{self.files.path}/delta/{name}/batch={batch}"
        if dealt is None:
            with by_source(self.spark):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        else:
            dealt_to(rows, path, dealt)
        return not self.spark.read.schema(f"{SCHEMAS[name]}, gone boolean").parquet(path).isEmpty()

    def commit(self, manifest: dict) -> None:
        found = [n for n in self.files.names("manifests") if n.endswith(".json")]
        number = int(found[-1].split(".")[0]) + 1 if found else 0
        self.files.put(f"manifests/{number:012d}.json", json.dumps(manifest))
        self.manifest = manifest
        for old in found[:-1]:
            self.files.drop(f"manifests/{old}")

    def fold(self) -> None:
        """Rewrites the buckets that the batches touched, and lets the batches go."""
        old, done = self.manifest, self.manifest["done"]
        base, gone = {t: dict(old["base"][t]) for t in SCHEMAS}, [f"delta/{t}/batch={n}" for t in SCHEMAS for n in old["batches"]]
        for t in SCHEMAS:
            batches = [n for n in old["batches"] if t in old["wrote"][str(n)]]
            if not batches:
                continue
            changed = self.spark.read.schema(SCHEMAS[t]).parquet(*[f"{self.files.path}/delta/{t}/batch={n}" for n in batches])
            touched = sorted(r.bucket for r in changed.select(bucket_of(t, self.buckets).alias("bucket")).distinct().collect())
            rows = self.table(t, touched).withColumn("bucket", bucket_of(t, self.buckets))
            rows.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.files.path}/base/{t}/fold={done}")
            there = {int(n.removeprefix("bucket=")) for n in self.files.names(f"base/{t}/fold={done}") if n.startswith("bucket=")}
            gone += [f"base/{t}/fold={base[t][str(b)]}/bucket={b}" for b in touched if str(b) in base[t]]
            base[t] = {b: n for b, n in base[t].items() if int(b) not in touched} | {str(b): done for b in there}
        for path in [*old["gone"], *self.strays(old, done)]:
            self.files.drop(path)
        self.commit({**old, "batches": [], "wrote": {}, "dealt": {}, "base": base, "gone": gone})

    def strays(self, manifest: dict, done: int) -> list[str]:
        """Folds that no manifest names: of a fold that was cut off."""
        named = {(t, n) for t in SCHEMAS for n in manifest["base"][t].values()}
        return [f"base/{t}/{f}" for t in SCHEMAS for f in self.files.names(f"base/{t}") if (n := int(f.removeprefix("fold="))) != done and (t, n) not in named and not any(x.startswith(f"base/{t}/fold={n}/") for x in manifest["gone"])]
