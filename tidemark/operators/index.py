"""A stored vector index: lists around centres, with product-quantised residuals, and an exact second look.

A unit vector is its list's centre and a residual. The residual is cut in sub-vectors, and each is told by the nearest
of at most 256 entries of a codebook of its own: one byte. A query has one table of inner products for each codebook,
so a row's approximate score is its centre's score and one lookup for each byte. The codes of the query's nearest lists
are read (``codes``, partitioned by list); the best of these, the short list, is looked up in ``vectors``, whose rows
are sorted by key within a list, so that Parquet's page index leaves all but the pages of those keys unread.

Centres and codebooks are fitted on at most ``SAMPLE`` vectors, in the order of hashed keys; every vector is indexed.
How many lists a search reads and how long its short list is are measured at the end of a build: both are the least that
hold ``RECALL`` of the true neighbours of TRIALS vectors, themselves left out, which an exact search finds. Rows appended later
are coded by the same centres and books and land beside the others.

Defined results: rows without a vector are not indexed, a vector without length lies in list 0 and has the score 0.5;
the same key may occur more than once; fewer rows than asked for may come back where the lists hold fewer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.vector import matrix, neighbours, top_k, unit
from tidemark.plans.tables import deleted, scratch

#: Vectors that centres and books are fitted on at most, queries that a build measures with, the recall it aims at.
SAMPLE, TRIALS, RECALL = 20_000, 200, 0.97
#: Rows in a list about, lists at most, entries of a codebook, components of a sub-vector, and the longest short list.
LIST_ROWS, MOST_LISTS, BOOK, SUB, LONGEST = 1000, 4096, 256, 4, 4000
#: Rows of a page of full vectors, rows scored at a time, and keys of a short list that are looked up one by one.
PAGE_ROWS, SLICE, LOOKED_UP = 32, 4096, 400


def fitted(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7, sphere: bool = False) -> np.ndarray:
    """Centres by k-means (on the unit sphere, if asked); an empty one stays where it is."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, out)
        sums, count = np.zeros_like(out), np.bincount(own, minlength=len(out))[:, None]
        np.add.at(sums, own, sample)
        means = sums / np.maximum(count, 1)
        out = np.where(count > 0, unit(means) if sphere else means, out)
    return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by squared distance, over blocks of rows."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((rows[i : i + SLICE] @ centres.T - half).argmax(axis=1) for i in range(0, len(rows), SLICE))])


def books_of(residuals: np.ndarray, sub: int, entries: int = BOOK) -> np.ndarray:
    """[sub-vectors, entries, components] codebooks; a small sample's last entry is repeated."""
    parts = residuals.reshape(len(residuals), -1, sub)
    books = [fitted(parts[:, m], entries, seed=m) for m in range(parts.shape[1])]
    return np.stack([np.concatenate([b, np.repeat(b[-1:], entries - len(b), axis=0)]) for b in books])


class Coder:
    """Lists and codes of vectors, and scores of codes."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books
        self.dim, self.sub = centres.shape[1], books.shape[2]

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, len(self.books) * self.sub - self.dim)))

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, [rows, sub-vectors] bytes) of unit vectors; a zero vector is in list 0."""
        own = np.where(rows.any(axis=1), nearest(rows, self.centres), 0)
        left = self.padded(rows - self.centres[own]).reshape(len(rows), -1, self.sub)
        return own, np.stack([nearest(left[:, m], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[queries, sub-vectors, entries] inner products."""
        return np.einsum("qms,mes->qme", self.padded(queries).reshape(len(queries), -1, self.sub), self.books)

    def near(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """[queries, probes] nearest lists."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :probes]


class Index:
    """The index at ``path``; a search sees what was there when the index was opened, or appended through it."""

    def __init__(self, path: str, coder: Coder, probes: int, short: int, schema: T.StructType):
        self.path, self.coder, self.probes, self.short, self.schema = path, coder, probes, short, schema

    @property
    def centres(self) -> np.ndarray:
        return self.coder.centres

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "chunk_hash", k: int = 10, lists: int | None = None, sub: int = SUB) -> Index:
        spark, real = vectors.sparkSession, vectors.where("vector IS NOT NULL")
        n = real.count()
        if not n:
            raise ValueError("there are no vectors to index")
        share = min(1.0, 1.5 * SAMPLE / n)
        some = real.select(key, "vector", F.xxhash64(key).alias("h")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).orderBy("h", key).limit(SAMPLE).collect()
        sample = unit(np.array([r.vector for r in some], np.float64))
        centres = fitted(sample, lists or max(1, min(MOST_LISTS, n // LIST_ROWS, round(4 * np.sqrt(n)))), sphere=True)
        left = sample - centres[nearest(sample, centres)]
        books = books_of(np.pad(left, ((0, 0), (0, -left.shape[1] % sub))), sub)
        out = cls(path, Coder(centres, books), len(centres), LONGEST, real.schema)
        out.append(real, key, "overwrite")
        out.measure(spark, [r[key] for r in some[:TRIALS]], sample[:TRIALS], key, k)
        told = [(i, c.tolist(), None) for i, c in enumerate(centres)] + [(i, b.ravel().tolist(), b.shape[1]) for i, b in enumerate(books)]
        spark.createDataFrame(told, "number int, numbers array<double>, sub int").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        told = json.dumps({"probes": out.probes, "short": out.short, "schema": real.schema.jsonValue()})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/told")
        return out

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/books").orderBy("number").collect()  # centres and books: their number is bounded
        centres, books = np.array([r.numbers for r in rows if r["sub"] is None]), np.array([np.reshape(r.numbers, (-1, r["sub"])) for r in rows if r["sub"] is not None])
        told = json.loads(spark.read.text(f"{path}/told").first().value)
        return cls(path, Coder(centres, books), told["probes"], told["short"], T.StructType.fromJson(told["schema"]))

    def append(self, vectors: DataFrame, key: str = "chunk_hash", mode: str = "append") -> None:
        """Codes rows (with the columns that the index was built on) by the centres and books that it has."""
        spark, schema = vectors.sparkSession, self.schema
        shared, place = spark.sparkContext.broadcast(self.coder), schema.fieldNames().index("vector")

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, shared.value.dim)
                own, code = shared.value.code(unit(rows))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=[*b.schema.names, "list", "code"])

        real = vectors.where("vector IS NOT NULL").select(*schema.fieldNames())
        rows = real.mapInArrow(coded, T.StructType([*schema.fields, T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType())]))
        # ranges of (list, key): a long list is cut over several tasks, and each writes few lists
        staged = scratch(spark, "coded")
        rows.repartitionByRange("list", key).sortWithinPartitions("list", key).write.parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged).repartitionByRange("list", key).sortWithinPartitions("list", key)
        small = {"parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": str(PAGE_ROWS)}
        rows.select(key, "vector", "list").write.mode(mode).options(**small).partitionBy("list").parquet(f"{self.path}/vectors")
        rows.drop("vector", "content").write.mode(mode).partitionBy("list").parquet(f"{self.path}/codes")
        deleted(spark, staged)

    def measure(self, spark: SparkSession, keys: list, trials: np.ndarray, key: str, k: int) -> None:
        """Sets probes and the length of the short list by the true neighbours of vectors that are left out."""
        stored = spark.read.parquet(f"{self.path}/vectors")
        asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(trials)], "query int, query_vector array<double>")
        true = neighbours(stored, asked, k + 1, key).join(stored.select(key, "list").distinct(), key).select("query", "list", key).collect()  # TRIALS x (k + 1)
        true = [r for r in true if r[key] != keys[r["query"]]]
        if not true:
            self.probes, self.short = 1, k
            return
        rank = np.argsort(np.argsort(-(trials @ self.centres.T), axis=1, kind="stable"), axis=1)
        # of what is missed at most half is missed by either
        part = 1 - (1 - RECALL) / 2
        self.probes = int(np.quantile([rank[r["query"], r["list"]] for r in true], part, method="higher")) + 1
        places = {(r["query"], r[key]): r.place for r in self.candidates(spark, trials, LONGEST, key).collect()}
        self.short = max(k, int(np.quantile([places.get((r["query"], r[key]), LONGEST) for r in true], part, method="higher")))

    def candidates(self, spark: SparkSession, queries: np.ndarray, short: int, key: str, where: Column | None = None) -> DataFrame:
        """(query, key, list, score, place from 1): the best by codes, of unit vectors that all tasks hold."""
        lists = self.coder.near(queries, self.probes)
        rows = spark.read.parquet(f"{self.path}/codes").where(F.col("list").isin(np.unique(lists).tolist()))
        rows = rows if where is None else rows.where(where)
        asks = {}
        for q, row in enumerate(lists.tolist()):
            for x in row:
                asks.setdefault(x, []).append(q)
        shared = spark.sparkContext.broadcast((self.coder.tables(queries).astype(np.float32), queries @ self.centres.T, {x: np.array(q) for x, q in asks.items()}))
        kind = rows.schema[key].dataType.simpleString()

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, base, by_list = shared.value
            best: dict[int, tuple] = {}  # of each query the short list so far: scores, keys, lists
            for b in batches:
                own = b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(b), tables.shape[1])
                for x in np.unique(own).tolist():
                    rows = np.flatnonzero(own == x)
                    for q in by_list[x].tolist():
                        found = base[q, x] + tables[q][np.arange(tables.shape[1]), code[rows]].sum(axis=1)
                        keys, at = b.column(0).take(pa.array(rows)), np.full(len(rows), x)
                        if q in best:
                            found, keys, at = np.concatenate([best[q][0], found]), pa.concat_arrays([best[q][1], keys]), np.concatenate([best[q][2], at])
                        top = np.argsort(-found, kind="stable")[:short] if len(found) > short else np.arange(len(found))
                        best[q] = found[top], keys.take(pa.array(top)), at[top]
            for q, (found, keys, at) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q), pa.int32()), keys, pa.array(at, pa.int32()), pa.array(found.astype(np.float64))], names=["query", key, "list", "score"])

        near = rows.select(key, "list", "code").mapInArrow(scored, f"query int, {key} {kind}, list int, score double")
        return near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("place") <= short)

    def near(self, query: list[float]) -> list[int]:
        return self.coder.near(unit(np.array([query], np.float64)), self.probes)[0].tolist()

    def top_k(self, spark: SparkSession, query: list[float], k: int = 10, key: str = "chunk_hash", where: Column | None = None) -> DataFrame:
        """The k nearest of one query: by codes, then exactly among the short list. Filters go before the short list."""
        found = self.candidates(spark, unit(np.array([query], np.float64)), max(k, self.short), key, where).select(key, "list").collect()  # a short list
        rows = self.looked_up(spark, sorted({(r["list"], r[key]) for r in found}), key)
        return top_k(rows.drop("list"), query, k, key)

    def looked_up(self, spark: SparkSession, keys: list[tuple], key: str) -> DataFrame:
        """Full vectors of (list, key). One comparison for each key, since Spark hands a long list of values down to
        Parquet as their range; above LOOKED_UP keys that would cost more than it spares, so the lists are joined."""
        rows = spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(sorted({x for x, _ in keys})))
        if not keys:
            return rows.where("false")
        if len(keys) > LOOKED_UP:
            some = spark.createDataFrame(keys, T.StructType([T.StructField("list", T.IntegerType()), rows.schema[key]]))
            return rows.join(F.broadcast(some), ["list", key], "left_semi")  # at most LONGEST rows
        return rows.where(reduce(lambda a, b: a | b, [F.col(key) == F.lit(x) for x in sorted({x for _, x in keys})]))

    def search(self, spark: SparkSession, queries: DataFrame, k: int = 10, key: str = "chunk_hash", most: int = 1000) -> DataFrame:
        """(query, key, score) of a stated set of queries (query, query_vector), which every task holds: ``most`` at most."""
        asked = queries.limit(most + 1).collect()
        if len(asked) > most:
            raise ValueError(f"more than {most} queries: search for them in blocks")
        names, vectors = [r["query"] for r in asked], unit(np.array([r.query_vector for r in asked], np.float64))
        near = self.candidates(spark, vectors, max(k, self.short), key).select("query", key, "list")
        given = spark.createDataFrame([(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, vectors, strict=True))], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("name", queries.schema["query"].dataType), T.StructField("query_vector", T.ArrayType(T.DoubleType()))]))
        rows = spark.read.parquet(f"{self.path}/vectors").join(near, ["list", key]).join(F.broadcast(given), "query")
        shared = T.StructType([given.schema["name"], rows.schema[key], T.StructField("score", T.DoubleType())])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dim = vectors.shape[1]
                a, c = (unit(matrix(b.select([0, i]), dim)[1]) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip((1 + (a * c).sum(axis=1)) / 2, 0, 1))], names=["name", key, "score"])

        scored = rows.select("name", key, "vector", "query_vector").mapInArrow(exact, shared)
        last = Window.partitionBy("name").orderBy(F.desc(F.round("score", 12)), key)
        return scored.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= k).select(F.col("name").alias("query"), key, "score")
