"""Centroid clustering in integers, with centroids screened by block norms.

A vector x becomes floor(256 x). Its compressed form is the Euclidean norm of each of its ``SEGMENTS`` segments. By
Cauchy-Schwarz two vectors are at least as far apart as their compressed forms, so the squared distance of these is a
lower bound. A vector meets its centroids in the order of the bounds; a centroid whose bound, less a margin for rounding,
exceeds the best distance so far gets no distance. All others get exact integer ones, so the result is that of all
distances.

Vectors, integers and norms are written once and read in every round. A task hands on its sums and counts for each
centroid, so a round shuffles CENTROIDS rows a task, and only the centroids (a fixed number) reach the driver and, from
there, the tasks.

Defined results: a null vector, one of another length, or one with a null or non-finite component is left out; a null
vec_id counts as '' in the hash and stays null; of equal hashes (repeated ids) the vector that is smaller by components
comes first; with fewer vectors than centroids each vector starts one; equal vectors, centroids among them, go to the
smallest number; an empty table has no rows. A squared distance that doesn't fit into a long is an error, while components of any
size that give one that does are exact. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, table

LENGTH, SEGMENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 40, 5, 256
#: Components up to this size have squared distances that fit into a long; larger ones are counted in Python's integers.
SMALL = 1 << 27
#: Part of a bound's terms that rounding may make up.
MARGIN = 1e-9


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", length: int = LENGTH) -> DataFrame:
    """(vec_id, x): the vectors kept, as doubles."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where((F.size("x") == length) & fine)


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """[rows, segments] norms of the segments."""
    return np.sqrt((x.astype(np.float64).reshape(len(x), segments, -1) ** 2).sum(axis=2))


def prepared(kept: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x, norms, large): integers as 64-bit ones; of a vector with a larger one, in ``large`` as decimals."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy().reshape(-1, length) * scale)
            wide = np.abs(x).max(axis=1, initial=0) >= 2.0**62
            large = [",".join(str(int(v)) for v in row) if w else None for row, w in zip(x, wide, strict=True)]
            fits = np.where(wide[:, None], 0, x).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([row.tobytes() for row in y], pa.binary()) for y in (fits, norms(x, segments))), pa.array(large, pa.string())], names=["vec_id", "x", "norms", "large"])

    return kept.mapInArrow(run, f"vec_id {kind}, x binary, norms binary, large string")


def integers(x: pa.Array, large: pa.Array) -> np.ndarray:
    out = matrix(x, "i8")
    if large.null_count < len(large):
        out = out.astype(object)
        for i, row in enumerate(large.to_pylist()):
            if row is not None:
                out[i] = [int(v) for v in row.split(",")]
    return out


def nearest(x: np.ndarray, compressed: np.ndarray, centroids: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, how many exact distances were needed) of each row of x."""
    if np.abs(x).max(initial=0) > SMALL or np.abs(centroids).max(initial=0) > SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    own = norms(centroids, segments)
    size = (compressed**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :]
    bound = size * (1 - MARGIN) - 2 * (compressed @ own.T) - 1
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(x))
    best, label, needed = None, order[:, 0].copy(), 0
    for rank in range(len(centroids)):
        there = order[:, rank] if rank else label
        left = rows if best is None else rows[bound[rows, there[rows]] <= best[rows].astype(np.float64) * (1 + MARGIN)]
        if not len(left):
            break
        rows = left  # bounds only grow from here on
        to = there[rows]
        distance = ((x[rows] - centroids[to]) ** 2).sum(axis=1)
        needed += len(rows)
        if best is None:
            best = distance
            continue
        closer = (distance < best[rows]) | ((distance == best[rows]) & (to < label[rows]))
        best[rows[closer]], label[rows[closer]] = distance[closer], to[closer]
    return label, best, needed


def assigned(found: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, cluster, distance) of prepared vectors."""
    kind = found.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                label, best, _ = nearest(integers(b.column(1), b.column(3)), matrix(b.column(2), "f8"), centroids, segments)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.int32()), pa.array(best.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return found.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def moved(found: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors, themselves where they have none."""
    length = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for b in batches:
            if len(b):
                x = integers(b.column(1), b.column(3))
                label, _, _ = nearest(x, matrix(b.column(2), "f8"), centroids, segments)
                for c in np.unique(label).tolist():
                    # sums of halves of 64 bits can't overflow in a batch
                    some = x[label == c]
                    sums[c] += some.sum(axis=0) if some.dtype == object or np.abs(some).max() < 1 << 40 else some.astype(object).sum(axis=0)
                    count[c] += len(some)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array([[str(v) for v in sums[c]] for c in there], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    parts = found.mapInArrow(run, "cluster int, n bigint, sums array<string>")
    totals = parts.select("cluster", "n", *(F.col("sums")[i].cast("decimal(38,0)").alias(f"s{i}") for i in range(length)))
    totals = totals.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(length)))
    out = [[int(v) for v in row] for row in centroids]
    for r in totals.collect():  # a row for each centroid at most
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(length)]
    return narrowed(out)


def narrowed(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.int64 if all(abs(v) < 1 << 62 for r in rows for v in r) else object)


def cluster(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2:", length: int = LENGTH, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that are kept."""
    spark = rows.sparkSession
    kept = vectors(rows, vec_id, embedding, length)
    found = saved(prepared(kept, length, segments), "vectors")
    whole = kept.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("sha"), F.transform("x", lambda v: F.floor(v * SCALE).cast("decimal(38,0)")).alias("x"))
    first = whole.orderBy("sha", "x").limit(centroids).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {found.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    means = narrowed([[int(v) for v in r.x] for r in first])
    for _ in range(rounds):
        means = moved(found, means, segments)
    out = saved(assigned(found, means, segments), "assigned")
    sums = {r.cluster: r.n for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    sha = lambda c: hashlib.sha256(",".join(str(int(v)) for v in means[c]).encode()).hexdigest()
    told = spark.createDataFrame([(c, n, sum(sums.values()), sha(c)) for c, n in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def sql() -> str:
    rounds = reduce(lambda out, k: out + f""",
        near{k} AS (SELECT v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM long v JOIN c{k} c USING (p) GROUP BY v.rid, c.cluster),
        to{k} AS (SELECT rid, cluster, d FROM near{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)""" + (f""",
        mean{k} AS (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM to{k} JOIN long USING (rid) GROUP BY cluster, p),
        c{k + 1} AS (SELECT c.cluster, c.p, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} c LEFT JOIN mean{k} m ON m.cluster = c.cluster AND m.p = c.p)""" if k < ROUNDS else ""), range(ROUNDS + 1), "")
    return f"""
        WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
            WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {LENGTH}),
        whole AS (SELECT rid, vec_id, list_transform(e, lambda v: floor({SCALE} * v)::HUGEINT) AS x FROM kept),
        first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS cluster, x FROM whole QUALIFY cluster < {CENTROIDS}),
        long AS (SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM whole),
        c0 AS (SELECT cluster, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM first){rounds},
        hashed AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
        SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM to{ROUNDS} JOIN whole USING (rid) JOIN hashed USING (cluster)"""
