"""Vector search: exact top-k, filters before it, retirement after it, rerank. operators.index has the stored index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidemark.functions import scores
from tidemark.operators.models import Model, applied, normal
from tidemark.plans.catalog import lineage
from tidemark.plans.store import Store, latest

SOURCE_FILTER = re.compile(r"^[a-zA-Z0-9_\-./]+$")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def checked(vector: list[float], dim: int) -> list[float]:
    if len(vector) != dim or not np.isfinite(vector).all():
        raise ValueError(f"a vector must have {dim} finite numbers")
    return [float(x) for x in vector]


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "chunk_hash", where: Column | None = None) -> DataFrame:
    """The k nearest by cosine: filters first, then a bounded heap in each task (TakeOrderedAndProject)."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("score", scores.search_score(scores.cosine(F.col("vector"), literal(query))))
    return scored.drop("vector").orderBy(F.desc("score"), F.col(key)).limit(k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_hash", most: int = 10_000) -> DataFrame:
    """(query, key, score): the k nearest of each of a stated set of queries (query, query_vector), with ids that differ;
    of equal scores (to 12 places) the smaller key. Every task holds the queries it compares, so a larger set is
    searched in blocks of at most ``most``. A task hands on k rows of each query, whatever it reads."""
    n, blocks = queries.count(), 1
    if n > most:
        block = lambda m: F.pmod(F.xxhash64("query"), F.lit(m))
        blocks = -(-n // most)
        while (largest := queries.groupBy(block(blocks).alias("block")).count().agg(F.max("count")).first()[0]) > most:
            if blocks > 4 * n:
                raise ValueError(f"{largest} queries have one id")
            blocks += max(1, blocks // 8)
        queries = queries.withColumn("block", block(blocks))
    parts = [queries] if blocks == 1 else [queries.where(F.col("block") == i).drop("block") for i in range(blocks)]
    shape = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    made_of = to_arrow_schema(shape)
    last = Window.partitionBy("query").orderBy(F.desc("score"), key)

    def nearest(part: DataFrame) -> DataFrame:
        rows = part.select("query", "query_vector").collect()  # at most ``most``
        if not rows:
            return vectors.sparkSession.createDataFrame([], shape)
        shared = vectors.sparkSession.sparkContext.broadcast(([r.query for r in rows], unit(np.array([r.query_vector for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, against = shared.value
            best: tuple[np.ndarray, np.ndarray] | None = None  # of each query, by falling score and then by key
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    ids, found = matrix(batch.slice(at, SLICE), against.shape[1])
                    order = np.argsort(ids, kind="stable")
                    score = np.round(np.clip((1 + against @ unit(found[order]).T) / 2, 0, 1), 12)
                    best = merged_best(best, ids[order], score, k)
            if best is not None and best[0].shape[1]:
                ids, score = best
                real = np.flatnonzero(score.reshape(-1) >= 0)
                values = [names[i] for i in real // score.shape[1]], ids.reshape(-1)[real].tolist(), score.reshape(-1)[real]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, made_of, strict=True)], names=made_of.names)

        near = vectors.select(key, "vector").where(F.col("vector").isNotNull()).mapInArrow(run, shape)
        return near.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= k).drop("_k")

    return reduce(DataFrame.union, map(nearest, parts))


#: Vectors that are compared with the queries at a time.
SLICE = 256


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of no length stay 0."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, vectors) of a batch (key, vector)."""
    return np.array(batch.column(0).to_pylist()), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def merged_best(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query after rows with rising ids; scores [queries, rows]. Only queries that a row can change
    are sorted. Places that are not filled have score -1."""
    if best is None:
        best = np.full((len(score), k), ids[0]), np.full((len(score), k), -1.0)
    old_ids, old = best
    if len(ids) and old_ids.dtype != np.promote_types(old_ids.dtype, ids.dtype):
        old_ids = old_ids.astype(np.promote_types(old_ids.dtype, ids.dtype))
    change = np.flatnonzero(score.max(1, initial=-1.0) >= old[:, -1])
    if len(change):
        top = np.argsort(-score[change], axis=1, kind="stable")[:, :k]
        all_ids = np.concatenate([old_ids[change], ids[top]], axis=1)
        all_scores = np.concatenate([old[change], np.take_along_axis(score[change], top, 1)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        old_ids[change], old[change] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
    return old_ids, old


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a sentence model: signed word hashes, normalised."""
    def encode(texts: pd.Series) -> pd.Series:
        import xxhash

        def one(text: str) -> list[float]:
            v = np.zeros(dim, np.float32)
            for w in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return encode


def embedded(chunks: DataFrame, encode: Callable[[pd.Series], pd.Series] | Model | None = None) -> DataFrame:
    """chunks as rows of vectors: the header is prepended for the encoder only. A Model is loaded once in each worker."""
    if isinstance(encode, Model):
        whole = Model(encode.name, lambda: (lambda texts, apply=encode.load(): normal(apply(texts))))
        text = F.when(F.col("context_header").isNotNull(), F.concat("context_header", F.lit("\n\n"), "content")).otherwise(F.col("content"))
        rows = chunks.select("chunk_hash", "source_id", "source_version", "domain", "content", "created_at", text.alias("_text"))
        return applied(rows, whole, ["_text"], "vector", T.ArrayType(T.FloatType())).select("chunk_hash", "source_id", "source_version", "domain", "content", "vector", "created_at")
    run = encode or hashing_encoder()

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return run(texts)

    text = F.when(F.col("context_header").isNotNull(), F.concat("context_header", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return chunks.select("chunk_hash", "source_id", "source_version", "domain", "content", vector(text).alias("vector"), "created_at")


def refined(hits: DataFrame, adapters: list[str] | None = None, least_score: float | None = None, since: str | None = None, before: str | None = None) -> DataFrame:
    """Hits after the search: of some adapters, of a score at least, of a time. They take rows away and bring no others."""
    hits = hits if adapters is None else hits.where(F.col("adapter_id").isin(adapters))
    hits = hits if least_score is None else hits.where(F.col("score") >= least_score)
    hits = hits if since is None else hits.where(F.col("fetch_timestamp") >= since)
    return hits if before is None else hits.where(F.col("fetch_timestamp") <= before)


def retrieve(store: Store, text: str, top_k_: int = 10, encode: Callable[[pd.Series], pd.Series] | None = None, domain: str | None = None, source: str | None = None, strict_source: bool = True) -> DataFrame:
    """Search hits with their chunk and lineage. Filters go before the k nearest, retirement after: fewer than k rows
    may come back. A person's metadata is not shown."""
    if not text.strip():
        raise ValueError("the query is blank")
    if top_k_ <= 0:
        raise ValueError("top_k must be positive")
    if source is not None and strict_source and not SOURCE_FILTER.match(source):
        raise ValueError("the source filter has characters that are not allowed")
    if store.vectors.isEmpty():
        raise RuntimeError("the index is empty")
    query = (encode or hashing_encoder())(pd.Series([text]))[0]
    where = F.lit(True)
    where = where if domain is None else where & (F.col("domain") == domain)
    where = where if source is None else where & (F.col("source_id") == source)
    by_hash = latest(store.vectors, ["chunk_hash"], F.desc("created_at"), F.desc("source_id"))
    hits = top_k(by_hash, query, top_k_, where=where).select("chunk_hash", "score")
    return enriched(store, hits).orderBy(F.desc("score"), "chunk_hash")


def enriched(store: Store, hits: DataFrame) -> DataFrame:
    """hits (chunk_hash, score) with chunk and lineage; hits whose chunk is retired go."""
    live = latest(store.live_chunks(), ["chunk_hash"], "created_at", "source_id", "source_version").select("chunk_hash", "content", "context_header", "chunk_type", "domain_metadata")
    return hits.join(live, "chunk_hash").join(lineage(store, hits), "chunk_hash").withColumn("domain_metadata", F.when(F.col("domain") != "people", F.col("domain_metadata")))


def rerank(hits: DataFrame, logit: Column, top_k_: int | None = None) -> DataFrame:
    """hits by the sigmoid of a cross-encoder's logit, which replaces the score."""
    if top_k_ is not None and top_k_ <= 0:
        raise ValueError("top_k must be positive")
    out = hits.withColumn("score", scores.sigmoid(logit)).orderBy(F.desc("score"), "chunk_hash")
    return out if top_k_ is None else out.limit(top_k_)


def reranked(hits: DataFrame, query: str, scorer: Model, top_k_: int | None = None, passage: str = "content") -> DataFrame:
    """hits by a cross-encoder: a Model that gives a logit for each (query, passage). The scores are its, as
    probabilities; all candidates are scored, in batches, and the others of their columns stay."""
    if not query.strip():
        raise ValueError("the query is blank")
    asked = hits.withColumn("_query", F.lit(query))
    scored = applied(asked, scorer, ["_query", passage], "_logit", T.DoubleType())
    return rerank(scored, F.col("_logit"), top_k_).drop("_query", "_logit")


def reembedded(store: Store, model: str, encode: Callable[[pd.Series], pd.Series] | None = None) -> tuple[Store, DataFrame]:
    """Embeds anew the active chunks of another model, in one job; what is done is not stale when it runs again.
    Returns also the count."""
    stale = store.active_chunks().where(F.col("embedding_model_id") != model)
    done = store.put_vectors(embedded(stale, encode)).set_embedding_model(stale, model)
    return done, stale.agg(F.count(F.lit(1)).alias("chunks_reembedded"))
