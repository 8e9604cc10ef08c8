"""Versions: history, differences, chains of parents, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scores import chain_similarity, cosine
from tidemark.plans.store import Store, latest
from tidemark.plans.tables import saved


def latest_versions(store: Store) -> DataFrame:
    return latest(store.versions, ["source_id"], F.desc("version"))


def source_version(store: Store, source_id: str, version: int) -> DataFrame:
    """One version of a source; no row, where there is none of that number."""
    return store.versions.where((F.col("source_id") == source_id) & (F.col("version") == version))


def history(store: Store, source_id: str | None = None) -> DataFrame:
    rows = store.versions if source_id is None else store.versions.where(F.col("source_id") == source_id)
    return rows.orderBy("source_id", "version")


def history_counts(store: Store) -> DataFrame:
    """Of each version, hashes added, removed and unchanged against the version before."""
    own = F.array_distinct("chunk_hashes")
    before = F.coalesce(F.lag("chunk_hashes").over(Window.partitionBy("source_id").orderBy("version")), F.array().cast("array<string>"))
    rows = store.versions.select("source_id", "version", own.alias("now"), F.array_distinct(before).alias("before"))
    return rows.select("source_id", "version", F.size(F.array_except("now", "before")).alias("added"), F.size(F.array_except("before", "now")).alias("removed"), F.size(F.array_intersect("now", "before")).alias("unchanged"))


def diff(store: Store, source_id: str, from_version: int, to_version: int) -> DataFrame:
    """(change, chunk_hash, content) between two versions; removed chunks may be retired."""
    if from_version == to_version:
        raise ValueError("the versions are the same")
    rows = store.versions.where(F.col("source_id") == source_id)
    have = {r.version for r in rows.where(F.col("version").isin(from_version, to_version)).select("version").collect()}
    if not have and rows.isEmpty():
        raise ValueError(f"unknown source: {source_id}")
    if missing := sorted({from_version, to_version} - have):
        raise ValueError(f"missing versions: {missing}")
    sides = rows.select("version", F.explode(F.array_distinct("chunk_hashes")).alias("chunk_hash"))
    old = sides.where(F.col("version") == from_version).select("chunk_hash", F.lit(True).alias("o"))
    new = sides.where(F.col("version") == to_version).select("chunk_hash", F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged")
    content = latest(store.chunks.where(F.col("source_id") == source_id), ["chunk_hash"], "created_at", "source_version").select("chunk_hash", "content")
    return old.join(new, "chunk_hash", "full_outer").select("chunk_hash", change.alias("change")).join(content, "chunk_hash", "left")


def chains(store: Store, heads: DataFrame) -> DataFrame:
    """(head, chunk_hash, level): each head and its ancestors by parent_chunk_hash, level 0 the head. A chunk that
    comes again ends its chain. heads: (chunk_hash).

    By doubling: after k rounds a chain has its first 2^k levels, and ``jumps`` leads 2^k levels up; so a chain of any
    length takes the logarithm of it in rounds."""
    live = latest(store.live_chunks(), ["chunk_hash"], "created_at", "source_id", "source_version").select("chunk_hash", "parent_chunk_hash")
    live = saved(live, "chain-nodes")
    there = live.select(F.col("chunk_hash").alias("up"))
    jumps = saved(live.select(F.col("chunk_hash").alias("at"), F.col("parent_chunk_hash").alias("up")).join(there, "up", "left_semi").select("at", "up"), "jumps")
    found = saved(live.join(heads.select("chunk_hash").distinct(), "chunk_hash", "left_semi").select(F.col("chunk_hash").alias("head"), "chunk_hash", F.lit(0).alias("level")), "chains")
    n, step = found.count(), 1
    while True:
        further = found.join(jumps, F.col("chunk_hash") == F.col("at")).select("head", F.col("up").alias("chunk_hash"), (F.col("level") + step).alias("level"))
        found = saved(found.union(further).groupBy("head", "chunk_hash").agg(F.min("level").alias("level")), "chains")
        before, n, step = n, found.count(), 2 * step
        if n == before:
            return found
        jumps = saved(jumps.join(jumps.select(F.col("at").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid")).select("at", F.col("top").alias("up")), "jumps")


def chain_similarities(store: Store, heads: DataFrame) -> DataFrame:
    """Chains with each member's similarity to its head."""
    vectors = store.vectors.groupBy("chunk_hash").agg(F.max_by("vector", "created_at").alias("vector"))
    rows = chains(store, heads).join(vectors, "chunk_hash", "left")
    head = F.first("vector", True).over(Window.partitionBy("head").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("head_vector", head).withColumn("similarity", chain_similarity(cosine(F.col("vector"), F.col("head_vector")))).drop("vector", "head_vector")


def provenance(store: Store, heads: DataFrame) -> DataFrame:
    """Chunk, lineage, origin and the ordered chain, oldest first and the chunk itself last."""
    chain = chains(store, heads).groupBy("head").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("o"), "chunk_hash"))), lambda x: x["chunk_hash"]).alias("version_chain"))
    first = latest(store.chunks.join(heads.select("chunk_hash").distinct(), "chunk_hash", "left_semi"), ["chunk_hash"], "created_at", "source_id", "source_version")
    origin = store.sources.select("source_id", "origin_ref", F.col("adapter_id").alias("source_adapter"))
    return first.join(origin, "source_id", "left").join(store.adapters.select(F.col("adapter_id").alias("source_adapter"), "adapter_type"), "source_adapter", "left").join(chain, F.col("chunk_hash") == F.col("head"), "left").drop("head")


def provenance_tree(store: Store, heads: DataFrame) -> DataFrame:
    """provenance() as (chunk, lineage, source, version_chain), each but the last a struct."""
    rows = provenance(store, heads)
    chunk = F.struct("chunk_hash", "content", "context_header", "chunk_index", "chunk_type", "domain_metadata", "cross_refs")
    lineage = F.struct("chunk_hash", "source_id", F.col("source_version").alias("source_version_id"), "adapter_id", "domain", "normalizer_version", "embedding_model_id")
    return rows.select(chunk.alias("chunk"), lineage.alias("lineage"), F.struct("source_id", "origin_ref", "adapter_type").alias("source"), "version_chain")


def timeline(store: Store, source_id: str) -> DataFrame:
    return history_counts(store).where(F.col("source_id") == source_id).join(store.versions.select("source_id", "version", "fetch_timestamp"), ["source_id", "version"]).orderBy("version")
