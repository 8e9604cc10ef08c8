"""Catalog reads over a store: lists with filters and pages, lookups, statistics, activity, queues."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.store import Store, latest

SORTS = ("created_at", "updated_at", "chunk_count")


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def prefix(column: str, text: str) -> Column:
    """LIKE 'text%' without wildcards in text, of either case of A-Z."""
    upper, lower = (string.ascii_uppercase, string.ascii_lowercase)
    return F.translate(F.col(column), upper, lower).startswith(text.translate(str.maketrans(upper, lower)))


def list_sources(store: Store, domain: str | None = None, adapter_id: str | None = None, source_id_prefix: str | None = None, state: str | None = None, fetched_after: str | None = None, fetched_before: str | None = None, limit: int = 50, offset: int = 0, sort_by: str = "created_at", order: str = "asc") -> tuple[DataFrame, DataFrame]:
    """(page, total): sources with their active chunks counted; total has one row, whatever the page."""
    active = store.active_chunks().groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    s = store.sources
    for column, value in (("domain", domain), ("adapter_id", adapter_id)):
        s = s if value is None else s.where(F.col(column) == value)
    s = s if source_id_prefix is None else s.where(prefix("source_id", source_id_prefix))
    s = s if fetched_after is None else s.where(F.col("last_fetched_at") >= fetched_after)
    s = s if fetched_before is None else s.where(F.col("last_fetched_at") <= fetched_before)
    if state in ("active", "inactive"):
        s = s.join(active, "source_id", "left_semi" if state == "active" else "left_anti")
    rows = s.join(store.adapters.select("adapter_id", "adapter_type"), "adapter_id").join(active, "source_id", "left").fillna({"chunk_count": 0})
    by = F.col(sort_by if sort_by in SORTS else "created_at")
    return page(rows, [by.desc() if order == "desc" else by.asc(), F.col("source_id")], limit, offset), s.agg(F.count(F.lit(1)).alias("total"))


def metadata_equals(column: str, key: str, value: str) -> Column:
    """Type-strict: only a JSON string can equal the text."""
    field = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "variant")
    return (F.schema_of_variant(field) == "STRING") & (F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "string") == value)


def list_chunks(store: Store, domain: str | None = None, adapter_id: str | None = None, source_id: str | None = None, metadata: tuple[str, str] | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Active chunks; domain and adapter are the source's. A row whose metadata isn't JSON is left out of the page and
    stays in the total."""
    s = store.sources.select("source_id", F.col("domain").alias("s_domain"), F.col("adapter_id").alias("s_adapter"))
    rows = store.active_chunks().join(s, "source_id")
    for column, value in (("s_domain", domain), ("s_adapter", adapter_id), ("source_id", source_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if metadata is None else rows.where(metadata_equals("domain_metadata", *metadata))
    sound = rows.where("domain_metadata IS NULL OR try_parse_json(domain_metadata) IS NOT NULL")
    order = [F.col("created_at").desc(), F.col("source_id"), F.col("chunk_index")]
    return page(sound.drop("s_domain", "s_adapter"), order, limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))


def chunks_of_source(store: Store, source_id: str, version: int | None = None, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): chunks of one version, the current one if none is named, retired ones included."""
    rows = store.chunks.where(F.col("source_id") == source_id)
    if version is None:
        rows = rows.join(store.sources.select("source_id", F.col("current_version").alias("source_version")), ["source_id", "source_version"])
    else:
        rows = rows.where(F.col("source_version") == version)
    return page(rows, [F.col("chunk_index"), F.col("chunk_hash")], limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))


def chunk_by_hash(store: Store, chunk_hash: str, source_id: str | None = None, retired: bool = False) -> DataFrame:
    """The earliest row of a hash; not only of current versions."""
    rows = (store.chunks if retired else store.live_chunks()).where(F.col("chunk_hash") == chunk_hash)
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    return latest(rows, ["chunk_hash"], "created_at", "source_id", "source_version")


def lineage(store: Store, hashes: DataFrame) -> DataFrame:
    """Lineage of the earliest row of each hash, retired ones included."""
    rows = store.chunks.join(hashes.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    first = latest(rows, ["chunk_hash"], "created_at", "source_id", "source_version")
    return first.select("chunk_hash", "source_id", F.col("source_version").alias("source_version_id"), "adapter_id", "domain", "normalizer_version", "embedding_model_id", "fetch_timestamp")


def source_detail(store: Store, source_id: str) -> DataFrame:
    return list_sources(store, source_id_prefix=source_id, limit=None)[0].where(F.col("source_id") == source_id)


def source_info(store: Store) -> DataFrame:
    return store.sources.join(store.adapters.select("adapter_id", "adapter_type"), "adapter_id").select("source_id", "origin_ref", "adapter_type", "adapter_id", "domain")


def sources_of_adapter(store: Store, adapter_id: str) -> DataFrame:
    return store.sources.where(F.col("adapter_id") == adapter_id).orderBy("source_id")


def has_non_push_sources(store: Store, adapter_id: str) -> DataFrame:
    return store.sources.where((F.col("adapter_id") == adapter_id) & (F.col("poll_strategy") != "push")).agg((F.count(F.lit(1)) > 0).alias("found"))


def due_for_poll(store: Store, now: str) -> DataFrame:
    """Pulled sources with an interval that were never fetched or whose interval has passed."""
    past = F.timestamp_add("SECOND", F.col("poll_interval_sec"), F.to_timestamp("last_fetched_at")) < F.to_timestamp(F.lit(now))
    return store.sources.where((F.col("poll_strategy") == "pull") & F.col("poll_interval_sec").isNotNull() & (F.col("last_fetched_at").isNull() | past))


def stale_embeddings(store: Store, model: str, limit: int | None = None) -> DataFrame:
    return page(store.active_chunks().where(F.col("embedding_model_id") != model), [F.col("source_id"), F.col("chunk_index")], limit)


# Statistics


def stats_by_domain(store: Store) -> DataFrame:
    """Sources and active chunks by the source's domain; a domain without chunks stays."""
    chunks = store.active_chunks().select("source_id", "chunk_hash")
    return store.sources.select("source_id", "domain").join(chunks, "source_id", "left").groupBy("domain").agg(F.countDistinct("source_id").alias("source_count"), F.count("chunk_hash").alias("chunk_count"))


def stats_total(store: Store) -> DataFrame:
    """Sums over domains, retired chunks and the pending queue, in one row."""
    both = stats_by_domain(store).agg(F.sum("source_count").alias("total_sources"), F.sum("chunk_count").alias("total_chunks"))
    retired = store.chunks.agg(F.count_if(F.col("retired_at").isNotNull()).alias("retired_chunks"))
    pending = store.sync_log.agg(F.count_if(F.col("operation") == "insert").alias("pending_inserts"), F.count_if(F.col("operation") == "delete").alias("pending_deletes"))
    return both.crossJoin(retired).crossJoin(pending)


def stats_by_model(store: Store) -> DataFrame:
    return store.active_chunks().groupBy("embedding_model_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def stats_by_adapter(store: Store) -> DataFrame:
    """Distinct hashes, unlike by domain."""
    chunks = store.active_chunks().select("source_id", "chunk_hash")
    rows = store.sources.select("source_id", "adapter_id").join(store.adapters.select("adapter_id", "adapter_type", "domain"), "adapter_id", "left").join(chunks, "source_id", "left")
    return rows.groupBy("adapter_id", "adapter_type", "domain").agg(F.countDistinct("source_id").alias("source_count"), F.countDistinct("chunk_hash").alias("chunk_count"))


def admin_status(store: Store) -> DataFrame:
    """Every adapter, also one without sources."""
    chunks = store.active_chunks().select("source_id", "chunk_hash")
    rows = store.adapters.select("adapter_id", "adapter_type", "enabled").join(store.sources.select("adapter_id", "source_id", "last_fetched_at"), "adapter_id", "left").join(chunks, "source_id", "left")
    return rows.groupBy("adapter_id", "adapter_type", "enabled").agg(F.max("last_fetched_at").alias("last_run"), F.countDistinct("source_id").alias("source_count"), F.countDistinct("chunk_hash").alias("chunk_count"))


def activity(store: Store, limit: int = 50, offset: int = 0) -> DataFrame:
    """Versions, newest first, with their source and adapter."""
    s = store.sources.select("source_id", "display_name", "domain")
    rows = store.versions.select("source_id", "version", "adapter_id", "fetch_timestamp", F.size("chunk_hashes").alias("chunk_count")).join(s, "source_id").join(store.adapters.select("adapter_id", "adapter_type"), "adapter_id")
    return page(rows, [F.col("fetch_timestamp").desc(), F.col("source_id"), F.col("version").desc()], limit, offset)


def sync_queue(store: Store, operation: str) -> DataFrame:
    """Pending operations with the earliest chunk of each hash."""
    rows = store.chunks.join(store.sync_log.where(F.col("operation") == operation), "chunk_hash")
    return latest(rows, ["chunk_hash"], "created_at", "source_id", "source_version").select("chunk_hash", "source_id", "source_version", "domain", "operation")


def dead_letters(store: Store, limit: int = 100) -> DataFrame:
    return page(store.dead_letters, [F.col("last_seen").desc(), F.col("source_id"), F.col("error_type")], limit)


def with_total(df: DataFrame) -> DataFrame:
    """Rows with the number of all rows beside each page row."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def adapter(store: Store, adapter_id: str) -> DataFrame:
    return store.adapters.where(F.col("adapter_id") == adapter_id)


def has_active_chunks(store: Store) -> DataFrame:
    """(source_id, active): whether a source has a chunk that is not retired, of any version."""
    live = store.live_chunks().groupBy("source_id").agg(F.lit(True).alias("active"))
    return store.sources.select("source_id").join(live, "source_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def is_retired(store: Store) -> DataFrame:
    """(chunk_hash, retired): whether every row of a hash is retired."""
    return store.chunks.groupBy("chunk_hash").agg(F.every(F.col("retired_at").isNotNull()).alias("retired"))


def sync_log(store: Store, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(store.sync_log, [F.desc_nulls_last("synced_at"), F.col("chunk_hash"), F.col("operation")], limit, offset)


def last_page(df: DataFrame, order: list[str], size: int, pages_back: int = 0) -> DataFrame:
    """The last page of an ascending order of columns, or one before it, in the order itself: the first rows of the
    order turned round, by a bounded heap in each task."""
    return page(df, [F.desc(c) for c in order], size, size * pages_back).orderBy(*order)


def table_bytes(store: Store) -> int:
    """Bytes of the files behind the store."""
    spark = store.chunks.sparkSession
    files = {f for name in ("adapters", "sources", "versions", "chunks", "entity_links", "sync_log", "dead_letters", "vectors") for f in getattr(store, name).inputFiles()}
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
