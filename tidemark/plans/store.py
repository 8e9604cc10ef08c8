"""The content store: append-only tables, views of what is current, and the operations that change it.

Tables are DataFrames; an operation returns the store with tables replaced, as plans over those before. Nothing is updated
in place. Store.write writes whole tables; plans.durable works on the rows that a batch touches, and writes what changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.plans.tables import by_source

DOMAINS = ("messages", "notes", "events", "tasks", "health", "documents", "people", "location")
CHUNK_TYPES = ("standard", "oversized", "table_part", "code", "table")
POLL_STRATEGIES = ("push", "pull", "webhook")

SCHEMAS = {
    "adapters": "adapter_id string, domain string, adapter_type string, normalizer_version string, config string, enabled boolean, created_at string, updated_at string",
    "sources": "source_id string, adapter_id string, domain string, origin_ref string, display_name string, current_version int, last_fetched_at string, poll_strategy string, poll_interval_sec int, created_at string, updated_at string",
    "versions": "source_id string, version int, markdown string, chunk_hashes array<string>, adapter_id string, normalizer_version string, fetch_timestamp string",
    "chunks": "chunk_hash string, source_id string, source_version int, chunk_index int, content string, context_header string, domain string, adapter_id string, fetch_timestamp string, normalizer_version string, embedding_model_id string, parent_chunk_hash string, domain_metadata string, cross_refs array<string>, chunk_type string, retired_at string, created_at string",
    "entity_links": "source_chunk_hash string, target_chunk_hash string, link_type string, confidence double, created_at string",
    "sync_log": "chunk_hash string, operation string, synced_at string",
    "dead_letters": "adapter_id string, source_id string, error_type string, message string, first_seen string, last_seen string, retry_count int",
    "vectors": "chunk_hash string, source_id string, source_version int, domain string, content string, vector array<float>, created_at string",
}

#: Sources of an adapter (some 30 bytes each) that are broadcast when it is reset.
FEW = 400_000


def empty(spark: SparkSession, name: str) -> DataFrame:
    """Known as empty to the optimizer, by the filter: joins with it cost nothing."""
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name])).where(F.lit(False))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Store:
    adapters: DataFrame
    sources: DataFrame
    versions: DataFrame
    chunks: DataFrame
    entity_links: DataFrame
    sync_log: DataFrame
    dead_letters: DataFrame
    vectors: DataFrame

    @classmethod
    def new(cls, spark: SparkSession) -> Store:
        return cls(**{name: empty(spark, name) for name in SCHEMAS})

    @classmethod
    def at(cls, spark: SparkSession, path: str, but: tuple[str, ...] = ()) -> Store:
        """The store that was written there; tables ``but`` for which it was written are empty."""
        return cls(**{name: empty(spark, name) if name in but else spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def write(self, path: str, but: tuple[str, ...] = ()) -> Store:
        """Writes the tables, ``but`` for some that have to be there already."""
        with by_source(self.chunks.sparkSession):
            for name in [name for name in SCHEMAS if name not in but]:
                getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        return Store.at(self.chunks.sparkSession, path, but)

    # Views

    def active_chunks(self) -> DataFrame:
        """Not retired and of the source's current version."""
        return self.with_active().where("active").drop("active")

    def with_active(self) -> DataFrame:
        """All chunks, and whether they are active."""
        now = self.sources.select("source_id", F.col("current_version").alias("_now"))
        # joined by source alone, so that tables dealt by it stay where they are; versions are compared after that
        rows = self.chunks.join(now, "source_id", "left").withColumn("active", F.col("retired_at").isNull() & F.coalesce(F.col("source_version") == F.col("_now"), F.lit(False)))
        first = ["source_id", "source_version"]
        return rows.select(*first, *[c for c in self.chunks.columns if c not in first], "active")

    def live_chunks(self) -> DataFrame:
        """Not retired, of any version: what lookups by hash and chains see."""
        return self.chunks.where("retired_at IS NULL")

    # Registration

    def register_adapters(self, rows: DataFrame) -> Store:
        """Insert if absent; an adapter that is there is never changed."""
        new = latest(rows, ["adapter_id"], "created_at").join(self.adapters, "adapter_id", "left_anti")
        return replace(self, adapters=self.adapters.unionByName(new.select(self.adapters.columns)))

    def register_sources(self, rows: DataFrame) -> Store:
        """Insert, or take over adapter, domain and polling of a later registration. A changed domain is written to
        the source's chunks and queues them for the vector store."""
        rows = latest(rows, ["source_id"], F.desc("created_at"))
        given = rows.select("source_id", *[F.col(c).alias(f"n_{c}") for c in ("adapter_id", "domain", "poll_strategy", "poll_interval_sec", "created_at")])
        old = self.sources.join(given, "source_id", "left")
        moved = old.where("n_domain IS NOT NULL AND n_domain <> domain").select("source_id", "n_domain")
        picked = {c: F.coalesce(f"n_{c}", c) for c in ("adapter_id", "domain", "poll_strategy", "poll_interval_sec")}
        kept = old.withColumns(picked | {"updated_at": F.coalesce("n_created_at", "updated_at")}).select(self.sources.columns)
        new = rows.join(self.sources, "source_id", "left_anti").select(self.sources.columns)
        chunks = self.chunks.join(moved, "source_id", "left").withColumn("domain", F.coalesce("n_domain", "domain")).select(self.chunks.columns)
        queued = self.active_chunks().join(moved, "source_id", "left_semi").select("chunk_hash", F.lit("insert").alias("operation"), F.lit(None).cast("string").alias("synced_at"))
        return replace(self, sources=kept.unionByName(new), chunks=chunks).queue(queued)

    def touch(self, source_ids: DataFrame, at: str) -> Store:
        """A re-fetch that found nothing new: only this sets last_fetched_at."""
        seen = source_ids.select("source_id").distinct().withColumn("_seen", F.lit(at))
        rows = self.sources.join(seen, "source_id", "left").withColumns({"last_fetched_at": F.coalesce("_seen", "last_fetched_at"), "updated_at": F.coalesce("_seen", "updated_at")})
        return replace(self, sources=rows.select(self.sources.columns))

    def rename(self, names: DataFrame) -> Store:
        """names: (source_id, display_name); null and unchanged names change nothing."""
        given = names.select("source_id", F.col("display_name").alias("_name"))
        rows = self.sources.join(given, "source_id", "left").withColumn("display_name", F.coalesce("_name", "display_name"))
        return replace(self, sources=rows.select(self.sources.columns))

    # Versions and chunks

    def add_versions(self, rows: DataFrame) -> Store:
        """rows: versions; one without a number gets its source's largest plus one, and the source moves to it."""
        if "version" not in rows.columns:
            top = self.versions.groupBy("source_id").agg(F.max("version").alias("_top"))
            rows = rows.join(top, "source_id", "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + 1).cast("int"))
        new = rows.select(self.versions.columns)
        now = new.select("source_id", F.col("version").alias("_now"), F.col("fetch_timestamp").alias("_at"))
        sources = self.sources.join(now, "source_id", "left").withColumns({"current_version": F.coalesce("_now", "current_version"), "updated_at": F.coalesce("_at", "updated_at")})
        return replace(self, versions=self.versions.unionByName(new), sources=sources.select(self.sources.columns))

    def write_chunks(self, rows: DataFrame) -> Store:
        """Insert or ignore: a hash is once in a version, an index is once in a version, what is there stays."""
        once = latest(rows, ["source_id", "source_version", "chunk_hash"], "chunk_index")
        once = latest(once, ["source_id", "source_version", "chunk_index"], "chunk_hash")
        new = once.join(self.chunks, ["source_id", "source_version", "chunk_hash"], "left_anti")
        new = new.join(self.chunks.select("source_id", "source_version", "chunk_index"), ["source_id", "source_version", "chunk_index"], "left_anti")
        return replace(self, chunks=self.chunks.unionByName(new.select(self.chunks.columns)))

    def retire(self, rows: DataFrame, at: str) -> Store:
        """rows: (source_id, source_version, chunk_hash), of that version only."""
        gone = rows.select("source_id", "source_version", "chunk_hash").distinct().withColumn("_at", F.lit(at))
        chunks = self.chunks.join(gone, ["source_id", "source_version", "chunk_hash"], "left").withColumn("retired_at", F.coalesce("retired_at", "_at"))
        return replace(self, chunks=chunks.select(self.chunks.columns))

    def missing_retirements(self, rows: DataFrame) -> DataFrame:
        """Of those rows the ones that name no chunk: asking to retire them is an error."""
        return rows.join(self.chunks, ["source_id", "source_version", "chunk_hash"], "left_anti")

    def set_embedding_model(self, hashes: DataFrame, model: str) -> Store:
        done = hashes.select("chunk_hash").distinct().withColumn("_model", F.lit(model))
        chunks = self.chunks.join(done, "chunk_hash", "left").withColumn("embedding_model_id", F.coalesce("_model", "embedding_model_id"))
        return replace(self, chunks=chunks.select(self.chunks.columns))

    def reset_adapter(self, adapter_id: str, at: str) -> tuple[Store, DataFrame]:
        """Retires all active chunks of the adapter's sources, queues vector deletes, forgets fetch times. Returns
        also the counts (chunks_retired, sources_reset); a second reset counts no chunks."""
        own = self.sources.where(F.col("adapter_id") == adapter_id).select("source_id")
        gone = self.live_chunks().join(own, "source_id", "left_semi").select("chunk_hash")
        counts = gone.agg(F.count(F.lit(1)).alias("chunks_retired")).crossJoin(own.agg(F.count(F.lit(1)).alias("sources_reset")))
        sources = self.sources.withColumn("last_fetched_at", F.when(F.col("adapter_id") != adapter_id, F.col("last_fetched_at")))
        hit = own.distinct().withColumn("_at", F.lit(at))
        # an adapter's few sources go to the chunks; else both are dealt by source
        hit = F.broadcast(hit) if own.limit(FEW + 1).count() <= FEW else hit
        chunks = self.chunks.join(hit, "source_id", "left").withColumn("retired_at", F.coalesce("retired_at", "_at")).select(self.chunks.columns)
        out = replace(self, chunks=chunks, sources=sources)
        return out.queue(gone.select("chunk_hash", F.lit("delete").alias("operation"), F.lit(None).cast("string").alias("synced_at"))), counts

    # Sync log, vectors, dead letters, links

    def queue(self, rows: DataFrame) -> Store:
        """Pending operations, keyed by (hash, operation)."""
        both = self.sync_log.unionByName(rows.select(self.sync_log.columns))
        return replace(self, sync_log=latest(both, ["chunk_hash", "operation"], F.desc_nulls_last("synced_at")))

    def unqueue(self, hashes: DataFrame) -> Store:
        """Both operations of the hashes are done."""
        return replace(self, sync_log=self.sync_log.join(hashes.select("chunk_hash").distinct(), "chunk_hash", "left_anti"))

    def put_vectors(self, rows: DataFrame) -> Store:
        """Upsert by (hash, source)."""
        kept = self.vectors.join(rows.select("chunk_hash", "source_id"), ["chunk_hash", "source_id"], "left_anti")
        return replace(self, vectors=kept.unionByName(latest(rows, ["chunk_hash", "source_id"], F.desc("created_at")).select(self.vectors.columns)))

    def drop_vectors(self, hashes: DataFrame) -> Store:
        return replace(self, vectors=self.vectors.join(hashes.select("chunk_hash").distinct(), "chunk_hash", "left_anti"))

    def with_dimension(self, dim: int) -> Store:
        """Vectors of another dimension are stale: the collection starts anew without them."""
        return replace(self, vectors=self.vectors.where(F.size("vector") == dim))

    def replay_sync_log(self, encoded: DataFrame) -> Store:
        """Does what is pending: deletes, then inserts from encoded (rows of vectors)."""
        gone = self.sync_log.where("operation = 'delete'").select("chunk_hash")
        due = self.sync_log.where("operation = 'insert'").select("chunk_hash")
        return self.drop_vectors(gone).put_vectors(encoded.join(due, "chunk_hash", "left_semi")).unqueue(self.sync_log)

    def add_dead_letters(self, failures: DataFrame) -> Store:
        """failures: (adapter_id, source_id, error_type, message, seen). One row for each key: first and last time,
        the latest message up to 2000 characters, and how often it came again."""
        old = self.dead_letters.select("adapter_id", "source_id", "error_type", "message", F.col("first_seen").alias("a"), F.col("last_seen").alias("z"), (F.col("retry_count") + 1).alias("n"))
        new = failures.select("adapter_id", "source_id", "error_type", F.substring("message", 1, 2000).alias("message"), F.col("seen").alias("a"), F.col("seen").alias("z"), F.lit(1).alias("n"))
        rows = old.unionByName(new).groupBy("adapter_id", "source_id", "error_type").agg(
            F.max_by("message", "z").alias("message"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"), (F.sum("n") - 1).cast("int").alias("retry_count"))
        return replace(self, dead_letters=rows.select(self.dead_letters.columns))

    def clear_dead_letters(self, done: DataFrame) -> Store:
        """done: (adapter_id, source_id) that succeeded."""
        return replace(self, dead_letters=self.dead_letters.join(done.select("adapter_id", "source_id").distinct(), ["adapter_id", "source_id"], "left_anti"))

    def new_links(self, rows: DataFrame) -> DataFrame:
        """Of those rows the ones that add_links would add; their count is what it reports."""
        key = ["source_chunk_hash", "target_chunk_hash", "link_type"]
        return latest(rows, key, F.desc("confidence")).join(self.entity_links, key, "left_anti")

    def add_links(self, rows: DataFrame) -> Store:
        return replace(self, entity_links=self.entity_links.unionByName(self.new_links(rows).select(self.entity_links.columns)))

    def stale_links(self) -> DataFrame:
        """Links whose person, or whose target, was known once and has no active chunk now."""
        # one row a hash, with both that it was known and that it isn't active
        gone = self.with_active().groupBy(F.col("chunk_hash").alias("h")).agg(F.max("active").alias("active")).where("NOT active")
        out = [self.entity_links.join(gone, F.col(end) == F.col("h"), "left_semi") for end in ("source_chunk_hash", "target_chunk_hash")]
        return out[0].union(out[1]).distinct()

    def clean_links(self) -> Store:
        key = ["source_chunk_hash", "target_chunk_hash", "link_type"]
        return replace(self, entity_links=self.entity_links.join(self.stale_links().select(key), key, "left_anti"))
