"""A content store over the relational test tables, by the engine's own ingest, kept as tables in the shared folder.

documents are document sources (source_id doc/<id>, adapter corpus:<source>), conversations are message sources
(conv/<id>, adapter chat:main). Documents are ingested twice; the second time a third has another last line, a third
has its blanks doubled, a third is unchanged. Then adapter corpus:src7 is reset.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import ingest, link_parents
from tidemark.plans.store import SCHEMAS, Store, empty
from tidemark.plans.tables import buckets_for, dealt, dealt_at, owned, saved, scratch, size_of, table, unnamed

FIRST, SECOND, RESET = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "2024-03-01T00:00:00Z"
#: Path of a store, and the buckets that its tables are dealt into by source.
_made: dict[tuple[str, str], tuple[str, int]] = {}
#: Tables of a store that are dealt by source; queries that join or group them by it move none of their rows.
DEALT = ("sources", "versions", "chunks")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("source_id"), F.concat(F.lit("corpus:"), "source").alias("adapter_id"), F.lit("documents").alias("domain"), F.concat(F.lit("file:///corpus/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("origin_ref"),
        F.concat(F.lit("Document "), "doc_id").alias("display_name"), F.when(F.col("doc_id") % 2 == 0, "pull").otherwise("push").alias("poll_strategy"), F.when(F.col("doc_id") % 4 == 0, 3600).alias("poll_interval_sec"), F.lit("1").alias("normalizer_version"), F.coalesce("text", F.lit("")).alias("markdown"), F.lit(None).cast("string").alias("extra_metadata"), F.col("doc_id").alias("n"))
    return docs


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("markdown"))
    none = F.lit(None).cast("string")
    return turns.select(
        F.concat(F.lit("conv/"), "conv_id").alias("source_id"), F.lit("chat:main").alias("adapter_id"), F.lit("messages").alias("domain"), none.alias("origin_ref"), none.alias("display_name"), F.lit("push").alias("poll_strategy"),
        F.lit(None).cast("int").alias("poll_interval_sec"), F.lit("1").alias("normalizer_version"), "markdown", none.alias("extra_metadata"), F.col("conv_id").alias("n"))


def edited(docs: DataFrame) -> DataFrame:
    lines = F.split("markdown", "\n")
    cut = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return docs.withColumn("markdown", F.when(F.col("n") % 3 == 0, F.concat(cut, F.lit("\nRevised line "), "n", F.lit("."))).when(F.col("n") % 3 == 1, F.replace("markdown", F.lit(" "), F.lit("  "))).otherwise(F.col("markdown")))


def corpus_store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        path = scratch(spark, "store")
        folder = f"{path.rsplit('/', 1)[-1]}/batches/"
        docs, talks = items(spark, sf_dir), conversation_items(spark, sf_dir)
        buckets = buckets_for(spark, sum(size_of(spark.read.parquet(f"{sf_dir}/{name}.parquet")) for name in ("documents", "conversations")))
        adapters = docs.select("adapter_id", "domain").union(talks.select("adapter_id", "domain")).distinct().select(
            "adapter_id", "domain", F.substring_index("adapter_id", ":", 1).alias("adapter_type"), F.lit("1").alias("normalizer_version"), F.lit("{}").alias("config"), F.lit(True).alias("enabled"), F.lit(FIRST).alias("created_at"), F.lit(FIRST).alias("updated_at"))
        idle = spark.createDataFrame([("idle:none", "notes", "idle", "1", "{}", False, FIRST, FIRST)], adapters.schema)
        with owned(spark) as paths:
            # dealt by source once: neither batch moves texts or chunks after that, nor do reset and parents
            fetched = docs.unionByName(talks).repartition(buckets, "source_id")
            store = Store.new(spark).register_adapters(adapters.union(idle))
            store, _ = ingest(store, fetched, FIRST, "model-a", by_line=True, vectors=False, buckets=buckets, folder=folder)
            first = paths[-1]
            # the second batch asks for them several times, and would cut the texts anew each time
            store = replace(store, chunks=unnamed(saved(store.chunks, "chunks", buckets)))
            # texts are written once for a batch, and with their chunks once: the tables between are plans over the batches.
            # All items are new in the first, so its table has them as they came, for the second
            came = dealt_at(spark, first, ", ".join(f"{name} {kind}" for name, kind in fetched.dtypes), buckets)
            store, _ = ingest(store, edited(came.where("domain = 'documents'")).drop("n"), SECOND, "model-b", by_line=True, buckets=buckets, folder=folder)
            store = replace(store, sources=saved(store.sources, "sources", buckets))
            store, _ = store.reset_adapter("corpus:src7", RESET)
            store = link_parents(store)
            vectors = table(spark, sf_dir, "embeddings").select(
                F.concat(F.lit("vec/"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("chunk_hash"), F.concat(F.lit("src/"), F.col("vec_id") % 7).alias("source_id"), F.lit(1).alias("source_version"), F.concat(F.lit("domain"), "label").alias("domain"),
                F.lit("").alias("content"), F.col("embedding").cast("array<float>").alias("vector"), F.lit(FIRST).alias("created_at"))
            store = replace(store, vectors=vectors, dead_letters=empty(spark, "dead_letters"))
            # the batches' tables have the versions already: they stay, and are not written again
            store.write(f"{path}/store", but=DEALT)
            for name in ("sources", "chunks"):
                dealt(getattr(store, name), f"{path}/store/{name}", buckets)
            paths[:] = [p for p in paths if not p.startswith(f"{path}/batches/")]
        _made[key] = path, buckets
    path, buckets = _made[key]
    versions, sources, chunks = (dealt_at(spark, f"{path}/{at}", SCHEMAS[name], buckets) for at, name in (("batches", "versions"), ("store/sources", "sources"), ("store/chunks", "chunks")))
    return replace(Store.at(spark, f"{path}/store", but=DEALT), versions=versions.where("version IS NOT NULL"), sources=sources, chunks=chunks)
