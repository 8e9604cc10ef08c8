"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words. Of every run of SPAN - K + 1 consecutive K-word hashes the smallest is a
fingerprint; each window covers exactly one such run, so equal windows have equal fingerprints and every shared
span of SPAN words or more is found. Training fingerprints are joined with the benchmark's; the few documents with
a hit are read again, their windows are compared word by word, and hits extend over overlapping windows. An item
with fewer words than SPAN is one window, found by the hash of its whole length.

Defined results: null or wordless texts have no words, no hits and are not contaminated; a wordless item is never
found; rows of the benchmark that share an id are one item in the counts, and have windows each of its own length; an item
without id counts as the item ''; rows equal in id and text get equal results; an empty benchmark
hits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, dropped_but, saved, staged, table

SPAN, K = 10, 5
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def fingerprinted(df: DataFrame, words: str, lengths: list[int], span: int = SPAN, k: int = K) -> DataFrame:
    """df with ``fps``: the distinct fingerprints of the array column ``words``; lengths: of short items."""
    run = span - k + 1
    grams = ", ".join(f"_h[i + {j}]" for j in range(k))
    mins = ", ".join(f"_k[i + {j}]" for j in range(run))
    parts = [f"CASE WHEN size(_k) >= {run} THEN array_distinct(transform(sequence(0, size(_k) - {run}), i -> least({mins}))) ELSE array() END"]
    for n in lengths:
        whole = ", ".join(f"_h[i + {j}]" for j in range(n))
        parts.append(f"CASE WHEN size(_h) >= {n} THEN array_distinct(transform(sequence(0, size(_h) - {n}), i -> xxhash64({n}, {whole}))) ELSE array() END")
    return (
        df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("_k", F.expr(f"CASE WHEN size(_h) >= {k} THEN transform(sequence(0, size(_h) - {k}), i -> xxhash64({grams})) ELSE array() END"))
        .withColumn("fps", F.expr(f"CAST(concat({', '.join(parts)}) AS array<bigint>)"))
        .drop("_h", "_k")
    )


def windows(df: DataFrame, words: str, lengths: list[int], span: int = SPAN) -> DataFrame:
    """df exploded to (pos, len, gram): its windows of ``span`` words and of the lengths of short items."""
    parts = [f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> struct(i AS pos, {n} AS len, array_join(slice({words}, i + 1, {n}), ' ') AS gram)) ELSE array() END" for n in [*lengths, span]]
    return df.select(*[c for c in df.columns if c != words], F.expr(f"inline(CAST(concat({', '.join(parts)}) AS array<struct<pos: int, len: int, gram: string>>))"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash."""
    # each row of the benchmark has windows of one length, whatever other rows have its id
    items = benchmark.repartition(benchmark.sparkSession.sparkContext.defaultParallelism).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), item_words(F.col(item_text)).alias("ws")).where("size(ws) > 0")
    items = saved(items.withColumn("len", F.expr(f"least(size(ws), {span})")), "items")
    lengths = sorted(r[0] for r in items.where(f"len < {span}").select("len").distinct().collect())  # at most span - 1
    grams = items.select("item", "len", F.explode(F.expr("transform(sequence(0, size(ws) - len), i -> array_join(slice(ws, i + 1, len), ' '))")).alias("gram"))
    grams = grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))
    # a table: the filter that explode adds would be pushed below the arrays and compute them again for each entry
    marks = [fingerprinted(items.where(F.col("len") == n), "ws", [n] if n < span else [], span, k).select("fps") for n in [*lengths, span]]
    marks = saved(reduce(DataFrame.union, marks), "item-fingerprints").select(F.explode("fps").alias("fp")).distinct()

    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), item_words(F.col(text)).alias("ws"))
    base = saved(fingerprinted(base, "ws", lengths, span, k).select("doc_id", "text_hash", F.size("ws").cast("long").alias("n_words"), "fps"), "winnowed")
    found = base.select("text_hash", F.explode("fps").alias("fp")).join(marks, "fp", "left_semi").select("text_hash").distinct()
    found = saved(found, "hit-texts")
    again = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("body"))
    again = again.join(found, "text_hash", "left_semi").select("doc_id", "text_hash", item_words(F.col("body")).alias("ws"))
    per = (
        windows(again, "ws", lengths, span)
        .join(grams, ["gram", "len"])
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("until")))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
        .select(
            F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "found",
            F.expr("aggregate(at, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.until - greatest(x.pos, a.upto)), 'upto', greatest(a.upto, x.until)), a -> a.n)").alias("n_hit"),
        )
    )
    return base.drop("fps").join(per, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_hash",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of the benchmark's windows, with their own columns."""
    bad = hits(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("text_hash").alias("bad_hash")).distinct()
    bad = saved(bad, "contaminated")
    dropped_but(spark, bad)
    boxed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    return boxed.join(bad, F.col("row_hash") == F.col("bad_hash"), "left_anti").select("row.*")


def sql() -> str:
    split = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split("text")} AS ws FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {split("text")} AS ws FROM benchmark),
        sized AS (SELECT *, least(len(ws), {SPAN}) AS n FROM b WHERE len(ws) > 0),
        grams AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
        lengths AS (SELECT DISTINCT n FROM sized),
        spots AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n)),
        found AS (SELECT r, i, n, item FROM spots JOIN grams USING (n, g)),
        cover AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found) f, range({SPAN}) x(j) WHERE j < n GROUP BY r),
        own AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (r) LEFT JOIN own USING (r)"""
