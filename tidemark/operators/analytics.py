"""Domain analytics: health windows and days, calendars, messages, tasks, music, places, folders, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scores import iso_week_key, score_band
from tidemark.plans.tables import saved


def hourly(samples: DataFrame, timestamp: str = "timestamp", value: str = "bpm") -> DataFrame:
    """(date, hour, avg, min, max, n) by the wall clock that the timestamp string shows, not by UTC."""
    at = F.col(timestamp)
    return samples.where(at.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:")).groupBy(F.substring(at, 1, 10).alias("date"), F.substring(at, 12, 2).cast("int").alias("hour")).agg(
        F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(value).alias("sample_count"))


def adapter_rank(adapter: Column) -> Column:
    base = F.lower(F.substring_index(adapter, ":", 1))
    return F.when(base.contains("oura"), 2).when(base.contains("apple_health") | base.contains("applehealth"), 1).otherwise(0)


def days(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metrics (date, metric_type, adapter_id, value, seq) to one row a day: for each metric the value of the best
    adapter (ties: the first row) and whether there were several."""
    w = Window.partitionBy("date", "metric_type")
    best = metrics.withColumns({"_k": F.row_number().over(w.orderBy(adapter_rank(F.col("adapter_id")).desc(), "seq")), "_n": F.count(F.lit(1)).over(w)}).where("_k = 1")
    aggs = []
    for m in names:
        own = F.col("metric_type") == m
        aggs += [F.max(F.when(own, F.col("value"))).alias(m), F.coalesce(F.bool_or(F.when(own, F.col("_n") > 1)), F.lit(False)).alias(f"{m}_conflict")]
    return best.groupBy("date").agg(*aggs)


def spine(df: DataFrame, date: str = "date") -> DataFrame:
    """df with a row for every day between its first and last; days without rows have nulls."""
    all_ = df.agg(F.sequence(F.to_date(F.min(date)), F.to_date(F.max(date)), F.expr("interval 1 day")).alias("d")).select(F.explode("d").alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias(date))
    return all_.join(df, date, "left")


def trends(by_day: DataFrame, names: list[str], dead_band: float = 0.5) -> DataFrame:
    """(metric, current, previous, delta, direction) from the last two days that have a value."""
    long = by_day.select("date", F.expr(f"stack({len(names)}, " + ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in names) + ") AS (metric, value)")).where("value IS NOT NULL")
    last = long.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("date")))).where("k <= 2")
    out = last.groupBy("metric").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("current"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("previous"))
    delta = F.col("current") - F.col("previous")
    return out.withColumn("delta", delta).withColumn("direction", F.when(delta.isNull(), "none").when(delta > dead_band, "up").when(delta < -dead_band, "down").otherwise("flat"))


def heat(by_day: DataFrame, value: str) -> DataFrame:
    """value / the largest (1 at least), null as 0."""
    top = by_day.agg(F.greatest(F.lit(1.0), F.max(value)).alias("_top"))  # one row
    return by_day.crossJoin(F.broadcast(top)).withColumn("heat", F.coalesce(F.col(value), F.lit(0)) / F.col("_top")).drop("_top")


def calendar(events: DataFrame, at: str = "ts", by: str = "auto", auto_days: int = 30) -> DataFrame:
    """(bucket, n): events by day, or by week when they span auto_days or more."""
    if by == "auto":
        span = events.agg(F.datediff(F.max(at), F.min(at)).alias("d")).first().d
        by = "week" if span is not None and span >= auto_days else "day"
    key = F.date_format(at, "yyyy-MM-dd") if by == "day" else iso_week_key(F.to_date(at))
    return events.groupBy(key.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def dividers(messages: DataFrame, thread: str, at: str, order: list[str], gap_seconds: int = 3600) -> DataFrame:
    """messages with ``divider``: the first of a thread, or more than the gap after the one before."""
    before = F.lag(at).over(Window.partitionBy(thread).orderBy(at, *order))
    return messages.withColumn("divider", before.isNull() | (F.col(at) - before > F.make_dt_interval(secs=F.lit(gap_seconds))))


def threads(messages: DataFrame, thread: str, sender: str, at: str, me: str) -> DataFrame:
    return messages.groupBy(thread).agg(F.array_sort(F.collect_set(F.when(F.col(sender) != me, F.col(sender)))).alias("participants"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_messages"))


def reply_roots(messages: DataFrame, id_: str, reply_to: str) -> DataFrame:
    """(id, root, depth): replies to a message that isn't there are roots; messages in a ring of replies have none and
    are left out. By pointer jumping: each round doubles the way that every message has gone up."""
    ids = messages.select(F.col(id_).alias("p")).distinct()
    tree = messages.select(F.col(id_).alias("id"), F.col(reply_to).alias("r")).join(ids, F.col("r") == F.col("p"), "left").select("id", F.col("p").alias("up"), F.col("p").isNotNull().cast("int").alias("depth"))
    done = saved(tree.where("up IS NULL").select("id", F.col("id").alias("root"), "depth"), "roots")
    now = saved(tree.where("up IS NOT NULL"), "replies")
    out, n = [done], now.count()
    for _ in range(max(1, n).bit_length() + 1):
        if now.isEmpty():
            break
        # up may be a message whose root is known, or one that has gone up as far itself
        known = reduce(DataFrame.union, out).select(F.col("id").alias("k"), F.col("root").alias("top"), F.col("depth").alias("more"))
        out.append(saved(now.join(known, F.col("up") == F.col("k")).select("id", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "roots"))
        others = now.select(F.col("id").alias("k"), F.col("up").alias("top"), F.col("depth").alias("more"))
        now = saved(now.join(others, F.col("up") == F.col("k")).select("id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "replies")
    return reduce(DataFrame.union, out)


#: The order of task states in lists.
TASK_ORDER = ("in-progress", "open", "completed", "cancelled")


def task_order(status: Column) -> Column:
    out = F.lit(len(TASK_ORDER))
    for k, name in enumerate(TASK_ORDER):
        out = F.when(status == name, k).otherwise(out)
    return out


def task_list(tasks: DataFrame) -> DataFrame:
    """tasks (status, priority, due, id) with their place in the list: by status, priority, due, nulls last."""
    w = Window.partitionBy("status").orderBy(F.asc_nulls_last("priority"), F.asc_nulls_last("due"), "id")
    return tasks.withColumns({"status_order": task_order(F.col("status")), "place": F.row_number().over(w)})


def albums(plays: DataFrame) -> DataFrame:
    return plays.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("tracks"), F.max("last_played").alias("last_played"), F.sum("play_count").alias("plays"))


def artists(plays: DataFrame) -> DataFrame:
    return plays.groupBy("artist").agg(F.count(F.lit(1)).alias("tracks"), F.countDistinct("album").alias("albums"), F.sum("play_count").alias("plays"))


def place_key(name: Column, lat: Column, lon: Column) -> Column:
    """The place's name, or its coordinates to three places."""
    return F.coalesce(name, F.concat(F.format_string("%.3f", lat), F.lit(","), F.format_string("%.3f", lon)))


def places(visits: DataFrame) -> DataFrame:
    """visits (place_name, latitude, longitude, arrival, id) by place, with the first visit's coordinates."""
    keyed = visits.withColumn("place_key", place_key(F.col("place_name"), F.col("latitude"), F.col("longitude")))
    first = F.min_by(F.struct("latitude", "longitude"), F.struct("arrival", "id"))
    return keyed.groupBy("place_key").agg(F.count(F.lit(1)).alias("visits"), first.alias("x")).select("place_key", "visits", F.col("x.latitude").alias("latitude"), F.col("x.longitude").alias("longitude"))


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, files): files in every folder and those below it; '' is the top."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def facets(hits: DataFrame) -> DataFrame:
    """(facet, value, n): hits by domain, adapter and score band, in one pass by grouping sets."""
    banded = hits.select("domain", "adapter_id", score_band(F.col("score")).alias("band"))
    g = banded.groupingSets([[F.col("domain")], [F.col("adapter_id")], [F.col("band")]], "domain", "adapter_id", "band").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, "domain").when(F.col("g") == 5, "adapter").otherwise("band").alias("facet"), F.when(F.col("g") == 3, F.col("domain")).when(F.col("g") == 5, F.col("adapter_id")).otherwise(F.col("band")).alias("value"), "n")


def backlinks(notes: DataFrame) -> DataFrame:
    """(name, backlinks): for notes (name, wikilinks), who links to them."""
    edges = notes.select(F.col("name").alias("src"), F.explode("wikilinks").alias("dst")).distinct()
    back = edges.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("backlinks"))
    return notes.select("name").distinct().join(back, F.col("name") == F.col("dst"), "left").select("name", F.coalesce("backlinks", F.array().cast("array<string>")).alias("backlinks"))


def failures(runs: DataFrame) -> DataFrame:
    """runs (adapter_id, seq, ok) with the length of the run of failures that a failure ends, and its severity:
    1-2 warning, 3-5 error, 6 and more critical."""
    island = F.count_if(F.col("ok")).over(Window.partitionBy("adapter_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    n = F.count_if(~F.col("ok")).over(Window.partitionBy("adapter_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("island", island).withColumn("consecutive", n).withColumn("severity", F.when(F.col("consecutive") == 0, "ok").when(F.col("consecutive") <= 2, "warning").when(F.col("consecutive") <= 5, "error").otherwise("critical")).drop("island")


def latest_watch(watches: DataFrame, indexed: DataFrame) -> DataFrame:
    """The latest watch of each video that has no transcript yet."""
    last = watches.where("video_id IS NOT NULL").groupBy("video_id").agg(F.max_by(F.struct(*[c for c in watches.columns if c != "video_id"]), "watched_at").alias("x"))
    return last.join(indexed.select("video_id").distinct(), "video_id", "left_anti").select("video_id", "x.*")


def by_type_and_day(records: DataFrame, kind: str, date: str, value: str) -> DataFrame:
    """(kind, date, n, total) of records."""
    return records.groupBy(kind, date).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


#: Orders of the music and document lists: (column, descending); ties by the id.
LIST_ORDERS = {"plays": ("play_count", True), "recent": ("last_played", True), "title": ("title", False), "name": ("title", False), "date": ("modified_at", True), "size": ("file_size_bytes", True)}


def listed_by(rows: DataFrame, sort: str, id_: str, limit: int | None = 50) -> DataFrame:
    """A list's first rows in one of its orders, nulls last."""
    column, falling = LIST_ORDERS[sort]
    out = rows.orderBy(F.desc_nulls_last(column) if falling else F.asc_nulls_last(column), F.col(id_))
    return out if limit is None else out.limit(limit)


def letters(names: DataFrame, name: str) -> DataFrame:
    """(letter, n): names by their first letter, '#' for what is none of A to Z."""
    first = F.upper(F.substring(F.trim(name), 1, 1))
    return names.groupBy(F.when(first.rlike("^[A-Z]$"), first).otherwise("#").alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def first_filled(rows: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """(key, column): of each key the first value that isn't null; null where all are."""
    return rows.groupBy(key).agg(F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order))).alias(column))


def choices(rows: DataFrame, column: str) -> DataFrame:
    """(column): the values of a filter's list, each once, in order; null is none."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
