"""Streaming forms: file feeds into the store, hourly windows with late data, debounced changes, retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.ingest import ingest
from tidemark.plans.durable import BUCKETS, MOST, DurableStore
from tidemark.plans.store import Store
from tidemark.plans.tables import owned, saved

CANONICAL = "adapter_id string, source_id string, domain string, markdown string, normalizer_version string, extra_metadata string, modified_at string"
MOST_RETRIES = 3


def feed(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """NDJSON files as they land. An empty markdown is a delete mark."""
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", per_batch).json(folder)


def hourly_windows(samples: DataFrame, at: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(hour, avg, min, max, n) over all samples of an hour, those of later pages too, up to the watermark. The batch
    form over one page at a time lets a later page replace an hour; this one merges it."""
    return samples.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w")).agg(
        F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(value).alias("sample_count")
    ).select(F.col("w.start").alias("hour"), "avg_value", "min_value", "max_value", "sample_count")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounced(changes: DataFrame, gap_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """changes (path, kind, ts): one row for each burst of a path, its last change; deleted then created is modified."""
    def last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kinds, ts = state.get
            state.remove()
            kind = "modified" if kinds.endswith("deleted,created") else kinds.rsplit(",", 1)[-1]
            yield pd.DataFrame({"path": [key[0]], "kind": [kind], "ts": [ts]})
            return
        kinds, ts = state.get if state.exists else ("", pd.Timestamp(0))
        rows = pd.concat(list(frames)).sort_values("ts")
        kinds = ",".join(([kinds] if kinds else []) + rows["kind"].tolist())
        ts = max(pd.Timestamp(ts), rows["ts"].max())
        state.update((kinds, ts))
        state.setTimeoutTimestamp(max(int(ts.timestamp() * 1000) + gap_ms, state.getCurrentWatermarkMs() + 1))

    kept = changes.withWatermark("ts", late).groupBy("path")
    return kept.applyInPandasWithState(last, "path string, kind string, ts timestamp", "kinds string, ts timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def into_store(feed_: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, most: int = MOST) -> Callable[[], StreamingQuery]:
    """Ingests each batch into the durable store at ``path``; the offset is committed after the batch is. A batch that
    comes again after a crash finds itself done, or overwrites what it had left behind."""
    spark = feed_.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        store = DurableStore(spark, path, buckets, most)
        with owned(spark):
            batch = saved(batch, "batch")
            at = batch.agg(F.coalesce(F.max("modified_at"), F.lit("1970-01-01T00:00:00Z")).alias("at")).first().at
            none = F.lit(None).cast("string")
            last = batch.groupBy("source_id").agg(F.max_by(F.struct("adapter_id", "domain", "markdown", "normalizer_version", "extra_metadata"), "modified_at").alias("x")).select("source_id", "x.*")
            items = last.select("source_id", "adapter_id", "domain", none.alias("origin_ref"), none.alias("display_name"), F.lit("push").alias("poll_strategy"), F.lit(None).cast("int").alias("poll_interval_sec"), "normalizer_version", F.coalesce("markdown", F.lit("")).alias("markdown"), "extra_metadata")
            adapters = items.groupBy("adapter_id").agg(F.min("domain").alias("domain")).select("adapter_id", "domain", F.lit("feed").alias("adapter_type"), F.lit("1").alias("normalizer_version"), F.lit("{}").alias("config"), F.lit(True).alias("enabled"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
            store.apply(number, items, lambda s: ingest(s.register_adapters(adapters), items, at)[0])

    return lambda: feed_.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def current(spark: SparkSession, path: str) -> Store:
    """The store as its last whole batch left it; a new one, where there is none."""
    return DurableStore(spark, path).store()


class Retries(StatefulProcessor):
    """Of one source: attempts so far. A failure asks for another attempt after a wait, by a timer in event time; the
    last one that is allowed ends as a dead letter; a success forgets the source and its timers."""

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "attempts int, error string")

    def told(self, key: tuple, kind: str, attempts: int, error: str | None, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"source_ref": [key[0]], "kind": [kind], "attempts": [attempts], "error": [error], "at": [pd.Timestamp(ms, unit="ms")]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values("ts", kind="stable")
        attempts, error = (self.state.get()[0], self.state.get()[1]) if self.state.exists() else (0, None)
        for ok, what, ts in zip(found["ok"], found["error"], found["ts"], strict=True):
            if ok:
                attempts, error = 0, None
                continue
            attempts, error, ms = attempts + 1, what, int(ts.timestamp() * 1000)
            if attempts >= self.most:
                yield self.told(key, "dead", attempts, error, ms)
                attempts, error = 0, None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if attempts:
            self.state.update((attempts, error))
            # a timer that lies before the watermark fires in the next batch
            self.handle.registerTimer(max(ms + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1))
        elif self.state.exists():
            self.state.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            attempts, error = self.state.get()
            yield self.told(key, "retry", attempts, error, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, most: int = MOST_RETRIES, wait_ms: int = 5_000, late: str = "10 seconds") -> DataFrame:
    """outcomes (source_ref, ok, error, ts) of attempts to (source_ref, kind, attempts, error, at): 'retry' when a
    failed source is due again, 'dead' at its last failure. Needs the state store of RocksDB."""
    return outcomes.withWatermark("ts", late).groupBy("source_ref").transformWithStateInPandas(Retries(most, wait_ms), "source_ref string, kind string, attempts int, error string, at timestamp", "append", "eventtime")


def retried(queue: DataFrame, succeeded: DataFrame, most: int = MOST_RETRIES) -> tuple[DataFrame, DataFrame]:
    """queue (path, attempts) after a drain: (what is tried again, what is given up)."""
    left = queue.join(succeeded.select("path").distinct(), "path", "left_anti").withColumn("attempts", F.col("attempts") + 1)
    return left.where(F.col("attempts") < most), left.where(F.col("attempts") >= most)
