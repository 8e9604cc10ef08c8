"""The durable store: the same rows as the operations on whole tables, what a batch writes, crashes, folds."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ingest import ingest
from tidemark.plans.durable import DurableStore
from tidemark.plans.store import SCHEMAS, Store
from tidemark.streaming import streams

ITEM = "source_id string, adapter_id string, domain string, origin_ref string, display_name string, poll_strategy string, poll_interval_sec int, normalizer_version string, markdown string, extra_metadata string"
ADAPTER = [("a:1", "notes", "a", "1", "{}", True, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")]


@pytest.fixture(autouse=True)
def small(spark):
    """The tables here have a few rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def items(spark, texts, name=None):
    return spark.createDataFrame([(i, "a:1", "notes", None, name, "push", None, "1", t, None) for i, t in texts.items()], ITEM)


def step(rows, at):
    def change(store):
        adapters = rows.sparkSession.createDataFrame(ADAPTER, SCHEMAS["adapters"])
        return ingest(store.register_adapters(adapters), rows, at)[0]

    return change


def told(store):
    return {t: sorted(map(str, getattr(store, t).collect())) for t in SCHEMAS}


def at(n):
    return f"2024-02-{n + 1:02d}T00:00:00Z"


#: Batches of texts by source: new ones, a changed one, an unchanged one, one that goes empty and one that comes back.
BATCHES = [{"s1": "one\n\ntwo", "s2": "alpha", "s3": "x"}, {"s1": "one\n\nthree", "s2": "alpha"}, {"s4": "new", "s3": ""}, {"s3": "x", "s1": "one\n\ntwo"}]


def test_same_rows_as_whole_tables(spark, tmp_path):
    plain, most = Store.new(spark), 2
    for n, texts in enumerate(BATCHES):
        rows = items(spark, texts)
        plain = step(rows, at(n))(plain).write(str(tmp_path / f"plain{n}"))
        store = DurableStore(spark, str(tmp_path / "store"), buckets=4, most=most)
        assert store.apply(n, rows, step(rows, at(n)))
        if n >= 3:
            assert told(DurableStore(spark, str(tmp_path / "store")).store()) == told(plain)
    assert len(store.files.names("manifests")) <= 2
    # files of batches that were folded, and buckets that were replaced, go with the next fold
    assert store.files.names("delta/sources") == ["batch=2", "batch=3"] and all(int(f[5:]) >= 1 for f in store.files.names("base/chunks"))


def test_operations_that_take_rows_away(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = items(spark, BATCHES[0])
    DurableStore(spark, path, most=2).apply(0, rows, step(rows, at(0)))
    fail = spark.createDataFrame([("a:1", "s1", "boom", "m", at(1))], "adapter_id string, source_id string, error_type string, message string, seen string")
    DurableStore(spark, path).apply(1, rows, lambda s: s.add_dead_letters(fail))
    store = DurableStore(spark, path)
    assert store.store().dead_letters.count() == 1
    store.apply(2, rows, lambda s: s.clear_dead_letters(fail).unqueue(s.sync_log.where("operation = 'insert'")))
    now = DurableStore(spark, path).store()
    assert now.dead_letters.count() == 0 and now.sync_log.count() == 0 and now.chunks.count() == 3
    store.apply(3, rows, lambda s: s.reset_adapter("a:1", at(3))[0])
    now = DurableStore(spark, path).store()
    assert now.live_chunks().count() == 0 and now.sync_log.where("operation = 'delete'").count() == now.chunks.select("chunk_hash").distinct().count()


@pytest.mark.parametrize("when", ["tables", "fold"])
def test_crash(spark, tmp_path, monkeypatch, when):
    """A batch that is cut off at any point leaves the store as it was, and comes whole when it is run again."""
    path, plain = str(tmp_path / "store"), Store.new(spark)
    for n, texts in enumerate(BATCHES[:2]):
        rows = items(spark, texts)
        if n == 1:
            held = told(DurableStore(spark, path).store())
            with monkeypatch.context() as m:
                calls = []

                def broken(self, *a, f=getattr(DurableStore, "written" if when == "tables" else "commit")):
                    calls.append(a)
                    if len(calls) == {"tables": 3, "commit": 1, "fold": 2, "folded": 3}[when]:
                        raise RuntimeError("lost")
                    return f(self, *a)

                m.setattr(DurableStore, "written" if when == "tables" else "commit", broken)
                if when == "folded":
                    DurableStore(spark, path, most=2).apply(n, rows, step(rows, at(n)))
                else:
                    with pytest.raises(RuntimeError):
                        DurableStore(spark, path, most=2).apply(n, rows, step(rows, at(n)))
            now = DurableStore(spark, path, most=2)
            assert (told(now.store()) == held) == (when in ("tables", "commit"))
            assert now.apply(n, rows, step(rows, at(n))) == (when in ("tables", "commit"))
        else:
            DurableStore(spark, path, most=2).apply(n, rows, step(rows, at(n)))
        plain = step(rows, at(n))(plain).write(str(tmp_path / f"plain{n}"))
    assert told(DurableStore(spark, path).store()) == told(plain)


def test_bytes_follow_the_batch(spark, tmp_path):
    """The same batch writes about as much into a large store as into a small one."""
    wrote, whole = {}, {}
    text = lambda i: "\n\n".join(f"Paragraph {i} {k} with some words of its own." for k in range(12))
    for n in (10, 600):
        path = str(tmp_path / f"s{n}")
        rows = items(spark, {f"s{i}": text(i) for i in range(n)})
        DurableStore(spark, path, most=1).apply(0, rows, step(rows, at(0)))  # folded at once
        some = items(spark, {f"s{i}": text(i) + "\n\nMore." for i in range(3)})
        store = DurableStore(spark, path, most=50)
        store.apply(1, some, step(some, at(1)))
        wrote[n] = sum(store.files.size(f"delta/{t}/batch=1") for t in SCHEMAS)
        whole[n] = store.files.size("base")
    print(f"\nstores of {whole}, batches of {wrote} bytes")
    assert whole[600] > 8 * whole[10] and wrote[600] < 1.2 * wrote[10] and wrote[600] < 0.2 * whole[600]


def test_stream_into_store(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    rec = lambda i, m, at: json.dumps({"adapter_id": "a", "source_id": i, "domain": "notes", "markdown": m, "normalizer_version": "1", "modified_at": at})
    (folder / "1.json").write_text(rec("x", "one", at(0)) + "\n" + rec("y", "two", at(0)))
    start = streams.into_store(streams.feed(spark, str(folder)), path, str(tmp_path / "ck"), buckets=2, most=2)
    start().awaitTermination()
    assert streams.current(spark, path).active_chunks().count() == 2
    (folder / "2.json").write_text(rec("x", "", at(1)))
    start().awaitTermination()
    assert {r.source_id for r in streams.current(spark, path).active_chunks().collect()} == {"y"}
    assert streams.current(spark, path).chunks.where(F.col("retired_at").isNotNull()).count() == 1


@pytest.mark.parametrize("most", [2, 9])
def test_dealt_by_source(spark, tmp_path, most):
    """batches that are dealt by source have the same rows as whole tables, and one is read as it was dealt."""
    from tests.test_lookup import exchanged
    from tidemark.plans.tables import by_source, saved

    def lines(rows, when, buckets=None):
        def change(store):
            came = rows if buckets is None else rows.repartition(buckets, "source_id")
            return ingest(store.register_adapters(spark.createDataFrame(ADAPTER, SCHEMAS["adapters"])), came, when, by_line=True, buckets=buckets)[0]

        return change

    plain, path = Store.new(spark), str(tmp_path / "store")
    for n, texts in enumerate([*BATCHES, {"s1": "a\nb\na\nc", None: "no source"}, {"s1": "b\nd", "s4": "new"}]):
        rows = items(spark, texts)
        plain = lines(rows, at(n))(plain).write(str(tmp_path / f"plain{n}"))
        store = DurableStore(spark, path, buckets=4, most=most)
        assert store.apply(n, rows, lines(rows, at(n), 3), 3)
        if n == 0:
            ids = saved(rows.select("source_id"), "ids", 3)
            with by_source(spark):
                assert [exchanged(spark, DurableStore(spark, path).table(t, None, ids, 3)) for t in ("sources", "versions", "chunks")] == [[], [], []]
        if n in (1, 3, 5):
            assert told(DurableStore(spark, path).store()) == told(plain)
