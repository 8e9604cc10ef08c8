"""Chunkers, ingest cycles, readers, streams: small cases with known results."""

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions import text as X
from tidemark.operators import analytics as A
from tidemark.operators import chunking as C
from tidemark.operators import linking, vector
from tidemark.operators.ingest import ingest, link_parents, run_stats
from tidemark.plans import catalog, provenance
from tidemark.plans.store import Store
from tidemark.sources import config, readers
from tidemark.streaming import streams

T1, T2, T3 = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z"


def plain_hash(text: str) -> str:
    t = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = re.sub(r"\n\n+", "\n\n", "\n".join(x.rstrip() for x in t.splitlines())).strip()
    return hashlib.sha256(t.encode()).hexdigest()


def test_hash_of_odd_texts(spark):
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(blanks + "ab.\n\n"), 12)) for _ in range(800)] + ["", " ", "a\r\nb\rc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.content_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [plain_hash(r.t) for r in got]


def test_phones_and_emails(spark):
    df = spark.createDataFrame([("(212) 555-0100 ext. 7",), ("+44 20 7946 0958",), ("1-212-555-0100",), ("12",), (" Ann@X.org ",), ("011 44 20 7946 0958",), ("011 44",)], "t string")
    assert [r.t for r in df.select(X.normalised_identifier(F.col("t")).alias("t")).collect()] == ["+12125550100", "+442079460958", "+12125550100", "", "ann@x.org", "+442079460958", ""]


def test_split_text():
    assert C.split_text("a  b\nc", 5) == ["a  b\nc"]
    assert C.split_text("a b. c d. e f.", 4) == ["a b. c d.", "e f."]
    assert C.split_text("x. a b c d e. y.", 3) == ["x.", "a b c", "d e. y."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c!", "d"]), max_size=40), st.integers(1, 6))
def test_split_text_keeps_words(words, limit):
    parts = C.split_text(" ".join(words), limit)
    assert [w for p in parts for w in p.split()] == words and all(C.tokens(p) <= limit for p in parts)


def test_notes():
    md = "intro\n\n# A\ntext one\ntwo\n\n```py\nx = 1\n```\n\n## B\n- i\n- j\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n# Empty\n\nTitle\n=====\n> q\n"
    got = [(h, b, k) for h, b, k, _ in C.notes(md)]
    assert got == [
        (None, "intro", "standard"), ("# A", "text one two", "standard"), ("# A", "x = 1", "code"), ("# A > ## B", "- i\n- j", "standard"),
        ("# A > ## B", "| h | k |\n| --- | --- |\n| 1 | 2 |", "table"), ("# Title", "> q", "standard"),
    ]


def test_notes_limits():
    body = "\n\n".join(" ".join(["w"] * 300) for _ in range(5))
    assert [C.tokens(b) for _, b, _, _ in C.notes("# H\n" + body)] == [900, 600]
    # pieces under one header around code join only with neighbours
    assert [k for _, _, k, _ in C.notes("# H\na\n\n```\nb\n```\n\nc")] == ["standard", "code", "standard"]


@pytest.mark.parametrize(("domain", "meta", "header"), [
    ("messages", {"thread_id": "t", "message_id": "m", "sender": "s"}, "(no subject) — s"),
    ("documents", {"document_id": "d", "title": "T", "document_type": "pdf", "source_type": "f"}, "T — pdf"),
    ("events", {"event_id": "e", "title": "T", "start_date": "2024-01-01"}, "T — 2024-01-01"),
    ("tasks", {"task_id": "k", "title": "T", "status": "open", "due_date": "2024-01-01"}, "T [due: 2024-01-01] [open]"),
    ("health", {"record_id": "r", "health_type": "spo2_summary", "date": "2024-01-01"}, "spo2_summary — 2024-01-01"),
    ("people", {"contact_id": "c", "display_name": "N", "organization": "O"}, "Contact: N — O"),
    ("location", {"latitude": 1.5, "longitude": 2}, "1.5, 2"),
])
def test_headers(domain, meta, header):
    assert C.chunk_item(domain, "body", json.dumps(meta))[0][1] == header
    with pytest.raises(ValueError):
        C.chunk_item(domain, "body", None)


def test_invalid_metadata():
    for domain, meta in (("tasks", {"task_id": "a", "title": "t", "status": "later"}), ("events", {"event_id": "e", "title": "t", "start_date": "2024-02-01", "end_date": "2024-01-01"}), ("messages", {"thread_id": "t", "message_id": "m", "sender": "s", "is_thread_root": True, "in_reply_to": "x"}), ("location", {"latitude": 91, "longitude": 0})):
        with pytest.raises(ValueError):
            C.chunk_item(domain, "x", json.dumps(meta))


def test_metadata_merge():
    meta = {"thread_id": "t", "message_id": "m", "sender": "s", "odd": 1}
    assert "odd" not in json.loads(C.chunk_item("messages", "x", json.dumps(meta))[0][3])
    meta = {"record_id": "r", "health_type": "spo2_summary", "date": "2024-01-01", "odd": 1, "gone": None}
    assert json.loads(C.chunk_item("health", "x", json.dumps(meta))[0][3]) == {k: v for k, v in meta.items() if v is not None}


def item(spark, rows):
    schema = "source_id string, adapter_id string, domain string, origin_ref string, display_name string, poll_strategy string, poll_interval_sec int, normalizer_version string, markdown string, extra_metadata string"
    return spark.createDataFrame([(i, "a:1", d, None, None, "push", None, "1", m, x) for i, d, m, x in rows], schema)


def adapters(spark):
    return spark.createDataFrame([("a:1", "notes", "t", "1", "{}", True, T1, T1)], "adapter_id string, domain string, adapter_type string, normalizer_version string, config string, enabled boolean, created_at string, updated_at string")


def test_ingest_cycle(spark, tmp_path):
    store = Store.new(spark).register_adapters(adapters(spark)).register_adapters(adapters(spark))
    assert store.adapters.count() == 1
    v1 = item(spark, [("n", "notes", "# A\none\n\n# B\ntwo", None), ("bad", "tasks", "x", '{"task_id": "1"}'), ("same", "notes", "keep", None)])
    store, report = ingest(store, v1, T1, "m1")
    store = store.write(str(tmp_path / "1"))
    assert {r.source_id: (r.status, r.chunks_added) for r in report.collect()} == {"n": ("new", 2), "bad": ("failed", 0), "same": ("new", 1)}
    assert store.dead_letters.count() == 1 and store.sync_log.where("operation = 'insert'").count() == 3

    v2 = item(spark, [("n", "notes", "# A\none\n\n# C\nthree", None), ("same", "notes", "  keep \n", None)])
    store, report = ingest(store, v2, T2, "m2")
    stats = run_stats(report).first()
    store = link_parents(store).write(str(tmp_path / "2"))
    assert (stats.chunks_added, stats.chunks_removed, stats.chunks_unchanged) == (1, 1, 2)
    seen = {r.source_id: r for r in store.sources.collect()}
    assert seen["n"].current_version == 2 and seen["n"].last_fetched_at is None and seen["same"].last_fetched_at == T2
    model = {r.content: r.embedding_model_id for r in store.active_chunks().where("source_id = 'n'").collect()}
    assert model == {"one": "m1", "three": "m2"}
    assert {r.change for r in provenance.diff(store, "n", 1, 2).collect()} == {"added", "removed", "unchanged"}
    three = store.chunks.where("content = 'three'").first()
    assert three.parent_chunk_hash == store.chunks.where("content = 'two'").first().chunk_hash
    with pytest.raises(ValueError):
        provenance.diff(store, "n", 1, 1)
    with pytest.raises(ValueError):
        provenance.diff(store, "none", 1, 2)

    # a tombstone retires everything; a reset and the same text bring it back
    gone, _ = ingest(store, item(spark, [("n", "notes", "", None)]), T3)
    assert gone.active_chunks().where("source_id = 'n'").isEmpty()
    store, counts = store.reset_adapter("a:1", T3)
    store = store.write(str(tmp_path / "3"))
    assert counts.first().chunks_retired == 4 and store.reset_adapter("a:1", T3)[1].first().chunks_retired == 0
    back, report = ingest(store, v2, "2024-01-04T00:00:00Z")
    assert {r.status for r in report.collect()} == {"resurrect"} and back.active_chunks().count() == 3


def test_duplicate_content(spark):
    store, _ = ingest(Store.new(spark).register_adapters(adapters(spark)), item(spark, [("d", "notes", "# A\nx\n\n# B\nx", None), ("e", "notes", "x", None)]), T1)
    assert store.chunks.count() == 2  # once in each source
    assert sorted(len(r.chunk_hashes) for r in store.versions.collect()) == [1, 2]


def test_prefix_is_literal(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("A_C",), ("a%",)], "source_id string")
    assert {r[0] for r in df.where(catalog.prefix("source_id", "a_")).collect()} == {"a_b", "A_C"}


def test_chain_with_cycle(spark):
    store, _ = ingest(Store.new(spark).register_adapters(adapters(spark)), item(spark, [("n", "notes", "# A\n1\n\n# B\n2\n\n# C\n3", None)]), T1)
    h = [r.chunk_hash for r in store.chunks.orderBy("chunk_index").collect()]
    parents = spark.createDataFrame([(h[0], h[1]), (h[1], h[2]), (h[2], h[0])], "chunk_hash string, p string")
    from dataclasses import replace

    store = replace(store, chunks=store.chunks.join(parents, "chunk_hash").withColumn("parent_chunk_hash", F.col("p")).select(store.chunks.columns))
    got = provenance.chains(store, spark.createDataFrame([(h[0],)], "chunk_hash string")).orderBy("level").collect()
    assert [r.chunk_hash for r in got] == h


def test_links_are_idempotent(spark):
    store = Store.new(spark).register_adapters(adapters(spark))
    rows = [("p", "people", "Ann", json.dumps({"contact_id": "c", "display_name": "Ann", "emails": ["ANN@x.org"], "phones": ["(212) 555-0100"]})), ("m", "messages", "hi", json.dumps({"thread_id": "t", "message_id": "m", "sender": "ann@x.org"})), ("e", "events", "call", json.dumps({"event_id": "e", "title": "t", "invitees": ["Ann <ann@x.org>", "+1 212 555 0100"]}))]
    store, _ = ingest(store, item(spark, rows), T1)
    once = linking.link_people(store, T1)
    assert once.entity_links.count() == 2 and linking.link_people(once, T2).entity_links.count() == 2
    page, total = linking.person_context(once, linking.person_chunks(once, "c"), ["messages"])
    assert total.first().total == 1 and page.first().content == "hi"


def test_retrieve(spark):
    store, _ = ingest(Store.new(spark).register_adapters(adapters(spark)), item(spark, [("a", "notes", "red apples", None), ("b", "notes", "blue whales swim", None)]), T1)
    store = store.put_vectors(vector.embedded(store.active_chunks()))
    hits = vector.retrieve(store, "blue whales", 1).collect()
    assert [h.source_id for h in hits] == ["b"] and 0.8 < hits[0].score <= 1
    with pytest.raises(ValueError):
        vector.retrieve(store, "x", source="a:b")
    gone, _ = store.reset_adapter("a:1", T2)
    assert vector.retrieve(gone, "blue whales", 2).isEmpty()


def test_neighbours_in_blocks(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("embedding", "vector")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("vector").alias("query_vector"))
    whole, parts = ({(r.query, r.vec_id, r.score) for r in vector.neighbours(v, q, 3, "vec_id", most=most).collect()} for most in (10_000, 20))
    assert len(whole) == 3 * q.count() and parts == whole


def test_readers(spark, tmp_path):
    def lines(name, *rows):
        p = tmp_path / name
        p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return str(p)

    items, rejects = readers.reminders(spark, lines("r.json", {"id": "1", "title": "Buy", "list": "L", "completed": False, "priority": 5}, {"id": "2", "title": "Odd", "list": "L", "completed": False, "priority": 12}, "not json"))
    got = items.collect()
    assert [g.source_id for g in got] == ["L/1"] and json.loads(got[0].extra_metadata)["priority"] == 3 and rejects.count() == 2
    hr, bad = readers.heart_rate(spark, lines("h.json", {"timestamp": "2026-03-07 09:10:00 -0500", "bpm": 60}, {"timestamp": "2026-03-07 09:50:00 -0500", "bpm": 80}, {"timestamp": "x", "bpm": 1}), "apple_health:1")
    row = hr.first()
    assert row.source_id == "heart_rate/2026-03-07T09" and "average 70" in row.markdown and bad.count() == 1
    both, _ = readers.tracks(spark, lines("t.json", {"id": "1", "title": "S", "play_count": 1, "played_at": T1}, {"id": "2", "title": "U", "play_count": 0}), library=True)
    assert sorted(r.domain for r in both.collect()) == ["documents", "documents", "events"]
    sleep, _ = readers.health(spark, lines("s.json", {"id": "1", "day": "2024-01-01", "score": 80, "efficiency": 0.9}), "oura:1", "sleep_summary")
    assert json.loads(sleep.first().extra_metadata)["efficiency"] == 90.0
    mail, _ = readers.mail(spark, lines("m.json", {"id": "1", "from": {"name": "A", "address": "A@x.org"}, "to": [], "subject": "s", "date": T1, "html": "<p>Hi <b>you</b></p><style>x</style>"}))
    assert mail.first().markdown == "Hi **you**" and json.loads(mail.first().extra_metadata)["is_thread_root"] is True
    feed = lines("f.json", {"source_id": "a.md", "markdown": "x"}, {"op": "delete", "source_id": "b.md", "modified_at": T1}, {"has_more": False, "next_cursor": "c"})
    got, _, trailer = readers.file_feed(spark, feed)
    assert {r.source_id: r.markdown for r in got.collect()} == {"a.md": "x", "b.md": ""} and trailer.first().next_cursor == "c"
    with pytest.raises(ValueError):
        readers.file_feed(spark, lines("cut.json", {"source_id": "a.md", "markdown": "x"}))
    every = {"contacts": {"id": "1", "displayName": "N", "emails": ["a@x.org"], "phones": []}, "chat": {"id": "1", "text": "x", "sender": "s", "timestamp": T1, "thread_id": "t"}, "calendar": {"id": "1", "title": "t", "startDate": T1, "endDate": T1, "attendees": [{"name": "A", "email": "a@x.org"}]}, "notes": {"id": "1", "title": "t", "body_markdown": "b", "created_at": "2024-01-01T00:00:00", "modified_at": T1}, "watches": {"video_id": "v", "title": "t", "watched_at": T1}}
    for name, record in every.items():
        items, rejects = readers.TYPES[name](spark, lines(f"{name}.json", record, {}))
        assert items.count() == 1 and rejects.count() == 1, name
        assert all(r.error is None for r in C.chunked(items.select("source_id", "domain", "markdown", "extra_metadata")).collect()), name


def test_files_and_pages(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "in").mkdir(parents=True)
    for name, text in (("a.md", "# A"), ("in/b.HTML", "<p>Hi <b>you</b></p>"), ("c.txt", "plain <b>"), ("d.bin", "x"), ("none", "x")):
        (docs / name).write_text(text)
    ids = lambda found: {r.source_id: r.markdown for r in found[0].collect()}
    assert ids(readers.files(spark, str(docs))) == {"a.md": "# A"}
    got = readers.files(spark, str(docs), extensions=("md", ".html", "txt"))
    assert ids(got) == {"a.md": "# A", "in/b.HTML": "Hi **you**", "c.txt": "plain <b>"} and got[1].isEmpty()
    assert {json.loads(r.extra_metadata)["document_type"] for r in got[0].collect()} == {"text/markdown", "text/html", "text/plain"}
    with pytest.raises(ValueError):
        readers.files(spark, str(docs), extensions=("pdf",))

    pages = tmp_path / "pages of a feed"
    pages.mkdir()
    (pages / "1.json").write_text('{"source_id": "a.md", "markdown": "x"}\n{"has_more": true, "next_cursor": "c1"}')
    (pages / "2.json").write_text('{"source_id": "b.md", "markdown": "y"}\n{"has_more": false, "next_cursor": "c2"}')
    items, _, trailers = readers.file_feed(spark, str(pages))
    assert {r.source_id for r in items.collect()} == {"a.md", "b.md"}
    assert {(r.has_more, r.next_cursor) for r in trailers.collect()} == {(True, "c1"), (False, "c2")}
    (pages / "3.json").write_text('{"source_id": "c.md", "markdown": "z"}')
    with pytest.raises(ValueError):  # one page of three was cut off
        readers.file_feed(spark, str(pages))


def test_calendar_and_card_files(spark, tmp_path):
    (tmp_path / "a.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Long\r\n  title\r\nDTSTART:20240101T100000Z\r\nDURATION:PT1H30M\r\nATTENDEE:mailto:b@x.org\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    row = readers.ical(spark, str(tmp_path))[0].first()
    meta = json.loads(row.extra_metadata)
    assert meta["title"] == "Long title" and meta["duration_minutes"] == 90 and meta["start_date"] == "2024-01-01T10:00:00Z"
    (tmp_path / "a.vcf").write_text("BEGIN:VCARD\nFN:Ann\nEMAIL:Ann@x.org\nTEL:(212) 555-0100\nEND:VCARD\n")
    meta = json.loads(readers.vcards(spark, str(tmp_path))[0].first().extra_metadata)
    assert meta["contact_id"] == hashlib.sha256(b"AnnAnn@x.org").hexdigest() and meta["phones"] == ["+12125550100"]
    (tmp_path / "b.vcf").write_text("BEGIN:VCARD\nFN:Ann\nEMAIL:Ann@x.org\nEND:VCARD\n")
    with pytest.raises(ValueError):
        readers.vcards(spark, str(tmp_path))


def test_vault(spark, tmp_path):
    (tmp_path / "A.md").write_text("---\ntags: [x, y]\naliases: one\n---\nSee [[B|bee]]. Due Date:: soon\nDue-date:: later\n")
    (tmp_path / "B.md").write_text("---\nkanban-plugin: basic\n---\n## Doing\n- [ ] task ⏫ 📅 2024-01-02 ⛔ t-1\n## Done\n- [x] old\n")
    got = {r.source_id: json.loads(r.extra_metadata) for r in readers.vault(spark, str(tmp_path))[0].collect()}
    assert got["A.md"]["tags"] == ["x", "y"] and got["A.md"]["aliases"] == ["one"] and got["A.md"]["dataview_fields"]["due_date"] == "soon" and got["B.md"]["backlinks"] == ["A"]
    tasks = {r.markdown: json.loads(r.extra_metadata) for r in readers.vault_tasks(spark, str(tmp_path))[0].collect()}
    assert tasks["task"]["status"] == "in-progress" and tasks["task"]["priority"] == 2 and tasks["task"]["due_date"] == "2024-01-02" and tasks["task"]["dependencies"] == ["t-1"] and tasks["old"]["status"] == "completed"


def test_captions(spark):
    segs = [("a b", 0.0, 1.0), ("c d", 1.0, 1.0), ("e", 2.0, 3.0)]
    df = spark.createDataFrame([(segs,)], "s array<struct<text:string, start:double, duration:double>>")
    got = df.select(readers.caption_blocks(F.col("s"), 3).alias("b")).first().b
    assert [(x.text, x.start, x.end) for x in got] == [("a b", 0.0, 1.0), ("c d e", 1.0, 5.0)]


def test_endpoints(spark, tmp_path):
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"id": "1", "title": "t", "body_markdown": "b"}))
    (items, _), status = readers.fetched(spark, {"good": lambda s: readers.notes(s, str(p)), "bad": lambda s: readers.notes(s, str(tmp_path / "none.json"))})
    assert items.count() == 1 and {r.endpoint: r.ok for r in status.collect()} == {"good": True, "bad": False}
    with pytest.raises(readers.AllEndpointsFailedError):
        readers.fetched(spark, {"bad": lambda s: readers.notes(s, str(tmp_path / "none.json"))})


def test_config(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"id": "1", "title": "t", "body_markdown": "b"}))
    good = tmp_path / "c.toml"
    good.write_text(f'[[readers]]\nid = "n"\ntype = "notes"\n[readers.options]\npath = "{tmp_path}/n.json"\n')
    assert config.read_all(spark, str(good))[0].count() == 1
    for text in ('{"readers": [{"id": "a", "type": "none"}]}', '{"readers": [{"id": "a", "type": "notes", "x": 1}]}', '{"other": 1}', '{"readers": [{"id": "a", "type": "notes"}, {"id": "a", "type": "chat"}]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            config.loaded(str(tmp_path / "bad.json"))


def test_stream_windows_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value", "user_id", "event_id")
    src.repartition(3).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = streams.hourly_windows(live, late="60 days").writeStream.outputMode("update").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.hour: r.n for r in spark.sql("SELECT hour, max(sample_count) n FROM hours GROUP BY hour").collect()}
    want = {r.h: r.n for r in src.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("value").alias("n")).collect()}
    assert got == want


def test_debounce(spark, tmp_path):
    rows = [("a", "deleted", 0.0), ("a", "created", 0.2), ("b", "created", 0.1), ("b", "modified", 0.3), ("z", "modified", 60.0)]
    base = pd.Timestamp("2024-01-01")
    spark.createDataFrame([(p, k, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for p, k, s in rows], "path string, kind string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "ch"))
    live = spark.readStream.schema("path string, kind string, ts timestamp").parquet(str(tmp_path / "ch"))
    q = streams.debounced(live).writeStream.outputMode("append").format("memory").queryName("changes").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert {r.path: r.kind for r in spark.table("changes").collect()} == {"a": "modified", "b": "modified"}


def test_retry_queue(spark):
    queue = spark.createDataFrame([("a", 0), ("b", 2), ("c", 0)], "path string, attempts int")
    again, over = streams.retried(queue, spark.createDataFrame([("c",)], "path string"))
    assert [r.path for r in again.collect()] == ["a"] and [r.path for r in over.collect()] == ["b"]


def test_scores(spark):
    row = spark.range(1).select(scores.sigmoid(F.lit(800.0)).alias("a"), scores.duration_label(F.lit(90)).alias("b"), scores.iso_week_key(F.to_date(F.lit("2025-12-29"))).alias("c"), scores.iso_week_key(F.to_date(F.lit("2025-12-29")), True).alias("d"), scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e")).first()
    assert tuple(row) == (1.0, "1h 30m", "2025-W01", "2026-W01", 0.0)


def test_folders(spark):
    df = spark.createDataFrame([("a/b/x.md",), ("a/y.md",), ("z.md",)], "path string")
    assert {r.folder: r.files for r in A.folders(df).collect()} == {"": 3, "a": 2, "a/b": 1}
    assert unicodedata.normalize("NFC", "é") == "é"


def test_line_diff_by_hand():
    from tidemark.operators.linediff import differences

    got = differences("a\nb\nc\nd", "a\nx\nc\ne\nd")
    assert [(k, c) for k, c, _ in got] == [("context", "a"), ("removed", "b"), ("added", "x"), ("context", "c"), ("added", "e"), ("context", "d")]
    assert [k for k, _, _ in differences("a", "b")] == ["removed", "added"]


def test_display(spark):
    from tidemark.functions import display as D

    df = spark.createDataFrame([("ann <lee>",), ("bo",), ("()",)], "n string")
    assert [r.i for r in df.select(D.initials(F.col("n")).alias("i")).collect()] == ["AL", "BO", "?"]
    want = 0
    for c in "bo":
        want = (want * 31 + ord(c)) & 0x7FFFFFFF
    assert df.where("n = 'bo'").select(D.palette_index(F.col("n")).alias("p")).first().p == want % 10
    assert spark.range(1).select(D.source_label(F.lit("caldav")).alias("x")).first().x == "CalDAV Tasks"


def test_reembed(spark):
    store, _ = ingest(Store.new(spark).register_adapters(adapters(spark)), item(spark, [("a", "notes", "red apples", None)]), T1, "old")
    done, n = vector.reembedded(store, "new")
    assert n.first()[0] == 1 and done.vectors.count() == 1 and vector.reembedded(done, "new")[1].first()[0] == 0


def test_remote_source(spark, monkeypatch):
    import http.server
    import threading

    from tidemark.sources import remote

    class Answer(http.server.BaseHTTPRequestHandler):
        tries = 0

        def do_POST(self):  # noqa: N802
            Answer.tries += 1
            self.rfile.read(int(self.headers["Content-Length"]))
            body = json.dumps({"normalized_contents": [{"source_id": "a", "markdown": "x"}]}).encode()
            self.send_response(503 if Answer.tries == 1 else 200)
            self.send_header("Content-Length", "0" if Answer.tries == 1 else str(len(body)))
            self.end_headers()
            if Answer.tries > 1:
                self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    rows = spark.read.format("remote_items").option("url", f"http://127.0.0.1:{server.server_port}").load().collect()
    server.shutdown()
    assert [(r.source_id, r.markdown) for r in rows] == [("a", "x")] and Answer.tries >= 2
    with pytest.raises(ValueError):
        remote.checked([{"source_id": "", "markdown": "x"}])
