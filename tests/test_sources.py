"""Paths with any name, HTML, change tokens, retries."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.sources.changes import Snapshots, TokenExpired
from tidemark.sources.markup import markdown_of
from tidemark.streaming import streams


@pytest.mark.parametrize("name", ["plain", "my notes (1)", "[x] {y}", "ünï 50% +1"])
def test_names_of_files_and_folders(spark, tmp_path, name):
    top = tmp_path / name
    (top / "sub dir").mkdir(parents=True)
    (top / "a b.md").write_text("see [[c]] and [[ö+ä]]")
    (top / "sub dir" / "c.md").write_text("back to [[a b]]\n- [ ] do it 📅 2024-05-01")
    (top / "ö+ä.md").write_text("[[a b]] [[100% [x]]]")
    for folder in (str(top), str(top) + "/"):
        found, _ = readers.files(spark, folder)
        assert {r.source_id for r in found.collect()} == {"a b.md", "sub dir/c.md", "ö+ä.md"}
        notes = {r.source_id: json.loads(r.extra_metadata) for r in readers.vault(spark, folder)[0].collect()}
        assert notes.keys() == {"a b.md", "sub dir/c.md", "ö+ä.md"} and notes["a b.md"]["backlinks"] == ["c", "ö+ä"]
        assert notes["sub dir/c.md"]["backlinks"] == ["a b"] and notes["ö+ä.md"]["backlinks"] == ["a b"]
        [task] = readers.vault_tasks(spark, folder)[0].collect()
        assert task.source_id == "sub dir/c.md/2" and task.markdown == "do it"


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("<b>Bold text</b>", "**Bold text**"), ("<i>Italic text</i>", "_Italic text_"), ('<a href="https://example.com">Click here</a>', "[Click here](https://example.com)"), ("<p>First paragraph</p><p>Second paragraph</p>", "First paragraph\n\nSecond paragraph"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>after", "- a\n  - b\n  - c\n- d\n\nafter"), ("<ol start=3><li>x</li><li><p>y</p><p>z</p></li></ol>", "3. x\n4. y\n\n   z"), ("<ol><li>one<ul><li>in</ul></li><li>two</ol>", "1. one\n   - in\n2. two"),
    ("<table><tr><th>A<th>B<tr><td>1&lt;2<td>x|y</table>", "| A | B |\n| --- | --- |\n| 1<2 | x\\|y |"), ("<table><tbody><tr><td><p>p</p><p>q</p></td></tr><tr><td>r</td><td>s</td></tr></tbody></table>t", "| p q | |\n| --- | --- |\n| r | s |\n\nt"),
    ("a &amp;nbsp; &eacute; &#x41;<br>new<script>x<b></script> <style>p{}</style>end", "a &nbsp; é A\nnew end"), ("<blockquote><p>q1</p><p>q2</p></blockquote>", "> q1\n>\n> q2"), ("<pre>  x\n   y</pre>", "```\n  x\n   y\n```"),
    ("<div>one<div>two</div>three</div><h2>Head  line</h2>t", "one\n\ntwo\n\nthree\n\n## Head line\n\nt"), ("<p>unclosed <b>bold", "unclosed **bold**"), ("x</p>y</b>z", "xyz"), ("<img src=a.png alt='A b'> <!-- c --> t", "![A b](a.png) t"), ("This is <strong> spaced </strong>text", "This is **spaced** text"),
    ("<html><head><title>T</title></head><body><p>Hi</p></body></html>", "Hi"), ("<p>a<p>b", "a\n\nb"), ("5 < 6 & 7", "5 < 6 & 7"), (None, None),
])
def test_html(html, want):
    assert markdown_of(html) == want


def test_html_reaches_the_readers(spark, tmp_path):
    (tmp_path / "p.html").write_text("<ul><li>a<ul><li>b</ul></ul>")
    assert readers.files(spark, str(tmp_path), extensions=("html",))[0].first().markdown == "- a\n  - b"


# Change tokens


def event(uid, summary="Meet", start="20240601T100000Z", changed="20240501T000000Z", more=""):
    return f"BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:{uid}\nSUMMARY:{summary}\nDTSTART:{start}\nDTEND:{start.replace('T10', 'T11')}\nLAST-MODIFIED:{changed}\n{more}END:VEVENT\nEND:VCALENDAR\n"


def test_calendar_sync(spark, tmp_path):
    folder, log = tmp_path / "cal", Snapshots(spark, f"file://{tmp_path}/log", keep=2)
    folder.mkdir()
    put = lambda name, text: (folder / f"{name}.ics").write_text(text)
    ids = lambda items: sorted(r.source_id for r in items.collect())
    with pytest.raises(ValueError):
        readers.ical_sync(log, None, None)
    put("a", event("a"))
    put("b b", event("b"))
    put("c", event("c", summary=""))
    put("d", event("d", start="20200101T100000Z"))
    first = log.put(readers.calendar_snapshot(spark, str(folder)))
    items, rejects, removed, token = readers.ical_sync(log, None, None)
    assert ids(items) == ["a", "b", "d"] and rejects.count() == 1 and removed.count() == 0 and token == first
    put("a", event("a", summary="Moved", changed="20240701T000000Z"))
    (folder / "b b.ics").unlink()
    put("e", event("e", changed="20240702T000000"))  # a time without zone
    put("f", event("f", changed="20230101T000000Z"))  # new here, but not changed since
    second = log.put(readers.calendar_snapshot(spark, str(folder)))
    items, _, removed, token = readers.ical_sync(log, first, "2024-06-15T00:00:00Z")
    assert ids(items) == ["a", "e"] and [r.href for r in removed.collect()] == ["b b.ics"] and token == second
    items, _, removed, _ = readers.ical_sync(log, second, "2024-06-15T00:00:00Z")
    assert items.count() == 0 and removed.count() == 0
    third = log.put(readers.calendar_snapshot(spark, str(folder)))
    assert log.tokens() == [second, third]
    with pytest.raises(TokenExpired):
        log.since(first)
    # the first token has expired: a range of time, in which nothing is seen to be removed
    items, _, removed, token = readers.ical_sync(log, first, "2024-05-15T00:00:00Z")
    assert ids(items) == ["a", "e"] and removed.count() == 0 and token == third
    items, _, _, _ = readers.ical_sync(log, "unknown", "2019-01-01T00:00:00Z")
    assert ids(items) == ["a", "d", "e", "f"]


def test_snapshots_by_hand(spark, tmp_path):
    log = Snapshots(spark, f"file://{tmp_path}/log")
    rows = lambda *x: spark.createDataFrame(list(x), "href string, etag string, value string")
    a = log.put(rows(("1", "x", "one"), ("2", None, "two"), ("3", "y", "three"), ("3", "z", "newer")))
    assert {(r.href, r.etag) for r in log.at(a).collect()} == {("1", "x"), ("2", None), ("3", "z")}
    log.put(rows(("1", "x", "one"), ("2", None, "two"), ("4", "q", "four")))
    assert sorted((r.href, r.kind, r.value) for r in log.since(a).items.fillna("-", ["value"]).collect()) == [("2", "upserted", "two"), ("3", "removed", "-"), ("4", "upserted", "four")]
    (tmp_path / "log/snapshots/token=000000000002").mkdir()  # cut off: no snapshot
    assert log.tokens() == [a, "000000000001"] and log.put(rows(("1", "x", "one"))) == "000000000003"


# Retries


def test_retries_by_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = pd.Timestamp("2024-01-01")
    at = lambda s: (base + pd.Timedelta(seconds=s)).to_pydatetime()
    batches = [
        [("a", False, "e1", at(0)), ("b", False, "e1", at(1)), ("c", True, None, at(1))],
        [("z", True, None, at(60))],  # time goes on: a and b are due
        [("a", False, "e2", at(61)), ("b", True, None, at(61))],
        [("z", True, None, at(120))],
        [("a", False, "e3", at(121)), ("d", False, "e1", at(121))],
        [("z", True, None, at(240))],
        [("z", True, None, at(300))],
    ]
    folder = tmp_path / "in"
    query = None
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, "source_ref string, ok boolean, error string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
            if query is None:
                live = spark.readStream.schema("source_ref string, ok boolean, error string, ts timestamp").parquet(str(folder))
                query = streams.retries(live).writeStream.format("memory").queryName("retries").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.source_ref, r.kind, r.attempts, r.error, int((r.at - base).total_seconds())) for r in spark.table("retries").collect())
    assert got == [("a", "dead", 3, "e3", 121), ("a", "retry", 1, "e1", 5), ("a", "retry", 2, "e2", 66), ("b", "retry", 1, "e1", 6), ("d", "retry", 1, "e1", 126)]
    assert spark.table("retries").where(F.col("source_ref").isin("c", "z")).count() == 0


# Feeds, vaults from a service, transcripts, resets


def test_drained_feed(spark, tmp_path):
    line = lambda more, cursor: json.dumps({"has_more": more, "next_cursor": cursor})
    item = lambda i: json.dumps({"op": "upsert", "source_id": i, "markdown": "x", "modified_at": at(0)})
    (tmp_path / "p1.json").write_text(item("a") + "\n" + line(True, "c1"))
    (tmp_path / "p2.json").write_text(item("b") + "\n" + line(False, "c2"))
    items, _, trailers = readers.file_feed(spark, str(tmp_path))
    assert items.count() == 2 and readers.drained(trailers) == ("c2", True)
    assert readers.drained(trailers.where("next_cursor = 'c1'")) == ("c1", False)
    (tmp_path / "p3.json").write_text(item("c") + "\n" + line(True, "c3"))
    with pytest.raises(ValueError, match="end of the feed"):
        readers.drained(readers.file_feed(spark, str(tmp_path))[2])


def test_vault_from_a_service(spark, tmp_path):
    notes = [{"path": "a b.md", "content": "---\ntags: [x]\n---\nsee [[c]]"}, {"path": "d/c.md", "content": "[[a b]]"}, {"path": "", "content": "x"}, {"path": "n.md"}]
    (tmp_path / "v.json").write_text("\n".join([*map(json.dumps, notes), "{broken"]))
    items, rejects = readers.vault_json(spark, str(tmp_path / "v.json"))
    found = {r.source_id: json.loads(r.extra_metadata) for r in items.collect()}
    assert found["a b.md"]["backlinks"] == ["c"] and found["a b.md"]["tags"] == ["x"] and found["d/c.md"]["backlinks"] == ["a b"] and len(found) == 2 and rejects.count() == 3


def at(n):
    return f"2024-02-{n + 1:02d}T00:00:00Z"


@pytest.fixture(scope="module")
def watched(spark, tmp_path_factory):
    from tidemark.operators.ingest import ingest
    from tidemark.plans.store import Store

    folder = tmp_path_factory.mktemp("watched")
    seen = [{"video_id": "v1", "title": "One", "channel": "C", "url": "https://v.example/1", "watched_at": at(0)}, {"video_id": "v1", "title": "One, again", "channel": "C", "url": "https://v.example/1", "watched_at": at(3)}, {"video_id": "v2", "title": "Two", "watched_at": at(1)}, {"video_id": "v3", "title": "Three", "watched_at": at(2)}]
    (folder / "w.json").write_text("\n".join(map(json.dumps, seen)))
    said = lambda i, *texts: {"video_id": i, "segments": [{"text": t, "start": 3599.0 + 2 * k, "duration": 2.0} for k, t in enumerate(texts)]}
    (folder / "c.json").write_text("\n".join(map(json.dumps, [said("v1", "hello there", "more words"), said("v2", "second"), said("v9", "never watched"), {"video_id": "v3"}])))
    items, _ = readers.watches(spark, str(folder / "w.json"))
    adapters = spark.createDataFrame([(a, d, "x", "1", "{}", True, at(0), at(0)) for a, d in (("videos:local", "events"), ("transcripts:local", "documents"))], "adapter_id string, domain string, adapter_type string, normalizer_version string, config string, enabled boolean, created_at string, updated_at string")
    store = ingest(Store.new(spark).register_adapters(adapters), items, at(5))[0].write(str(folder / "store"))
    return folder, store


def test_transcripts_of_watched_videos(spark, watched):
    from tidemark.operators.ingest import ingest

    folder, store = watched
    items, rejects = readers.transcripts(spark, str(folder / "c.json"), store, "videos:local", words=2)
    found = {r.source_id: r for r in items.collect()}
    assert found.keys() == {"video/transcript/v1", "video/transcript/v2"} and rejects.count() == 1
    assert found["video/transcript/v1"].markdown == f"# One, again\n\n**Channel:** C\n**URL:** https://v.example/1\n**Watched:** {at(3)}\n\n## Transcript\n\n[59:59] hello there\n\n[1:00:01] more words"
    store = ingest(store, items.where("source_id = 'video/transcript/v1'"), at(6))[0].write(str(folder / "later"))
    again, _ = readers.transcripts(spark, str(folder / "c.json"), store, "videos:local")
    assert [r.source_id for r in again.collect()] == ["video/transcript/v2"]


def test_reset_in_steps(spark, watched):
    from tidemark.plans.reset import HelperFailed, UnknownAdapter, reset

    _, store = watched
    done = []
    after, told = reset(store, "videos:local", at(7), helper=lambda: done.append("helper") or ["cursor"], trigger=lambda a: done.append(a) or True)
    assert told.ok and told.helper_reset and told.cleared == ["cursor"] and told.triggered and done == ["helper", "videos:local"]
    assert told.sources_reset == 4 and told.chunks_retired == store.live_chunks().count() and after.live_chunks().count() == 0
    with pytest.raises(UnknownAdapter):
        reset(store, "no:such", at(7))

    def broken(*_):
        raise OSError("down")

    with pytest.raises(HelperFailed, match="OSError: down"):
        reset(store, "videos:local", at(7), helper=broken)
    after, told = reset(store, "videos:local", at(7), trigger=broken)
    assert not told.ok and told.helper_reset is None and told.errors == ["OSError: down"] and after.live_chunks().count() == 0
    after, told = reset(store, "videos:local", at(7))
    assert told.needs_fetch != told.ok and told.chunks_retired > 0
