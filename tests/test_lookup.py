"""Substring index, page index, stored sketches, line differences, phone numbers, models."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import linediff, linking, sketches, vector
from tidemark.operators.models import Model, ModelError, applied
from tidemark.operators.substrings import SubstringIndex
from tidemark.plans.pages import Pages

SF = "/root/testdata/sf0.001"


# Substrings


def test_substrings(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abC dÉ") for _ in range(rng.choice([0, 1, 2, 3, 20, 60])))) for i in range(400)] + [(900, None), (901, ""), (902, "Ab"), (903, "x" * 50_000 + "Needle"), (903, "other of one key"), (904, "%_\\ d")]
    docs = spark.createDataFrame(texts, "id long, body string")
    index = SubstringIndex.build(docs.where("id < 300"), f"file://{tmp_path}/i", "id", "body")
    index.append(docs.where("id >= 300"), "id", "body")
    for term in ["", "AB", "c dé", "needle", "zzz", "\\ d", "x" * 40]:
        got = sorted(map(str, index.search(docs, term, "id", "body").collect()))
        want = sorted(str(r) for r in docs.collect() if r.body is not None and term.lower() in r.body.lower())
        assert got == want, term


def test_substring_plan_reads_postings(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = SubstringIndex.build(docs, f"file://{tmp_path}/i", "doc_id")
    term = docs.orderBy("doc_id").first().text[3:15]
    found = index.search(docs, term, "doc_id")
    assert found.count() == docs.where(F.lower("text").contains(term.lower())).count() > 0
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and any("/postings/" in f for f in found.inputFiles())
    assert len(index.chosen(term)) <= 4 and index.candidates(term).count() < docs.count()


# Pages


def test_deep_page_reads_one_range(spark, tmp_path):
    rows = spark.range(1_200_000).select(F.xxhash64("id").alias("k"), "id", (F.col("id") % 7).alias("g"))
    pages = Pages.build(rows, f"file://{tmp_path}/p", [("g", False), ("k", True)])
    pages = Pages(spark, pages.path)
    assert pages.total == 1_200_000 and len(pages.ranges) >= 10
    got = [r.id for r in pages.page(1_000_000, 20).collect()]
    assert got == [r.id for r in rows.orderBy(F.desc("g"), "k").offset(1_000_000).limit(20).collect()]
    plan = pages.page(1_000_000, 20)._jdf.queryExecution().toString()
    [own] = [r for r, before, n in pages.ranges if before <= 1_000_000 < before + n]
    assert re.search(rf"PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = {own}\)\]", plan)


def test_pages_odd(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5 if i % 3 else None, i) for i in range(57)], "k int, id int")
    for n, keys in enumerate([[("k", True), ("id", True)], [("k", False), ("id", False)]]):
        pages = Pages.build(rows, f"file://{tmp_path}/p{n}", keys, per_range=10)
        whole = [r.id for r in rows.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys]).collect()]
        for offset, limit in [(0, 5), (8, 25), (50, 20), (57, 5), (90, 5), (3, 0)]:
            assert [r.id for r in pages.page(offset, limit).collect()] == whole[offset : offset + limit]
    with pytest.raises(ValueError):
        pages.page(-1, 5)
    empty = Pages.build(rows.where("false"), f"file://{tmp_path}/none", [("id", True)])
    assert empty.total == 0 and empty.page(0, 5).collect() == []


# Sketches


def test_sketches(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = spark.range(600_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5 * 86_400).alias("ts"), F.concat(F.lit("a"), F.col("id") % 3).alias("adapter"), F.pmod(F.xxhash64("id"), F.lit(150_000)).alias("item"))
    sketches.stored(sketches.daily(rows, "ts", "adapter", "item"), path)
    exact = {r.adapter: (r.n, r.items) for r in rows.groupBy("adapter").agg(F.count("item").alias("n"), F.countDistinct("item").alias("items")).collect()}
    for r in sketches.merged(sketches.read(spark, path), "group").collect():
        n, items = exact[r.group]
        assert r.n == n and abs(r["items"] - items) <= 0.03 * items
    days = sorted(r.day for r in sketches.read(spark, path).select("day").distinct().collect())
    part = rows.where(F.to_date("ts").between(days[1], days[2])).agg(F.countDistinct("item")).first()[0]
    [found] = sketches.merged(sketches.read(spark, path, str(days[1]), str(days[3]))).collect()
    assert abs(found["items"] - part) <= 0.03 * part
    again = rows.where(F.to_date("ts") == F.lit(days[0])).where("adapter = 'a1'")  # one day anew, the others stay
    sketches.stored(sketches.daily(again, "ts", "adapter", "item"), path)
    left = sketches.read(spark, path)
    assert left.where(F.col("day") == F.lit(days[0])).count() == 1 and left.where(F.col("day") > F.lit(days[0])).count() == 12


# Line differences


def quadratic(a, b):
    """By the whole table of lengths."""
    a, b = a.split("\n"), b.split("\n")
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("context", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or n[i + 1][j] >= n[i][j + 1]):
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return [(kind, line, k + 1) for k, (kind, line) in enumerate(out)]


@pytest.mark.parametrize("held", [1, 3, 64])
def test_line_diff_equals_the_table(monkeypatch, held):
    monkeypatch.setattr(linediff, "HELD", held)
    rng = random.Random(held)
    for _ in range(300):
        a, b = ("\n".join(rng.choice("abcde") for _ in range(rng.randint(0, rng.choice([2, 9, 40])))) for _ in range(2))
        assert linediff.differences(a, b) == quadratic(a, b)


def test_line_diff_of_20_000_lines():
    """In another process, whose memory is measured."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from tidemark.operators.linediff import differences
rng = random.Random(1)
a, b = ("\\n".join(f"line {rng.randint(0, 9000)}" for _ in range(20_000)) for _ in range(2))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
d = differences(a, b)
assert "\\n".join(x for k, x, _ in d if k != "added") == a and "\\n".join(x for k, x, _ in d if k != "removed") == b
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 100  # MB


# Phone numbers


@pytest.mark.parametrize(("given", "want"), [
    ("(555) 123-4567", "+15551234567"), ("555-123-4567 EXT. 456", "+15551234567"), ("555-123-4567x123", "+15551234567"), ("+1 (555) 123-4567 ext. 8901", "+15551234567"), ("+44 20 7946 0958", "+442079460958"), ("+44 0207 946 0958", "+442079460958"),
    ("+33 1 42 34 56 78", "+33142345678"), ("+33 (0)1 42 34 56 78", "+33142345678"), ("+49 30 12345678", "+493012345678"), ("+49 (0) 30 12345678", "+493012345678"), ("+81-3-1234-5678", "+81312345678"), ("+81 03 1234 5678", "+81312345678"), ("+39 06 6982 1234", "+390669821234"),
    ("+353 1 234 5678", "+35312345678"), ("+353 01 234 5678", "+35312345678"), ("+972-054-123-4567", "+972541234567"), ("+7 8 912 345 67 89", "+79123456789"), ("+36 06 1 234 5678", "+3612345678"), ("+61 2 9374 4000", "+61293744000"), ("011 44 20 7946 0958", "+442079460958"), ("+1 1 555 123 4567", "+15551234567"),
    ("0555 123 4567", ""), ("+9", ""), ("9", ""), ("+", ""), ("+ - ()", ""), ("abc", ""), ("   ", ""), ("()--", ""), ("", ""), ("+44 12", ""), ("+1 555 123 456", ""), ("+45 123 456 789", ""), ("+0 123 456 789", ""), ("\t555.123.4567\n", "+15551234567"), ("+298 123456", "+298123456"),
])
def test_phones(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(X.normalised_phone(F.col("t"))).first()[0] == want


# Models


def lengths(folder, fail=None):
    def load():
        if fail == "load":
            raise OSError("no file")
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def run(pairs):
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{len(pairs)}\n")
            if fail == "run":
                raise RuntimeError("broken")
            return [float(p[1].count("!")) - 2 for p in pairs] if fail != "short" else []

        return run

    return load


def candidates(spark):
    return spark.createDataFrame([(f"h{i:03d}", "passage" + "!" * (i % 5), 0.5, "kept") for i in range(700)], "chunk_hash string, content string, score double, source string").repartition(6, "chunk_hash")


def test_rerank_by_a_model(spark, tmp_path):
    rows = vector.reranked(candidates(spark), "a query", Model(f"m {tmp_path}", lengths(tmp_path)), 150).collect()
    assert len(rows) == 150 and [r.chunk_hash for r in rows[:3]] == ["h004", "h009", "h014"] and rows[0].asDict().keys() == {"chunk_hash", "content", "score", "source"}
    assert abs(rows[0].score - 1 / (1 + 2.718281828**-2)) < 1e-6 and rows[140].score < rows[0].score
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) and max(map(int, (tmp_path / "calls").read_text().split())) <= 256  # once in each worker
    assert vector.reranked(candidates(spark).where("false"), "q", Model("x", lengths(tmp_path))).collect() == []
    assert vector.reranked(candidates(spark), "q", Model(f"m {tmp_path}", lengths(tmp_path))).count() == 700
    for bad in [("", None), (" \n", None), ("q", 0), ("q", -1)]:
        with pytest.raises(ValueError):
            vector.reranked(candidates(spark), bad[0], Model("x", lengths(tmp_path)), bad[1])


@pytest.mark.parametrize(("fail", "message"), [("load", "failed to load model 'broken load'"), ("run", "failed on .* inputs: RuntimeError"), ("short", "returned 0 outputs")])
def test_models_that_fail(spark, tmp_path, fail, message):
    with pytest.raises(Exception, match=message):
        vector.reranked(candidates(spark), "q", Model(f"broken {fail}", lengths(tmp_path, fail))).collect()


def test_memory_errors_pass():
    def run(_):
        raise MemoryError

    with pytest.raises(MemoryError):
        Model("full", lambda: run).run(["x"])
    with pytest.raises(ModelError):
        Model("none", lambda: lambda x: x[:-1]).run(["x"])


def test_embedding_by_a_model(spark):
    from pyspark.sql import types as T

    chunks = spark.createDataFrame([("a", "s", 1, "notes", "x y", "Head", "t"), ("b", "s", 1, "notes", "zz", None, "t"), ("c", "s", 1, "notes", None, None, "t")], "chunk_hash string, source_id string, source_version int, domain string, content string, context_header string, created_at string")
    got = {r.chunk_hash: r.vector for r in vector.embedded(chunks, Model("sizes", lambda: lambda texts: [[len(t), 1.0] for t in texts])).collect()}
    assert got == {"a": [9.0, 1.0], "b": [2.0, 1.0], "c": None}
    pairs = applied(chunks, Model("both", lambda: lambda rows: [a + b for a, b in rows]), ["chunk_hash", "content"], "out", T.StringType())
    assert [r.out for r in pairs.orderBy("chunk_hash").collect()] == ["ax y", "bzz", None]


def _named(spark):
    """People and messages: several identifiers in common, repeated hashes, crowds, nobody's messages."""
    rows = [(f"p{k}", "people", {"emails": [f"c{k}@x.example", "all@x.example" if k < 6 else f"d{k}@x.example"], "phones": [f"(212) 555-{k % 3:04}"]}) for k in range(12)]
    rows += [("p1", "people", {"emails": ["other@x.example"]})]
    rows += [(f"m{k}", "messages", {"sender": f"c{k % 14}@x.example", "recipients": [f"+1 212 555 {k % 4:04}", f"c{k % 5}@x.example", "all@x.example" if k % 7 == 0 else "other@x.example"]}) for k in range(30)]
    rows += [("m0", "messages", {"sender": "c11@x.example"}), ("m99", "messages", {"sender": "nobody@x.example"}), ("p20", "people", {"emails": ["alone@x.example"]})]
    return spark.createDataFrame([(h, d, json.dumps(m)) for h, d, m in rows], "chunk_hash string, domain string, domain_metadata string")


def test_pairs_are_made_once(spark):
    chunks = _named(spark)
    people, others = linking.people_identifiers(chunks).cache(), linking.mentioned_identifiers(chunks).cache()
    want = sorted(map(tuple, people.withColumnRenamed("chunk_hash", "a").join(others, "identifier").select("a", "chunk_hash").distinct().collect()))
    for carried in (0, 1, 2, 64):
        assert sorted(map(tuple, linking.pairs(people, others, carried).collect())) == want
    linked = {a for a, _ in want}
    assert {r.chunk_hash for r in linking.orphans(chunks).collect()} == {f"p{k}" for k in [*range(12), 20]} - linked
    assert "p20" not in linked


def test_colleagues_by_identifiers(spark):
    chunks = _named(spark)
    links = linking.resolved(chunks, "x").select("source_chunk_hash", "target_chunk_hash").collect()
    people = {}
    for p, t in links:
        people.setdefault(t, set()).add(p)
    want = {}
    for some in people.values():
        for a in some:
            for b in some:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.shared for r in linking.colleagues_of(chunks).collect()} == want


def test_lines_of_an_ingest(spark):
    """A long text with repeated lines, twice: rows of chunks carry no list of all the hashes."""
    from tidemark.operators.chunking import first_lines, line_hashes
    from tidemark.operators.ingest import ingest
    from tidemark.plans.store import Store

    text = [f"line {k % 700}" for k in range(1000)]
    item = lambda lines: spark.createDataFrame([("d", "a", "documents", "\n".join(lines))], "source_id string, adapter_id string, domain string, markdown string").selectExpr("*", "'o' origin_ref", "'n' display_name", "'push' poll_strategy", "cast(null as int) poll_interval_sec", "'1' normalizer_version", "cast(null as string) extra_metadata")
    placed = item(text).select("markdown", line_hashes("markdown").alias("h")).select(F.inline(first_lines("markdown", "h"))).collect()
    assert sorted((r.chunk_index, r.content) for r in placed) == [(k, f"line {k}") for k in range(700)]
    store, _ = ingest(Store.new(spark), item(text), "t1", "m1", by_line=True)
    store, report = ingest(store, item([*text[:-1], "new"]), "t2", "m2", by_line=True)
    assert [(r.status, r.chunks_added, r.chunks_removed, r.chunks_unchanged) for r in report.collect()] == [("changed", 1, 0, 700)]
    assert sorted((r.source_version, r.embedding_model_id, r["count"]) for r in store.chunks.groupBy("source_version", "embedding_model_id").count().collect()) == [(1, "m1", 700), (2, "m1", 700), (2, "m2", 1)]
    for join in [x for x in store.chunks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]:
        assert "array_contains" not in join
    lists = [x for x in store.chunks._jdf.queryExecution().executedPlan().toString().split("\n") if "array_contains" in x]
    assert not lists


def test_dealt_ingest_moves_no_chunks(spark):
    """Items dealt by source: the tables of both batches are the same as without, and no chunk is shuffled for them."""
    from tidemark.operators.ingest import ingest, link_parents
    from tidemark.plans.store import Store
    from tidemark.plans.tables import by_source, saved

    def items(k):
        text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda x: F.concat(F.lit("line "), x)), F.when(F.col("id") % 3 == 0, F.lit(f"run {k}")))
        return spark.range(60).select(F.concat(F.lit("s"), "id").alias("source_id"), text.alias("markdown")).selectExpr("*", "'a' adapter_id", "'documents' domain", "'o' origin_ref", "'n' display_name", "'push' poll_strategy", "cast(null as int) poll_interval_sec", "'1' normalizer_version", "cast(null as string) extra_metadata")

    stores = {}
    for buckets in (None, 3):  # fewer than the session's partitions
        store = Store.new(spark)
        for k in (1, 2):
            rows = items(k) if buckets is None else saved(items(k).repartition(buckets, "source_id"), "items", buckets)
            store, report = ingest(store, rows, f"t{k}", f"m{k}", by_line=True, buckets=buckets)
        stores[buckets] = store = link_parents(store)
    for name in ("versions", "chunks", "sources", "sync_log"):
        a, b = (sorted(map(str, getattr(s, name).collect())) for s in stores.values())
        assert a == b and a
    joins = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(c) for c in joins]
    try:
        spark.conf.set(joins[0], "-1")
        spark.conf.set(joins[1], "false")
        with by_source(spark):
            plan = stores[3].chunks.select("source_id", "source_version", "content", "retired_at", "parent_chunk_hash")._jdf.queryExecution().executedPlan()
            moved, todo = [], [plan]
            while todo:
                node = todo.pop()
                todo += [node.children().apply(i) for i in range(node.children().size())]
                if node.nodeName().startswith("Exchange"):
                    moved.append(node.output().toString())
    finally:
        for c, value in zip(joins, before, strict=True):
            spark.conf.set(c, value)
    assert not [x for x in moved if "content" in x or "markdown" in x], moved


def exchanged(spark, df):
    """Columns of each shuffle in the plan of df, without broadcasts."""
    joins = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(c) for c in joins]
    try:
        spark.conf.set(joins[0], "-1")
        spark.conf.set(joins[1], "false")
        moved, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName().startswith("Exchange"):
                moved.append(node.output().toString())
    finally:
        for c, value in zip(joins, before, strict=True):
            spark.conf.set(c, value)
    return moved


def test_statuses_move_no_texts(spark):
    """texts and lists of hashes are hashed and counted before rows are dealt by source."""
    from tidemark.queries import QUERIES

    for name in ("unchanged_short_circuit", "resurrect"):
        moved = exchanged(spark, QUERIES[name](spark, SF))
        # the small table of documents is dealt to all cores as it is read
        assert moved and not [x for x in moved if "markdown" in x or "chunk_hashes" in x], (name, moved)
        assert len([x for x in moved if "text#" in x]) <= 1, (name, moved)


def test_stale_links_compare_hashes_once(spark):
    """F8: what was known and what is active come from one grouping of the chunks."""
    from dataclasses import replace

    from tidemark.plans.corpus import corpus_store

    st = corpus_store(spark, SF)
    row = lambda a, b: (a, b, "t", 1.0, "x")
    chunks = {r.chunk_hash: r.n for r in st.active_chunks().groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {r.chunk_hash for r in st.chunks.select("chunk_hash").distinct().collect()}
    gone, live = sorted(known - set(chunks))[:2], sorted(chunks)[:2]
    assert len(gone) == 2 and len(live) == 2
    links = [row(gone[0], live[0]), row(live[0], gone[1]), row(live[0], live[1]), row("never", live[0]), row(gone[0], gone[1])]
    st = replace(st, entity_links=spark.createDataFrame(links, "source_chunk_hash string, target_chunk_hash string, link_type string, confidence double, created_at string"))
    got = st.stale_links()
    assert sorted((r.source_chunk_hash, r.target_chunk_hash) for r in got.collect()) == sorted((a, b) for a, b, *_ in links if a in gone or b in gone)
    moved = exchanged(spark, got)
    assert not [x for x in moved if "source_id" in x or "source_version" in x], moved


def test_store_tables_are_read_by_source(spark):
    """versions, chunks and sources that are dealt by source are not dealt anew by queries over them."""
    from tidemark.queries import QUERIES

    assert exchanged(spark, QUERIES["line_diff"](spark, SF)) == []
    assert exchanged(spark, QUERIES["version_history_counts"](spark, SF)) == []
    assert exchanged(spark, QUERIES["cross_refs"](spark, SF)) == []
    assert exchanged(spark, QUERIES["active_chunks"](spark, SF)) == []
    rows = QUERIES["admin_status"](spark, SF)
    assert not [x for x in exchanged(spark, rows) if "source_version" in x]


def test_build_writes_texts_with_their_batch_alone(spark):
    """The build of the store keeps no table of items beside those of its batches."""
    from tidemark.plans import corpus, tables

    names, plain = [], tables.scratch
    made, corpus._made = corpus._made, {}
    try:
        tables.scratch = lambda s, name: names.append(name) or plain(s, name)
        store = corpus.corpus_store(spark, SF)
    finally:
        tables.scratch, corpus._made = plain, made
    assert "items" not in names and len([n for n in names if n.endswith("statuses")]) == 2
    assert {r.version for r in store.versions.select("version").distinct().collect()} == {1, 2}


def test_first_batch_is_cut_into_lines_once(spark):
    """the plans of the second batch read the first's chunks, and don't cut its texts again; what is dealt
    by source stays known as that."""
    from tidemark.plans import corpus, tables

    found, plain, made = [], corpus.link_parents, corpus._made
    corpus._made = {}
    try:
        corpus.link_parents = lambda store: found.append(store) or plain(store)
        corpus.corpus_store(spark, SF)
        chunks = found[0].chunks
        with tables.by_source(spark):
            plan = chunks._jdf.queryExecution().optimizedPlan().toString()
            # of what the second batch adds alone
            assert plan.count("Generate inline(") == 1
            assert exchanged(spark, chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))) == []
    finally:
        corpus.link_parents, corpus._made = plain, made


def normalised_by_hand(text):
    blanks = "\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+", " "), ("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), (rf"[ \t\x1f{blanks}]+(?=\n|\Z)", ""), (r"\n\n+", "\n\n")):
        text = re.sub(pattern, to, text)
    return text.strip("".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))


def test_usual_texts_are_hashed_without_patterns(spark):
    """usual texts and lines are told by one look; the rest, and their hashes, are as by the patterns."""
    import hashlib

    rng = random.Random(7)
    odd = [chr(c) for c in (0, 8, 9, 11, 12, 13, 14, 27, 28, 30, 31, 127, 128, 133, 160, 161, 0x1680, 0x1681, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202A, 0x202F, 0x205F, 0x3000, 0x3001, 0xFEFF, 0x1F600)]
    texts = ["".join(rng.choice(odd if rng.random() < p else [" ", "\n", "a", "é"]) for _ in range(rng.randrange(24))) for p in (0, 0.05, 0.5) for _ in range(800)]
    sha = lambda x: hashlib.sha256(normalised_by_hand(x).encode()).hexdigest()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unusual(F.col("t")).alias("u"), X.content_hash(F.col("t")).alias("h"), X.line_hashes(F.col("t")).alias("l")).collect()
    usual = [r for r in rows if not r.u]
    assert len(usual) > 800 and all(r.u for r in rows if set(r.t) & set("\t\r\x0b\x0c\x1c\x1e\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"))
    for r in rows:
        assert r.h == sha(r.t) and r.l == [sha(x.strip(" ")) for x in r.t.split("\n") if x.strip(" ")], r.t
