"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, no rows and
clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, katz, language, licenses, lines, minhash, packing, quality, sharding, simhash, token_files
from tidemark.llm.common import saved
from tidemark.llm.components import components
from tidemark.llm.encode import Encoder

SF = "/root/testdata/sf0.001"
#: Names that the operators make themselves.
MADE = ["row_no", "gone", "gone_no", "bands", "component", "key0", "bad0", "row_hash", "bad_hash", "n_words", "ll", "best", "p0", "h0", "x0", "confidence", "held", "start", "part", "seq"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, shard string, fp string, kept string, body string, " + ", ".join(f"{c} string" for c in MADE)
MIT = licenses.TEMPLATES["MIT"]
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "word", "en", "s"), (5, "A b c d e f g h. " * 5000, "en", "s"), (6, "same text here for all", "en", "s"), (6, "same text here for all", "en", "s"),
    (7, "same text here for all", "de", None), (None, "no id at all", "en", "s"), (8, "Released under the MIT License.\nother line", "en", "t"), (9, "x" * 30000, "en", "t"), (10, "ünï çödé 漢字 " * 12, "fr", "t"), (11, "a\n\nb\n" + MIT[:400] + "\n" + MIT[400:], "en", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, src, len(t or ""), "r", 1, "s", "f", "k", "b", *MADE) for i, t, lang, src in ODD]
    return saved(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return saved(spark.createDataFrame([], SCHEMA), "none")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_sets(sets, similarity=0.8):
    """Components of sets, by comparing all pairs."""
    out = Sets()
    for i, s in enumerate(sets):
        out.find(i)
        for j in range(i):
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                out.join(i, j)
    return out


# Tokens


def tokens_by_hand(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize(("path", "space"), [(token_files.vocabulary(), False), (packing.vocabulary(), True)])
def test_encoder_equals_library(path, space):
    rng = random.Random(1)
    bits = ["a", "B", "é", "ß", "1", "23", "'s", "'", " ", "  ", "\n", "\t", "\x0b", "\x1f", "　", "\xa0", "!", "...", "İ", "Σ", "é", "́", "漢", "<|endoftext|>", "don't", "​", ", ", ". "]
    texts = ["".join(rng.choice(bits + [" "] * 8) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    enc = Encoder(path, space, 7)
    ids, count = enc.encode(pa.array(texts, pa.large_string()))
    want = [x.ids + [7] for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


def test_token_files_round_trip(spark, docs, tmp_path):
    got = sorted(token_files.op3_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, g in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = tokens_by_hand(token_files.vocabulary(), r.text, 2)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_segments_close_at_a_size(spark, docs, tmp_path):
    one, many = ({r.doc_id: tuple(r) for r in token_files.read(saved(token_files.write(docs, f"file://{tmp_path}/{n}", most=n), "manifest"), f"file://{tmp_path}/{n}").collect()} for n in (1 << 20, 7))
    assert one == many and len(list((tmp_path / "7").glob("*.tids"))) >= docs.count() / 7
    for path in (tmp_path / "7").glob("*.tids"):
        assert len(token_files.Segment(*token_files.file_system(f"file://{tmp_path}/7"), path.name)) <= 7


def test_token_files_odd(spark, odd, none, tmp_path):
    from pyarrow import fs

    folder = f"file://{tmp_path}/files"
    manifest = saved(token_files.write(odd, folder), "manifest")
    got = token_files.read(manifest, folder).collect()
    assert len(got) == len(ODD) and sum(g.doc_id is None for g in got) == 1
    assert next(g for g in got if g.doc_id == 1).n_tokens == 1
    system, top = fs.FileSystem.from_uri(folder)
    segment = token_files.Segment(system, top, manifest.orderBy("segment").first().file)
    assert len(segment.ids(0)) == segment.count[0]  # one document without reading the rest
    (next(p for p in (tmp_path / "files").iterdir() if p.name.startswith("dictionary"))).write_bytes(b"other")
    with pytest.raises(ValueError):
        token_files.Segment(system, top, manifest.first().file)
    empty = saved(token_files.write(none, f"file://{tmp_path}/none"), "manifest")
    assert token_files.read(empty, f"file://{tmp_path}/none").count() == 0


# Packing


def check_packing(pieces, texts, length=packing.LENGTH):
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    for i, text in texts.items():
        ids, at = tokens_by_hand(packing.vocabulary(), text, 0), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for k, ps in by_window.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == max(by_window) and at < length
    assert sorted(by_window) == list(range(len(by_window)))
    return by_window


def test_packing(spark, docs):
    pieces = packing.op4_pack(spark, SF).collect()
    windows = check_packing(pieces, {r.doc_id: r.text for r in docs.collect()})
    totals = collections.Counter()
    for p in pieces:
        totals[p.source] += p.length
    grand = sum(totals.values())
    for k, ps in windows.items():
        own = collections.Counter()
        for p in ps:
            own[p.source] += p.length
        if k < max(windows):
            assert all(abs(own[s] - 1024 * n / grand) < 2.5 for s, n in totals.items())


def test_packing_weights_and_odd(spark, odd, none):
    rows = odd.where("doc_id IS NOT NULL AND doc_id <> 6")
    pieces = packing.pack(rows, weights={None: 1, "s": 2, "t": 3}).collect()
    check_packing(pieces, {i: t for i, t, _, _ in ODD if i not in (None, 6)})
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == sum(len(tokens_by_hand(packing.vocabulary(), t, 0)) for _, t, _, _ in ODD)
    assert packing.pack(none).count() == 0


def test_packing_many_sources(spark, docs):
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "large").otherwise(F.col("doc_id").cast("string")).alias("source"))
    pieces = packing.pack(rows, length=64).collect()
    windows = check_packing(pieces, {r.doc_id: r.text for r in rows.collect()}, 64)
    assert len({p.source for p in pieces}) > packing.MANY
    share = sum(p.length for p in pieces if p.source == "large") / sum(p.length for p in pieces)
    assert all(abs(sum(p.length for p in ps if p.source == "large") - 64 * share) < 2.5 for k, ps in windows.items() if k < max(windows))


def test_packing_needs_all_weights(spark, odd):
    with pytest.raises(ValueError, match="no weight for source"):
        packing.pack(odd, weights={"s": 2, "t": 3})


def test_given_is_a_growing_prefix():
    rng = random.Random(2)
    for _ in range(50):
        totals = [rng.randint(1, 40) for _ in range(rng.randint(1, 6))]
        weights = [rng.randint(1, 9) for _ in totals]
        order = sorted(((2 * k + 1) / (2 * w), s) for s, (t, w) in enumerate(zip(totals, weights, strict=True)) for k in range(t))
        for n in range(sum(totals) + 1):
            have = collections.Counter(s for _, s in order[:n])
            got = packing.given(n, totals, weights)
            assert sum(got) == n and all(abs(got[s] - have[s]) <= 1 for s in range(len(totals)))


def test_rounds_with_tiny_queues():
    quotas = np.array([[5000, 1, 1, 1, 2, 3000, 1], [7, 0, 0, 0, 0, 0, 0]])
    got = packing.rounds(quotas, 64)
    assert (np.diff(got, axis=1) >= 0).all() and (got[:, -1] == quotas).all()
    assert (np.diff(got, axis=1).sum(2)[0] == np.minimum(64, 8006 - 64 * np.arange(126))).all()


# Sharding, components


def test_sharding(spark):
    g = sharding.op2_shard(spark, SF).toPandas()
    sizes = g.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in g.groupby("shard").slot)
    assert (g.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()


def test_sharding_cut(spark):
    """Of links that can all be kept nearly all are; of random ones more than without moves. Rounds end by themselves."""
    rng = random.Random(9)
    n, shards = 480, 4
    nodes = saved(spark.range(n).toDF("id"), "nodes")

    def uncut(groups):
        rows = [(i, k) for k, g in enumerate(groups) for i in g]
        got = {r.id: r.label for r in sharding.propagate(nodes, saved(spark.createDataFrame(rows, "id long, key long"), "links"), shards).collect()}
        sizes = collections.Counter(got.values())
        assert len(got) == n and max(sizes.values()) - min(sizes.values()) <= 1
        pairs = [(a, b) for g in groups for a in g for b in g if a < b]
        return sum(got[a] == got[b] for a, b in pairs) / len(pairs)

    ids = rng.sample(range(n), n)
    assert uncut([ids[i : i + 3] for i in range(0, 240, 3)]) >= 0.95  # half the documents are linked by threes
    assert uncut([rng.sample(range(n), 2) for _ in range(400)]) > 0.35  # by chance: 0.25


def test_sharding_hot_group(spark):
    """A group of a third of all rows takes about a third of the shards; the others stay whole."""
    n = 1200
    nodes = saved(spark.range(n).toDF("id"), "nodes")
    links = nodes.where("id < 600").select("id", F.when(F.col("id") < 400, F.lit(-1)).otherwise(F.floor(F.col("id") / 4)).cast("long").alias("key"))
    got = {r.id: r.label for r in sharding.propagate(nodes, links).collect()}
    count = collections.Counter(got.values())
    assert max(count.values()) - min(count.values()) <= 1 and len(got) == n
    split = sum(len({got[i] for i in range(k, k + 4)}) > 1 for k in range(400, 600, 4))
    assert split <= 2


@pytest.mark.parametrize("part", [0.6, 0.75, 0.9])
def test_sharding_group_below_a_shard(spark, part):
    """A group of more than half a shard stays whole where other documents can make room."""
    n, size = 1600, int(100 * part)
    nodes = saved(spark.range(n).toDF("id"), "nodes")
    links = nodes.where(f"id < {size}").select("id", F.lit(-1).cast("long").alias("key"))
    got = {r.id: r.label for r in sharding.propagate(nodes, links).collect()}
    assert set(collections.Counter(got.values()).values()) == {100}
    assert len({got[i] for i in range(size)}) == 1


def test_sharding_odd(spark, odd, none, tmp_path):
    for df, n in ((odd, len(ODD)), (none, 0)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        g = sharding.op2_shard(spark, str(tmp_path)).toPandas()
        assert len(g) == n and all(sorted(x) == list(range(len(x))) for _, x in g.groupby("shard").slot)
        assert set(g.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (1, 0)]
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets)}


# SimHash


def test_fingerprint_by_hand():
    import xxhash

    text = "One  two THREE four\tfive one two three"
    w = "one two three four five one two three".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(6)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") & (2**64 - 1) == xxhash.xxh64_intdigest("a b", 42)


@pytest.mark.parametrize("long", [64, 4])
def test_links_of_fingerprints(spark, long):
    """Random fingerprints and a dense cloud, also with lists so short that all are taken as long."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)} | {base[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    sets = Sets()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                sets.join(a, b)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, long=long)).collect()}
    assert got == {x: sets.find(x) for x in list(sets)}


def test_candidates_of_fingerprints(spark):
    """In the pipeline a fingerprint's list is its component within 2 bits: sharing four bytes of the index isn't enough."""
    base = 0x0123456789ABCDEF
    fps = {1: base, 2: base ^ 3, 3: base ^ 3 << 4 ^ 3, 4: base ^ 0xF00, 5: base, 6: base ^ 0xFFFF << 16}
    out = simhash.linked(spark.createDataFrame(list(fps.items()), "key long, fp long")).collect()
    lists = {}
    for r in out:
        lists.setdefault(bytes(r.bands), set()).add(r.key)
    assert sorted(map(sorted, lists.values())) == [[1, 2, 3, 5], [4], [6]] and {len(b) for b in lists} == {8}


def test_simhash_query(spark, docs):
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, SF).collect()}
    rows = docs.collect()
    fp = {r.doc_id: simhash.fingerprint(r.text or "") & (2**64 - 1) for r in rows}
    sets = Sets()
    for a in fp:
        sets.find(a)
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                sets.join(a, b)
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == sets.find(i) for i, f in fp.items())


def test_results_outlive_later_stages(spark, odd, tmp_path):
    """A stage's result can be read after other stages began, and a run's after another run."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = [stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES]
    again = [stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES]
    assert [a.count() for a in first] == [b.count() for b in again]
    runs = [corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2)]
    assert sorted(map(tuple, runs[0].collect())) == sorted(map(tuple, runs[1].collect()))


def test_near_duplicate_stage(spark, docs, odd, none):
    rows = docs.orderBy("doc_id").collect()
    sets = near_sets([simhash.shingle_set(r.text or "") for r in rows])
    want = {rows[i].doc_id for i in range(len(rows)) if sets.find(i) == i}
    assert {r.doc_id for r in simhash.stage(spark, docs, SF).collect()} == want
    out = simhash.stage(spark, odd, SF)
    assert out.columns == odd.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 4, 5, 6, 8, 9, 10, 11]
    assert simhash.stage(spark, none, SF).count() == 0


# Lines


def by_hand(rows):
    """Kept (doc, line) pairs."""
    occ = [(i, k, lines.normalised(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if lines.normalised(x)]
    names = sorted({o[2] for o in occ})
    sets = near_sets([lines.shingles(x) for x in names])
    place, seen, kept = {x: i for i, x in enumerate(names)}, set(), set()
    for i, k, x in occ:
        root = sets.find(place[x])
        if root not in seen:
            seen.add(root)
            kept.add((i, k))
    return kept


def test_line_dedup(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    want = by_hand([(r.doc_id, r.text) for r in rows.orderBy("doc_id").collect()])
    numbered = saved(rows.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text"), "rows")
    got = {(r.doc_id, r.line_no) for r in lines.classed(numbered).where("kept").collect()}
    assert got == want


def near_by_prefixes(sets, similarity=0.8):
    """As near_sets, for many sets: of two that are near, the rarest members of both up to a bound share one."""
    often = collections.Counter(x for s in sets for x in s)
    out, at = Sets(), collections.defaultdict(list)
    for i, s in enumerate(sets):
        out.find(i)
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(similarity * len(s)) + 1]
        for j in {j for x in first for j in at[x]}:
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                out.join(i, j)
        for x in first:
            at[x].append(i)
    return out


def test_prefixes_lose_no_pair():
    rng = random.Random(4)
    sets = [frozenset(rng.sample(range(30), rng.randint(1, 12))) for _ in range(300)]
    a, b = near_sets(sets), near_by_prefixes(sets)
    assert [a.find(i) for i in range(300)] == [b.find(i) for i in range(300)]


def test_op5(spark, docs):
    """The whole query: components and the line kept of each."""
    rows = [(r.doc_id, k, lines.normalised(x)) for r in docs.orderBy("doc_id").collect() for k, x in enumerate((r.text or "").split("\n"))]
    rows = [r for r in rows if r[2]]
    names = sorted({x for _, _, x in rows})
    sets, place = near_by_prefixes([lines.shingles(x) for x in names]), {x: i for i, x in enumerate(names)}
    want, first = collections.defaultdict(set), {}
    for i, k, x in rows:
        root = sets.find(place[x])
        want[root].add((i, k))
        first.setdefault(root, (i, k))
    got, kept = collections.defaultdict(set), set()
    for r in lines.op5_line_dedup(spark, SF).collect():
        got[r.component].add((r.doc_id, r.line_no))
        if r.kept:
            kept.add((r.doc_id, r.line_no))
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))
    assert kept == set(first.values())


def edited_lines(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base, out = [rng.choice(words) for _ in range(25)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(25)] = rng.choice(words)
        out.append((i, i, " ".join(w)))
    return out


def test_long_lists(spark, monkeypatch):
    """Edited copies of one line, with lists cut into many small blocks."""
    monkeypatch.setattr(minhash, "LONG", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = edited_lines(3)
    got = {(r.doc_id, r.line_no) for r in lines.classed(spark.createDataFrame(rows, "row_no long, doc_id long, text string")).where("kept").collect()}
    assert got == by_hand([(i, t) for _, i, t in rows])


def test_line_stage_odd(spark, odd, none):
    out = {r.doc_id: r.text for r in lines.stage(spark, odd, SF).where("doc_id IS NOT NULL AND doc_id <> 6").collect()}
    assert out[1] is None and out[2] == "" and out[3] == " \n\t " and out[7] == "" and out[11].startswith("a\n\nb\n")
    assert lines.stage(spark, odd, SF).columns == odd.columns
    assert [r.text for r in lines.stage(spark, odd, SF).where("doc_id = 6").orderBy("text").collect()] == ["", "same text here for all"]
    assert lines.stage(spark, none, SF).count() == 0


def test_recall_of_bands():
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(400)]
    twins = [np.concatenate([s[:90], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for s in sets]  # Jaccard 0.82
    a, b = (minhash.bands(np.concatenate(x), np.full(400, 100)) for x in (sets, twins))
    assert (a == b).any(1).mean() >= 0.98


# Rules, licenses, benchmark


def test_quality_verdicts(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() >= 0.995 and (~bad.kept).mean() >= 0.7


def test_quality_odd(spark, odd, none):
    rows = {r.doc_id: r for r in quality.with_verdict(saved(quality.measured(odd.select("doc_id", "text", "lang", "source")), "q")).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[5].n_repeat_words == rows[5].n_words == 40000 and rows[10].word_chars == 108
    assert quality.stage(spark, odd, SF).columns == odd.columns and quality.stage(spark, none, SF).count() == 0


def test_licenses_odd(odd, none):
    got = {(r.doc_id, r.unit): r for r in licenses.scan(odd).collect()}
    assert got[(8, "line")].license == "MIT/line" and got[(11, "block")].license == "MIT"
    # the line with the two words after it is a block of 6 bigrams, 4 of them the template's: 2 * 4 / (6 + 4) = 0.8
    assert got[(8, "block")].license == "MIT/line" and len(got) == 3
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("d", [SF, "/root/testdata/sf0.01"])
def test_rights_lines(spark, d):
    """Every licence or rights line of the tables is reported."""
    known = r"(?i)^(all rights reserved\.|(this work is )?licensed under .*|released under the mit license\.)$"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").distinct()
    want = {(r.doc_id, r.unit_no) for r in docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_no", "body")).where(F.col("body").rlike(known)).collect()}
    got = {(r.doc_id, r.unit_no): r.license for r in licenses.scan(docs).where("unit = 'line'").collect()}
    assert want and want <= got.keys() and "Reserved/short" in got.values()


def runs_by_hand(text):
    """(first, last, license) of the runs of blocks that have rows, by comparing all runs with all templates."""
    blocks, close = re.split(r"\n[ \t-\r]*\n", text), {}
    pairs = lambda s: {(a, b) for w in [[x for x in re.split("[^a-z0-9]+", s.lower()) if x]] for a, b in zip(w, w[1:])}
    known = {name: pairs(body) for name, body in licenses.TEMPLATES.items()}
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            unit = pairs("\n\n".join(blocks[i : j + 1]))
            score, name = min((-len(unit & t) / (len(unit) + len(t)), name) for name, t in known.items())
            if unit and score <= -0.4:
                close[i, j, name] = score
    first = {min((k for k in close if k[::2] == (i, name)), key=lambda k: (close[k], k[1])) for i, _, name in close}
    best = {min((k for k in first if k[1:] == (j, name)), key=lambda k: (close[k], -k[0])) for _, j, name in first}
    return {k for k in best if k[0] < k[1]}


def test_license_needed_words():
    """Without the needed words of a template fewer of its bigrams are left than a run needs."""
    bigrams = {}
    for name, body in licenses.TEMPLATES.items():
        w = re.findall("[a-z0-9]+", body.lower())
        bigrams[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
    for threshold in (50, 80, 100):
        words = set(licenses.needed_words(bigrams, threshold))
        for pairs in bigrams.values():
            left = [p for p in pairs if not words & set(p.split())]
            assert len(left) * (200 - threshold) < len(pairs) * threshold


def test_license_in_paragraphs(spark):
    """Licenses in their usual layout, alone, within other text, twice, and next to each other."""
    cut = lambda t, *starts: re.sub("|".join(f" (?={re.escape(s)})" for s in starts), "\n\n", t)
    texts = licenses.TEMPLATES
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + cut(MIT, "The above", "THE SOFTWARE IS")
    apache = cut(texts["Apache-2.0"], "Unless required", "you may not")
    gpl = cut(texts["GPL-3.0"], "This program is distributed", "You should have")
    rest = "Some words before.\n\nAnd of the rest\nof the file.\n \t\nmore"
    rows = [mit, apache, gpl, f"{rest}\n\n{mit}\n\n{rest}", f"{mit}\n\n{rest}\n\n{mit}", f"{mit}\r\n\r\n{apache}\n\n{gpl}", rest, "Released under\n\nthe MIT License.", texts["BSD-3-Clause"], texts["BSD-2-Clause"], texts["Unlicense"], texts["LGPL-3.0"]]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(rows)] * 2, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.unit_no, r.license) for r in licenses.scan(docs).where("unit = 'run'").collect())
    want = {(None if i == 3 else i, first, name) for i, t in enumerate(rows) for first, _, name in runs_by_hand(t)}
    assert set(got) == want and set(got.values()) == {2}  # rows equal in id and text, one by one
    assert {(0, "MIT"), (1, "Apache-2.0"), (2, "GPL-3.0"), (None, "MIT"), (5, "MIT"), (5, "Apache-2.0"), (5, "GPL-3.0"), (8, "BSD-3-Clause"), (9, "BSD-2-Clause"), (10, "Unlicense"), (11, "LGPL-3.0")} <= {(i, name) for i, _, name in want} and 6 not in {i for i, _, _ in want}


def test_full_licenses(spark):
    full = sorted(k for k in licenses.TEMPLATES if k.endswith("/full"))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame([(i, licenses.TEMPLATES[k]) for i, k in enumerate(full)], "doc_id long, text string")).where("unit = 'run' AND n_shared = n_template").collect()}
    assert got == {*enumerate(full), (full.index("Apache-2.0/full"), "Apache-2.0"), (full.index("GPL-3.0/full"), "GPL-3.0")}  # both end with their notice


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([("b", "Same TEXT here-for all"), ("c", None), ("d", ""), (None, "word"), ("e", "b c d e f g h a b c d")], "item_id string, text string")
    rows = [r for r in decontaminate.hits(odd, bench).collect()]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and got[6].n_hit == 5 and got[6].n_items == 1 and got[4].contaminated and got[5].n_hit == 39995  # from word 1 to 39995: the last window starts at 39986
    assert not got[1].contaminated and got[1].n_words == 0
    nothing = bench.where("item_id = 'z'")
    assert decontaminate.hits(odd, nothing).where("contaminated").count() == 0
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.stage(spark, odd, SF).columns == odd.columns


TWENTY = " ".join(f"w{i}" for i in range(20))


@pytest.mark.parametrize("ids", [("x", "x"), (None, None), ("x", "y"), (None, "")])
def test_decontamination_items_of_one_id(spark, ids):
    """A long item has no windows of the length of a short one, whatever their ids."""
    bench = spark.createDataFrame([(ids[0], "a b c d e"), (ids[1], TWENTY)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "w3 w4 w5 w6 w7"), (2, "b a b c d e"), (3, f"z {TWENTY[:40]} z"), (4, f"a b c d e {TWENTY}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.hits(docs, bench).collect()}
    both = 2 if ids == ("x", "y") else 1
    assert got == {1: (0, 0, False), 2: (5, 1, True), 3: (12, 1, True), 4: (25, both, True)}


def test_decontamination_stage_keeps_parts_of_items(spark, tmp_path):
    spark.createDataFrame([("x", "a b c d e"), ("x", TWENTY)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "w3 w4 w5 w6 w7"), (2, "a b c d e")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.stage(spark, docs, str(tmp_path)).collect()] == [1]


# Models


@pytest.mark.parametrize("hot", [katz.HOT_TOKENS, 3])
def test_katz_by_hand(spark, docs, monkeypatch, hot):
    """With few contexts spread over the parts, and with nearly all."""
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(katz, "PART_ENTRIES", 50_000)
    got = {r.doc_id: r for r in katz.op8_katz(spark, SF).collect()}
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tok = {r.doc_id: (r.text or "").encode().translate(lower).split() + ["</s>"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c1, c2, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, t in tok.items():
        if not held[i]:
            c1.update(t)
            c2.update(zip(["<s>", *t], t, strict=False))
    for a, b in c2:
        after[a].add(b)
    n, kinds = sum(c1.values()), len(c1)
    d1, d2 = (katz.discounts([sum(x == r for x in c.values()) for r in range(7)]) for c in (c1, c2))
    d = lambda c, ds: ds[c] if c < len(ds) else 1.0
    mass = lambda counts, ds: sum((1 - d(c, ds)) * c for c in counts)
    left = mass(c1.values(), d1)
    below = n if left > 1e-9 else n + 1
    p1 = lambda w: d(c1[w], d1) * c1[w] / below if c1[w] else (left if left > 1e-9 else 1) / below
    memo = {}

    def context(a):
        if a not in memo:
            counts = [c2[(a, b)] for b in after[a]]
            lost = mass(counts, d2)
            under = sum(counts) + (lost <= 1e-9)
            memo[a] = (under, (lost if lost > 1e-9 else 1) / under / (1 - sum(map(p1, after[a])))) if counts else (1, 1.0)
        return memo[a]

    def p2(a, b):
        under, alpha = context(a)
        return d(c2[(a, b)], d2) * c2[(a, b)] / under if c2[(a, b)] else alpha * p1(b)

    for a in ["<s>", b"the", next(iter(after))]:
        assert sum(p2(a, w) for w in c1) + p2(a, b"not a word") == pytest.approx(1, abs=1e-12)
    for i, t in tok.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c1[w] > 0 for w in t), n)
        assert got[i].score == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *t], t, strict=False)), rel=1e-12)
        assert got[i].base_score == pytest.approx(sum(math.log10((c1[w] + 1) / (n + kinds + 1)) for w in t), rel=1e-12)


def test_katz_odd(odd, none):
    rows = katz.score(odd.withColumn("held_out", F.coalesce(F.col("doc_id") == 4, F.lit(False)))).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 1).n_tokens == 1
    assert katz.score(none.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0
    assert all(r.score == 0 for r in katz.score(odd.select("doc_id", "text", F.lit(True).alias("held_out"))).collect())


def test_language(spark, docs):
    got = language.op6_language(spark, SF).toPandas()
    true = docs.select("doc_id", F.col("lang").alias("true_lang"), F.length("text").alias("n")).toPandas()
    held = got.dropna(subset=["doc_id"]).merge(true, on="doc_id")
    assert (held.lang == held.true_lang).mean() >= 0.97
    pages = got.dropna(subset=["page_id"])
    assert len(pages) == 50 and (pages.lang == pages.declared).mean() >= 0.95


def fused_by_hand(rows, k):
    """(best language, its probability) of rows (ll, host, domain, declared, suffix), by loops."""
    soft = []
    for r in rows:
        e = np.exp(np.array(r["ll"]) - max(r["ll"]))
        soft.append(e / e.sum())
    tally = lambda key: {v: sum(p for r, p in zip(rows, soft, strict=True) if key(r) == v) for v in {key(r) for r in rows} - {None}}
    hosts = tally(lambda r: None if r["host"] is None else (r["host"], r["domain"]))
    domains = tally(lambda r: None if r["host"] is None else r["domain"])
    corpus = (sum(soft) + 1) / (len(rows) + k)
    trust = {}
    for name in ("declared", "suffix"):
        seen = tally(lambda r, name=name: r[name])
        all_ = sum(seen.values(), np.zeros(k))
        trust[name] = {v: np.log((n + language.SMOOTH) / (all_ + language.SMOOTH * (len(seen) + 1))) for v, n in seen.items()}
    for r, p in zip(rows, soft, strict=True):
        prior = corpus
        if r["host"] is not None:
            d = domains.get(r["domain"], np.zeros(k))
            parent = (d + language.STRENGTH * corpus) / (d.sum() + language.STRENGTH)
            own = np.maximum(hosts[r["host"], r["domain"]] - p, 0)
            prior = (own + language.STRENGTH * parent) / (own.sum() + language.STRENGTH)
        x = np.array(r["ll"]) + np.log(prior) + sum(trust[n][r[n]] for n in trust if r[n] is not None)
        e = np.exp(x - x.max())
        yield int(x.argmax()), (e / e.sum()).max()


def test_language_by_hand(spark):
    """The query's rows from its tables, by plain Python but for the trigram model."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    names, model = language.fitted(docs)
    rows = [{"id": (r.doc_id, None), "text": r.text or "", "declared": None, "suffix": None, "host": r.source, "domain": None} for r in docs.collect()]
    for r in spark.read.parquet(SF + "/pages.parquet").collect():
        host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url.lower())[1]
        text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", r.html)
        said = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", r.html.lower())
        parts = host.split(".")
        rows.append({"id": (None, r.page_id), "text": re.sub(r"&[#A-Za-z0-9]{1,10};", " ", text), "declared": said and said[1], "suffix": parts[-1] if len(parts) > 1 else None, "host": host, "domain": ".".join(parts[-2:]) if len(parts) > 1 else None})
    for r in rows:
        r["ll"] = model[language.cells(r["text"])].sum(0, dtype=float) * language.TEMPER
    want = {r["id"]: found for r, found in zip(rows, fused_by_hand(rows, len(names)), strict=True)}
    got = language.op6_language(spark, SF).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        best, sure = want[r.doc_id, r.page_id]
        assert r.lang == names[best] and abs(r.confidence - sure) < 1e-4


def test_language_by_hand_mixed(spark):
    """Texts that say little, so that hosts, domains, declarations and suffixes decide; nulls in each."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = rng.choice([None, "a.x.org", "b.x.org", "c.y.de", "d.z.fr", "local"])
        rows.append({"i": i, "ll": [rng.gauss(0, 1) + (2 if host and host.endswith(("org", "de", "fr")[j]) else 0) for j in range(3)], "host": host, "domain": host[2:] if host and "." in host else None, "declared": rng.choice([None, "p", "q", "r"]), "suffix": rng.choice([None, "org", "de"])})
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "i long, ll array<double>, host string, domain string, declared string, suffix string")
    got = {r.i: r for r in language.fused(frame, ["p", "q", "r"]).collect()}
    for r, (best, sure) in zip(rows, fused_by_hand(rows, 3), strict=True):
        assert got[r["i"]].lang == "pqr"[best] and abs(got[r["i"]].confidence - sure) < 1e-5


def test_language_held_out(spark):
    """Fitted on one half of the labels, tested on the other."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, model = language.fitted(d.where("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    rows = d.where("doc_id % 2 = 1").select("doc_id", "text", F.col("lang").alias("true_lang"), none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    got = language.fused(language.likelihoods(rows, model), names).toPandas()
    assert (got.lang == got.true_lang).mean() >= 0.97


def test_language_rare(spark, monkeypatch):
    """Languages with one long text, with few rows and with one id, beside many rows without a label."""
    monkeypatch.setattr(language, "TRAIN_ROWS", 40)
    rows = [(i, f"the word and number {i} of this", "en" if i % 100 == 0 else None) for i in range(20_000)]
    rows += [(-1, "zag zog zug " * 3000, "xx"), (-2, "kel kol kul", "yy"), *[(None, f"mip map mop {i}", "zz") for i in range(400)], *[(-3, None, "aa")]]
    names, model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["aa", "en", "xx", "yy", "zz"] and model.shape == (language.CELLS, 5)
    for name, text in {"en": "the word of this", "xx": "zag zog zug", "yy": "kel kol kul", "zz": "mip map mop"}.items():
        assert names[model[language.cells(text)].sum(0).argmax()] == name


def test_language_odd(odd, none):
    n = F.lit(None).cast("string")
    rows = odd.withColumns({"declared": n, "suffix": n, "host": F.col("source"), "domain": n})
    names, model = language.fitted(odd)
    out = language.fused(language.likelihoods(rows, model), names)
    assert sorted(out.columns) == sorted(set(rows.columns) - {"text", "ll"})
    got = out.collect()
    assert len(got) == len(ODD) and all(r.lang in names and r.p0 == "p0" and r.best == "best" for r in got)
    names, model = language.fitted(none)
    assert names == [] and language.fused(language.likelihoods(rows, model), names).where("lang IS NOT NULL").count() == 0


# Pipeline


def test_pipeline(spark, docs):
    """Each stage's rows against brute force on its own input."""
    now, bench = docs, spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, now, SF), name)
        before, after = now.collect(), out.collect()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.op7_quality_rules(spark, SF).where("kept").collect()}
            assert {r.doc_id for r in after} == kept
        elif name == "line_dedup":
            want = by_hand([(r.doc_id, r.text) for r in sorted(before, key=lambda r: r.doc_id)])
            texts = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if not lines.normalised(x) or (r.doc_id, k) in want) for r in before}
            assert {r.doc_id: r.text for r in after} == texts
        elif name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: r.doc_id)
            sets = near_sets([simhash.shingle_set(r.text or "") for r in rows])
            assert {r.doc_id for r in after} == {rows[i].doc_id for i in range(len(rows)) if sets.find(i) == i}
        elif name == "decontaminate":
            words = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()
            grams = {tuple(w[i : i + min(10, len(w))]) for r in bench for w in [words(r.text)] for i in range(max(1, len(w) - 9))}
            sizes = {len(g) for g in grams}
            hit = {r.doc_id for r in before for w in [words(r.text)] if any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit
        else:
            check_packing(after, {r.doc_id: r.text for r in before})
            break
        assert out.columns == docs.columns
        now = out


def left(spark):
    from pathlib import Path

    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir()}


@pytest.mark.parametrize("name", ["pipeline", "op7_quality_rules", "op9_simhash"])
def test_tables_go_with_their_owner(spark, name):
    """The tables that a result reads go at the end of the owner around it; without one nothing else stays."""
    from tidemark.llm.common import owned
    from tidemark.llm.queries import QUERIES

    query, before = corpus_pipeline.run if name == "pipeline" else QUERIES[name], left(spark)
    with owned(spark):
        assert query(spark, SF).count() > 0
    assert left(spark) <= before
    out = query(spark, SF)
    assert {n for n in left(spark) - before if n not in {f[: f.rindex("/")].rsplit("/", 1)[-1] for f in out.inputFiles()}} == set()
    assert out.count() > 0
