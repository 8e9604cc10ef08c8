"""Fingerprints, conversation repair and clustering against brute force, and on nulls, empty and long values, ties,
repeats, no rows and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import clusters, repair, weighted
from tidemark.llm.common import saved

SF = "/root/testdata/sf0.001"


# Fingerprints


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_terms_are_counted_shingles():
    for text in ["", " \n", "one", "A b a B", "a b c d e f", "x y z x y z x y z x y z", "é à " * 9, "w " * 50_000]:
        h, count = weighted.terms(text)
        want = shingles(text)
        assert sorted(count.tolist()) == sorted(want.values()) and len(set(h.tolist())) == len(want)
    assert weighted.terms("A B c d e")[0] == weighted.terms(" a\tb C D\nE")[0] and weighted.terms("a b")[0] != weighted.terms("b a")[0]


def test_words_of_pieces(monkeypatch):
    text = "Some words, ünd längere wörter; " * 30
    whole = weighted.word_hashes(text.encode())
    monkeypatch.setattr(weighted, "SPAN", 11)
    assert (weighted.word_hashes(text.encode()) == whole).all()


def test_blocks_give_the_same_samples(monkeypatch):
    texts = [weighted.terms(" ".join(f"w{(i * i) % m}" for i in range(n))) for n, m in [(900, 50), (0, 1), (7, 3), (2000, 2000)]]
    whole = weighted.fingerprints(texts)
    for block in (1, 100):
        monkeypatch.setattr(weighted, "BLOCK", block)
        assert (weighted.fingerprints(texts) == whole).all()
    # one term at a time, the least of all draws
    h, count = texts[0]
    least = np.min([weighted.drawn(h[i : i + 1], count[i : i + 1], np.zeros(1, np.int64))[0] for i in range(len(h))], axis=0)
    assert (least.astype(np.uint16) == whole[0]).all() and not whole[1].any()


def test_samples_agree_as_often_as_the_coefficient():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(200):
        h, a = rng.integers(0, 1 << 63, 40, dtype=np.uint64), rng.integers(0, 6, 40)
        b = np.where(rng.random(40) < 0.6, a, rng.integers(0, 6, 40))
        x, y = weighted.fingerprints([(h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])])
        off.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015  # 4 standard errors


def compared_by_hand(rows):
    out = []
    for (i, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, text, following))
    return out


def test_op11(spark):
    got = {r.doc_id: r for r in weighted.op11_fingerprints(spark, SF).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = weighted.fingerprints([weighted.terms(t) for _, t in rows])
    off = []
    for (i, n, sha, edited, text, following), own in zip(compared_by_hand(rows), prints, strict=True):
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (n, sha, own.astype(">u2").tobytes().hex())
        assert r.edited_fingerprint == weighted.fingerprints([weighted.terms(edited)])[0].astype(">u2").tobytes().hex()
        off += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, following)]
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.35
    for text, group in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        assert len({got[i].fingerprint for i, _ in group}) == 1


@pytest.mark.parametrize("parts", ["1", "4"])
def test_fingerprints_odd(spark, parts):
    texts = [(3, "A b c d e f g h"), (None, "no id"), (1, None), (2, ""), (4, "word"), (4, "word"), (5, "ü漢字 😀 " * 3), (6, "long word " * 60_000), (7, "\n\t "), (8, "a" * 100_000)]
    docs = saved(spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, edge string, part int"), "odd")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = weighted.pairs(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0]))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((x[0] or -1, *x[1:3]) for x in compared_by_hand(rows))
    found = {r.doc_id: r for r in got}
    assert not any(found[1].fp) and not any(found[2].fp) and not any(found[7].fp) and any(found[4].fp)
    assert found[1].near_next == 1.0 and found[2].near_next == 0.0  # no terms: like another such text, unlike all others
    assert weighted.pairs(docs.where("false")).collect() == []
    [one] = weighted.pairs(docs.where("doc_id = 3")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"A b c d A b c d"[:8] + b"A b c d").hexdigest()


# Conversation repair


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest_by_hand(turns):
    """By trying all edits, with at most two inserts in a place."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", ())}

    def put(new, state, cost, audit, lines):
        if state is not None and (state not in new or (cost, audit) < new[state][:2]):
            new[state] = (cost, audit, lines)

    def inserts(best):
        for _ in range(3):
            new = dict(best)
            for s, (c, a, x) in best.items():
                role = "assistant" if s == 2 else "user"
                put(new, step[role[0]].get(s), c + 5, a + "I", (*x, f"{role}:"))
            best = new
        return best

    seen = set()
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        gone = not body or (role, text) in seen
        seen.add((role, text))
        more, new = 5 * (not gone and body[-1] not in ".!?"), {}
        for s, (c, a, x) in inserts(best).items():
            put(new, s, c + 2, a + "D", x)
            if not gone:
                put(new, step.get(role[:1], {}).get(s), c + more, a + "K", (*x, f"{role}:{text}"))
                for to in ("user", "assistant"):
                    put(new, step[to[0]].get(s), c + 1 + more, a + "R", (*x, f"{to}:{text}"))
        best = new
    return min(v for s, v in inserts(best).items() if s in (0, 3))


def repaired_by_hand(rows):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in damaged_by_hand(rows):
        groups[conv].append(tuple(rest))
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        nos = {t[0] for t in turns} - {None}
        counts, seen = collections.Counter(), set()
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            counts["blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""] += 1
            seen.add((role, text))
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest_by_hand([t[1:] for t in turns])
        out.append((conv, max(nos) - min(nos) + 1 - len(nos) if nos else 0, counts["blank"], counts["dup"], counts["cut"], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(repair.op12_repair(spark, SF)) == repaired_by_hand(rows)


@pytest.mark.parametrize(("most", "piece"), [(2048, 1024), (3, 1), (0, 2), (5, 7)])
def test_repair_odd(spark, most, piece):
    """Whole, and in pieces."""
    rng, roles, texts = np.random.default_rng(7), ["user", "assistant", "system", "tool", "", None, "Speaker", "ua"], ["Hi.", "Oh", "", " \t", None, "What?\n", "Hi.", "x" * 20_000]
    rows = [(int(c), None if t == 9 else int(t), roles[r], texts[x]) for c, t, r, x in zip(rng.integers(0, 60, 500), rng.integers(0, 10, 500), rng.choice(8, 500, p=[0.3, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]), rng.integers(0, 8, 500), strict=True)]
    rows += [(None, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(40)] + [(None, None, "user", "No turn")] * 3 + [(77, i // 3, "user", "Same.") for i in range(30)]
    rows += [(-c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(f"{-c}:0".encode()) % 20 == 0][:2]  # conversations whose only turn goes
    data = saved(spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "conv_id long, turn long, role string, text string, key string, times int, fault string"), "conversations")
    assert collected(repair.repair(repair.damaged(data), most, piece)) == repaired_by_hand(rows)
    assert repair.repair(repair.damaged(data.where("false")), most, piece).collect() == []


def test_one_long_conversation(spark):
    """A conversation far longer than a piece."""
    rows = [(1, i, ["user", "assistant", "user", "tool"][i % 4], f"Turn {i % 900}" + "." * (i % 7 > 0)) for i in range(3000)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(repair.repair(repair.damaged(data), 100, 64)) == repaired_by_hand(rows)


# Clusters


def clustered_by_hand(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(means))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        means = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(means)]
    found = [(i, *near(x)) for i, x in kept]
    total = collections.Counter()
    for _, d, c in found:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def test_op13(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(150).collect()]
    data = saved(spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, x int"), "vectors")
    assert collected(clusters.cluster(data)) == clustered_by_hand(rows)


def test_clusters_odd(spark):
    rng = np.random.default_rng(3)
    some = [(i, rng.normal(size=64).round(3).tolist()) for i in range(20)]
    rows = [*some, (3, some[3][1]), (3, [0.5] * 64), (None, [0.25] * 64), (30, None), (31, [1.0] * 63), (32, [1.0] * 63 + [None]), (33, [float("nan")] + [1.0] * 63), (34, [float("inf")] + [1.0] * 63), (35, [1e5, -2e5] * 32), (36, [2e6] + [0.0] * 63)]
    data = saved(spark.createDataFrame([(i, e, "c", "n") for i, e in rows], "vec_id long, embedding array<double>, cluster string, norms string"), "vectors")
    assert collected(clusters.cluster(data)) == clustered_by_hand(rows)
    assert collected(clusters.cluster(data, centroids=4, rounds=2)) == clustered_by_hand(rows, 4, 2)
    assert clusters.cluster(data.where("false")).collect() == []
    with pytest.raises(Exception, match="(?i)overflow|too large|int64"):
        clusters.cluster(spark.createDataFrame([(1, [1e12] + [0.0] * 63), (2, [0.0] * 64)], "vec_id long, embedding array<double>"), centroids=1, rounds=1).collect()


def test_screening_spares_distances():
    """Groups of vectors around far centres need about one exact distance each; the result is that of all."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * np.repeat(rng.gamma(1, 2, (40, 16)), 4, axis=1)
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 0.05)).astype(np.int64)
    label, best, needed = clusters.nearest(x, clusters.norms(x), c := np.floor(256 * centres).astype(np.int64))
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and needed < 2 * len(x)
