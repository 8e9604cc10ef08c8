"""MinHash bands over sets of 64-bit shingle hashes, and the verified links of items that share a band.

Banding: 13 bands of 5 rows; two items of Jaccard 0.8 share a band with probability 0.994, of 0.9 with 0.99999.
A band shared by different items makes a list. Its smallest item is the pivot: every other member is verified
against it, and only members that fail are verified against the rest of the list, in long lists as a query set by
blocks; members that pass are connected through the pivot already. So a list of m near copies costs m verifications,
and no verified link between two members that the pivot does not connect is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.encode import relax

BANDS, ROWS, SIMILARITY = 13, 5, 0.8
#: A list longer than LONG compares its failing members with the others by blocks of BLOCK.
LONG, BLOCK = 32, 1024
#: Bands in a packed load, and about as many in a part.
PART = 1_000_000
#: Bits of the filters that spare shuffling rows which surely match nothing; the joins after them are exact.
LEAST_BITS, MOST_BITS = 24, 28
_rng = np.random.default_rng(20_240_501)
_ODD = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)).astype(np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bands(hashes: np.ndarray, count: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """[items, BANDS] signed 64-bit band keys; hashes: the items' shingle hashes one after another, count > 0 each."""
    ends = np.cumsum(count)
    least = np.empty((BANDS * ROWS, len(count)), np.uint32)
    at = 0
    while at < len(count):  # whole items, about a cache's worth of hashes at a time
        first = int(ends[at] - count[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + block, "right")))
        low = mixed(hashes[first : int(ends[upto - 1])]).astype(np.uint32)
        starts = ends[at:upto] - count[at:upto] - first
        y = np.empty_like(low)
        for k in range(BANDS * ROWS):
            np.multiply(low, _ODD[k], out=y)
            np.minimum.reduceat(y, starts, out=least[k, at:upto])
        at = upto
    out = np.empty((len(count), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(count), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        out[:, b] = key.view(np.int64)
    return out


def bitset(keys: DataFrame, column: str) -> np.ndarray:
    """A filter with some eight bits for each key, between 2**LEAST_BITS and 2**MOST_BITS (32 MB) in all: bit (key mod its size)
    is set for each key. What it can't rule out the joins after it do."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
    word = F.col(column).bitwiseAND(F.lit(size - 1))
    rows = keys.groupBy(F.shiftright(word, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("b")).toArrow()  # size / 64 rows at most
    out = np.zeros(size >> 6, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def passing(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & ((len(filter_) << 6) - 1)
    return (filter_[at >> 6] >> (at & 63)) & 1 == 1


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the 64-bit numbers in a column of binaries, one after another, and how many each row has; null: none)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.int64, int(offsets[-1] - offsets[0]) // 8, int(offsets[0])), np.diff(offsets) // 8


def ends_of_runs(band: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each band once, ascending, its smallest key, its largest)."""
    order = np.argsort(band)
    band, key = band[order], key[order]
    starts = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else np.zeros(0, np.int64)
    return band[starts], *((f.reduceat(key, starts) if len(starts) else key) for f in (np.minimum, np.maximum))


def shared_bands(signed: DataFrame) -> DataFrame:
    """(band) of the bands that different keys have. Bands go to the parts of their range in packed rows, a task's
    equal bands as their smallest and largest key alone: so there are never more rows than bands, and a band of any
    frequency is two entries of a task's load."""
    n = signed.agg(F.sum(F.length("bands") / 8)).first()[0] or 0
    parts = max(1, math.ceil(n / PART))
    edges = np.linspace(-(2.0**63), 2.0**63, parts + 1)[1:-1].astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def load() -> pa.RecordBatch:
            band, low, top = ends_of_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            more = np.flatnonzero(low != top)
            band, key = np.concatenate([band, band[more]]), np.concatenate([low, top[more]])
            part = np.searchsorted(edges, band, "right")
            order = np.argsort(part, kind="stable")
            real, starts = np.unique(part[order], return_index=True)
            cut = [x.tolist() for x in (starts, np.append(starts[1:], len(part)))]
            packed = [pa.array([x[order[i:j]].tobytes() for i, j in zip(*cut, strict=True)], pa.binary()) for x in (band, key)]
            return pa.RecordBatch.from_arrays([pa.array(real, pa.int64()), *packed], names=["part", "band", "key"])

        for batch in batches:
            flat, per = unpacked(batch.column(1))
            held.append((flat, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), per)))
            size += len(flat)
            if size >= PART:
                yield load()
                held, size = [], 0
                relax()
        if size:
            yield load()
            held = []
        relax()

    def both(group: pa.Table) -> pa.Table:
        band, low, top = ends_of_runs(*(np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("band", "key")))
        out = pa.table({"band": band[low != top]})
        del band, low, top
        relax()
        return out

    return signed.select("key", "bands").mapInArrow(send, "part long, band binary, key binary").groupBy("part").applyInArrow(both, "band long")


def lists(signed: DataFrame) -> DataFrame:
    """(band, key, n, pivot) of the lists, a band for each: the bands shared by different keys, of those with the same
    members one. signed: (key long, bands binary: 64-bit numbers, or null); n: a list's members.

    A list's pivot is the member with the longest lists in all: the original of a group of edited copies is in
    nearly every list of the group, and nearer to each copy than the copies are to each other."""
    signed = signed.where("bands IS NOT NULL")
    shared = saved(shared_bands(signed), "shared-bands")
    likely = signed.sparkSession.sparkContext.broadcast(bitset(shared, "band"))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, per = unpacked(batch.column(1))
            fit = np.flatnonzero(passing(likely.value, flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), per)[fit]), pa.array(flat[fit])], names=["key", "band"])
        relax()

    members = signed.select("key", "bands").mapInArrow(run, "key long, band long")
    members = saved(members.join(shared, "band").distinct(), "members")
    # lists of different members differ in 128 bits of hashes, or in their number or ends
    marks = [F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("top"), *[F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"s{i}") for i in (1, 2)]]
    each = members.groupBy("band").agg(*marks).groupBy("n", "low", "top", "s1", "s2").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("times"))
    members = saved(members.join(each.select("band", "n", "times"), "band"), "distinct-lists")
    weights = members.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    # a table, so that the join with it isn't bound to the aggregation's partitions: a long list can be split
    pivots = saved(members.join(weights, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).alias("x")).select("band", F.col("x.key").alias("pivot")), "pivots")
    return saved(members.drop("times").join(pivots, "band"), "lists")


def links(members: DataFrame, bodies: Callable[[np.ndarray], DataFrame], shingles: Callable[[str], frozenset], hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], codes: Callable[[str], np.ndarray | None] = lambda _: None, similarity: float = SIMILARITY) -> DataFrame:
    """Verified edges (u, v) among the members of lists(). bodies(filter): (key, body) of at least the keys that pass the filter; shingles: the set
    of a body; hashes: the 64-bit hashes of the shingles of many bodies, one after another, and how many each has;
    codes: the set as sorted numbers that stand for shingles one to one, where there are such."""
    keys = members.select("key").distinct()
    wanted = saved(keys, "wanted")
    texts = saved(bodies(bitset(wanted, "key")).join(wanted, "key", "left_semi").groupBy("key").agg(F.min("body").alias("body")), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (u, v, ...) with ``near``."""

        @F.pandas_udf("boolean")
        def near(a: pd.Series, b: pd.Series) -> pd.Series:
            sets, numbers = lru_cache(1024)(shingles), lru_cache(1024)(codes)

            def one(x: str, y: str) -> bool:
                s, t = numbers(x), numbers(y)
                if s is None or t is None:
                    s, t = sets(x), sets(y)
                    both = len(s & t)
                else:
                    s, t = (s, t) if len(s) <= len(t) else (t, s)
                    if len(s) < similarity * len(t):
                        return False
                    both = np.count_nonzero(t.take(t.searchsorted(s), mode="clip") == s)
                return both >= similarity * (len(s) + len(t) - both)

            out = pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)
            sets.cache_clear()
            numbers.cache_clear()
            relax()
            return out

        first = texts.withColumnsRenamed({"key": "k1", "body": "b1"})
        second = texts.withColumnsRenamed({"key": "k2", "body": "b2"})
        return pairs.join(first, F.col("u") == F.col("k1")).join(second, F.col("v") == F.col("k2")).withColumn("near", near("b1", "b2")).drop("k1", "k2", "b1", "b2")

    tested = saved(verified(members.where("key <> pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v")).distinct()), "tested")
    far = members.join(tested.where("NOT near").select(F.col("u").alias("f1"), F.col("v").alias("f2")), (F.col("key") == F.col("f1")) & (F.col("pivot") == F.col("f2"))).drop("f1", "f2")
    far = saved(far, "far")
    short = far.where((F.col("n") > 2) & (F.col("n") <= LONG)).select("band", F.col("key").alias("o"))
    rest = short.join(members.where("key <> pivot").select("band", F.col("key").alias("m")), "band").where("o <> m")
    rest = rest.select(F.greatest("o", "m").alias("u"), F.least("o", "m").alias("v")).distinct()
    near = saved(tested.where("near").select("u", "v").union(verified(rest).where("near").select("u", "v")), "near")
    long = far.where(F.col("n") > LONG)
    queries = long.select("pivot", "key").distinct()
    # a table, so that the join isn't planned by band, of which a long list is one
    bands_ = saved(long.select("band").distinct(), "long-bands")
    lists_ = members.join(bands_, "band", "left_semi").where("key <> pivot").select("pivot", "key").distinct()
    return near.union(against(lists_, saved(queries, "queries"), texts, hashes, similarity))


def against(lists_: DataFrame, queries: DataFrame, texts: DataFrame, hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], similarity: float) -> DataFrame:
    """Edges between queries (pivot, key) and the members (pivot, key) of their pivot's lists, by blocks of at most
    about ``BLOCK`` queries and members: intersections of a block are one matrix product over the shingles that
    occur in it more than once. A query gets one edge to the members that the pivot connects, and one to each
    component of the others; so a block gives no more edges than rows."""
    n = lists_.groupBy("pivot").agg(F.count(F.lit(1)).alias("n_m")).join(queries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n_q")), "pivot")
    # as a table of its own it doesn't bind the joins to the aggregation's partitions: a large pivot can be split
    n = saved(n.select("pivot", F.ceil(F.col("n_m") / BLOCK).alias("m_blocks"), F.ceil(F.col("n_q") / BLOCK).alias("q_blocks")), "blocks")
    own = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    flags = lists_.join(queries.withColumn("far", F.lit(True)), ["pivot", "key"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    m = flags.join(n, "pivot").select("pivot", "key", "far", F.lit(False).alias("asks"), own("m_blocks").alias("mb"), every("q_blocks").alias("qb"))
    q = queries.join(n, "pivot").select("pivot", "key", F.lit(True).alias("far"), F.lit(True).alias("asks"), every("m_blocks").alias("mb"), own("q_blocks").alias("qb"))
    rows = m.unionByName(q).join(texts, "key").select("pivot", "qb", "mb", "asks", "far", "key", "body")

    def block(group: pa.Table) -> pa.Table:
        keys, asks, far = (group.column(c).to_numpy() for c in ("key", "asks", "far"))
        flat, count = hashes(group.column("body").to_pylist())
        order = np.argsort(flat, kind="stable")  # so equal shingles stand by owner
        flat, owner = flat[order], np.repeat(np.arange(len(count)), count)[order]
        new = np.append(True, flat[1:] != flat[:-1])
        once = new | np.append(True, owner[1:] != owner[:-1])
        new, owner = new[once], owner[once]
        size = np.bincount(owner, minlength=len(count))
        column = np.cumsum(new) - 1
        use = np.bincount(column)[column] > 1
        owner, column = owner[use], np.cumsum(new[use]) - 1
        asking, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        spot = np.empty(len(count), np.int64)
        spot[asking], spot[there] = np.arange(len(asking)), np.arange(len(there))
        both = np.zeros((len(asking), len(there)), np.float32)
        for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):  # shingles at a time
            now = (column >= at) & (column < at + 4096)
            a, b = np.zeros((len(asking), 4096), np.float32), np.zeros((len(there), 4096), np.float32)
            mine = now & asks[owner]
            a[spot[owner[mine]], column[mine] - at] = 1
            mine = now & ~asks[owner]
            b[spot[owner[mine]], column[mine] - at] = 1
            both += a @ b.T
        linked = (both >= similarity * (size[asking][:, None] + size[there][None, :] - both)) & (keys[asking][:, None] != keys[there][None, :])
        root = np.where(far[there], np.arange(len(there)), len(there))  # those that the pivot connects are one
        us, vs = [], []
        for i in range(len(asking)):
            found = np.flatnonzero(linked[i])
            roots, first = np.unique(root[found], return_index=True)
            for j in found[first]:
                us.append(keys[asking[i]])
                vs.append(keys[there[j]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[-1]
        u, v = np.array(us, np.int64), np.array(vs, np.int64)
        del both, linked
        relax()
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return rows.groupBy("pivot", "qb", "mb").applyInArrow(block, "u long, v long")
