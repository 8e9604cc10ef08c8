"""SimHash fingerprints and the components of those within a few bits, by an inverted index on byte positions.

A fingerprint is 8 positional bytes. Two within 2 bits differ in at most 2 bytes, so they share at least 6: the
guaranteed minimum. Lists of a single (position, byte) would hold 1/256 of all rows; the index is therefore keyed
by 4 positions at once, two of the four byte pairs (0-1, 2-3, 4-5, 6-7): two differing bytes spoil at most two
pairs, so every linked pair meets in one of the 6 lists. Pairs of a list tally their shared positional bytes,
those with fewer than 6 go, and the rest is verified by the bits that differ.

A list longer than ``LONG`` makes no pairs. Its rows share 4 bytes and so differ in the other 32 bits only; each
row goes to itself and to its 32 neighbours at one bit, and two rows within 2 bits meet in one of these points. The
rows of a point are linked to the smallest of them: at most 33 rows for each of the list, and no link is lost.

Only distinct fingerprints are indexed; rows join them at the end. Defined results: null, empty and wordless texts
have fingerprint zero and link like any other; repeated rows share a component; rows without id have no say in the
smallest id, and a component that has none gets null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import minhash
from tidemark.llm.common import dropped_but, saved, staged, table
from tidemark.llm.components import components
from tidemark.llm.encode import relax, strings

WORDS, BITS, LONG, SLICE = 3, 2, 64, 65_536
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PAIRS = [(a, b) for a in range(4) for b in range(a)]


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every shingle in turn; of the whole sequence, where words are fewer; none without words."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().translate(LOWER).split()  # bytes.split() splits at the contract's blanks
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    if len(tokens) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint, as signed 64 bits: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[k : k + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    return folded(shingle_hashes(text, words))


def fingerprinted(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with ``fp``."""
    kept = docs.drop(text)
    names = [*kept.columns, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, body = batch.columns
            fps = pa.array([fingerprint(t, words) for t in strings(body).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, fps], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "fp bigint"])
    return docs.select(*kept.columns, text).mapInArrow(run, schema)


def links(fps: DataFrame, bits: int = BITS, long: int = LONG) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that make the components of those within 2 bits."""
    if bits != BITS:
        raise ValueError("the index is made for 2 bits: 4 byte pairs of which two stay whole")
    mask = [0xFFFF << (16 * p) for p in range(4)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask[a] | mask[b]))).alias("bytes")) for i, (a, b) in enumerate(PAIRS)])
    postings = saved(fps.select("fp", F.inline(keys)), "postings")
    sizes = postings.groupBy("k", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = saved(postings.join(sizes, ["k", "bytes"]), "lists")

    short = listed.where(F.col("n") <= long).select("k", "bytes", "fp")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    shared = sum((F.when(F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    near = short.select("k", "bytes", F.col("fp").alias("u")).join(short.select("k", "bytes", F.col("fp").alias("v")), ["k", "bytes"]).where("u < v")
    near = near.where((shared >= 8 - bits) & (F.bit_count(differ) <= bits)).select("u", "v")

    free = F.array(*[F.array(*[F.lit(signed(1 << bit)) for p in range(4) if p not in pair for bit in range(16 * p, 16 * p + 16)]) for pair in PAIRS])
    steps = F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, F.col("k") + 1))
    points = listed.where(F.col("n") > long).select("fp", F.explode(F.transform(steps, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    points = saved(points.distinct(), "points")
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
    stars = points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.union(stars)


def grouped(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows (with fp) and component_id: the smallest doc_id of its fingerprint's component."""
    fps = saved(rows.groupBy("fp").agg(F.min(doc_id).alias("least")), "fingerprints")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("r_fp"), F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("r_fp", "component_id")
    return rows.join(named, F.col("fp") == F.col("r_fp"), "left").drop("r_fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    return grouped(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int = 5) -> frozenset:
    tokens = text.encode().translate(LOWER).split()
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)))


def text_hashes(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in turn, shingles of each); a wordless text has one."""
    found = [h if len(h) else np.zeros(1, np.uint64) for h in (shingle_hashes(t, words) for t in texts)]
    return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))


def signed(rows: DataFrame, words: int = 5) -> DataFrame:
    """rows with ``key``, the text's hash, ``fp``, its fingerprint, and ``bands``, its MinHash bands, in place of ``text``."""
    place = rows.columns.index("text")
    names, fields = [c for c in rows.columns if c != "text"], [f for f in rows.schema if f.name != "text"]
    more = [("key", T.LongType()), ("fp", T.LongType()), ("bands", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = strings(batch.column(place)).to_pylist()
            hashes = [shingle_hashes(t, words) for t in texts]
            fps = pa.array([folded(h) for h in hashes], pa.int64())
            none = np.zeros(1, np.uint64)
            some = [h if len(h) else none for h in hashes]
            alike = minhash.bands(np.concatenate(some), np.fromiter(map(len, some), np.int64, len(some)))
            keys = np.array([xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64)
            packed = pa.array([row.tobytes() for row in alike], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(keys), fps, packed], names=[*names, *(n for n, _ in more)])
            del texts, hashes, some, alike, packed
            relax()

    return rows.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in more)]))


def linked(rows: DataFrame) -> DataFrame:
    """(key, bands) of rows (key, fp): one band, the component of the key's fingerprint in ``links``, that is by the index
    on byte positions, the tally of shared bytes and the bits that differ. Keys of one fingerprint share it too."""
    fps = saved(rows.select("key", "fp").distinct(), "fingerprints")
    roots = components(links(fps.select("fp").distinct()))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("root", "fp").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = minhash.mixed(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in band], pa.binary())], names=["key", "bands"])

    return named.mapInArrow(run, "key long, bands binary")


def bodies(rows: DataFrame, filter_: np.ndarray) -> DataFrame:
    likely = rows.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(minhash.passing(likely.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.select("key", F.coalesce("text", F.lit("")).alias("body")).mapInArrow(run, "key long, body string")


@staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the first by id (of rows that share it, one), with its own
    columns. Near duplicates share 0.8 of their five-word shingles (Jaccard). At that similarity fingerprints differ
    in some 10 of 64 bits and need not share a byte, so the index on byte positions alone would lose most of them:
    candidates are the components of fingerprints within 2 bits, by index, tally and verification as in op9, and the
    lists of MinHash bands; all are verified by the exact coefficient."""
    boxed = docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(signed(boxed), "simhash")
    members = minhash.lists(rows.select("key", "bands").union(linked(rows)))
    roots = components(minhash.links(members, lambda f: bodies(rows.select("key", F.col("row.text").alias("text")), f), shingle_set, text_hashes))
    found = rows.select("row_no", "doc_id", "key").join(roots, F.col("key") == F.col("node"), "left").select("row_no", "doc_id", F.coalesce("root", "key").alias("component"))
    first = saved(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("x")).select(F.col("x.row_no").alias("first_no")), "firsts")
    gone = saved(rows.select("row_no").join(first, F.col("row_no") == F.col("first_no"), "left_anti").withColumnRenamed("row_no", "gone_no"), "gone")
    dropped_but(spark, rows, gone)
    return rows.join(gone, F.col("row_no") == F.col("gone_no"), "left_anti").select("row.*")
