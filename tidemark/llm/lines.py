"""Fuzzy line dedup: one line of each component of near-equal lines stays, the first by document id and place.

A line is normalised (white space runs to one space, trimmed, lower case) and stands for its set of ``CHARS``-
character shingles; a shorter line is one shingle. Equal normalised lines share a 64-bit key and are one node.
Candidates come from MinHash bands, links from the exact Jaccard coefficient, components from distributed joins.

Defined results: blank lines belong to no component and always stay; a null text has no lines and stays null;
rows that share id and text are told apart by their place in the input and their lines are duplicates; of lines
that tie the first row's stays; an empty table gives an empty result. A document that loses all its lines stays,
with an empty text: this operator edits documents and drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.common import dropped_but, saved, staged, table
from tidemark.llm.components import components
from tidemark.llm.encode import relax

CHARS, CHUNK = 8, 4 << 20
#: White space other than single blanks and line feeds, as str.split() knows it.
_BLANKS = ["  ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1)))


def plain_lines(text: str) -> list[str]:
    """The normalised lines of a text, blank ones as ''."""
    low = text.lower()
    if not any(c in low for c in _BLANKS):
        return [x.strip(" ") for x in low.split("\n")]
    return [" ".join(x.split()) for x in low.split("\n")]


def codes(line: str) -> np.ndarray | None:
    """The shingles of a line of one-byte characters, each its 8 bytes as a number: sorted, distinct and exact."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(raw) < CHARS:
        return None
    out = np.sort(np.ndarray(len(raw) - CHARS + 1, "<u8", raw, strides=(1,)))
    new = out[1:] != out[:-1]
    return out if new.all() else out[np.append(True, new)]


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all lines in turn, shingles of each line) of normalised lines of CHARS characters
    or more. Eight one-byte characters are their own hash; others are hashed to 64 bits."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends, joined = np.cumsum(size), "".join(lines)
    n = int(ends[-1]) if len(lines) else 0
    whole = np.ones(n, bool)  # a shingle that would cross the end of its line is none
    for j in range(1, CHARS):
        whole[ends - j] = False
    try:
        return np.ndarray(n, "<u8", joined.encode("latin-1") + bytes(CHARS), strides=(1,))[whole], size - CHARS + 1
    except UnicodeEncodeError:
        pass
    wide, m = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0x100000001B3
    out = np.empty(n, np.uint64)
    for at in range(0, n, 1 << 14):  # a cache's worth at a time; spans of 2, 4 and 8 characters by doubling
        bytes_, mix, top = (np.zeros(min(1 << 14, n - at) + CHARS - 1, np.uint64) for _ in range(3))
        piece = wide[at : at + len(mix)]
        bytes_[: len(piece)] = mix[: len(piece)] = top[: len(piece)] = piece
        for j in range(3):
            bytes_ = bytes_[: -(1 << j)] | bytes_[1 << j :] << np.uint64(8 << j)
            mix = mix[: -(1 << j)] * np.uint64(pow(m, 1 << j, 1 << 64)) + mix[1 << j :]
            top = top[: -(1 << j)] | top[1 << j :]
        out[at : at + len(mix)] = np.where(top < 256, bytes_, mix)
    return out[whole], size - CHARS + 1


def signed_lines(rows: DataFrame) -> DataFrame:
    """(row_no, doc_id, line_no, key, bands) of the non-blank lines of rows (row_no, doc_id, text); bands: with the
    first of equal lines in a batch, else null. A line below CHARS characters has none: it is one shingle, which no
    other line can share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def made(part: list[tuple]) -> pa.RecordBatch:
            keys = np.array([p[3] for p in part], np.uint64).view(np.int64)
            _, first = np.unique(keys, return_index=True)
            first = [i for i in np.sort(first).tolist() if len(part[i][4]) >= CHARS]
            signs: list[bytes | None] = [None] * len(part)
            for i, found in zip(first, minhash.bands(*line_hashes([part[i][4] for i in first])), strict=True):
                signs[i] = found.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()), pa.array(keys), pa.array(signs, pa.binary())], names=["row_no", "doc_id", "line_no", "key", "bands"])

        for batch in batches:
            part, size = [], 0
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, plain in enumerate(plain_lines(text or "")):
                    if plain:
                        part.append((row, doc, k, xxh64_intdigest(plain.encode(), 42), plain))
                        size += len(plain)
                if size > CHUNK:
                    yield made(part)
                    part, size = [], 0
            if part:
                yield made(part)
            relax()

    return rows.select("row_no", "doc_id", "text").mapInArrow(run, "row_no long, doc_id long, line_no long, key long, bands binary")


def line_bodies(texts: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(key, body) of the lines whose keys pass the filter. texts: one column."""
    likely = texts.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            plain = list({p for text in batch.column(0).to_pylist() for p in plain_lines(text or "") if p})
            keys = np.array([xxh64_intdigest(p.encode(), 42) for p in plain], np.uint64).view(np.int64)
            fit = np.flatnonzero(minhash.passing(likely.value, keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[fit], pa.int64()), pa.array([plain[i] for i in fit], pa.string())], names=["key", "body"])
            del plain, keys
            relax()

    return texts.mapInArrow(run, "key long, body string")


def classed(rows: DataFrame) -> DataFrame:
    """(row_no, doc_id, line_no, component, kept) of every non-blank line of rows (row_no, doc_id, text)."""
    signed = saved(signed_lines(rows), "lines")
    members = minhash.lists(signed.select("key", "bands"))
    edges = minhash.links(members, lambda f: line_bodies(rows.select("text"), f), shingles, line_hashes, codes)
    roots = components(edges)
    lines = signed.select("row_no", "doc_id", "line_no", "key").join(roots, F.col("key") == F.col("node"), "left")
    lines = saved(lines.select("row_no", "doc_id", "line_no", F.coalesce("root", "key").alias("component")), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "line_no")
    # as a table of its own it doesn't bind the join to the aggregation's partitions: a frequent line can be split
    first = saved(lines.groupBy("component").agg(F.min(order).alias("first")).select(F.col("component").alias("c"), "first"), "first-lines")
    joined = lines.join(first, F.col("component") == F.col("c"))
    return joined.select("row_no", "doc_id", "line_no", "component", ((F.col("row_no") == F.col("first.row_no")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"))


def rewritten(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the lines that do not stay cut from their texts."""
    boxed = saved(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*docs.columns).alias("row")), "line-rows")
    rows = boxed.select("row_no", F.col("row")[doc_id].cast("long").alias("doc_id"), F.col("row")[text].alias("text"))
    gone = saved(classed(rows).where("NOT kept").groupBy(F.col("row_no").alias("gone_no")).agg(F.collect_list(F.col("line_no").cast("int")).alias("gone")), "lines-to-cut")
    dropped_but(docs.sparkSession, boxed, gone)
    left = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda x, k: ~F.array_contains("gone", k)), "\n")
    cut = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(left(F.col("row")[text]))
    both = boxed.join(gone.hint("merge"), F.col("row_no") == F.col("gone_no"), "left")  # it grows with the documents
    return both.select(*[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classed(rows).drop("row_no")


@staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rewritten(docs)
