"""Document fingerprints by improved consistent weighted sampling.

A text's terms are its shingles of ``WORDS`` words (lower-case A-Z; a text of fewer words has one, its whole sequence),
weighted by how often they occur. For each of ``SAMPLES`` draws a term has r and c, both Gamma(2, 1), and a uniform b.
With weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the draw is the term and t of the least a. Two texts
agree in a draw with the probability of their generalised Jaccard coefficient, sum of min(w) / sum of max(w). The
fingerprint has 16 bits for each draw, so differing draws look alike in one of 65,536 cases.

r and c are made of three exponentials from bits of the term's hash: E, F and S, with c = E + F and r = ln(c / E) + S,
b = S / r. Both are Gamma(2, 1), b is uniform, and all are independent, since E / c is uniform whatever c is, and the
parts b and 1 - b of r are exponentials. At weight 1, the usual one, t = 0 and a = ln E, so one exponential decides and
the others need not be made. A term has the same values in every text, on every machine.

``pairs`` compares each text with the next in the order of ids and with a mixture of both. Texts are dealt by ranges of
ids and read in order; the last of a range waits, with its text, for the first of the next range. Only these cross
ranges: two texts for each range, whatever the table's size.

Defined results: null text is the empty one; a text without words has no terms, its fingerprint is all zeros and is
like another such one (1.0), and unlike all others (0.0); null ids come first; rows of one id are ordered by their
text's hash, and repeated rows follow each other; a table of one row is its own next; an empty table has no rows; texts of any
length are read whole, their terms are drawn in blocks. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, table
from tidemark.llm.encode import ragged, relax, strings
from tidemark.llm.minhash import mixed

WORDS, SAMPLES = 5, 64
#: Terms drawn at a time, terms gathered before drawing, and bytes of a text whose words are hashed at a time.
BLOCK, GATHERED, SPAN = 1 << 16, 1 << 20, 1 << 20
BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_rng = np.random.default_rng(20_240_611)
_ODD = _rng.integers(0, 1 << 32, (2, SAMPLES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SEED = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For hashes of words, a random number for each byte (the same for both cases of A-Z) and powers of an odd number.
_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_CODE[65:91] = _CODE[97:123]
_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: its bytes' numbers times powers of the base, as differences of sums over the text."""
    out, at = [], 0
    while at < len(data):
        gap = BLANKS.search(data, at + SPAN) if at + SPAN < len(data) else None
        upto = gap.start() if gap else len(data)
        x = np.frombuffer(data, np.uint8, upto - at, at)
        edge = np.flatnonzero(np.diff(_WORD[x].view(np.int8), prepend=0, append=0))
        first, end = edge[0::2], edge[1::2]
        up, down = powers(max(SPAN, 1 << (len(x) - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[x] * up[: len(x)])])
        out.append(mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)))
        at = upto
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def terms(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct shingle, how often it occurs)."""
    h = word_hashes(text.encode())
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for j in range(min(words, len(h))):
        out += h[j : j + n] * _PLACE[j]
    out = mixed(out)
    out.sort()
    first = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return out[first], np.diff(np.append(first, n))


def drawn(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """[segments, samples] uint64: of the terms of each segment the least (a, term and t) of every draw, the bits of a
    above those of the sample. a is told by the place of its exponential among 2^32 equal parts of the law."""
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    key = np.empty((len(h), 2), np.uint32)  # little-endian halves of a 64-bit key
    key[:, 0] = name = (h ^ (h >> np.uint64(29))).astype(np.uint32)
    heavy = np.flatnonzero(weight > 1)
    log_w, h_heavy, name_heavy = np.log(weight[heavy]), h[heavy], name[heavy]
    x, y, out = np.empty_like(low), np.empty_like(low), np.empty((len(starts), samples), np.uint64)
    for k in range(samples):
        np.multiply(low, _ODD[0, k], out=x)
        np.bitwise_xor(x, high, out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, _ODD[1, k], out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=key[:, 1])
        if len(heavy):
            more = mixed(h_heavy ^ _SEED[k])
            part = lambda bits: (bits.astype(np.float64) + 0.5) * 2.0**-32
            first = -np.log1p(-part(key[heavy, 1]))
            c = first - np.log(part(more & np.uint64(0xFFFFFFFF)))
            before = -np.log(part(more >> np.uint64(32)))
            r = np.log(c / first) + before
            t = np.floor(log_w / r + before / r)
            place = -np.expm1(-c * np.exp(-r * (t + 1) + before)) * 2.0**32
            key[heavy, 1] = np.where(t == 0, key[heavy, 1], place.astype(np.uint32))
            key[heavy, 0] = name_heavy + t.astype(np.uint32) * np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(key.view(np.uint64).ravel(), starts)
    return out


def fingerprints(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[texts, SAMPLES] 16-bit samples from the terms of each text; zeros without terms."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    some = [i for i, (h, _) in enumerate(texts) if len(h)]
    if not some:
        return out
    h, weight = (np.concatenate([texts[i][j] for i in some]) for j in (0, 1))
    count = np.fromiter((len(texts[i][0]) for i in some), np.int64, len(some))
    # segments of at most BLOCK terms, none across texts
    parts = -(-count // BLOCK)
    first_part = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(count) - count, parts) + BLOCK * ragged(np.zeros(len(parts), np.int64), parts)
    ends, least, at = np.append(starts[1:], len(h)), np.empty((len(starts), SAMPLES), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        cut = slice(int(starts[at]), int(ends[upto - 1]))
        least[at:upto] = drawn(h[cut], weight[cut], starts[at:upto] - starts[at])
        at = upto
    out[some] = np.minimum.reduceat(least, first_part).astype(np.uint16)
    return out


def mixture(text: str, following: str) -> str:
    """text with its last half replaced by as many code points from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars bigint, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def compared(texts: list[str], following: list[str], own: np.ndarray, nexts: np.ndarray) -> list[pa.Array]:
    """The columns FIELDS of texts with the texts after them; own, nexts: both fingerprints."""
    edited = [mixture(a, b) for a, b in zip(texts, following, strict=True)]
    prints = gathered(edited)
    packed = lambda x: pa.array([row.tobytes() for row in x.astype(">u2")], pa.binary())
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        packed(own), packed(prints), pa.array((own == prints).mean(axis=1)), pa.array((own == nexts).mean(axis=1)),
    ]


def gathered(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts, whose terms are held for about GATHERED of them at a time."""
    out, some, held = [], [], 0
    for text in texts:
        some.append(terms(text))
        held += len(some[-1][0])
        if held >= GATHERED:
            out, some, held = [*out, fingerprints(some)], [], 0
    return np.concatenate([*out, fingerprints(some)])


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) in order: each row compared with the next; the last row of the range with its text alone
    (edge 'last'), and once more the first (edge 'first')."""
    from pyspark import TaskContext

    part, names = TaskContext.get().partitionId(), ["doc_id", *(f.split()[0] for f in FIELDS.split(", ")), "part", "edge", "text"]
    kind, held = pa.int64(), None

    def rows(ids: pa.Array, columns: list[pa.Array], edge: str | None, text: list[str | None]) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([ids, *columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(text, pa.string())], names=names)

    def alone(ids: pa.Array, text: str, fp: np.ndarray, edge: str) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(1, kind)
        return rows(ids, [none(pa.int64()), none(pa.string()), pa.array([fp.astype(">u2").tobytes()], pa.binary()), none(pa.binary()), none(pa.float64()), none(pa.float64())], edge, [text])

    for batch in batches:
        if not len(batch):
            continue
        ids, texts = batch.column(0), strings(batch.column(1)).to_pylist()
        kind, prints = ids.type, gathered(texts)
        if held is None:
            yield alone(ids.slice(0, 1), texts[0], prints[0], "first")
        else:
            ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2][None], prints])
        if len(texts) > 1:
            yield rows(ids.slice(0, len(texts) - 1), compared(texts[:-1], texts[1:], prints[:-1], prints[1:]), None, [None] * (len(texts) - 1))
        held = (ids.slice(len(texts) - 1).cast(kind), texts[-1], prints[-1])
        del texts, prints
        relax()
    if held is not None:
        yield alone(*held, "last")


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges, from (doc_id, text, fp, next_text, next_fp)."""
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
    unpacked = lambda column: np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, SAMPLES).astype(np.uint16)
    for batch in batches:
        if len(batch):
            ids, text, fp, following, next_fp = batch.columns
            yield pa.RecordBatch.from_arrays([ids, *compared(strings(text).to_pylist(), strings(following).to_pylist(), unpacked(fp), unpacked(next_fp))], names=names)


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next), one row for each of docs."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    found = saved(dealt.mapInArrow(ranges, f"doc_id {kind}, {FIELDS}, part int, edge string, text string"), "ranges")
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
    parts = sorted(r.part for r in found.where("edge = 'first'").select("part").collect())  # one for each range
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, [*parts[1:], *parts[:1]], strict=True)], "part int, next_part int")
    first = found.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    last = found.where("edge = 'last'").select("doc_id", "text", "fp", "part").join(after, "part").join(first, "next_part").select("doc_id", "text", "fp", "next_text", "next_fp")
    return found.where("edge IS NULL").select(*names).union(last.mapInArrow(edges, f"doc_id {kind}, {FIELDS}"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs(table(spark, sf_dir, "documents"))
    told = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_chars", "edited_sha256", told("fp").alias("fingerprint"), told("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
