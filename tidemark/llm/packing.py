"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's documents form a queue of tokens. A window takes from every queue its quantum, the window's length
times the source's share of what the mixture gives, plus the deficit that the queue carries; whole tokens are
taken, the places that rounding leaves go to the largest deficits, and what a queue could not take it carries to
the next window. Documents are cut where a quantum ends.

Windows are dealt in spans of ``SPAN`` windows, so that they can be filled in parallel. What each queue has given
before a span is closed form: the first N tokens in the order of (k + 1/2) / weight, k being a token's place in its
queue, are a prefix of every queue, and prefixes grow with N. So the deficits carried into a span are known without
the spans before it. The default weights are the queues' lengths: every window has the corpus's mixture and all
queues end together. With other weights a queue that ends leaves its share to the rest.

A source whose share is below one token a window can't be in every window: such sources are dealt by hash to
``SHARED`` queues, which have the sum of their shares. So there are at most LENGTH + SHARED queues, however many
sources there are. If weights are given, each of their sources is a queue; a source without a weight is an error.

Defined results: a null or empty text has its end token alone; null source is a queue of its own; repeated rows are
packed one by one; an empty table makes no piece. Only the last window may be short of ``LENGTH``.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved, staged, table
from tidemark.llm.encode import encoder, ragged, relax, strings

LENGTH, SPAN = 1024, 1024
#: Queues that sources below a token a window share, counts that a worker holds at once, and queues from which on
#: rows are dealt by their place in the queues.
SHARED, COUNTS, MANY = 256, 1 << 21, 64


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def given(n: int, totals: list[int], weights: list[int]) -> list[int]:
    """Tokens of each queue among the first n, in the order of (k + 1/2) / weight and of queues."""
    if n >= sum(totals):
        return list(totals)
    upto = lambda x: [min(t, (2 * x.numerator * w + x.denominator) // (2 * x.denominator)) for t, w in zip(totals, weights, strict=True)]
    # rounding takes at most half a token for each queue: the lower bound is close, if no queue has ended
    lo = max(Fraction(0), Fraction(2 * n - len(totals), 2 * sum(weights)))
    hi = max(lo, Fraction(max((t + 1) / w for t, w in zip(totals, weights, strict=True))))
    for _ in range(200):
        mid = Fraction(float((lo + hi) / 2))
        if mid in (lo, hi) or n - sum(upto(lo)) <= len(totals):
            break
        lo, hi = (mid, hi) if sum(upto(mid)) <= n else (lo, mid)
    out = upto(lo)
    queue = [(Fraction(2 * k + 1, 2 * w), s) for s, (k, t, w) in enumerate(zip(out, totals, weights, strict=True)) if k < t]
    heapq.heapify(queue)
    for _ in range(n - sum(out)):
        _, s = queue[0]
        out[s] += 1
        if out[s] < totals[s]:
            heapq.heapreplace(queue, (Fraction(2 * out[s] + 1, 2 * weights[s]), s))
        else:
            heapq.heappop(queue)
    return out


def rounds(quotas: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Deficit round-robin within spans. quotas: [spans, sources], each span's tokens of each source. Returns
    [spans, windows + 1, sources]: tokens that each queue has given before each window and at the end."""
    total = quotas.sum(1)
    windows = int(-(-total.max() // length))
    out = np.zeros((len(quotas), windows + 1, quotas.shape[1]), np.int64)
    deficit = np.zeros_like(quotas)
    for w in range(windows):
        room = np.clip(total - w * length, 0, length)
        deficit += quotas * room[:, None]
        take = np.maximum(deficit, 0) // np.maximum(total, 1)[:, None]
        left = room - take.sum(1)
        # a place more for the largest remainders; one less, where queues in debt let others take too much
        rest = deficit - take * total[:, None]
        order = np.argsort(-rest, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        take += rank < left[:, None]
        for b in np.flatnonzero(left < 0):
            owing = [s for s in order[b][::-1] if take[b, s] > 0][: -left[b]]
            take[b, owing] -= 1
        deficit -= take * total[:, None]
        out[:, w + 1] = out[:, w] + take
    return out


def tokenized(docs: DataFrame, path: str, end: int, doc_id: str, text: str, source: str) -> DataFrame:
    """Runs: (source, part, seq, n_tokens, doc_ids, counts, ids), a slice of one source's documents in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, zip_, part, seq = encoder(path, True, end), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            for at, ids, count in enc.chunks(strings(batch.column(1))):
                sources = batch.column(2).slice(at, len(count)).dictionary_encode("encode")
                upto = np.cumsum(count)
                for k, name in enumerate(sources.dictionary.to_pylist()):
                    own = np.flatnonzero(sources.indices.to_numpy() == k)
                    took = ids[ragged(upto[own] - count[own], count[own])]
                    blob = zip_.compress(took.astype("<u2" if enc.flat.dtype == np.uint16 else "<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.string()), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(took)], pa.int64()), pa.array([keys.take(pa.array(at + own)).to_pylist()], pa.list_(pa.int64())), pa.array([count[own].tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                        names=["source", "part", "seq", "n_tokens", "doc_ids", "counts", "ids"],
                    )
                seq += 1

    schema = "source string, part long, seq long, n_tokens long, doc_ids array<long>, counts array<long>, ids binary"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")).mapInArrow(run, schema)


def queued(runs: DataFrame) -> DataFrame:
    """runs (with ``queue``) and ``start``, tokens of the same queue before it; windows see sums by part first, then a
    part's runs."""
    parts = runs.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("queue").alias("b_queue"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("queue", "part").orderBy("seq", "source").rowsBetween(Window.unboundedPreceding, -1)
    keys = runs.select("queue", "source", "part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner"))
    starts = keys.join(bases, (keys["queue"] == bases["b_queue"]) & (keys["part"] == bases["b_part"])).select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), F.col("seq").alias("s_seq"), (F.col("base") + F.col("inner")).alias("start"))
    return runs.join(starts, runs["source"].eqNullSafe(starts["s_source"]) & (runs["part"] == starts["s_part"]) & (runs["seq"] == starts["s_seq"])).select(*runs.columns, "start")


def dealt(runs: DataFrame, length: int, weights: dict[str | None, int] | None) -> tuple[DataFrame, list[int], list[int]]:
    """runs with ``queue``, and the queues' totals and weights."""
    sums = runs.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    grand = runs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if weights is None:
        own = sums.where(F.col("n") * length >= grand)  # at most `length` rows
    else:
        named = F.coalesce(F.col("source").isin([w for w in weights if w is not None]), F.lit(None in weights))
        if (other := sums.where(~named).first()) is not None:
            raise ValueError(f"no weight for source {other.source!r}")
        own = sums
    names = [r.source for r in own.orderBy("source").collect()]
    known = runs.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], "own string, place int")
    rest = (F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(SHARED))).cast("int")
    rows = runs.join(F.broadcast(known), runs["source"].eqNullSafe(known["own"]), "left").select(*runs.columns, F.coalesce("place", rest).alias("queue"))
    totals = {r.queue: r.n for r in rows.groupBy("queue").agg(F.sum("n_tokens").alias("n")).collect()}
    # queues that no source fell to are left out
    order = {q: k for k, q in enumerate(sorted(totals))}
    if len(order) < len(names) + SHARED and any(k != q for q, k in order.items()):
        rows = rows.withColumn("queue", F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("queue")))
    return rows, [totals[q] for q in order], [totals[q] for q in order] if weights is None else [weights[name] for name in names]


def pack(docs: DataFrame, length: int = LENGTH, weights: dict[str | None, int] | None = None, path: str | None = None, end: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces: (doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset). weights: whole numbers,
    each source's part of the mixture; the sources' tokens if None."""
    runs = saved(tokenized(docs, path or vocabulary(), end, doc_id, text, source), "runs")
    rows, totals, parts = dealt(runs, length, weights)
    grand, span = sum(totals), length * SPAN
    at_once = max(1, min(16, COUNTS // ((SPAN + 1) * max(1, len(totals)))))  # spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, edges = zstandard.ZstdDecompressor(), {}

        def edge(b: int) -> list[int]:
            if b not in edges:
                edges[b] = given(min(b * span, grand), totals, parts)
            return edges[b]

        def spans_of(s: int, a: int, z: int) -> range:
            """Spans that hold the tokens a..z-1 of source s."""
            def at(k: int) -> int:
                lo, hi = 0, -(-grand // span)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if edge(mid)[s] <= k else (lo, mid)
                return lo
            return range(at(a), at(z - 1) + 1)

        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            for r in rows:
                r["spans"] = spans_of(r["queue"], r["start"], r["start"] + r["n_tokens"])
            need = sorted({b for r in rows for b in r["spans"]})
            for k in range(0, len(need), at_once):
                own = need[k : k + at_once]
                base = np.array([edge(b) for b in own], np.int64)
                got = rounds(np.array([edge(b + 1) for b in own], np.int64) - base, length)
                inner = np.cumsum(np.diff(got, axis=1), axis=2) - np.diff(got, axis=1)  # places of the queues before
                for r in rows:
                    if not (mine := [i for i, b in enumerate(own) if b in r["spans"]]):
                        continue
                    s, a = r["queue"], r["start"]
                    lo, hi = max(a, int(base[mine[0], s])), min(a + r["n_tokens"], edge(own[mine[-1]] + 1)[s])
                    starts = np.concatenate([base[i, s] + got[i, :-1, s] for i in mine])  # of windows, in the queue
                    counts = np.array(r["counts"], np.int64)
                    ends = a + np.cumsum(counts)
                    cuts = np.unique(np.concatenate([[lo], starts[(starts > lo) & (starts < hi)], ends[(ends > lo) & (ends < hi)]]))
                    n = np.diff(np.append(cuts, hi))
                    doc = np.searchsorted(ends, cuts, "right")
                    flat = np.searchsorted(starts, cuts, "right") - 1  # the last window that begins there has the tokens
                    width = got.shape[1] - 1
                    block, window = np.array(mine)[flat // width], flat % width
                    offset = inner[block, window, s] + cuts - starts[flat]
                    raw = unzip.decompress(r["ids"])
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * r["n_tokens"] else "<u4")[lo - a : hi - a].astype("<u4").tobytes()
                    view, at = memoryview(ids), ((cuts - lo) * 4).tolist()
                    crc = [zlib.crc32(view[x:y]) for x, y in zip(at, [*at[1:], len(ids)], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r["doc_ids"], pa.int64()).take(pa.array(doc)), pa.array([r["source"]], pa.string()).take(pa.array(np.zeros(len(cuts), np.int64))), pa.array(cuts - (ends[doc] - counts[doc])), pa.array(n), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(np.array(own, np.int64)[block] * SPAN + window), pa.array(offset)],
                        names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                    )
            del rows
            relax()

    placed = queued(rows)
    if len(totals) > MANY:  # a task then has few spans
        placed = placed.repartitionByRange(F.col("start") / F.element_at(F.array(*map(F.lit, totals)), F.col("queue") + 1))
    return placed.mapInArrow(run, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
