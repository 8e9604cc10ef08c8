"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights, by token.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)   if the pair was seen in training, else   alpha(h) P(w)
    P(w)     = d(c(w)) c(w) / N            if the word was seen, else the mass that discounting left, for one unknown word
    alpha(h) = (1 - sum of P(w | h) over words seen after h) / (1 - sum of P(w) over the same words)

d is Katz's discount for counts up to 5 (fewer where counts of counts are missing or give no discount below 1). A
context whose counts are all above that leaves no mass: its denominator grows by one, and so does N likewise; so
every context's probabilities over the vocabulary and the unknown word sum to exactly 1. The context of a text's
first token is a start mark.

Layout. Texts become *blocks*: some millions of tokens as ids into the block's word hashes, common words first (64 bits; the
hash is the word). Counting is a round trip: a block sends its distinct words, or pairs, with training counts to
the partitions of a count table, once each, one row for a partition that it has any for; so there are never more
rows than entries. A partition adds them up, stores its part of the table and answers every block in the order of what it sent. Contexts live in one partition each, but for those with over 1/4096 of
all tokens, or over two million, which are spread by pair. Their sums are added up again, and each block is joined with those of
its own. So a word, pair or context of any frequency is one entry for each block that has it, no partition holds more
than its share of a context, and every lookup of the recursion is local.

Defined results: null, empty and blank texts have the end token alone; repeated rows count and score each; with no
training text every probability is that of the unknown word, 1; rows without id are training rows unless crc32 of
'' says otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, table
from tidemark.llm.encode import relax, strings
from tidemark.llm.minhash import mixed

MOST_DISCOUNTED, BLOCK_TOKENS, PART_ENTRIES, CHUNK = 5, 1_500_000, 2_000_000, 4 << 20
#: A context is spread over the parts if it has more than this share of all tokens, or more than so many.
HOT_SHARE, HOT_TOKENS = 4096, PART_ENTRIES
END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end token; words hash to anything
START = (1 << 40) - 1  # the id of the start mark; word ids are smaller


def zipped(a: np.ndarray) -> bytes:
    """The narrowest whole numbers that fit (or floats), their bytes by place: small values leave planes of zeros."""
    import zstandard

    if a.dtype.kind in "iu":
        top = int(a.max()) if len(a) else 0
        a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unzipped(b: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    dtype = np.dtype(b[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1).astype(kind)


def discounts(n: list[int]) -> list[float]:
    """d[r] for r = 0.. from n[r], the number of entries that occur r times (n[0] unused); 1 beyond the list."""
    for k in range(min(MOST_DISCOUNTED, len(n) - 2), 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            share = (k + 1) * n[k + 1] / n[1]
            if share < 1:
                d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d[1:]):
                    return d
    return [1.0]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c."""
    return c * np.where(c < len(d), np.array(d)[np.minimum(c, len(d) - 1)], 1.0)


def hot_from(n: int) -> int:
    """Tokens above which a context is spread, of n in all."""
    return max(1, min(n // HOT_SHARE, HOT_TOKENS))


class Unigrams:
    """P(w) by count."""

    def __init__(self, n: int, kinds: int, of: list[int]):
        self.n, self.kinds, self.d = n, kinds, discounts(of)
        low = sum((1 - self.d[r]) * r * of[r] for r in range(1, len(self.d)))
        self.below = n if low > 1e-9 else n + 1
        self.unknown = (low if low > 1e-9 else 1.0) / self.below

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.below, self.unknown)


def blocked(docs: DataFrame, held: str) -> DataFrame:
    """Blocks of docs (doc_id, text, and the boolean column named by held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        part, seq = TaskContext.get().partitionId(), 0
        keys, hashes, counts, n = [], [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal keys, hashes, counts, n, seq
            vocabulary, local, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # common words get small ids
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            vocabulary, local = vocabulary[order], rank[local]
            ids, flags = (pa.concat_arrays([k[i] for k in keys]) for i in (0, 1))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([flags.to_pylist()], pa.list_(pa.bool_())), pa.array([zipped(np.concatenate(counts))]), pa.array([vocabulary.tobytes()]), pa.array([zipped(local)]), pa.array([len(vocabulary)], pa.int64()), pa.array([n], pa.int64())],
                names=["block", "doc_ids", "held", "counts", "vocabulary", "tokens", "n_words", "n_tokens"],
            )
            keys, hashes, counts, n = [], [], [], 0
            seq += 1
            relax()
            return out

        for batch in batches:
            texts = strings(batch.column(2))
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                # the blanks of ascii_split_whitespace are those of the contract; an end token follows each text
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, upto - at)))
                per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                value = np.fromiter((xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
                empty = words.index("") if "" in words else -1
                index = coded.indices.to_numpy()
                real = index != empty
                owner = np.repeat(np.arange(len(per)), per)[real]
                count = np.bincount(owner, minlength=len(per))
                hashes.append(np.insert(value[index[real]], np.cumsum(count), END))
                counts.append(count + 1)
                keys.append((batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at)))
                n += len(hashes[-1])
                at = upto
                if n >= BLOCK_TOKENS:
                    yield made()
        if n:
            yield made()

    schema = "block long, doc_ids array<long>, held array<boolean>, counts binary, vocabulary binary, tokens binary, n_words long, n_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(held).alias("held"), F.col("text")).mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One large row at a time."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()
        relax()


def histogram(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= MOST_DISCOUNTED + 1)], minlength=MOST_DISCOUNTED + 2).tolist()


class Block:
    """A block's tokens; ``train`` marks those of training texts."""

    def __init__(self, row: dict):
        self.row = row
        self.count = unzipped(row["counts"])
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = unzipped(row["tokens"])
        self.ends = np.cumsum(self.count)
        self.train = np.repeat(~np.array(row["held"], bool), self.count)

    def words(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of words by partition, ends of the partitions in it, training counts of words)."""
        part = (mixed(self.vocabulary) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.cumsum(np.bincount(part, minlength=parts)), np.bincount(self.tokens[self.train], minlength=len(self.vocabulary))

    def answered(self, answers: list[dict], parts: int) -> None:
        """Takes the words' ids and counts from the unigram partitions."""
        order, ends, _ = self.words(parts)
        self.ids, self.c1 = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for a in answers:
            own = order[ends[a["part"] - 1] if a["part"] else 0 : ends[a["part"]]]
            self.ids[own], self.c1[own] = unzipped(a["ids"]), unzipped(a["counts"])

    def pairs(self, parts: int, hot: int) -> None:
        """Distinct pairs as places in the vocabulary (u1: the start mark has the last) and where tokens have them;
        ``order`` and ``pair_ends``: pairs by partition and, inside, by context."""
        n = len(self.vocabulary)
        before = np.concatenate([[n], self.tokens[:-1]])
        before[self.ends[:-1]] = n
        key, self.place = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        self.u1, self.u2 = key // (n + 1), key % (n + 1)
        self.ids1 = np.append(self.ids, START)
        first = self.ids1[self.u1].astype(np.uint64)
        spread = np.append(self.c1 > hot, True)[self.u1]
        by = mixed(first + np.uint64(1)) ^ np.where(spread, mixed(self.ids[self.u2].astype(np.uint64) + np.uint64(77)), np.uint64(0))
        part = (mixed(by) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.pair_ends = np.cumsum(np.bincount(part, minlength=parts))

    def own(self, part: int) -> np.ndarray:
        return self.order[self.pair_ends[part - 1] if part else 0 : self.pair_ends[part]]


def contexts(u1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs, lengths) of equal neighbours."""
    starts = np.flatnonzero(np.append(True, u1[1:] != u1[:-1])) if len(u1) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(u1)))


def unigram_table(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows (part, block, ids, counts) answer a block; one row of each part, block -1, has its words (hashes in
    ``words``), their counts, and its sums."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                order, ends, counts = block.words(parts)
                pieces = {k: order[a:b] for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b}  # never more than words
                yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([row["block"]] * len(pieces), pa.int64()), pa.array([block.vocabulary[p].tobytes() for p in pieces.values()]), pa.array([zipped(counts[p]) for p in pieces.values()])], names=["part", "block", "words", "counts"])

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        words, place = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unzipped(r["counts"]) for r in rows]), minlength=len(words)).astype(np.int64)
        part, rank = rows[0]["part"], np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))  # common words get small ids
        ids, at, out = rank * parts + part, 0, []
        for r in rows:
            own = place[at : at + len(r["words"]) // 8]
            at += len(own)
            out.append((part, r["block"], zipped(ids[own]), zipped(counts[own]), None, 0, 0, None))
        out.append((part, -1, zipped(ids), zipped(counts), words.tobytes(), int(counts.sum()), int((counts > 0).sum()), histogram(counts)))
        return pa.Table.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(shape)}, shape)

    shape = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64()), ("of", pa.list_(pa.int64()))])
    sent = blocks.mapInArrow(send, "part long, block long, words binary, counts binary")
    return saved(sent.groupBy("part").applyInArrow(add, "part long, block long, ids binary, counts binary, words binary, n long, kinds long, of array<long>"), "unigrams")


def asked(blocks: DataFrame, *answers: tuple[str, DataFrame]) -> DataFrame:
    """blocks with what the partitions answered: an array column for each table."""
    for name, rows in answers:
        listed = rows.groupBy("block").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "block"])).alias(name))
        blocks = blocks.join(listed, "block")
    return blocks


def pair_table(blocks: DataFrame, uni: DataFrame, one: Unigrams, word_parts: int, parts: int) -> DataFrame:
    """Rows (part, block, counts, totals, of, seen) answer a block: its pairs' counts, and for its contexts in the
    part c(h), their counts of counts and the sum of P(w) seen. Block -1: the part of the table (ids1, ids2, counts)
    and its counts of counts; block -2: sums of the part's share of a context that is spread."""
    hot = hot_from(one.n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                block.answered(row["uni"], word_parts)
                block.pairs(parts, hot)
                counts = np.bincount(block.place[block.train], minlength=len(block.u1))
                for part in np.flatnonzero(np.diff(block.pair_ends, prepend=0)).tolist():  # never more than pairs
                    own = block.own(part)
                    starts, lengths = contexts(block.u1[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int64()), pa.array([row["block"]], pa.int64()), *(pa.array([zipped(x)]) for x in (block.ids1[block.u1[own][starts]], lengths, block.ids[block.u2[own]], counts[own], block.c1[block.u2[own]], np.append(block.c1 > hot, True)[block.u1[own][starts]].astype(np.uint8)))],
                        names=["part", "block", "ids1", "lengths", "ids2", "counts", "c1", "spread"],
                    )

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        of = lambda name: [unzipped(r[name]) for r in rows]
        heads, lengths, seconds = of("ids1"), of("lengths"), of("ids2")
        first, second = np.concatenate([np.repeat(h, n) for h, n in zip(heads, lengths, strict=True)]), np.concatenate(seconds)
        order = np.lexsort((second, first))
        new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)) if len(order) else np.zeros(0, bool)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        top = order[new]
        counts = np.bincount(place, np.concatenate(of("counts")), minlength=len(top)).astype(np.int64)
        p1 = np.where(counts > 0, one.p(np.concatenate(of("c1"))[top]), 0.0)
        names, run = np.unique(first[top], return_inverse=True)
        total = np.bincount(run, counts, minlength=len(names)).astype(np.int64)
        kinds = np.stack([np.bincount(run[counts == r], minlength=len(names)) for r in range(1, MOST_DISCOUNTED + 1)]) if len(names) else np.zeros((MOST_DISCOUNTED, 0), np.int64)
        seen = np.bincount(run, p1, minlength=len(names))
        part, at, out = rows[0]["part"], 0, []
        for r, head, second_ in zip(rows, heads, seconds, strict=True):
            own, at = place[at : at + len(second_)], at + len(second_)
            k = np.searchsorted(names, head)
            out.append((part, r["block"], None, None, zipped(counts[own]), zipped(total[k]), zipped(kinds[:, k].reshape(-1)), zipped(seen[k]), None))
        real = counts > 0
        out.append((part, -1, zipped(first[top][real]), zipped(second[top][real]), zipped(counts[real]), None, None, None, histogram(counts)))
        spread = np.unique(np.concatenate([h[unzipped(r["spread"]) > 0] for r, h in zip(rows, heads, strict=True)]))
        k = np.searchsorted(names, spread)
        out.append((part, -2, zipped(spread), None, None, zipped(total[k]), zipped(kinds[:, k].reshape(-1)), zipped(seen[k]), None))
        return pa.Table.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(shape)}, shape)

    shape = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("ids1", "ids2", "counts", "totals", "kinds", "seen")), ("of", pa.list_(pa.int64()))])
    joined = asked(blocks, ("uni", uni.where("block >= 0").select("block", "part", "ids", "counts")))
    sent = joined.mapInArrow(send, "part long, block long, ids1 binary, lengths binary, ids2 binary, counts binary, c1 binary, spread binary")
    return saved(sent.groupBy("part").applyInArrow(add, "part long, block long, ids1 binary, ids2 binary, counts binary, totals binary, kinds binary, seen binary, of array<long>"), "pairs")


def spread_sums(shares: DataFrame) -> DataFrame:
    """(id, total, k0.., seen) of the contexts that are spread, added up over the parts' shares."""
    names = ["id", "total", *(f"k{i}" for i in range(MOST_DISCOUNTED)), "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                kinds = unzipped(r["kinds"]).reshape(MOST_DISCOUNTED, -1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (unzipped(r["ids1"]), unzipped(r["totals"]), *kinds, unzipped(r["seen"], np.float64)))], names=names)

    schema = ", ".join(f"{c} {'double' if c == 'seen' else 'long'}" for c in names)
    return shares.select("ids1", "totals", "kinds", "seen").mapInArrow(run, schema).groupBy("id").agg(*[F.sum(c).alias(c) for c in names[1:]])


def score(docs: DataFrame, held: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text and
    the boolean column named by held): the model learns from rows where that is false."""
    blocks = saved(blocked(docs, held), "blocks")
    size = blocks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    word_parts, parts = (max(1, math.ceil((x or 0) / PART_ENTRIES)) for x in size)
    uni = unigram_table(blocks, word_parts)
    sums = uni.where("block = -1").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), *[F.sum(F.col("of")[r]).alias(f"of{r}") for r in range(MOST_DISCOUNTED + 2)]).first()
    one = Unigrams(sums.n or 0, sums.kinds or 0, [sums[f"of{r}"] or 0 for r in range(MOST_DISCOUNTED + 2)])
    table_ = pair_table(blocks, uni, one, word_parts, parts)
    sums = table_.where("block = -1").agg(*[F.sum(F.col("of")[r]).alias(f"of{r}") for r in range(MOST_DISCOUNTED + 2)]).first()
    d = discounts([sums[f"of{r}"] or 0 for r in range(MOST_DISCOUNTED + 2)])
    hot = hot_from(one.n)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                own = unzipped(r["ids"])[unzipped(r["counts"]) > hot]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"])), pa.array(own)], names=["block", "id"])

    # the spread contexts of each block: its frequent words, and the start mark
    own = uni.where("block >= 0").select("block", "ids", "counts").mapInArrow(above, "block long, id long").union(blocks.select("block", F.lit(START).cast("long")))
    spread = own.join(spread_sums(table_.where("block = -2")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                block.answered(row["uni"], word_parts)
                block.pairs(parts, hot)
                n = len(block.vocabulary)
                c12, total, seen, kinds = np.zeros(len(block.u1), np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1), np.zeros((MOST_DISCOUNTED, n + 1), np.int64)
                for a in row["pairs"]:
                    own = block.own(a["part"])
                    c12[own] = unzipped(a["counts"])
                    starts, _ = contexts(block.u1[own])
                    at = block.u1[own][starts]
                    total[at], seen[at], kinds[:, at] = unzipped(a["totals"]), unzipped(a["seen"], np.float64), unzipped(a["kinds"]).reshape(MOST_DISCOUNTED, -1)
                sums = {x["id"]: (x["total"], [x[f"k{i}"] for i in range(MOST_DISCOUNTED)], x["seen"]) for x in row["spread"]}
                for at in np.flatnonzero(np.append(block.c1 > hot, True)).tolist():
                    total[at], kinds[:, at], seen[at] = sums.get(int(block.ids1[at]), (0, 0, 0.0))
                lost = sum(((1 - d[r]) * r * kinds[r - 1] for r in range(1, len(d))), np.zeros(n + 1))
                below = np.where(lost > 1e-9, total, total + 1)
                left = np.where(lost > 1e-9, lost, 1.0) / below
                alpha = np.where(total > 0, left / (1 - seen), 1.0)
                p1 = one.p(block.c1)
                p = np.where(c12 > 0, discounted(c12, d) / below[block.u1], alpha[block.u1] * p1[block.u2])
                starts = block.ends - block.count
                add = lambda x: np.add.reduceat(x, starts)
                base = np.log10((block.c1 + 1) / (one.n + one.kinds + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(block.count), pa.array(add((block.c1 > 0).astype(np.int64)[block.tokens])), pa.array(np.full(len(block.count), one.n, np.int64)), pa.array(add(base[block.tokens])), pa.array(add(np.log10(p)[block.place]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = asked(blocks, ("uni", uni.where("block >= 0").select("block", "part", "ids", "counts")), ("pairs", table_.where("block >= 0").select("block", "part", "counts", "totals", "kinds", "seen")), ("spread", spread))
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held_out")))
