"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents start spread evenly, counts at most one apart. In each round every link group (documents that share a
key) elects, of its members' shards that have room, the one that most are in, and members elsewhere ask to move there. Requests between
two shards in both directions are exchanges; beyond these a shard admits as many as it can make room for by moving
documents without links out, which fill the places that were left. So every round keeps each shard's count, and
cuts fewer links. A group larger than a shard is first dealt into blocks of about half a shard by a hash of the
document, as it can't be in one shard anyway.

Rounds go on until no document asks to move, none can, or ``STALLED`` rounds in a row leave no fewer of them asking.

Only sums by (group, shard) and tables of shards x shards counts are gathered; ranks are counted in pieces. Defined
results: null and empty texts are equal texts of no bytes; repeated rows are documents of their own; texts of any
length are hashed whole; groups that elect with equal votes decide by a hash of group and shard; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import dropped, numbered, saved, table

SHARDS, PIECE_ROWS = 16, 20_000
#: Rounds in a row without fewer members outside their group's shard, after which it has settled.
STALLED = 2


def spread(nodes: DataFrame, shards: int, pieces: int) -> DataFrame:
    """(id, label): labels 0..shards-1 in turn, in the order of hashes, so that counts are at most one apart."""
    dealt = numbered(nodes.select("id", F.lit(0).alias("all")), "all", [F.xxhash64("id"), F.col("id")], "place", pieces, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(pieces)))
    return dealt.select("id", F.pmod("place", F.lit(shards)).cast("int").alias("label"))


def by_ranges(value: Column, ranges: list[tuple[int, int]]) -> Column:
    """The shard of each number, by consecutive ranges (shard, length)."""
    out, upto = F.lit(None).cast("int"), sum(n for _, n in ranges)
    for shard, n in reversed(ranges):
        upto -= n
        out = F.when(value >= upto + n, out).otherwise(F.lit(shard))
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, label) for nodes (id long, distinct) and links (id, key): which documents share which keys."""
    n = nodes.count()
    pieces = max(1, n // PIECE_ROWS)
    sizes = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.when(F.col("n") <= -(-n // shards), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("n") * F.lit(2.0 * shards / max(1, n)))))
    # a group larger than a shard can't meet as a whole, so the block is part of the key
    tied = saved(links.join(sizes, "key").select("id", F.xxhash64("key", block).alias("key")), "tied")
    free = saved(nodes.select("id").join(tied.select("id").distinct(), "id", "left_anti"), "free")
    state = saved(spread(nodes, shards, pieces), "labels")
    least, stalled = None, 0
    while True:
        loose = free.join(state, "id")
        room = {r.label: r.n for r in loose.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        votes = tied.join(state, "id").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        # a shard that can't make room for the members elsewhere is elected only if none of the group's can
        space = F.element_at(F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(room.get(s, 0)))]), F.col("label"))
        fits = space >= F.sum("n").over(Window.partitionBy("key")) - F.col("n")
        # as a table of its own it doesn't bind the next join to these partitions: a large group can be split
        elected = saved(votes.withColumn("fits", fits).groupBy("key").agg(F.max(F.struct("fits", "n", F.xxhash64("key", "label").alias("h"), "label")).alias("won")), "elected")
        asks = tied.join(elected, "key").groupBy("id").agg(F.max("won").alias("won")).select("id", F.col("won.label").alias("to"), F.col("won.h").alias("h"))
        asks = saved(asks.join(state, "id").where("to <> label").select("id", "to", "h", (F.col("label") * shards + F.col("to")).alias("pair")), "asks")
        wanted = {r.pair: r.n for r in asks.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards x shards at most
        left = sum(wanted.values())
        least, stalled = (left, 0) if least is None or left < least else (least, stalled + 1)
        if not wanted or stalled == STALLED:
            break
        quota, change = {}, [0] * shards
        for pair, asked in sorted(wanted.items()):
            a, b = divmod(pair, shards)
            quota[pair] = min(asked, wanted.get(b * shards + a, 0))
        for pair, asked in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
            a, b = divmod(pair, shards)
            more = min(asked - quota[pair], room.get(b, 0) - change[b])
            more = max(0, min(more, asked - quota[pair]))
            quota[pair] += more
            change[a] -= more
            change[b] += more
        if not any(quota.values()):
            break
        allowed = F.element_at(F.create_map(*[x for p, q in quota.items() for x in (F.lit(p), F.lit(q))]), F.col("pair"))
        ranked = numbered(asks, "pair", [F.col("h"), F.col("id")], "place", pieces, F.pmod("h", F.lit(pieces)))
        moves = ranked.where(F.col("place") < allowed).select("id", F.col("to").alias("new"))
        out = [(s, change[s]) for s in range(shards) if change[s] > 0]
        into = [(s, -change[s]) for s in range(shards) if change[s] < 0]
        if out:
            base, at = {}, 0
            for s, k in out:
                base[s], at = at, at + k
            leaving = F.element_at(F.create_map(*[x for s, k in out for x in (F.lit(s), F.lit(k))]), F.col("label"))
            first = F.element_at(F.create_map(*[x for s, k in base.items() for x in (F.lit(s), F.lit(k))]), F.col("label"))
            evicted = numbered(loose.where(F.col("label").isin([s for s, _ in out])), "label", [F.xxhash64("id"), F.col("id")], "place", pieces, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(pieces)))
            moves = moves.union(evicted.where(F.col("place") < leaving).select("id", by_ranges(F.col("place") + first, into).alias("new")))
        after = saved(state.join(moves, "id", "left").select("id", F.coalesce("new", "label").cast("int").alias("label")), "labels")
        dropped(state)
        dropped(asks)
        dropped(elected)
        state = after
    return state


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("id"), "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
    )
    rows = saved(rows, "documents")
    labels = propagate(rows.select("id"), rows.select("id", F.xxhash64("hash", "text_crc32", "size").alias("key")))
    out = rows.join(labels, "id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("label").alias("shard"), "id")
    pieces = max(1, rows.count() // PIECE_ROWS)
    out = numbered(out, "shard", [F.col("id")], "slot", pieces, F.pmod(F.xxhash64("id"), F.lit(pieces)))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
