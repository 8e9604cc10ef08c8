"""Conversation structure repair: the cheapest edits of a conversation's turns that make its roles alternate.

The lattice has a node for each (turn index, grammar state). Its edges are Keep (0), Rerole (1), Delete (2), and Insert
of an empty turn (5); a truncated turn that stays adds 5, a blank or repeated one can only be deleted. Roles have to
read ``(s?(ua)+)?`` by their initials. Dijkstra makes nodes as it meets them, with the key (cost, audit), audit being the
edits' initials so far, and stops at the first popped node behind the last turn whose state accepts. Of two ways to a
node neither audit starts with the other, since more inserts cost more, so the least key of a node leads to the least of
all that follow, and the first audit popped is the least by ASCII.

A conversation is read in order from a sorted partition and repaired as it ends. One with more than ``LONG`` turns is
dealt by ranges of turns and cut in pieces of at most ``PIECE`` turns, which are searched apart from each state that a
piece can be entered in. What a piece costs from state to state, and the order of its audits, are 32 numbers; these are
put together in order, and the pieces are read again for the edits on the way chosen. The hash of a long conversation's
text reads that text in order, once, without holding it: a hash has no parts to add.

Defined results: null roles and texts are one space, so such a text is blank and such a role has to change; turns come by
turn (null first), then role, then text, so repeated rows stand next to each other and all but one are repetitions; a
null conv_id is a conversation; texts of any length are whole; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import saved, table

LONG, PIECE = 2048, 1024
BLANKS, WORD = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Faults of a turn by letter.
BLANK, DUPLICATE, CUT, SOUND = "bdt-"
COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def wanted(state: int) -> tuple[int, str]:
    """The state and role that a new or changed turn has after this state."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def after(state: int, initial: str) -> int | None:
    """The state behind a kept turn; none where the grammar has no such turn."""
    if initial == "s":
        return SYSTEM if state == START else None
    to, role = wanted(state)
    return to if initial == role[0] else None


def edges(state: int, initial: str, fault: str) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, state behind) of the edits of one turn."""
    yield DELETE, "D", state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if (kept := after(state, initial)) is not None:
            yield more, "K", kept
        yield REROLE + more, "R", wanted(state)[0]


def search(turns: list[tuple[str, str]], entry: int = START, ends: bool = True) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) of the nodes behind the last of the turns (initial, fault), as they are popped; of accepting
    ones where the conversation ends here. Inserts behind the last turn belong to the piece that follows."""
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and (not ends or state in ACCEPTING):
            yield cost, audit, state
        if i < len(turns):
            for more, edit, to in edges(state, *turns[i]):
                heapq.heappush(heap, (cost + more, audit + edit, i + 1, to))
        if i < len(turns) or ends:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, wanted(state)[0]))


def replayed(audit: str, initials: Iterable[str], entry: int = START) -> Iterator[tuple[int | None, str | None]]:
    """(turn, new role) of each line of the repaired text: no turn for an insert, no role for a kept one."""
    state, at, initials = entry, -1, list(initials)
    for edit in audit:
        if edit != "I":
            at += 1
        if edit == "K":
            state = after(state, initials[at])
            yield at, None
        elif edit != "D":
            state, role = wanted(state)
            yield None if edit == "I" else at, role


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """COUNTS of the turns (turn, role, text) of one conversation in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append(BLANK if not body else DUPLICATE if (role, text) in seen else SOUND if body[-1] in ".!?" else CUT)
        seen.add((role, text))
    initials, turns = [initial_of(r[1]) for r in rows], {r[0] for r in rows} - {None}
    cost, audit, _ = next(search(list(zip(initials, faults, strict=True))))
    lines = (f"{role or rows[at][1]}:{rows[at][2] if at is not None else ''}" for at, role in replayed(audit, initials))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in (BLANK, DUPLICATE, CUT)), illegal(initials), cost, audit, sha


def key_of(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, times): times is 0 for a dropped row and 2 for a repeated one."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", kind.alias("kind")).select(
        key_of("conv_id").alias("key"), "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def whole(rows: DataFrame) -> DataFrame:
    """(conv_id, COUNTS): conversations as they pass in a sorted partition."""
    fields = [T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(COUNTS).fields]
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told(out: list, kind: pa.DataType) -> pa.RecordBatch:
            ids, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=[f.name for f in fields])

        kind = None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for k, conv, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append((conv_id, *repaired(held)))
                    key, conv_id, held = k, conv, []
                held += [(turn, role, text)] * times
            if out:
                yield told(out, kind)
        if key is not None:
            yield told([(conv_id, *repaired(held))], kind)

    dealt = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return dealt.mapInArrow(run, T.StructType(fields))


def lattice(code: str) -> tuple[list[int], list[int]]:
    """Of a piece's turns, two letters each, from each state to each: the cost (-1: no way), and the place of the audit
    among those from the same state."""
    costs, places, turns = [], [], [(code[i], code[i + 1]) for i in range(0, len(code), 2)]
    for entry in range(4):
        found = {state: (cost, audit) for cost, audit, state in search(turns, entry, ends=False)}
        order = sorted(found, key=lambda s: found[s][1])
        costs += [found[s][0] if s in found else -1 for s in range(4)]
        places += [order.index(s) if s in found else -1 for s in range(4)]
    return costs, places


def way(pieces: list[tuple[list[int], list[int], str]]) -> tuple[list[int], int]:
    """The state before each piece of a conversation and behind the last, and the cost; the last piece is searched to the
    end of the conversation, so it is given by its turns."""
    best, back = {START: (0, 0)}, []  # of each state the cost, and the place of its audit among all states'
    for costs, places, _ in pieces[:-1]:
        found = {}
        for entry, (cost, place) in best.items():
            for to in range(4):
                if costs[4 * entry + to] >= 0:
                    found[to] = min(found.get(to, (float("inf"),)), (cost + costs[4 * entry + to], place, places[4 * entry + to], entry))
        order = sorted(found, key=lambda s: found[s][1:3])
        back.append({s: x[3] for s, x in found.items()})
        best = {s: (found[s][0], order.index(s)) for s in found}
    code = pieces[-1][2]
    turns = [(code[i], code[i + 1]) for i in range(0, len(code), 2)]
    ends = [(cost + x[0], place, x[1], entry) for entry, (cost, place) in best.items() for x in [next(search(turns, entry))]]
    cost, _, _, state = min(ends)
    states = [state]
    for step in reversed(back):
        states.insert(0, step[states[0]])
    return states, cost


def edited(code: str, entry: int, to: int) -> tuple[str, list[tuple[int, int | None, str | None]]]:
    """The audit of a piece on the way from one state to another (-1: to the end), and the lines (place, turn, role)."""
    turns = [(code[i], code[i + 1]) for i in range(0, len(code), 2)]
    audit = next(a for _, a, state in search(turns, entry, ends=to < 0) if to in (-1, state))
    return audit, [(n, at, role) for n, (at, role) in enumerate(replayed(audit, code[::2], entry))]


def placed(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Adds the piece and the place in it to rows in order, whose first column is the key."""
    from pyspark import TaskContext

    base, key, n = TaskContext.get().partitionId() << 32, None, 0
    for batch in batches:
        pieces, places = [], []
        for k in batch.column(0).to_pylist():
            if k != key or n % piece == 0:
                key, n, base = k, 0, base + 1
            pieces.append(base)
            places.append(n)
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int32())], names=[*batch.schema.names, "piece", "place"])


def in_pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, COUNTS) of long conversations."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    turns = rows.where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "key", "turn", "role", "text", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("no"), (~F.col("text").rlike(WORD)).alias("blank"), (~body.rlike(r"[.!?]\z")).alias("cut"))
    turns = saved(turns, "long-turns")
    firsts = turns.groupBy("key", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn", "no"))["no"].alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("no") != F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    marked = saved(turns.join(firsts, ["key", "role", "sha"]).select("key", "turn", "role", "text", "no", fault.alias("fault")), "faults")
    # ranges by a prefix of the text, since Spark takes a sample of the keys to the driver
    dealt = marked.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text", "no")
    at = saved(dealt.mapInArrow(lambda batches: placed(batches, piece), "key string, turn bigint, role string, text string, no bigint, fault string, piece bigint, place int"), "placed")
    initial = F.substring("role", 1, 1)
    letters = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), "fault")
    codes = at.groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", letters.alias("x")))), lambda x: x["x"]), "").alias("code"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lattice(c) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int32()))], names=["key", "piece", "code", "costs", "places"])

    pieces = saved(codes.mapInArrow(costs, "key string, piece bigint, code string, costs array<bigint>, places array<int>"), "pieces")
    last = pieces.groupBy("key").agg(F.max("piece").alias("last"))
    # 32 numbers, two letters and a count for each PIECE turns; the letters of the last piece only
    inner = F.expr("size(filter(sequence(0, length(code) div 2 - 2), i -> NOT concat(substr(code, 2 * i + 1, 1), substr(code, 2 * i + 3, 1)) IN ('su', 'ua', 'au')))")
    listed = pieces.join(last, "key").select("key", F.struct("piece", "costs", "places", F.when(F.col("piece") == F.col("last"), F.col("code")).alias("code"), F.substring("code", 1, 1).alias("head"), F.expr("substr(code, length(code) - 1, 1)").alias("tail"), F.when(F.length("code") > 2, inner).otherwise(0).alias("inner")).alias("x"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                states, cost = way([(x["costs"], x["places"], x["code"]) for x in xs])
                bad = sum(x["inner"] for x in xs) + sum(a["tail"] + c["head"] not in LEGAL for a, c in zip(xs, xs[1:], strict=False))
                n = len(xs)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([x["piece"] for x in xs], pa.int64()), pa.array(states, pa.int32()), pa.array([*states[1:], -1], pa.int32()), pa.array([cost] * n, pa.int64()), pa.array([bad] * n, pa.int64())], names=["key", "piece", "entry", "to", "cost", "illegal"])

    chosen = saved(listed.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs")).mapInArrow(ways, "key string, piece bigint, entry int, to int, cost bigint, illegal bigint"), "ways")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.list_(pa.struct([("n", pa.int32()), ("place", pa.int32()), ("new", pa.string())]))
        for b in batches:
            found = [edited(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found]), pa.array([[{"n": n, "place": p, "new": r} for n, p, r in x[1]] for x in found], line)], names=["key", "piece", "audit", "lines"])

    done = saved(pieces.select("key", "piece", "code").join(chosen.select("key", "piece", "entry", "to"), ["key", "piece"]).mapInArrow(edits, "key string, piece bigint, audit string, lines array<struct<n: int, place: int, new: string>>"), "edits")
    lines = done.select("key", "piece", F.inline("lines")).join(at.select("key", "piece", "place", "role", "text"), ["key", "piece", "place"], "left")
    lines = lines.select("key", "piece", "n", F.concat(F.coalesce("new", "role"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("line")).repartition("key").sortWithinPartitions("key", "piece", "n")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "sha"])
        for b in batches:
            for k, line in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield told()
                    key, sha = k, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
        if key is not None:
            yield told()

    shas = lines.mapInArrow(hashed, "key string, sha string")
    audits = done.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    counted = lambda letter: F.count(F.when(F.col("fault") == letter, 1))
    faults = marked.groupBy("key").agg(counted(BLANK).alias("blank"), counted(DUPLICATE).alias("duplicate"), counted(CUT).alias("truncated"))
    gaps = turns.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    ids = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    costs_of = chosen.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    out = ids.join(faults, "key").join(gaps, "key", "left").join(costs_of, "key").join(audits, "key").join(shas, "key", "left")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame, most: int = LONG, piece: int = PIECE) -> DataFrame:
    """(conv_id, COUNTS) of all conversations of rows (key, conv_id, turn, role, text, times)."""
    sizes = rows.groupBy("key").agg(F.sum("times").alias("n")).where(F.col("n") > most).select("key")
    long = saved(sizes, "long-conversations")
    if long.isEmpty():
        return whole(rows)
    return whole(rows.join(long, "key", "left_anti")).union(in_pieces(saved(rows.join(long, "key", "left_semi"), "long-rows"), piece))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def sql() -> str:
    inserts = [(s, to, text, 5 * n, "I" * n) for s in range(4) for n, to, text in [(0, s, ""), (1, wanted(s)[0], f"\n{wanted(s)[1]}:"), (2, wanted(wanted(s)[0])[0], f"\n{wanted(s)[1]}:\n{wanted(wanted(s)[0])[1]}:")]]
    moves = [(s, i, f, to, cost, edit, wanted(s)[1] if edit == "R" else None) for s in range(4) for i in "sua-" for f in "bdt-" for cost, edit, to in edges(s, i, f)]
    told = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)
    return f"""
        WITH RECURSIVE hashed AS (
            SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, coalesce('=' || conv_id::VARCHAR, '') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
        kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind FROM hashed),
        turns AS (SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE kind <> 0)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i FROM turns),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY i) AS again FROM numbered),
        told AS (SELECT key, i, turn, role, text, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '-' END AS initial,
            CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN '-' ELSE 't' END AS fault FROM ordered),
        inserts(s, t, said, c, e) AS (VALUES {told(inserts)}), moves(t, initial, fault, s, c, e, new) AS (VALUES {told(moves)}),
        found(key, i, s, best, lines) AS (
            SELECT DISTINCT key, 0::BIGINT, 0, '0000000000', '' FROM hashed
            UNION ALL
            SELECT key, i, s, min(label), arg_min(text, label) FROM (
                SELECT f.key, r.i, m.s, printf('%010d', substr(f.best, 1, 10)::INT + n.c + m.c) || substr(f.best, 11) || n.e || m.e AS label,
                    f.lines || n.said || CASE m.e WHEN 'D' THEN '' ELSE chr(10) || coalesce(m.new, r.role) || ':' || r.text END AS text
                FROM found f JOIN told r ON r.key = f.key AND r.i = f.i + 1 JOIN inserts n ON n.s = f.s JOIN moves m ON m.t = n.t AND m.initial = r.initial AND m.fault = r.fault) GROUP BY key, i, s),
        lasts AS (SELECT key, max(i) AS i FROM found GROUP BY key),
        ends AS (SELECT f.key, min(printf('%010d', substr(f.best, 1, 10)::INT + n.c) || substr(f.best, 11) || n.e) AS best, arg_min(f.lines || n.said, printf('%010d', substr(f.best, 1, 10)::INT + n.c) || substr(f.best, 11) || n.e) AS lines
            FROM found f JOIN lasts USING (key, i) JOIN inserts n USING (s) WHERE n.t IN (0, 3) GROUP BY f.key),
        pairs AS (SELECT key, initial || lead(initial) OVER (PARTITION BY key ORDER BY i) AS p FROM told),
        bad AS (SELECT key, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY key),
        counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM told GROUP BY key)
        SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            substr(e.best, 1, 10)::BIGINT AS cost, substr(e.best, 11) AS audit, sha256(substr(e.lines, 2)) AS repaired_sha256
        FROM (SELECT DISTINCT key, conv_id FROM hashed) h JOIN ends e USING (key) LEFT JOIN counts USING (key) LEFT JOIN bad USING (key)"""
