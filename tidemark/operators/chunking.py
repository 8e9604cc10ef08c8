"""Chunkers: one normalised item in, ordered chunks out, by the item's domain.

Token limits, header formats and merge rules are data in ``DOMAINS``; markdown is read by a small block parser.
The table function is ``chunked``; an item that can't be chunked gives one row with ``error`` set.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X

SOFT, HARD = 512, 1024
#: Allowed values of metadata fields.
TASK_STATES = ("open", "completed", "cancelled", "in-progress")
HEALTH_TYPES = ("sleep_summary", "readiness_summary", "activity_summary", "workout_session", "heart_rate_series", "spo2_summary", "mindfulness_session", "user_health_tag")
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\Z")

CHUNK_SCHEMA = "chunk_index int, content string, context_header string, chunk_type string, domain_metadata string, error string"


def tokens(text: str) -> int:
    return len(text.split())


def packed(parts: list[str], limit: int, glue: str = " ", start: str = "") -> tuple[list[str], str]:
    """Parts joined greedily up to limit tokens: (full pieces, the last, still open one)."""
    out, now = [], start
    for part in parts:
        if now and tokens(now) + tokens(part) > limit:
            out.append(now)
            now = part
        else:
            now = f"{now}{glue}{part}" if now else part
    return out, now


def split_text(text: str, limit: int = HARD) -> list[str]:
    """Text within the limit stays as it is; else sentences are packed, and the words of a sentence beyond it."""
    if tokens(text) <= limit:
        return [text]
    out, now = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if tokens(sentence) > limit:
            if now:
                out.append(now)
            full, now = packed(sentence.split(), limit)
        else:
            full, now = packed([sentence], limit, start=now)
        out += full
    out += [now] if now else []
    return out or [text]


def own_words(text: str) -> str:
    """A message without quoted lines and the lines that introduce them."""
    kept = [x for x in text.splitlines() if not x.strip().startswith(">") and not re.match(r"^On .+ wrote:$", x.strip())]
    return "\n".join(kept).strip()


# Markdown blocks


_FENCE, _HEADING, _RULE = re.compile(r"^ {0,3}(`{3,}|~{3,})"), re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"), re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM, _TABLE_RULE = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$"), re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def cells_of(row: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]


def blocks(markdown: str) -> Iterator[tuple[str, str, int]]:
    """(kind, body, level): heading, code, table, rule, list, quote or paragraph."""
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j]):
                j += 1
            yield "code", "\n".join(lines[i + 1 : j]), 0
            i = j + 1
        elif re.match(r"^(?: {4}|\t)", line):
            j = i
            while j < len(lines) and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip()):
                j += 1
            yield "code", "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:j]).rstrip("\n"), 0
            i = j
        elif m := _HEADING.match(line):
            yield "heading", (m[2] or "").strip(), len(m[1])
            i += 1
        elif _RULE.match(line):
            yield "rule", "---", 0
            i += 1
        elif "|" in line and i + 1 < len(lines) and _TABLE_RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            j = i + 2
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                j += 1
            head = cells_of(line)
            rows = [head, ["---"] * len(head), *(cells_of(x) for x in lines[i + 2 : j])]
            yield "table", "\n".join(f"| {' | '.join(r)} |" for r in rows), 0
            i = j
        elif _ITEM.match(line):
            j, items = i, []
            while j < len(lines) and lines[j].strip():
                if m := _ITEM.match(lines[j]):
                    items.append([m[2], m[3]])
                else:
                    items[-1][1] += " " + lines[j].strip()
                j += 1
            ordered = items[0][0][0].isdigit()
            yield "list", "\n".join(f"{k + 1}. {t}" if ordered else f"- {t}" for k, (_, t) in enumerate(items)), 0
            i = j
        elif line.lstrip().startswith(">"):
            j, quoted = i, []
            while j < len(lines) and lines[j].strip():
                quoted.append(re.sub(r"^\s*>\s?", "", lines[j]))
                j += 1
            yield "quote", "\n".join(f"> {x}" for x in quoted), 0
            i = j
        else:
            j, words = i, []
            while j < len(lines) and lines[j].strip() and not (_HEADING.match(lines[j]) or _FENCE.match(lines[j]) or lines[j].lstrip().startswith(">") or (j > i and (re.match(r"^(?:=+|-+)\s*$", lines[j]) or _ITEM.match(lines[j])))):
                words.append(lines[j].strip())
                j += 1
            if j < len(lines) and (m := re.match(r"^(=+|-+)\s*$", lines[j])):
                yield "heading", " ".join(words), 1 if m[1][0] == "=" else 2
                j += 1
            else:
                yield "paragraph", " ".join(words), 0
            i = j


def notes(markdown: str, soft: int = SOFT, hard: int = HARD) -> list[tuple[str | None, str, str, int | None]]:
    """(header, content, type, heading level). The header is the trail of headings; code and tables stand alone;
    pieces under one header join while the first is below soft and the sum within hard; pieces beyond hard are split
    by paragraphs, sentences and words. Headings without a body give nothing."""
    trail: list[tuple[int, str]] = []
    found: list[list] = []
    header = lambda: " > ".join(f"{'#' * n} {t}" for n, t in trail) or None
    now: list[str] = []

    def flush() -> None:
        if body := "\n\n".join(now).strip():
            found.append([header(), body, "standard", trail[-1][0] if trail else None])
        now.clear()

    for kind, body, level in blocks(markdown):
        if kind == "heading":
            flush()
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, body))
        elif kind in ("code", "table"):
            flush()
            if body.strip():
                found.append([header(), body, kind, trail[-1][0] if trail else None])
        else:
            now.append(body)
    flush()

    joined: list[list] = []
    for piece in found:
        last = joined[-1] if joined else None
        if last and last[2] == piece[2] == "standard" and last[0] == piece[0] and tokens(last[1]) < soft and tokens(last[1]) + tokens(piece[1]) <= hard:
            last[1] += "\n\n" + piece[1]
        else:
            joined.append(piece)
    return [(h, part, kind, level) for h, body, kind, level in joined for part in ([body] if kind != "standard" or tokens(body) <= hard else split_note(body, hard))]


def split_note(body: str, hard: int) -> list[str]:
    """One running piece across paragraphs, sentences and words."""
    out, now = [], ""
    for paragraph in re.split(r"\n\n+", body):
        if tokens(paragraph) <= hard:
            full, now = packed([paragraph], hard, "\n\n", now)
            out += full
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            parts = [sentence] if tokens(sentence) <= hard else sentence.split()
            full, now = packed(parts, hard, " ", now)
            out += full
    return out + ([now] if now else [])


# Domains: (check and header) of the metadata; how raw and checked metadata merge.


def need(meta: dict, *names: str) -> None:
    for name in names:
        if not isinstance(meta.get(name), str) or not meta[name].strip():
            raise ValueError(f"{name} must not be empty")


def iso(meta: dict, *names: str) -> None:
    for name in names:
        if meta.get(name) is not None and not (isinstance(meta[name], str) and _ISO.match(meta[name])):
            raise ValueError(f"{name} is not an ISO 8601 time: {meta[name]!r}")


def instant(value: str) -> pd.Timestamp:
    t = pd.Timestamp(value)
    return t.tz_localize("UTC") if t.tzinfo is None else t.tz_convert("UTC")


def ordered_times(meta: dict, a: str, b: str) -> None:
    iso(meta, a, b)
    if meta.get(a) and meta.get(b) and instant(meta[a]) > instant(meta[b]):
        raise ValueError(f"{a} is after {b}")


def not_negative(meta: dict, *names: str) -> None:
    for name in names:
        if meta.get(name) is not None and meta[name] < 0:
            raise ValueError(f"{name} is negative")


def messages(m: dict) -> str:
    need(m, "thread_id", "message_id", "sender")
    iso(m, "timestamp")
    if m.get("is_thread_root") and m.get("in_reply_to") is not None:
        raise ValueError("a thread root replies to nothing")
    return f"{m.get('subject') or '(no subject)'} — {m['sender']}"


def documents(m: dict) -> str:
    need(m, "document_id", "title", "document_type", "source_type")
    not_negative(m, "file_size_bytes")
    iso(m, "created_at", "modified_at")
    return f"{m['title']} — {m['document_type']}"


def events(m: dict) -> str:
    need(m, "event_id", "title")
    ordered_times(m, "start_date", "end_date")
    not_negative(m, "duration_minutes")
    return f"{m['title']} — {m['start_date']}" if m.get("start_date") else m["title"]


def tasks(m: dict) -> str:
    need(m, "task_id", "title")
    if m.get("status") not in TASK_STATES:
        raise ValueError(f"status must be one of {TASK_STATES}")
    if m.get("priority") is not None and m["priority"] not in (1, 2, 3, 4):
        raise ValueError("priority must be 1 to 4")
    iso(m, "due_date", "date_first_observed")
    return f"{m['title']}{' [due: ' + m['due_date'] + ']' if m.get('due_date') else ''} [{m['status']}]"


def health(m: dict) -> str:
    need(m, "record_id", "health_type", "date")
    if m["health_type"] not in HEALTH_TYPES or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", m["date"]):
        raise ValueError("health_type or date is not valid")
    not_negative(m, "steps", "sample_count", "total_sleep_minutes", "active_minutes")
    if m.get("hour") is not None and not 0 <= m["hour"] <= 23 or m.get("score") is not None and not 0 <= m["score"] <= 100:
        raise ValueError("hour or score is out of range")
    return f"{m['health_type']} — {m['date']}"


def people(m: dict) -> str:
    need(m, "contact_id", "display_name")
    return f"Contact: {m['display_name']}{' — ' + m['organization'] if m.get('organization') else ''}"


def location(m: dict) -> str:
    lat, lon = m.get("latitude"), m.get("longitude")
    if lat is None or lon is None or not -90 <= lat <= 90 or not -180 <= lon <= 180:
        raise ValueError("latitude or longitude is out of range")
    ordered_times(m, "arrival_date", "departure_date")
    not_negative(m, "duration_minutes")
    if m.get("source_type") == "current_location":
        return f"Current location — {m.get('date_first_observed')}"
    if m.get("place_name"):
        return f"{m['place_name']} — {m['arrival_date']}" if m.get("arrival_date") else m["place_name"]
    return f"{lat}, {lon}"


#: Fields that a domain's metadata keeps where unknown fields are dropped.
KNOWN = {
    "messages": ("thread_id", "message_id", "sender", "recipients", "timestamp", "in_reply_to", "subject", "is_thread_root", "is_from_me"),
    "tasks": ("task_id", "title", "status", "due_date", "priority", "dependencies", "collaborators", "date_first_observed", "source_type"),
    "documents": ("document_id", "title", "document_type", "source_type", "date_first_observed", "created_at", "modified_at", "file_size_bytes", "author", "tags", "directory_hierarchy", "album", "genre", "play_count", "duration_minutes", "video_id", "channel", "channel_id", "url", "published_at"),
    "people": ("contact_id", "display_name", "given_name", "family_name", "emails", "phones", "organization", "job_title", "notes", "source_type", "extended_fields"),
}
#: domain: (header, unknown fields kept, nulls kept)
DOMAINS: dict[str, tuple[Callable[[dict], str], bool, bool]] = {
    "messages": (messages, False, True),
    "tasks": (tasks, False, True),
    "events": (events, True, True),
    "health": (health, True, False),
    "documents": (documents, False, False),
    "people": (people, False, True),
    "location": (location, True, False),
}


def merged_metadata(domain: str, raw: dict) -> dict:
    _, unknown, nulls = DOMAINS[domain]
    out = dict(raw) if unknown else {k: raw.get(k) for k in KNOWN[domain]}
    return out if nulls else {k: v for k, v in out.items() if v is not None}


def chunk_item(domain: str, markdown: str, metadata: str | None) -> list[tuple]:
    """(content, header, type, metadata as JSON) of one item."""
    raw = json.loads(metadata) if metadata else {}
    if domain == "notes":
        return [(body, header, kind, json.dumps({**raw, **({"heading_level": level} if level else {})})) for header, body, kind, level in notes(markdown)]
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain: {domain}")
    if not raw:
        raise ValueError(f"{domain} items need metadata")
    header = DOMAINS[domain][0](raw)
    body = own_words(markdown) if domain == "messages" else markdown.strip()
    kept = json.dumps(merged_metadata(domain, raw), ensure_ascii=False)
    return [(part, header, "standard", kept) for part in split_text(body)] if body else []


def chunked(items: DataFrame) -> DataFrame:
    """items (source_id, domain, markdown, extra_metadata, ...) to their columns but markdown, with CHUNK_SCHEMA and
    the hash. An empty item gives a row with index -1: a tombstone's source is still seen."""
    keep = [c for c in items.columns if c not in ("markdown", "extra_metadata")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                base = tuple(getattr(row, c) for c in keep)
                try:
                    parts = chunk_item(row.domain, row.markdown or "", row.extra_metadata) if (row.markdown or "").strip() else []
                    out += [(*base, i, *p, None) for i, p in enumerate(parts)] or [(*base, -1, None, None, None, None, None)]
                except (ValueError, TypeError, KeyError) as e:
                    out.append((*base, -1, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*keep, "chunk_index", "content", "context_header", "chunk_type", "domain_metadata", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in keep), CHUNK_SCHEMA])
    return items.mapInPandas(run, schema).withColumn("chunk_hash", X.content_hash(F.col("content")))


def line_hashes(markdown: str) -> Column:
    """The hashes of the lines of the markdown, in order."""
    return X.line_hashes(F.col(markdown))


def first_lines(markdown: str, hashes: str) -> Column:
    """Array of (chunk_hash, chunk_index, content): of the lines of one hash the first. Sorted, a line is compared with
    the one before, so no list is searched for each line."""
    lines = F.transform(F.arrays_zip(F.col(hashes).alias("h"), X.lines(F.col(markdown)).alias("c")), lambda x, i: F.struct(x["h"].alias("chunk_hash"), i.alias("chunk_index"), x["c"].alias("content")))
    order = F.sort_array(lines)
    before = F.concat(F.array(F.lit(None).cast("struct<chunk_hash:string,chunk_index:int,content:string>")), order)
    return F.filter(F.zip_with(order, before, lambda x, b: F.when(b.isNull() | (b["chunk_hash"] != x["chunk_hash"]), x)), lambda x: x.isNotNull())


def line_chunks(items: DataFrame) -> DataFrame:
    """Chunks that are the lines of the markdown; native, for corpora whose lines are their units."""
    pos = items.select(*[c for c in items.columns if c != "markdown"], F.posexplode(X.lines(F.col("markdown"))).alias("chunk_index", "content"))
    return pos.withColumn("chunk_hash", X.content_hash(F.col("content")))


def cross_refs(chunks: DataFrame, keys: tuple[str, ...] = ("source_id", "source_version"), reach: int = 3) -> DataFrame:
    """chunks with cross_refs: hashes of up to ``reach`` chunks before or after that the words refer to, sorted."""
    w = Window.partitionBy(*keys).orderBy("chunk_index")
    near = lambda a, b: F.collect_list("chunk_hash").over(w.rowsBetween(a, b))
    before, after = X.refers(F.col("content"))
    none: Column = F.array().cast("array<string>")
    both = F.concat(F.when(before, near(-reach, -1)).otherwise(none), F.when(after, near(1, reach)).otherwise(none))
    return chunks.withColumn("cross_refs", F.sort_array(F.array_remove(F.array_distinct(both), F.col("chunk_hash"))))
