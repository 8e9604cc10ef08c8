"""Readers: one function for each family of sources, from files of its wire records to normalised items.

Every reader returns (items, rejects). items have ITEM columns; rejects have (adapter_id, record, reason): a malformed
record is set aside and the rest goes on. Records are read with explicit schemas, as text first, so that a wrong type
rejects a record and not the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scores
from tidemark.functions import text as X
from tidemark.operators.analytics import hourly, latest_watch
from tidemark.plans.store import Store
from tidemark.sources.changes import Snapshots
from tidemark.sources.markup import html_markdown
from tidemark.sources.office import MOST_BYTES, OFFICE, office_markdown

ITEM = ("source_id", "adapter_id", "domain", "origin_ref", "display_name", "poll_strategy", "poll_interval_sec", "normalizer_version", "markdown", "extra_metadata")
Both = tuple[DataFrame, DataFrame]


def json_lines(spark: SparkSession, path: str | list[str], schema: str, file: str | None = None) -> DataFrame:
    """(raw, r): each line, and the record it holds; r is null where it holds none. Also its file, under that name."""
    kind = T._parse_datatype_string(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    named = [F.col("_metadata.file_path").alias(file)] if file else []
    return lines.select(F.col("value").alias("raw"), F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r"), *named)


def metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def made(rows: DataFrame, adapter_id: str, domain: str, source_id: Column, markdown: Column, meta: Column, sound: Column, name: Column | None = None, origin: Column | None = None, strategy: str = "pull") -> Both:
    """Items of the rows that are sound and have an id, and the others as rejects."""
    none = F.lit(None).cast("string")
    good = F.coalesce(sound & source_id.isNotNull() & (source_id != ""), F.lit(False))
    items = rows.where(good).select(
        source_id.alias("source_id"), F.lit(adapter_id).alias("adapter_id"), F.lit(domain).alias("domain"), (origin if origin is not None else none).alias("origin_ref"), (name if name is not None else none).alias("display_name"),
        F.lit(strategy).alias("poll_strategy"), F.lit(None).cast("int").alias("poll_interval_sec"), F.lit("1").alias("normalizer_version"), F.coalesce(markdown, F.lit("")).alias("markdown"), meta.alias("extra_metadata"))
    return items, rows.where(~good).select(F.lit(adapter_id).alias("adapter_id"), F.col("raw").alias("record"), F.lit("malformed").alias("reason"))


def joined(*parts: Both) -> Both:
    items, rejects = parts[0]
    for a, b in parts[1:]:
        items, rejects = items.unionByName(a), rejects.unionByName(b)
    return items, rejects


def filled(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & (c.cast("string") != "")
    return out


def r(name: str) -> Column:
    return F.col(f"r.{name}")


def join_text(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


# Files and notes


def listed(spark: SparkSession, folder: str, pattern: str = "*", binary: bool = False) -> DataFrame:
    """(raw, path, inner, at, size) of the files below a folder, which may have any name; inner: the path inside it. raw
    is text, or bytes."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = Path(folder)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    reader, place = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern), re.sub(r"([\[\]{}*?\\])", r"\\\1", folder)
    rows = reader.format("binaryFile").load(place).withColumnRenamed("content", "value") if binary else reader.text(place, wholetext=True)
    # Spark tells paths as URIs, with percent signs; a plus is a plus there
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = rows.select(F.col("value").alias("raw"), path.alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("length" if binary else "_metadata.file_size").alias("size"))
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "")
    return rows.withColumn("inner", F.substr(plain, F.lit(len(top) + 2)))


#: Files that are read, with the type that their items name.
FORMATS = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", **OFFICE}


def files(spark: SparkSession, folder: str, adapter_id: str = "files:local", pattern: str = "*", extensions: tuple[str, ...] = ("md",)) -> Both:
    """Files below a folder with one of the extensions (of FORMATS, either case); HTML, office files, tables, books and
    archives become markdown, other text stays as it is. The id is the path inside the folder. An extension that can't be
    read is an error; a file that can't be converted is a reject, whose record is its path."""
    kinds = {e.lower().lstrip("."): FORMATS.get(e.lower().lstrip(".")) for e in extensions}
    if unknown := [e for e, kind in kinds.items() if kind is None]:
        raise ValueError(f"no reader for {unknown}; there are {sorted(FORMATS)}")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    inner = F.col("inner")
    meta = metadata(document_id=inner, title=X.file_name(inner), document_type=F.col("kind"), source_type=F.lit("filesystem"), file_size_bytes=F.col("size"), modified_at=F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def read(types: set[str], binary: bool) -> DataFrame:
        return listed(spark, folder, pattern, binary).withColumn("kind", kind).where(F.col("kind").isin(*types))

    def items(rows: DataFrame, body: Column, sound: Column) -> Both:
        return made(rows, adapter_id, "documents", inner, body, meta, sound, X.file_name(inner), F.col("path"))

    parts, wanted, office = [], set(kinds.values()), set(OFFICE.values())
    if wanted - office:
        body = F.when(F.col("kind") == "text/html", html_markdown(F.col("raw"))).otherwise(F.col("raw"))
        parts.append(items(read(wanted - office, False), body, F.lit(True)))
    if wanted & office:
        rows = read(wanted & office, True)
        done = rows.where(F.col("size") <= MOST_BYTES).withColumn("md", office_markdown(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.col("raw"))).withColumn("raw", F.col("path"))
        parts.append(items(done, F.col("md"), F.col("md").isNotNull()))
        # the bytes of larger files are never read
        parts.append(items(rows.where(F.col("size") > MOST_BYTES).withColumn("raw", F.col("path")), F.lit(None).cast("string"), F.lit(False)))
    return joined(*parts)


def file_feed(spark: SparkSession, path: str | list[str], adapter_id: str = "files:feed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """An NDJSON feed of one or more pages, a file each: canonical records, delete marks, and a last line with the
    cursor. Returns (items, rejects, trailers), a trailer for each page; a delete is an item with empty markdown. Any
    page without a trailer was cut off: an error, so that no cursor moves past rows that never came."""
    rows = json_lines(spark, path, "op string, source_id string, markdown string, modified_at string, has_more boolean, next_cursor string, extra_metadata string", "page")
    trailer = rows.where("r.has_more IS NOT NULL").select("page", r("has_more").alias("has_more"), r("next_cursor").alias("next_cursor"))
    plain = lambda file: re.sub("^([^:/]+):/+", r"\1:/", unquote(file))  # noqa: E731  Spark writes file:/ and file:///
    pages = {plain(f) for f in spark.read.text(path).inputFiles()}
    cut = pages - {plain(x.page) for x in trailer.select("page").distinct().toLocalIterator()}
    if cut or not pages:
        raise ValueError(f"the feed was cut off, it has no last line: {sorted(cut)[:10]}")
    body = rows.where("r.has_more IS NULL OR r IS NULL")
    meta = F.coalesce(r("extra_metadata"), metadata(document_id=r("source_id"), title=X.file_name(r("source_id")), document_type=F.lit("text/markdown"), source_type=F.lit("filesystem"), modified_at=r("modified_at")))
    items, rejects = made(body, adapter_id, "documents", r("source_id"), F.when(F.coalesce(r("op"), F.lit("")) != "delete", r("markdown")), meta, r("markdown").isNotNull() | (r("op") == "delete"), origin=r("source_id"), strategy="push")
    return items, rejects, trailer


def drained(trailers: DataFrame) -> tuple[str | None, bool]:
    """(cursor to go on from, whether the feed is drained) of file_feed's pages, which follow each other by name. A page
    that says that nothing follows, but isn't the last, is an error: what comes after it belongs to another feed."""
    pages = [(r.page, r.has_more, r.next_cursor) for r in trailers.orderBy("page").select("page", "has_more", "next_cursor").collect()]  # one for each page
    if early := [p for p, more, _ in pages[:-1] if not more]:
        raise ValueError(f"pages follow the end of the feed: {early[:10]}")
    return (pages[-1][2], not pages[-1][1]) if pages else (None, False)


FRONT = r"\A---\n(?s:(.*?))\n---\n?"


def front_list(front: Column, key: str) -> Column:
    """A YAML list or string of the front matter, as an array."""
    inline = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t].*\n?)+)", 1)
    one = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*([^\[\n]+)$", 1)
    clean = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")), lambda x: x != "")
    return F.when(inline != "", clean(F.split(inline, ","))).when(block != "", clean(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]*", "")))).when(one != "", clean(F.array(one))).otherwise(F.array().cast("array<string>"))


def inline_fields(body: Column) -> Column:
    """Key:: Value fields as a map; keys in lower case with underscores; the first of a key counts."""
    pattern = r"\[?(\w+(?:[-\s]\w+)*)\s*::\s*([^\n\]]+)"
    keys = F.transform(F.regexp_extract_all(body, F.lit(pattern), 1), lambda x: F.regexp_replace(F.lower(x), r"[ \-]", "_"))
    values = F.transform(F.regexp_extract_all(body, F.lit(pattern), 2), lambda x: F.trim(x))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_arrays(F.transform(firsts, lambda p: p["k"]), F.transform(firsts, lambda p: p["v"]))


def vault(spark: SparkSession, folder: str, adapter_id: str = "vault:local") -> Both:
    """A vault of linked notes: front matter, inline fields, links out and links back."""
    return linked_notes(listed(spark, folder, "*.md").select("raw", F.col("inner").alias("path")), adapter_id)


def vault_json(spark: SparkSession, path: str, adapter_id: str = "vault:remote") -> Both:
    """A vault as a service hands it out: a line for each note, {path, content}; malformed lines are rejects."""
    lines = json_lines(spark, path, "path string, content string")
    sound = F.coalesce(filled(r("path")) & r("content").isNotNull(), F.lit(False))
    items, _ = linked_notes(lines.where(sound).select(r("content").alias("raw"), r("path").alias("path")), adapter_id)
    return items, lines.where(~sound).select(F.lit(adapter_id).alias("adapter_id"), F.col("raw").alias("record"), F.lit("malformed").alias("reason"))


def linked_notes(rows: DataFrame, adapter_id: str) -> Both:
    """Notes (raw, path) with front matter, inline fields, links out and links back."""
    rows = rows.withColumns({"front": F.regexp_extract("raw", FRONT, 1), "body": F.regexp_replace("raw", FRONT, "")})
    rows = rows.withColumns({"name": F.regexp_replace(X.file_name(F.col("path")), r"\.md$", ""), "wikilinks": X.wikilinks(F.col("body"))})
    edges = rows.select(F.col("name").alias("src"), F.explode("wikilinks").alias("dst"))
    back = edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("backlinks"))
    rows = rows.join(back, F.col("name") == F.col("dst"), "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))
    meta = metadata(tags=front_list(F.col("front"), "tags"), aliases=front_list(F.col("front"), "aliases"), dataview_fields=inline_fields(F.col("body")), wikilinks=F.col("wikilinks"), backlinks=F.col("backlinks"))
    return made(rows, adapter_id, "notes", F.col("path"), F.col("body"), meta, F.lit(True), F.col("name"), F.col("path"))


#: Marks of checkboxes and lanes, and signs of priorities.
BOX = {" ": "open", "x": "completed", "/": "in-progress", "-": "cancelled"}
LANES = {"done": "completed", "complete": "completed", "completed": "completed", "in progress": "in-progress", "doing": "in-progress"}
SIGNS = {"🔺": 1, "⏫": 2, "🔼": 3, "🔽": 4}


def mapped(c: Column, table: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def vault_tasks(spark: SparkSession, folder: str, adapter_id: str = "vault-tasks:local") -> Both:
    """Checkbox lines of a vault; on a board, the lane's heading gives an open box its state. The text is the title."""
    from pyspark.sql.window import Window

    rows = listed(spark, folder, "*.md")
    lines = rows.select(F.col("inner").alias("path"), F.col("raw").rlike(r"(?m)^kanban-plugin:").alias("board"), F.posexplode(F.split("raw", "\n")).alias("i", "raw"))
    lane = F.last(F.when(F.col("raw").rlike(r"^#{2,3}\s"), F.lower(F.trim(F.regexp_replace("raw", r"^#{2,3}\s+", "")))), True).over(Window.partitionBy("path").orderBy("i"))
    tasks = lines.withColumn("lane", lane).where(F.col("raw").rlike(r"^\s*- \[[^\]]*\] .+$"))
    text, mark = F.regexp_extract("raw", r"^\s*- \[([^\]]*)\] (.+)$", 2), F.lower(F.regexp_extract("raw", r"^\s*- \[([^\]]*)\] (.+)$", 1))
    status = F.when(F.col("board") & (mark == " "), mapped(F.col("lane"), LANES, F.lit("open"))).otherwise(mapped(mark, BOX, F.lit("open")))
    due = X.or_else(F.regexp_extract(text, r"📅 (\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(text, r"\[due:: (\d{4}-\d{2}-\d{2})\]", 1))
    sign = F.regexp_extract(text, "(🔺|⏫|🔼|🔽)", 1)
    deps = F.concat(F.regexp_extract_all(text, F.lit(r"⛔ ([a-zA-Z0-9_\-/]+)"), 1), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[depends:: ([^\]]+)\]"), 1), lambda x: F.split(x, r"\s*,\s*"))))
    title = F.trim(F.regexp_replace(F.regexp_replace(text, r"📅 \d{4}-\d{2}-\d{2}|⛔ [a-zA-Z0-9_\-/]+|🔺|⏫|🔼|🔽|\[(?:due|depends):: [^\]]*\]", ""), r"\s+", " "))
    tasks = tasks.withColumn("id", F.concat("path", F.lit("/"), (F.col("i") + 1).cast("string")))
    meta = metadata(task_id=F.col("id"), title=title, status=status, due_date=due, priority=mapped(sign, SIGNS, F.lit(None).cast("int")), dependencies=deps)
    return made(tasks, adapter_id, "tasks", F.col("id"), title, meta, title != "", title, F.col("path"))


def notes(spark: SparkSession, path: str, adapter_id: str = "notes:local", folder: str | None = None) -> Both:
    rows = json_lines(spark, path, "id string, title string, body_markdown string, created_at string, modified_at string, folder string")
    rows = rows if folder is None else rows.where(r("folder") == folder)
    zoned = lambda c: F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("+00:00")))
    meta = metadata(title=r("title"), created_at=zoned(r("created_at")), modified_at=zoned(r("modified_at")), folder=r("folder"))
    return made(rows, adapter_id, "notes", r("id"), r("body_markdown"), meta, filled(r("id")) & r("body_markdown").isNotNull(), r("title"))


# Messages


def chat(spark: SparkSession, path: str, adapter_id: str = "chat:local") -> Both:
    rows = json_lines(spark, path, "id string, text string, sender string, timestamp string, thread_id string, recipients array<string>, is_from_me boolean")
    meta = metadata(thread_id=r("thread_id"), message_id=r("id"), sender=r("sender"), recipients=F.coalesce(r("recipients"), F.array().cast("array<string>")), timestamp=r("timestamp"), in_reply_to=F.lit(None).cast("string"), subject=F.lit(None).cast("string"), is_thread_root=F.lit(False))
    body = F.concat(F.lit("**"), r("sender"), F.lit("** ("), r("timestamp"), F.lit(")\n\n"), r("text"))
    return made(rows, adapter_id, "messages", F.concat_ws("/", r("thread_id"), r("id")), body, meta, filled(r("id"), r("thread_id"), r("sender"), r("timestamp")) & r("text").isNotNull())


def mail(spark: SparkSession, path: str, account: str = "main") -> Both:
    rows = json_lines(spark, path, "id string, threadId string, messageId string, from struct<name:string, address:string>, to array<struct<name:string, address:string>>, subject string, date string, inReplyTo string, text string, html string")
    ids = lambda c: X.or_else(c, r("id"))
    sender = X.or_else(F.lower(r("from.address")), r("from.name"))
    meta = metadata(thread_id=ids(r("threadId")), message_id=ids(r("messageId")), sender=sender, recipients=F.coalesce(F.transform(r("to"), lambda x: F.lower(x["address"])), F.array().cast("array<string>")), timestamp=r("date"), in_reply_to=r("inReplyTo"), subject=r("subject"), is_thread_root=r("inReplyTo").isNull())
    body = F.coalesce(F.when(r("html") != "", html_markdown(r("html"))), r("text"))
    return made(rows, f"email:{account}", "messages", F.concat(F.lit(f"email:{account}:"), r("id")), body, meta, filled(r("id"), sender, r("date")), r("subject"))


# Calendars, contacts, tasks


def calendar(spark: SparkSession, path: str, adapter_id: str = "calendar:local") -> Both:
    rows = json_lines(spark, path, "id string, title string, notes string, startDate string, endDate string, isAllDay boolean, calendar string, location string, status string, lastModified string, attendees array<struct<name:string, email:string>>, recurrence string")
    who = F.transform(r("attendees"), lambda x: F.when(filled(x["name"], x["email"]), F.concat(x["name"], F.lit(" <"), x["email"], F.lit(">"))).otherwise(F.coalesce(x["email"], x["name"])))
    minutes = scores.duration_minutes(F.to_timestamp(r("startDate")), F.to_timestamp(r("endDate")))
    meta = metadata(event_id=r("id"), title=r("title"), start_date=r("startDate"), end_date=r("endDate"), duration_minutes=minutes, invitees=F.coalesce(who, F.array().cast("array<string>")), location=r("location"), calendar=r("calendar"), status=r("status"), is_all_day=r("isAllDay"), recurrence=r("recurrence"), source_type=F.lit("calendar"))
    return made(rows, adapter_id, "events", F.concat_ws("/", r("calendar"), r("id")), join_text(r("title"), r("notes")), meta, filled(r("id"), r("title"), r("startDate")), r("title"))


def unfolded(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]", "")


def prop(block: Column, name: str) -> Column:
    value = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
    return F.when(value != "", F.replace(F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")))


def props(block: Column, name: str) -> Column:
    return F.regexp_extract_all(block, F.lit(rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$"), 1)


def ical_time(value: Column) -> Column:
    """YYYYMMDD[THHMMSS[Z]] as ISO; a day is its midnight, UTC."""
    day = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3T00:00:00Z")
    return F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6Z")


def ical(spark: SparkSession, folder: str, adapter_id: str = "caldav:local", changed_after: str | None = None) -> Both:
    """VEVENTs of .ics files. changed_after drops those with an older LAST-MODIFIED; one that can't be read stays."""
    rows = spark.read.option("pathGlobFilter", "*.ics").text(folder, wholetext=True)
    return ical_events(rows, adapter_id, changed_after)


def ical_events(rows: DataFrame, adapter_id: str, changed_after: str | None = None) -> Both:
    """VEVENTs of calendar texts (value). One without UID or SUMMARY can't be named: it is rejected."""
    ev = rows.select(F.explode(F.regexp_extract_all(unfolded(F.col("value")), F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)).alias("raw"))
    b = F.col("raw")
    start, end = ical_time(prop(b, "DTSTART")), ical_time(prop(b, "DTEND"))
    given = prop(b, "DURATION")
    part = lambda unit: F.coalesce(F.try_element_at(F.regexp_extract_all(given, F.lit(rf"(\d+){unit}"), 1), F.lit(1)).cast("int"), F.lit(0))
    spoken = F.when(given.isNotNull(), part("W") * 10080 + part("D") * 1440 + part("H") * 60 + part("M"))
    minutes = F.coalesce(spoken, scores.duration_minutes(F.to_timestamp(start), F.to_timestamp(end)))
    host = prop(b, "ORGANIZER")
    meta = metadata(event_id=prop(b, "UID"), title=prop(b, "SUMMARY"), start_date=start, end_date=end, duration_minutes=minutes, host=host, invitees=F.filter(props(b, "ATTENDEE"), lambda x: host.isNull() | (x != host)), source_type=F.lit("caldav"))
    if changed_after is not None:
        at = F.try_to_timestamp(ical_time(prop(b, "LAST-MODIFIED")))
        ev = ev.where(at.isNull() | (at > F.to_timestamp(F.lit(changed_after))))
    return made(ev, adapter_id, "events", prop(b, "UID"), join_text(F.coalesce(prop(b, "SUMMARY"), F.lit("")), F.coalesce(prop(b, "DESCRIPTION"), F.lit(""))), meta, filled(F.trim(prop(b, "UID")), F.trim(prop(b, "SUMMARY")), start), prop(b, "SUMMARY"))


def calendar_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(href, etag, value, start, end) of the .ics files of a folder, for changes.Snapshots: the name is the href, the
    hash of the text the etag; start and end are those of the file's first event."""
    rows = listed(spark, folder, "*.ics")
    b = F.regexp_extract(unfolded(F.col("raw")), r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT", 1)
    return rows.select(F.col("inner").alias("href"), F.sha2("raw", 256).alias("etag"), F.col("raw").alias("value"), ical_time(prop(b, "DTSTART")).alias("start"), ical_time(prop(b, "DTEND")).alias("end"))


def ical_sync(snapshots: Snapshots, token: str | None, since: str | None, adapter_id: str = "caldav:local") -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """(items, rejects, removed hrefs, next token) of the calendar since a token, or since a time where the token has
    expired. Either way events whose LAST-MODIFIED isn't after ``since`` don't come again."""
    delta = snapshots.sync(token, since)
    items, rejects = ical_events(delta.items.where("kind = 'upserted'").select("value"), adapter_id, since)
    return items, rejects, delta.items.where("kind = 'removed'").select("href"), delta.token


def contact_text(name: Column, org: Column, title: Column, notes_: Column) -> Column:
    """What is said of a person; addresses and numbers are left to the metadata."""
    work = F.when(filled(org, title), F.concat(title, F.lit(" at "), org)).otherwise(F.coalesce(org, title))
    return join_text(name, F.coalesce(work, F.lit("")), F.coalesce(notes_, F.lit("")))


def vcards(spark: SparkSession, folder: str, adapter_id: str = "vcard:local") -> Both:
    """Cards of .vcf files. The id is UID, or the hash of the name and first address; two cards of one id are an
    error, as one would hide the other."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.vcf").load(folder)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    cards = rows.select(F.explode(F.regexp_extract_all(unfolded(text), F.lit(r"(?s)BEGIN:VCARD\n(.*?)END:VCARD"), 1)).alias("raw"))
    b = F.col("raw")
    name, emails = prop(b, "FN"), props(b, "(?:item\\d+\\.)?EMAIL")
    id_ = F.coalesce(prop(b, "UID"), F.sha2(F.concat(name, F.coalesce(F.try_element_at(emails, F.lit(1)), F.lit(""))), 256))
    cards = cards.withColumn("id", id_)
    if twice := cards.groupBy("id").count().where("count > 1").take(1):
        raise ValueError(f"two cards have the id {twice[0].id}")
    org = F.regexp_replace(prop(b, "ORG"), ";+$", "")
    meta = metadata(contact_id=F.col("id"), display_name=name, emails=X.distinct_emails(emails), phones=X.distinct_phones(props(b, "(?:item\\d+\\.)?TEL")), organization=org, job_title=prop(b, "TITLE"), notes=prop(b, "NOTE"))
    return made(cards, adapter_id, "people", F.col("id"), contact_text(name, org, prop(b, "TITLE"), prop(b, "NOTE")), meta, filled(name), name)


def contacts(spark: SparkSession, path: str, adapter_id: str = "contacts:local") -> Both:
    rows = json_lines(spark, path, "id string, displayName string, givenName string, familyName string, emails array<string>, phones array<string>, organization string, jobTitle string, notes string, modifiedAt string")
    meta = metadata(contact_id=r("id"), display_name=r("displayName"), given_name=r("givenName"), family_name=r("familyName"), emails=X.distinct_emails(r("emails")), phones=X.distinct_phones(r("phones")), organization=r("organization"), job_title=r("jobTitle"), notes=r("notes"))
    return made(rows, adapter_id, "people", r("id"), contact_text(r("displayName"), r("organization"), r("jobTitle"), r("notes")), meta, filled(r("id"), r("displayName")) & r("emails").isNotNull() & r("phones").isNotNull(), r("displayName"))


def reminders(spark: SparkSession, path: str, adapter_id: str = "reminders:local") -> Both:
    rows = json_lines(spark, path, "id string, title string, notes string, list string, completed boolean, completionDate string, dueDate string, priority int, modifiedAt string, collaborators array<string>")
    meta = metadata(task_id=r("id"), title=r("title"), status=F.when(r("completed"), "completed").otherwise("open"), due_date=r("dueDate"), priority=scores.task_priority(r("priority")), collaborators=F.coalesce(r("collaborators"), F.array().cast("array<string>")), source_type=F.lit("reminders"))
    return made(rows, adapter_id, "tasks", F.concat_ws("/", r("list"), r("id")), join_text(r("title"), r("notes")), meta, filled(r("id"), r("title")) & F.coalesce(r("priority"), F.lit(0)).between(0, 9), r("title"))


# Health


def heart_rate(spark: SparkSession, path: str, adapter_id: str) -> Both:
    """Samples by the hour that their timestamps show."""
    rows = json_lines(spark, path, "timestamp string, bpm double, source string")
    sound = F.coalesce(r("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & r("bpm").isNotNull(), F.lit(False))
    hours = hourly(rows.where(sound).select(r("timestamp").alias("timestamp"), r("bpm").alias("bpm"))).withColumn("raw", F.lit(None).cast("string"))
    id_ = F.format_string("heart_rate/%sT%02d", "date", "hour")
    body = F.format_string("Heart rate on %s, %02d:00: average %.0f, from %.0f to %.0f bpm in %d samples", "date", "hour", "avg_value", "min_value", "max_value", "sample_count")
    meta = metadata(record_id=id_, health_type=F.lit("heart_rate_series"), date=F.col("date"), hour=F.col("hour"), avg_heart_rate=F.col("avg_value"), min_heart_rate=F.col("min_value"), max_heart_rate=F.col("max_value"), sample_count=F.col("sample_count"))
    items, _ = made(hours, adapter_id, "health", id_, body, meta, F.lit(True))
    return items, rows.where(~sound).select(F.lit(adapter_id).alias("adapter_id"), F.col("raw").alias("record"), F.lit("malformed").alias("reason"))


#: health type: (schema, day, fields of the metadata, fields that must be there). A field with several names takes the
#: first that is there and not empty.
HEALTH: dict[str, tuple[str, tuple[str, ...], dict[str, tuple[str, ...]]]] = {
    "sleep_summary": ("id string, date string, day string, score int, totalSleepMinutes int, total_sleep_minutes int, deepSleepMinutes int, remSleepMinutes int, lightSleepMinutes int, inBedMinutes int, efficiency double", ("date", "day"), {"score": ("score",), "total_sleep_minutes": ("totalSleepMinutes", "total_sleep_minutes"), "deep_sleep_minutes": ("deepSleepMinutes",), "rem_sleep_minutes": ("remSleepMinutes",), "light_sleep_minutes": ("lightSleepMinutes",), "in_bed_minutes": ("inBedMinutes",), "efficiency": ("efficiency",)}),
    "readiness_summary": ("id string, date string, day string, score int, temperatureDeviation double, temperature_deviation double, restingHeartRate double, hrvBalance double", ("date", "day"), {"score": ("score",), "temperature_deviation": ("temperatureDeviation", "temperature_deviation"), "resting_heart_rate": ("restingHeartRate",), "hrv_balance": ("hrvBalance",)}),
    "activity_summary": ("id string, date string, day string, score int, steps int, activeCalories double, active_calories double, activeMinutes int, distance double", ("date", "day"), {"score": ("score",), "steps": ("steps",), "active_calories": ("activeCalories", "active_calories"), "active_minutes": ("activeMinutes",), "distance": ("distance",)}),
    "workout_session": ("id string, activityType string, activity string, startDate string, endDate string, day string, durationSeconds double, totalEnergyBurned double, calories double, totalDistance double, averageHeartRate double, notes string", ("startDate", "day"), {"activity_type": ("activityType", "activity"), "duration_seconds": ("durationSeconds",), "calories": ("totalEnergyBurned", "calories"), "distance": ("totalDistance",), "avg_heart_rate": ("averageHeartRate",)}),
    "spo2_summary": ("id string, date string, day string, avgSpo2 double, average double", ("date", "day"), {"avg_spo2": ("avgSpo2", "average")}),
    "mindfulness_session": ("id string, startDate string, endDate string, day string, durationSeconds double, sessionType string, type string", ("startDate", "day"), {"duration_seconds": ("durationSeconds",), "session_type": ("sessionType", "type")}),
    "user_health_tag": ("id string, date string, day string, tag string, text string", ("date", "day"), {"tag": ("tag", "text")}),
}


def health(spark: SparkSession, path: str, adapter_id: str, kind: str) -> Both:
    schema, dates, fields = HEALTH[kind]
    rows = json_lines(spark, path, schema)
    pick = lambda names: F.coalesce(*[F.when(r(n).cast("string") != "", r(n)) for n in names])
    day = F.substring(pick(dates), 1, 10)
    values = {k: scores.as_percent(pick(v)) if k == "efficiency" else pick(v) for k, v in fields.items()}
    said = F.concat_ws(", ", *[F.when(c.isNotNull(), F.concat(F.lit(k.replace("_", " ") + " "), c.cast("string"))) for k, c in values.items()])
    body = F.concat(F.initcap(F.lit(kind.replace("_", " "))), F.lit(" on "), day, F.lit(": "), said)
    meta = metadata(record_id=r("id"), health_type=F.lit(kind), date=day, **values)
    return made(rows, adapter_id, "health", F.concat(F.lit(f"{kind}/"), r("id")), body, meta, filled(r("id"), day) & day.rlike(r"^\d{4}-\d{2}-\d{2}$"))


# Music, podcasts, screens, browsers, places, videos


def tracks(spark: SparkSession, path: str, adapter_id: str = "music:local", library: bool = False) -> Both:
    """Tracks as documents; from a library also an event for each that was played."""
    rows = json_lines(spark, path, "id string, title string, artist string, album string, genre string, duration_seconds double, play_count int, played_at string")
    body = F.concat_ws("\n", r("title"), F.concat(F.lit("Artist: "), r("artist")), F.concat(F.lit("Album: "), r("album")), F.concat(F.lit("Genre: "), r("genre")))
    sound = filled(r("id"), r("title"))
    doc = metadata(document_id=r("id"), title=r("title"), document_type=F.lit("music_track"), source_type=F.lit("music"), author=r("artist"), album=r("album"), genre=r("genre"), play_count=r("play_count"))
    out = made(rows, adapter_id, "documents", F.concat(F.lit("track/"), r("id")), body, doc, sound, r("title"))
    if not library:
        return out
    event = metadata(event_id=F.concat(F.lit("play/"), r("id"), F.lit("/"), r("played_at")), title=r("title"), start_date=r("played_at"), artist=r("artist"), source_type=F.lit("music"))
    played = rows.where(r("played_at") != "")
    return out[0].unionByName(made(played, adapter_id, "events", F.concat(F.lit("play/"), r("id"), F.lit("/"), r("played_at")), F.concat(F.lit("Played "), r("title")), event, sound, r("title"))[0]), out[1]


def podcasts(spark: SparkSession, listens: str, transcripts: str, adapter_id: str = "podcasts:local") -> Both:
    schema = "id string, showTitle string, episodeTitle string, episodeGuid string, feedUrl string, listenedAt string, durationSeconds double, playedSeconds double, completed boolean, transcript string, publishedDate string"
    heard, said = json_lines(spark, listens, schema), json_lines(spark, transcripts, schema)
    title = F.concat_ws(" — ", r("showTitle"), r("episodeTitle"))
    event = metadata(event_id=r("id"), title=title, start_date=r("listenedAt"), duration_minutes=F.round(r("playedSeconds") / 60).cast("int"), completed=r("completed"), source_type=F.lit("podcast"))
    doc = metadata(document_id=r("id"), title=title, document_type=F.lit("podcast_transcript"), source_type=F.lit("podcast"), created_at=r("publishedDate"))
    a = made(heard, adapter_id, "events", F.concat(F.lit("listen/"), r("id")), F.concat(F.lit("Listened to "), title), event, filled(r("id"), r("episodeTitle"), r("listenedAt")), title)
    some = said.where(F.coalesce(F.trim(r("transcript")) != "", F.lit(True)))
    return joined(a, made(some, adapter_id, "documents", F.concat(F.lit("transcript/"), r("id")), r("transcript"), doc, filled(r("id"), r("transcript"), r("episodeTitle")), title))


def screen_time(spark: SparkSession, usage: str, locks: str, adapter_id: str = "screen:local") -> Both:
    u = json_lines(spark, usage, "date string, bundleId string, appName string, durationSeconds double")
    k = json_lines(spark, locks, "timestamp string, eventType string")
    minutes = F.round(r("durationSeconds") / 60).cast("int")
    use = metadata(event_id=F.concat_ws("/", r("bundleId"), r("date")), title=r("appName"), start_date=r("date"), duration_minutes=minutes, source_type=F.lit("app_usage"))
    lock = metadata(event_id=F.concat_ws("/", r("eventType"), r("timestamp")), title=F.concat(F.lit("Screen "), r("eventType")), start_date=r("timestamp"), source_type=F.lit("screen_lock"))
    return joined(
        made(u, adapter_id, "events", F.concat(F.lit("usage/"), F.concat_ws("/", r("bundleId"), r("date"))), F.concat(r("appName"), F.lit(": "), scores.duration_label(minutes)), use, filled(r("date"), r("bundleId"), r("appName")) & (r("durationSeconds") >= 0), r("appName")),
        made(k, adapter_id, "events", F.concat(F.lit("lock/"), r("timestamp")), F.concat(F.lit("Screen "), r("eventType")), lock, r("eventType").isin("lock", "unlock") & filled(r("timestamp"))))


def browser(spark: SparkSession, visits: str, tabs: str, adapter_id: str = "browser:local") -> Both:
    v = json_lines(spark, visits, "id string, url string, title string, visitedAt string, browser string, visitCount int")
    t = json_lines(spark, tabs, "url string, title string, browser string")
    title = X.or_else(r("title"), r("url"))
    tab_id = F.substring(F.sha2(r("url"), 256), 1, 8)
    visit = metadata(event_id=r("id"), title=title, start_date=r("visitedAt"), url=r("url"), browser=r("browser"), source_type=F.lit("browser_visit"))
    tab = metadata(event_id=tab_id, title=title, url=r("url"), browser=r("browser"), source_type=F.lit("browser_tab"))
    body = F.concat(F.lit("["), title, F.lit("]("), r("url"), F.lit(")"))
    return joined(
        made(v, adapter_id, "events", F.concat(F.lit("visit/"), r("id")), body, visit, filled(r("id"), r("url"), r("visitedAt")), title, r("url")),
        made(t, adapter_id, "events", F.concat(F.lit("tab/"), tab_id), body, tab, filled(r("url")), title, r("url")))


def locations(spark: SparkSession, visits: str, current: str, adapter_id: str = "location:local") -> Both:
    v = json_lines(spark, visits, "id string, latitude double, longitude double, placeName string, locality string, country string, arrivalDate string, departureDate string, durationMinutes int")
    c = json_lines(spark, current, "latitude double, longitude double, accuracy double, updatedAt string")
    place = F.coalesce(r("placeName"), F.concat_ws(", ", r("locality"), r("country")))
    sound = r("latitude").between(-90, 90) & r("longitude").between(-180, 180)
    visit = metadata(location_id=r("id"), latitude=r("latitude"), longitude=r("longitude"), place_name=r("placeName"), locality=r("locality"), country=r("country"), arrival_date=r("arrivalDate"), departure_date=r("departureDate"), duration_minutes=r("durationMinutes"), source_type=F.lit("visit"))
    now = metadata(location_id=F.lit("current"), latitude=r("latitude"), longitude=r("longitude"), date_first_observed=r("updatedAt"), source_type=F.lit("current_location"))
    where_ = F.format_string("%.5f, %.5f", r("latitude"), r("longitude"))
    return joined(
        made(v, adapter_id, "location", F.concat(F.lit("visit/"), r("id")), F.concat(F.lit("Visited "), F.when(place != "", place).otherwise(where_)), visit, filled(r("id")) & sound, r("placeName")),
        made(c, adapter_id, "location", F.lit("current"), F.concat(F.lit("At "), where_), now, sound))


def watches(spark: SparkSession, path: str, adapter_id: str = "videos:local") -> Both:
    rows = json_lines(spark, path, "video_id string, title string, channel string, channel_id string, url string, watched_at string, duration double")
    id_ = F.concat(F.lit("video/watch/"), r("video_id"), F.lit("/"), r("watched_at"))
    meta = metadata(event_id=id_, title=r("title"), start_date=r("watched_at"), video_id=r("video_id"), channel=r("channel"), url=r("url"), source_type=F.lit("video_watch"))
    return made(rows, adapter_id, "events", id_, F.concat_ws("\n", F.concat(F.lit("Watched "), r("title")), F.concat(F.lit("Channel: "), r("channel"))), meta, filled(r("video_id"), r("watched_at"), r("title")), r("title"), r("url"))


def caption_blocks(segments: Column, words: int = 350) -> Column:
    """Captions (text, start, duration) merged into blocks (text, start, end) of about so many words. A block ends
    where the next begins, the last with its last caption."""
    count = lambda t: F.size(F.array_remove(F.split(t, r"\s+"), "")).cast("int")
    block = "struct<text:string, start:double, end:double, words:int>"
    zero = F.array().cast(f"array<{block}>")

    def add(acc: Column, seg: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        text, start, end = F.trim(seg["text"]), seg["start"].cast("double"), (seg["start"] + seg["duration"]).cast("double")
        new = F.struct(text.alias("text"), start.alias("start"), end.alias("end"), count(text).alias("words"))
        grown = F.struct(F.concat_ws(" ", last["text"], text).alias("text"), last["start"].alias("start"), end.alias("end"), (last["words"] + count(text)).alias("words"))
        closed = F.struct(last["text"].alias("text"), last["start"].alias("start"), start.alias("end"), last["words"].alias("words"))
        before = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.size(acc) == 0, F.array(new)).when(last["words"] + count(text) > words, F.concat(before, F.array(closed, new))).otherwise(F.concat(before, F.array(grown))).cast(f"array<{block}>")

    return F.aggregate(segments, zero, add)


def transcripts(spark: SparkSession, path: str, store: Store, watch_adapter: str, adapter_id: str = "transcripts:local", words: int = 350) -> Both:
    """Transcripts of the videos that the store's watch history has and its transcripts lack: captions {video_id,
    segments} are joined with the latest watch of each, and merged into blocks. A video without captions waits."""
    kind = T._parse_datatype_string("video_id string, title string, channel string, channel_id string, url string, start_date string")
    seen = store.active_chunks().where(F.col("adapter_id") == watch_adapter).select(F.from_json("domain_metadata", kind).alias("m")).select("m.*").withColumnRenamed("start_date", "watched_at")
    have = store.sources.where((F.col("adapter_id") == adapter_id) & F.startswith("source_id", F.lit("video/transcript/"))).select(F.substr("source_id", F.lit(len("video/transcript/") + 1)).alias("video_id"))
    due = latest_watch(seen.withColumn("watched_at", F.coalesce("watched_at", F.lit(""))), have)
    lines = json_lines(spark, path, "video_id string, segments array<struct<text:string, start:double, duration:double>>")
    sound = F.coalesce(filled(r("video_id")) & r("segments").isNotNull(), F.lit(False))
    rows = lines.where(sound).select("raw", r("video_id").alias("video_id"), r("segments").alias("segments")).join(due, "video_id")
    title, url = X.or_else(F.col("title"), F.concat(F.lit("Video "), "video_id")), F.col("url")
    said = F.transform(caption_blocks(F.col("segments"), words), lambda b: F.concat(F.lit("["), scores.clock(b["start"]), F.lit("] "), b["text"]))
    head = F.concat_ws("\n", F.concat(F.lit("**Channel:** "), "channel"), F.concat(F.lit("**URL:** "), url), F.concat(F.lit("**Watched:** "), X.or_else(F.col("watched_at"), F.lit(None).cast("string"))))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.when(head != "", head), F.when(F.size(said) > 0, F.lit("## Transcript")), F.when(F.size(said) > 0, F.array_join(said, "\n\n")))
    meta = metadata(document_id=F.col("video_id"), title=title, document_type=F.lit("video/transcript"), source_type=F.lit("video_transcript"), channel=F.col("channel"), channel_id=F.col("channel_id"), url=url, watched_at=F.col("watched_at"))
    items, _ = made(rows, adapter_id, "documents", F.concat(F.lit("video/transcript/"), "video_id"), body, meta, F.lit(True), title, url)
    return items, lines.where(~sound).select(F.lit(adapter_id).alias("adapter_id"), F.col("raw").alias("record"), F.lit("malformed").alias("reason"))


def pushed(spark: SparkSession, path: str) -> Both:
    """Payloads {adapter_id, domain, normalizer_version, items} of 1 to 10,000 items, as an application pushed them."""
    rows = json_lines(spark, path, "adapter_id string, domain string, normalizer_version string, items array<struct<source_id:string, markdown:string, structural_hints:struct<extra_metadata:string>>>")
    good = F.coalesce(filled(r("adapter_id"), r("domain")) & F.size(r("items")).between(1, 10_000), F.lit(False))
    none = F.lit(None).cast("string")
    items = rows.where(good).select(r("adapter_id").alias("adapter_id"), r("domain").alias("domain"), F.coalesce(r("normalizer_version"), F.lit("1")).alias("normalizer_version"), F.explode(r("items")).alias("x"))
    items = items.where("x.source_id <> '' AND x.markdown IS NOT NULL").select(F.col("x.source_id").alias("source_id"), "adapter_id", "domain", none.alias("origin_ref"), none.alias("display_name"), F.lit("webhook").alias("poll_strategy"), F.lit(None).cast("int").alias("poll_interval_sec"), "normalizer_version", F.col("x.markdown").alias("markdown"), F.col("x.structural_hints.extra_metadata").alias("extra_metadata"))
    return items.select(*ITEM), rows.where(~good).select(F.coalesce(r("adapter_id"), F.lit("?")).alias("adapter_id"), F.col("raw").alias("record"), F.lit("malformed").alias("reason"))


#: Readers by the type that a configuration names.
TYPES: dict[str, Callable[..., Both]] = {
    "files": files, "vault": vault, "vault_tasks": vault_tasks, "notes": notes, "chat": chat, "mail": mail, "calendar": calendar, "ical": ical, "vcards": vcards, "contacts": contacts,
    "reminders": reminders, "heart_rate": heart_rate, "health": health, "tracks": tracks, "podcasts": podcasts, "screen_time": screen_time, "browser": browser, "locations": locations, "watches": watches, "pushed": pushed,
}


class PartialFetchError(RuntimeError):
    """Some endpoints failed; what the others gave is good."""


class AllEndpointsFailedError(RuntimeError):
    """No endpoint gave anything."""


def fetched(spark: SparkSession, endpoints: dict[str, Callable[[SparkSession], Both]]) -> tuple[Both | None, DataFrame]:
    """Reads every endpoint. Returns the union, and (endpoint, ok, error); if all fail, raises."""
    good, status = [], []
    for name, read in endpoints.items():
        try:
            items, rejects = read(spark)
            items.isEmpty()  # a path that isn't there shows here
            good.append((items, rejects))
            status.append((name, True, None))
        except Exception as e:  # noqa: BLE001
            if isinstance(e, PermissionError):
                raise
            status.append((name, False, f"{type(e).__name__}: {e}"[:2000]))
    if endpoints and not good:
        raise AllEndpointsFailedError("; ".join(f"{n}: {e}" for n, _, e in status))
    return joined(*good), spark.createDataFrame(status, "endpoint string, ok boolean, error string")
