"""A Spark data source for services that answer /fetch with canonical items, and one for cursor feeds as a stream.

The stream reads each endpoint of a service as a partition of its own, on executors. The service keeps a cursor for each
endpoint and moves it when it is told to. A round is an offset: for each endpoint the cursors that it reads from and to,
which the driver asks for without items (/peek), so a round that is run again reads the same pages. A task that has
handed on all pages of its endpoint leaves a receipt in the folder ``receipts``, one that fails leaves what went wrong there,
and its endpoint alone is missing from the batch. After a batch is in the sink, commit() acknowledges the endpoints
with a receipt: all at once, or by name if one is missing. What an endpoint didn't deliver stays behind its cursor and
comes in the next round. Rows are never lost; after a crash between sink and commit they may come twice, which ingest sees as unchanged.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source_id string, domain string, markdown string, normalizer_version string, extra_metadata string"
RETRY = (502, 503, 504)


def posted(url: str, body: dict, token: str | None = None, attempts: int = 3, wait: float = 0.5) -> dict:
    """The JSON answer; 502, 503 and 504 are tried again, waiting twice as long each time; others are errors at once."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    for k in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise PermissionError(f"HTTP {e.code} from {url}") from e
            if e.code not in RETRY or k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def checked(items: list[dict]) -> list[tuple]:
    """All items or none: one that is malformed is an error."""
    out = []
    for x in items:
        if not isinstance(x.get("source_id"), str) or not x["source_id"] or not isinstance(x.get("markdown"), str):
            raise ValueError(f"malformed item: {str(x)[:200]}")
        hints = x.get("structural_hints") or {}
        out.append((x["source_id"], x.get("domain"), x["markdown"], x.get("normalizer_version", "1"), json.dumps(hints.get("extra_metadata") or {})))
    return out


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.token, self.refs = options["url"].rstrip("/"), options.get("token"), options.get("source_refs", "").split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(ref) for ref in self.refs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from checked(posted(f"{self.url}/fetch", {"source_ref": partition.value}, self.token)["normalized_contents"])


class Receipts:
    """Small files in a shared folder, by round and endpoint: {"to": cursor} or {"error": message}; and ``state``, the
    cursors received so far. Hadoop is not at hand in Python workers, so the folder is opened by Arrow."""

    def __init__(self, folder: str):
        self.folder = folder

    def at(self, path: str = "") -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder}/{path}".rstrip("/"))

    def put(self, path: str, value: dict) -> None:
        """Whole or not at all: written aside, then moved."""
        system, to = self.at(path)
        system.create_dir(to.rsplit("/", 1)[0], recursive=True)
        aside = f"{to}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps(value).encode())
        system.move(aside, to)

    def get(self, path: str) -> dict | None:
        from pyarrow import fs

        system, to = self.at(path)
        if system.get_file_info(to).type != fs.FileType.File:
            return None
        with system.open_input_stream(to) as f:
            return json.loads(f.read())

    def rounds(self) -> dict[int, dict[str, dict]]:
        """Of each round that isn't folded into the state, what its endpoints left."""
        from pyarrow import fs

        system, top = self.at()
        out: dict[int, dict[str, dict]] = {}
        for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
            if f.type == fs.FileType.File and f.path.endswith(".json") and f.base_name != "state.json":
                number, name = f.path.split("/")[-2:]
                out.setdefault(int(number), {})[bytes.fromhex(name.removesuffix(".json")).decode()] = self.get(f"{number}/{name}")
        return out

    def path(self, number: int, endpoint: str) -> str:
        return f"{number}/{endpoint.encode().hex()}.json"

    def fold(self, upto: int, cursors: dict[str, str]) -> None:
        """The state after a round; the receipts up to it go."""
        self.put("state.json", {"round": upto, "cursors": cursors})
        for number in self.rounds():
            if number <= upto:
                system, to = self.at(str(number))
                system.delete_dir(to)


@dataclass
class EndpointRange(InputPartition):
    round: int
    endpoint: str
    start: str
    end: str


class RemoteStream(DataSourceStreamReader):
    """Options: url, token, endpoints (by comma), receipts (a folder that driver and executors share), attempts."""

    def __init__(self, options: dict):
        self.url, self.token, self.attempts = options["url"].rstrip("/"), options.get("token"), int(options.get("attempts", 3))
        self.endpoints, self.receipts = [e.strip() for e in options.get("endpoints", "").split(",")], Receipts(options["receipts"].rstrip("/"))

    def asked(self, what: str, body: dict) -> dict:
        return posted(f"{self.url}/{what}", body, self.token, self.attempts)

    def received(self) -> tuple[int, dict[str, str]]:
        """(last round, cursor of each endpoint behind what it has delivered)."""
        state = self.receipts.get("state.json") or {"round": 0, "cursors": {}}
        cursors, last = dict(state["cursors"]), state["round"]
        for number, left in sorted(self.receipts.rounds().items()):
            cursors |= {e: x["to"] for e, x in left.items() if "to" in x}
            last = max(last, number)
        return last, cursors

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0, "due": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        """The next round, if an endpoint has something behind its cursor. One that can't be asked waits."""
        last, cursors = self.received()
        due = {}
        for e in self.endpoints:
            start = cursors.get(e, "")
            try:
                end = self.asked("peek", {"endpoint": e, "cursor": start}).get("next_cursor") or start
            except OSError:
                continue
            if end != start:
                due[e] = [start, end]
        return {"round": last + 1, "due": due} if due else {"round": last, "due": {}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [EndpointRange(end["round"], e, a, z) for e, (a, z) in sorted(end["due"].items())]

    def pages(self, part: EndpointRange) -> Iterator[list[tuple]]:
        cursor = part.start
        while cursor != part.end:
            answer = self.asked("fetch", {"endpoint": part.endpoint, "cursor": cursor, "until": part.end})
            yield checked(answer["normalized_contents"])
            if (following := answer.get("next_cursor")) in (None, cursor):
                raise ValueError(f"{part.endpoint}: no page between {cursor!r} and {part.end!r}")
            cursor = following

    def read(self, part: EndpointRange) -> Iterator[tuple]:
        """A round's pages of an endpoint are bounded by the service (what it lets a peek promise); they are checked
        before the first row is handed on, so that an endpoint comes whole or not at all."""
        try:
            rows = [row for page in self.pages(part) for row in page]
        except (OSError, ValueError, KeyError) as e:
            self.receipts.put(self.receipts.path(part.round, part.endpoint), {"error": f"{type(e).__name__}: {e}"[:2000]})
            return
        yield from rows
        self.receipts.put(self.receipts.path(part.round, part.endpoint), {"to": part.end})

    def commit(self, end: dict) -> None:
        """Acknowledges what came of the round, as well as it can: the service may be told again, and a service that
        isn't reached serves the same pages from the state's cursors."""
        left = self.receipts.rounds().get(end["round"], {})
        came = sorted(e for e, x in left.items() if "to" in x)
        if came:
            try:
                self.asked("ack", {"cursors": {e: left[e]["to"] for e in came}} if len(came) == len(end["due"]) == len(self.endpoints) else {"keys": came, "cursors": {e: left[e]["to"] for e in came}})
            except (OSError, ValueError) as e:
                print(f"acknowledgement failed: {e}", file=sys.stderr)
        if end["round"]:
            self.receipts.put(f"failures-{end['round']:012d}", {e: x["error"] for e, x in left.items() if "error" in x})
            self.receipts.fold(end["round"], self.received()[1])


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """(round, endpoint, message) of the endpoints that didn't deliver, for dead letters."""
    files = spark.read.option("pathGlobFilter", "failures-*").text(folder, wholetext=True)
    each = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)$", 1).cast("long").alias("round"), F.explode(F.from_json("value", "map<string, string>")).alias("endpoint", "message"))
    return each.select("round", "endpoint", "message")


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RemoteReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return RemoteStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSource)
