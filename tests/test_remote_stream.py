"""The keyed stream against a service with three endpoints."""

import http.server
import json
import threading

import pytest

from tidemark.sources import remote


class Service:
    """Each endpoint has pages of items; its cursor counts items. ``broken`` endpoints answer 500 to a fetch."""

    def __init__(self, items: dict[str, list[str]], page: int = 2):
        self.items, self.page, self.broken, self.acks, self.down, self.fetches = items, page, set(), [], False, 0
        outer = self

        class Answer(http.server.BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                code, out = outer.answer(self.path.strip("/"), body)
                data = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, what: str, body: dict) -> tuple[int, dict]:
        if what == "ack":
            if self.down:
                return 500, {}
            self.acks.append(body)
            return 200, {}
        name, at = body["endpoint"], int(body["cursor"] or 0)
        if what == "peek":
            return 200, {"next_cursor": str(len(self.items[name]))}
        self.fetches += 1
        if name in self.broken:
            return 500, {}
        upto = min(at + self.page, int(body["until"]))
        return 200, {"normalized_contents": [{"source_id": f"{name}/{x}", "markdown": x} for x in self.items[name][at:upto]], "next_cursor": str(upto)}


@pytest.fixture
def service():
    made = Service({"sleep": ["s1", "s2", "s3"], "heart-rate": ["h1"], "steps": ["t1", "t2"]})
    yield made
    made.server.shutdown()


def run(spark, service, folder):
    remote.register(spark)
    stream = spark.readStream.format("remote_items").options(url=service.url, endpoints="sleep,heart-rate,steps", receipts=f"file://{folder}/receipts", attempts="1").load()
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(r.source_id for r in spark.read.schema(remote.SCHEMA).parquet(f"{folder}/out").collect())


def test_one_of_three_endpoints_fails(spark, service, tmp_path):
    service.broken = {"steps"}
    first = ["heart-rate/h1", "sleep/s1", "sleep/s2", "sleep/s3"]
    assert run(spark, service, tmp_path) == first
    service.items["sleep"].append("s4")
    service.broken = set()
    assert run(spark, service, tmp_path) == sorted([*first, "sleep/s4", "steps/t1", "steps/t2"])
    # the first round is acknowledged by name, without the endpoint that failed
    assert service.acks[0] == {"keys": ["heart-rate", "sleep"], "cursors": {"heart-rate": "1", "sleep": "3"}}
    told = remote.failures(spark, f"file://{tmp_path}/receipts").collect()
    assert [(r["round"], r.endpoint) for r in told] == [(1, "steps")] and "500" in told[0].message
    service.items["heart-rate"].append("h2")
    assert run(spark, service, tmp_path) == sorted([*first, "sleep/s4", "steps/t1", "steps/t2", "heart-rate/h2"])
    assert service.acks[1] == {"keys": ["sleep", "steps"], "cursors": {"sleep": "4", "steps": "2"}}
    fetches = service.fetches
    run(spark, service, tmp_path)  # nothing new: nothing is fetched
    assert service.fetches == fetches


def stream_of(service, folder):
    return remote.RemoteStream({"url": service.url, "endpoints": "sleep,heart-rate,steps", "receipts": f"file://{folder}", "attempts": "1"})


def test_rounds(service, tmp_path):
    stream = stream_of(service, tmp_path)
    end = stream.latestOffset()
    parts = stream.partitions(stream.initialOffset(), end)
    assert [(p.endpoint, p.start, p.end) for p in parts] == [("heart-rate", "", "1"), ("sleep", "", "3"), ("steps", "", "2")]
    # a round that is run again reads the same pages, even if there is more by now
    service.items["steps"].append("t3")
    assert [len(list(stream.read(p))) for p in parts] == [1, 3, 2] == [len(list(stream.read(p))) for p in parts]
    service.down = True
    stream.commit(end)  # an acknowledgement that fails is no error
    service.down = False
    again = stream_of(service, tmp_path).latestOffset()
    assert again == {"round": 2, "due": {"steps": ["2", "3"]}}
    service.broken = {"steps"}
    [part] = stream.partitions(end, again)
    assert list(stream.read(part)) == []
    stream.commit(again)
    assert service.acks == []  # nothing came, nothing is acknowledged
    service.broken = set()
    last = stream.latestOffset()
    assert last == {"round": 3, "due": {"steps": ["2", "3"]}}
    assert [x[0] for p in stream.partitions(again, last) for x in stream.read(p)] == ["steps/t3"]
    stream.commit(last)
    assert service.acks == [{"keys": ["steps"], "cursors": {"steps": "3"}}] and stream.latestOffset() == {"round": 3, "due": {}}


def test_all_come_and_are_acknowledged_at_once(service, tmp_path):
    stream = stream_of(service, tmp_path)
    end = stream.latestOffset()
    for p in stream.partitions({}, end):
        list(stream.read(p))
    stream.commit(end)
    assert service.acks == [{"cursors": {"heart-rate": "1", "sleep": "3", "steps": "2"}}]


def test_malformed_page_is_a_failure(service, tmp_path):
    service.items["steps"] = [""]
    stream = stream_of(service, tmp_path)
    service.items["sleep"] = service.items["heart-rate"] = []
    service.answer = lambda what, body, f=service.answer: (200, {"normalized_contents": [{"source_id": "", "markdown": "x"}], "next_cursor": "1"}) if what == "fetch" else f(what, body)
    end = {"round": 1, "due": {"steps": ["", "1"]}}
    [part] = stream.partitions({}, end)
    assert list(stream.read(part)) == [] and "malformed" in stream.receipts.rounds()[1]["steps"]["error"]
