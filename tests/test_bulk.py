"""Bulk jobs against a service on this machine that tasks reach by HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from attriq.plans import bulk, pipeline
from attriq.sources import chat_service


class Service:
    """Jobs end at their second poll. Those whose requests hold "bad" fail the first time; "never" is refused."""

    def __init__(self):
        self.jobs, self.sent, self.polls, lock, outer = {}, [], 0, threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def say(self, status, body):
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_POST(self):  # noqa: N802
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["requests"]
                with lock:
                    names = sorted(r["custom_id"] for r in asked)
                    outer.sent.append(names)
                    if "never" in names:
                        return self.say(400, {"error": "no"})
                    job = f"j{len(outer.sent)}"
                    outer.jobs[job] = [0, names, "bad" in names and outer.sent.count(names) == 1]
                    return self.say(200, {"data": {"id": job}})

            def do_GET(self):  # noqa: N802
                with lock:
                    outer.polls += 1
                    found = outer.jobs.get(self.path.rpartition("/")[2])
                    if found is None:
                        return self.say(404, {})
                    found[0] += 1
                    if found[0] < 2:
                        return self.say(200, {"data": {"status": "running"}})
                    if found[2]:
                        return self.say(200, {"data": {"status": "failed"}})
                    answers = [{"custom_id": n, "response": {"body": {"choices": [{"message": {"content": f"answer: {n}"}}]}}} for n in found[1]]
                    return self.say(200, {"data": {"status": "completed", "results": answers}})

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/batches"


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def packed(spark, *chunks):
    return spark.createDataFrame([(0, k, json.dumps({"custom_id": n})) for k, names in enumerate(chunks) for n in names], "shard int, chunk int, request string")


def contents(spark, base, tmp_path):
    bulk.results(spark, base).write.mode("overwrite").text(str(tmp_path / "text"))
    return {r["custom_id"]: r["content"] for r in pipeline.bulk_contents(spark, str(tmp_path / "text")).collect()}


def test_a_failing_chunk_and_a_lost_driver(spark, service, tmp_path):
    base, client = str(tmp_path / "b"), chat_service.BulkService(service.url, "k", "m")
    given = packed(spark, ["a", "b"], ["bad", "c"], ["never"])

    class Lost(Exception):
        pass

    def lost(_):
        raise Lost

    with pytest.raises(Lost):
        bulk.run_bulk(spark, base, given, client, sleep=lost)
    assert {r["chunk"]: r["state"] for r in bulk.jobs(spark, base).collect()} == {0: "sent", 1: "sent", 2: "new"}
    assert len(service.sent) == 3
    assert bulk.run_bulk(spark, base, given, client, sleep=lambda _: None) == {"read": 2, "given_up": 1}
    # The chunks that were sent weren't sent again but for the one that failed; the refused one was tried three times.
    assert sorted(map(str, service.sent)) == sorted(map(str, [["a", "b"], ["bad", "c"], ["bad", "c"], ["never"], ["never"], ["never"]]))
    assert contents(spark, base, tmp_path) == {n: f"answer: {n}" for n in ("a", "b", "bad", "c")}
    rows = {r["chunk"]: r for r in bulk.jobs(spark, base).collect()}
    assert rows[1]["tries"] == 2 and rows[2]["tries"] == 3 and "no" in rows[2]["error"]
    # A run that is over asks for nothing more.
    polls = service.polls
    assert bulk.run_bulk(spark, base, given, client) == {"read": 2, "given_up": 1} and service.polls == polls


def test_rounds_do_not_grow_with_chunks(spark, service, tmp_path):
    """Forty chunks take no more Spark jobs than two."""
    client, counts = chat_service.BulkService(service.url, "k", "m"), []
    for n in (2, 40):
        spark.sparkContext.setJobGroup(f"bulk{n}", "")
        bulk.run_bulk(spark, str(tmp_path / str(n)), packed(spark, *[[f"{n}-{k}"] for k in range(n)]), client, sleep=lambda _: None)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bulk{n}")))
        assert len(contents(spark, str(tmp_path / str(n)), tmp_path)) == n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 6


def test_unknown_jobs_and_no_chunks(spark, service, tmp_path):
    client = chat_service.BulkService(service.url, "k", "m")
    base, given = str(tmp_path / "b"), packed(spark, ["a"])
    bulk.run_bulk(spark, base, given, client, rounds=1)
    service.jobs.clear()
    assert bulk.run_bulk(spark, base, given, client, grace=2, sleep=lambda _: None) == {"read": 1}
    assert service.sent == [["a"], ["a"]]
    assert bulk.run_bulk(spark, str(tmp_path / "none"), given.limit(0), client) == {}
    assert bulk.results(spark, str(tmp_path / "none")).count() == 0
