"""Clients of a chat service and of its bulk jobs, for deciders; they run in tasks or, for `BulkService.run`, on the driver."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from attriq.operators.decide import EmptyAnswer

Transport = Callable[[str, str, dict, object], tuple[int, dict]]

# States in which a bulk job is over.
TERMINAL = ("completed", "failed", "expired", "cancelled")
#: Keys that are arguments of a request of their own; others of the extra body pass through.
TOP_LEVEL = ("reasoning_effort",)


class ServiceError(Exception):
    def __init__(self, status_code: int, text: str):
        super().__init__(text)
        self.status_code = status_code


def http(method: str, url: str, headers: dict, payload: object) -> tuple[int, dict]:
    """(status, body) of a request with a JSON payload, by the standard library."""
    data = None if payload is None else json.dumps(payload).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=600) as r:
            return r.status, json.loads(r.read() or b"{}")
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode(errors="replace")[:1000]}


def extra_body(text: str | None) -> dict:
    """Extra arguments from JSON text; none if it is blank, an error at once if it is no JSON object."""
    if not (text or "").strip():
        return {}
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"the extra body is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("the extra body is no JSON object")
    return found


@dataclass(frozen=True)
class ChatService:
    """A service that answers messages. As a client of decide.call it takes (system, prompt) pairs and answers `at_once` of them together."""

    url: str
    key: str
    model: str
    extra: dict = field(default_factory=dict)
    at_once: int = 1
    transport: Transport = http

    @classmethod
    def from_env(cls, url: str, model: str, **more: object) -> ChatService:
        """From LLM_API_KEY, which must be set, and LLM_BASE_URL, LLM_MODEL and LLM_EXTRA_BODY, which need not."""
        key = os.environ.get("LLM_API_KEY")
        if not key:
            raise ValueError("LLM_API_KEY is not set")
        return cls(os.environ.get("LLM_BASE_URL") or url, key, os.environ.get("LLM_MODEL") or model, extra_body(os.environ.get("LLM_EXTRA_BODY")), **more)

    def complete(self, messages: list[dict]) -> tuple[str, int, int]:
        """The answer and the tokens in and out; a blank answer is an error."""
        body = {"model": self.model, "messages": messages, "temperature": 0.0, **self.extra}
        status, got = self.transport("POST", f"{self.url.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body)
        if status >= 400:
            raise ServiceError(status, str(got)[:500])
        content = (((got.get("choices") or [{}])[0].get("message") or {}).get("content") or "").strip()
        if not content:
            raise EmptyAnswer("blank answer")
        used = got.get("usage") or {}
        return content, used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0

    def _one(self, pair: tuple[str, str]) -> tuple[str, int, int]:
        system, prompt = pair
        try:
            return self.complete([{"role": "system", "content": system}, {"role": "user", "content": prompt}])
        except EmptyAnswer:
            return "", 0, 0  # asked again by the caller

    def __call__(self, pairs: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(self._one, pairs))


@dataclass(frozen=True)
class BulkService:
    """Bulk jobs: submitted, polled to their end, and read back."""

    url: str
    key: str
    model: str
    transport: Transport = http
    sleep: Callable[[float], None] = time.sleep

    def _send(self, method: str, url: str, payload: object) -> tuple[int, dict]:
        return self.transport(method, url, {"Authorization": f"Bearer {self.key}"}, payload)

    def submit(self, requests: list[dict]) -> str:
        """The id of a job of one chunk's requests, which the service's limits bound."""
        status, got = self._send("POST", self.url, {"endpoint": "/v1/chat/completions", "model": self.model, "requests": requests})
        if status >= 400:
            raise ServiceError(status, f"not submitted: {str(got)[:1000]}")
        found = got.get("id") or (got.get("data") or {}).get("id")
        if not found:
            raise RuntimeError(f"no id in {str(got)[:500]}")
        return found

    def state(self, job: str) -> dict | None:
        """What the service says of a job now; None if it doesn't know it."""
        status, got = self._send("GET", f"{self.url.rstrip('/')}/{job}", None)
        if status == 404:
            return None
        if status >= 400:
            raise ServiceError(status, str(got)[:500])
        return got.get("data", got)

    def wait(self, job: str, interval: float = 30, grace: int = 10) -> dict:
        """The job's final state; it may be unknown `grace` times at first."""
        missing = 0
        while True:
            got = self.state(job)
            if got is None:
                missing += 1
                if missing > grace:
                    raise ServiceError(404, f"no job {job}")
            elif got.get("status") in TERMINAL:
                return got
            self.sleep(interval)

    def run(self, spark: SparkSession, packed: DataFrame, out: str) -> None:
        """A job for each chunk of packed(shard, chunk, request), one after another; each one's results are appended as JSON lines under out. See plans.pipeline.bulk_answers; plans.bulk runs all chunks at once, in tasks, and goes on after a loss."""
        for shard, chunk in _chunks(packed):
            rows = packed.filter((packed["shard"] == shard) & (packed["chunk"] == chunk)).select("request").toLocalIterator()
            state = self.wait(self.submit([json.loads(r["request"]) for r in rows]))
            results = [(json.dumps(x, ensure_ascii=False),) for x in state.get("results") or []]
            spark.createDataFrame(results, "value string").write.mode("append").text(out)


def _chunks(packed: DataFrame) -> Iterator[tuple[int, int]]:
    for r in packed.select("shard", "chunk").distinct().orderBy("shard", "chunk").toLocalIterator():
        yield r["shard"], r["chunk"]
