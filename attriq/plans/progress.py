"""How far a run is: counters that tasks add to while they work, snapshots, and a table of them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Snapshot:
    """Counts of a run: rows done are those that came out well and those that failed."""

    total: int
    done: int
    success: int
    error: int
    in_tokens: int
    out_tokens: int
    elapsed: float

    @property
    def left(self) -> float | None:
        """Seconds to go at the pace so far; None before the first row."""
        return self.elapsed / self.done * (self.total - self.done) if self.done else None


class Progress:
    """Counts rows of (status, in_tokens, out_tokens) as tasks make them.

    Tasks add to accumulators, which the driver has after each task; `snapshot` may be read at any time, also
    from another thread while the run goes on. A task that runs again adds again, so the counts are for
    watching; the output table has the exact ones. `watch` calls on_progress at each change.
    """

    def __init__(self, spark: SparkSession, total: int, clock: Callable[[], float] = time.time) -> None:
        sc = spark.sparkContext
        self.spark, self.total, self.clock, self.begun = spark, total, clock, clock()
        self._ok, self._bad, self._in, self._out = (sc.accumulator(0) for _ in range(4))

    def snapshot(self) -> Snapshot:
        ok, bad = self._ok.value, self._bad.value
        return Snapshot(self.total, ok + bad, ok, bad, self._in.value, self._out.value, self.clock() - self.begun)

    def counted(self, answers: DataFrame) -> DataFrame:
        """answers unchanged; each batch of rows adds to the counters as it passes."""
        ok, bad, tokens_in, tokens_out = self._ok, self._bad, self._in, self._out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                well = int((b["status"] == "ok").sum())
                ok.add(well)
                bad.add(len(b) - well)
                tokens_in.add(int(b["in_tokens"].fillna(0).sum()))
                tokens_out.add(int(b["out_tokens"].fillna(0).sum()))
                yield b

        return answers.mapInPandas(run, answers.schema)

    def watch(self, on_progress: Callable[[Snapshot], None], every: float = 1.0) -> Watch:
        return Watch(self, on_progress, every)


class Watch:
    """A context in which on_progress gets a snapshot whenever the counts have changed, and one at the end."""

    def __init__(self, progress: Progress, on_progress: Callable[[Snapshot], None], every: float) -> None:
        self.progress, self.on_progress, self.every, self.over = progress, on_progress, every, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        told = -1
        while not self.over.wait(self.every):
            now = self.progress.snapshot()
            if now.done != told:
                told = now.done
                self.on_progress(now)

    def __enter__(self) -> Watch:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()
        self.on_progress(self.progress.snapshot())


def table_of(spark: SparkSession, path: str) -> Callable[[Snapshot], None]:
    """An on_progress that appends each snapshot as a row of the table at path."""

    def save(now: Snapshot) -> None:
        spark.createDataFrame([tuple(asdict(now).values())], "total long, done long, success long, error long, in_tokens long, out_tokens long, elapsed double").coalesce(1).write.mode("append").parquet(path)

    return save


def status_line(now: Snapshot) -> str:
    """One line for a terminal."""
    left = "?" if now.left is None else f"{now.left:.0f} s"
    return f"{now.done}/{now.total} done, {now.success} well, {now.error} failed, {now.in_tokens}+{now.out_tokens} tokens, {now.elapsed:.0f} s, {left} to go"


class StreamProgress(StreamingQueryListener):
    """Hands each micro-batch's (query name, batch, input rows, seconds) to on_progress, and the error of a query that ends with one."""

    def __init__(self, on_progress: Callable[[dict], None]) -> None:
        self.on_progress = on_progress

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.on_progress({"query": event.name, "event": "started"})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.on_progress({"query": p.name, "event": "batch", "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.on_progress({"query": None, "event": "ended", "error": event.exception})
