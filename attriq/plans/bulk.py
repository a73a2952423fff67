"""Bulk jobs as a table: a row for each chunk with its state; tasks send, poll and read; a lost driver goes on where the table is."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriq.sources import exists
from attriq.sources.chat_service import TERMINAL, BulkService, ServiceError
from attriq.sources.sinks import current, drop_old, last_version, replace

JOB = "shard int, chunk int, state string, job string, tries int, polls int, error string"
JOB_COLUMNS = [part.split()[0] for part in JOB.split(", ")]
#: States of a chunk: to be sent, sent, read to its end, given up.
NEW, SENT, READ, GIVEN_UP = "new", "sent", "read", "given_up"


def jobs(spark: SparkSession, base: str) -> DataFrame:
    """The chunks' states, JOB."""
    return current(spark, f"{base.rstrip('/')}/jobs")


def results(spark: SparkSession, base: str) -> DataFrame:
    """The results of all jobs read, one JSON text a row, as `plans.pipeline.bulk_contents` takes them; none before the first."""
    path = f"{base.rstrip('/')}/results"
    return spark.read.parquet(path).select("value") if exists(spark, path) else spark.createDataFrame([], "value string")


def _send(service: BulkService, tries: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One chunk's requests to the service, which bounds them; an error is the chunk's own and leaves the others alone."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        shard, chunk, tried = int(key[0]), int(key[1]), int(f["tries"].iloc[0]) + 1
        try:
            row = (SENT, service.submit([json.loads(x) for x in f.sort_values("request")["request"]]), None)
        except Exception as e:
            fatal = isinstance(e, ServiceError) and e.status_code in (401, 402, 403)
            row = (GIVEN_UP if fatal or tried >= tries else NEW, None, str(e)[:500])
        return pd.DataFrame([(shard, chunk, row[0], row[1], tried, 0, row[2])], columns=JOB_COLUMNS)

    return run


def _poll(service: BulkService, tries: int, grace: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each sent chunk's state once; of a job that is over, its results come along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples():
                state, error, found = SENT, None, []
                try:
                    got = service.state(r.job)
                    if got is None and r.polls >= grace:
                        state, error = NEW, "unknown to the service"
                    elif got is not None and got.get("status") in TERMINAL:
                        found = [json.dumps(x, ensure_ascii=False) for x in got.get("results") or []]
                        state = READ if got["status"] == "completed" or found else NEW
                        error = None if state == READ else f"the job is {got['status']}"
                except Exception as e:  # asked again in the next round
                    error = str(e)[:500]
                if state == NEW and r.tries >= tries:
                    state = GIVEN_UP
                yield pd.DataFrame([(r.shard, r.chunk, state, r.job, r.tries, r.polls + 1, error, found)], columns=[*JOB_COLUMNS, "found"])

    return run


def run_bulk(spark: SparkSession, base: str, packed: DataFrame, service: BulkService, tasks: int = 8, tries: int = 3, grace: int = 10, interval: float = 30, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Sends each chunk of packed(shard, chunk, request) as a bulk job, polls all, and writes what they answer under base; returns the number of chunks by state.

    A round is one Spark job for sending and one for polling, whatever the number of chunks: tasks, at most
    `tasks` at once, talk to the service for a chunk each. After each the table of states gets its next version,
    and the results a partition of the round, which a round that runs again replaces. A driver that is lost is
    started again with the same arguments: chunks that were sent are polled only, those read are done. A chunk
    whose job fails, or is unknown to the service `grace` polls long, is sent again, up to `tries` times. A
    task that is lost between the service's answer and the table's version sends its chunk twice; answers are
    merged by request id, so that costs money but no rows. Ends when no chunk is new or sent, or after `rounds`.
    """
    table, out = f"{base.rstrip('/')}/jobs", f"{base.rstrip('/')}/results"
    if not exists(spark, table):
        fresh = packed.select(F.col("shard").cast("int").alias("shard"), F.col("chunk").cast("int").alias("chunk")).distinct()
        fresh = fresh.select("shard", "chunk", F.lit(NEW).alias("state"), F.lit(None).cast("string").alias("job"), F.lit(0).alias("tries"), F.lit(0).alias("polls"), F.lit(None).cast("string").alias("error"))
        replace(fresh, table)
    done = 0
    while True:
        now = current(spark, table)
        states = {r["state"]: r["count"] for r in now.groupBy("state").count().collect()}
        if not (states.get(NEW) or states.get(SENT)) or (rounds is not None and done >= rounds):
            return states
        if states.get(NEW):
            new = now.filter(F.col("state") == NEW)
            asked = packed.select("shard", "chunk", "request").join(new.select("shard", "chunk", "tries"), ["shard", "chunk"])
            sent = asked.repartition(tasks, "shard", "chunk").groupBy("shard", "chunk").applyInPandas(_send(service, tries), JOB)
            now = current(spark, table, replace(now.filter(F.col("state") != NEW).unionByName(sent), table))
        waiting = now.filter(F.col("state") == SENT)
        if not waiting.isEmpty():
            polled = waiting.repartition(tasks, "shard", "chunk").mapInPandas(_poll(service, tries, grace), JOB + ", found array<string>")
            # The answers of a round are kept once; the states that say so are published after them.
            polled.write.mode("overwrite").parquet(kept := f"{base.rstrip('/')}/polled")
            polled = spark.read.schema(polled.schema).parquet(kept)
            polled.select(F.explode("found").alias("value")).write.mode("overwrite").parquet(f"{out}/after={last_version(spark, table)}")
            replace(now.filter(F.col("state") != SENT).unionByName(polled.drop("found")), table)
        drop_old(spark, table, keep=2)
        done += 1
        left = current(spark, table).filter(F.col("state").isin(NEW, SENT))
        if (rounds is None or done < rounds) and not left.isEmpty():
            sleep(interval)
