"""Records as a stream: stateless stages, duplicates dropped within the watermark, appends with a checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attriq.sources import shared_dir
from attriq.sources.sinks import append_store


def distinct_records(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each record once: a repeat within `delay` of event time is dropped, and state older than that is let go."""
    rows = events.filter("event_type is not null").selectExpr("event_id AS record_id", "event_type AS subtype", "cast(ts AS timestamp) AS ts")
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["record_id"])


def start(rows: DataFrame, out: str, checkpoint: str):
    """Appends all that is there, then stops; a restart goes on behind what the checkpoint has."""
    return rows.writeStream.foreachBatch(append_store(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """The records of one Parquet file, read as a stream into a table of the shared folder."""
    shared = shared_dir(spark)
    base = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    start(distinct_records(events).drop("ts"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
