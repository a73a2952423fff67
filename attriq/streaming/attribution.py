"""Records as a stream through all stages: recall, subtype, decision and gate, each record exactly once in the output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attriq.config import Gate
from attriq.operators import arbiter, recall, subtype
from attriq.sources import exists, once
from attriq.sources.sinks import append_store

Decider = Callable[[DataFrame, DataFrame], DataFrame]


def attributed(records: DataFrame, pair_sims: DataFrame, decide: Decider, scores: Callable[[DataFrame], DataFrame], gate: Gate = Gate()) -> DataFrame:
    """Arbitrated decisions of records(record_id, ...): candidates by a join of the records with pair similarities, then class, decision and gate.

    decide gets the classified records, with their own columns, and their candidates; scores gets the candidates.
    """
    mine = pair_sims.join(records.select("record_id").distinct(), "record_id", "left_semi")
    candidates = once(recall.recall(mine))
    decisions = decide(subtype.classify(records, candidates).join(records, "record_id"), candidates)
    return arbiter.arbitrate(decisions, scores(candidates), gate)


def start(records: DataFrame, pair_sims: DataFrame, decide: Decider, scores: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, gate: Gate = Gate(), sink: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Runs each micro-batch of the record stream through `attributed` into the partition batch=<id> of out.

    A batch that is run again after a failure sees the same records (the source's offsets are in the
    checkpoint) and replaces its own partition, so a restart neither loses nor doubles a record. A record
    that comes again in a later batch is left out, as it has its decision. One that repeats within a batch is
    decided once. Similarities may be a table that grows: a batch sees what is there when it runs.
    By default the query stops once it has read all that is there.
    """
    save = sink or append_store(out)

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["record_id"])
        before = decided(batch.sparkSession, out, number)
        if before is not None:
            rows = rows.join(before, "record_id", "left_anti")
        save(attributed(once(rows), pair_sims, decide, scores, gate), number)

    query = records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def decided(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """record_id of what batches before that number decided; None if there is none. Later partitions are what a lost run left."""
    if before == 0 or not exists(spark, out):
        return None
    return spark.read.parquet(out).filter(F.col("batch") < before).select("record_id")
