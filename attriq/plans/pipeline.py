"""Stage tables of a run: written once, read by the next stage, resumed where one is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriq.config import Gate
from attriq.operators import arbiter, decide, recall, subtype
from attriq.operators.joins import not_done, realigned
from attriq.operators.sets import first_wins, merged_answers
from attriq.plans.progress import Progress, Snapshot
from attriq.sources import done, exists, once
from attriq.sources.sinks import append, write_if_absent

Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def run_stages(spark: SparkSession, base: str, stages: list[Stage], chosen: list[str] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Tables by stage: a stage runs if it is chosen and its table isn't there, or if forced; else its table is read."""
    tables: dict[str, DataFrame] = {}
    for name, make in stages:
        path = f"{base.rstrip('/')}/{name}"
        if chosen is None or name in chosen:
            ready = exists(spark, path) and not force
            tables[name] = spark.read.parquet(path) if ready else write_if_absent(make(tables), path, force)
        elif exists(spark, path):
            tables[name] = spark.read.parquet(path)
    return tables


def attribution(records: DataFrame, pair_sims: DataFrame, scores: Callable[[DataFrame], DataFrame], gate: Gate = Gate()) -> list[Stage]:
    """The stages from pair similarities to arbitrated decisions, with the rule decider."""
    return [
        ("candidates", lambda t: recall.recall(pair_sims)),
        ("classified", lambda t: subtype.classify(records, t["candidates"])),
        ("decisions", lambda t: decide.decide_by_rules(t["classified"], t["candidates"])),
        ("arbitrated", lambda t: arbiter.arbitrate(t["decisions"], scores(t["candidates"]), gate)),
    ]


def resume(spark: SparkSession, records: DataFrame, path: str, judge: Callable[[DataFrame], DataFrame], probe: int | None = None, every: int | None = None, on_progress: Callable[[Snapshot], None] | None = None) -> int:
    """Judges the records that path lacks (the first `probe` at most) and appends those that came out well; returns how many are missing still.

    With `every`, about so many are judged and saved at a time, dealt by their ids' hash. Records that don't come out well are not asked
    again in the same run. on_progress gets snapshots while it runs, if judge's rows have in_tokens and out_tokens as decide.call's do.
    """
    left = once(records.join(done(spark, path), "record_id", "left_anti"))
    if probe is not None:
        left = once(left.orderBy("record_id").limit(probe))
    if every is None:
        batches = [left]
    else:
        n = -(-left.count() // every)
        batches = [left.filter(F.pmod(F.xxhash64("record_id"), F.lit(n)) == k) for k in range(n)]
    if on_progress is None:
        for b in batches:
            append(judge(b).filter("status = 'ok'"), path)
    else:
        progress = Progress(spark, left.count())
        with progress.watch(on_progress):
            for b in batches:
                append(once(progress.counted(judge(b))).filter("status = 'ok'"), path)
    return records.join(done(spark, path), "record_id", "left_anti").count()


def bulk_contents(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content) of the results of bulk jobs, JSON lines; content is null where a result has no answer."""
    at = ("$.response.body.choices[0].message.content", "$.response.choices[0].message.content")
    return spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.coalesce(*[F.get_json_object("value", a) for a in at]).alias("content"))


def bulk_answers(requests: DataFrame, *contents: DataFrame) -> DataFrame:
    """requests(record_id, ...) with what contents(custom_id, content) say and a status as decide.call has it; blank, malformed and missing answers are errors."""
    found, _ = merged_answers(*contents)
    out = requests.join(found.select(F.col("custom_id").alias("record_id"), "content"), "record_id", "left")
    missing = F.col("content").isNull()
    return out.withColumns({"status": F.when(missing, "error").otherwise("ok"), "kind": F.when(missing, "runtime_error"), "content": F.coalesce("content", F.lit("no answer in the bulk job")), "in_tokens": F.lit(0).cast("long"), "out_tokens": F.lit(0).cast("long")})


def final_table(target: DataFrame, made: DataFrame, *done: DataFrame) -> DataFrame:
    """The rows of target(record_id, pos), in its order: those made now before those done earlier, errors left out; fails if any is missing."""
    every = first_wins(made.filter("predicted <> 'error'"), *done).drop("copies")
    lost = not_done(target, every).count()
    if lost:
        raise ValueError(f"{lost} records are missing")
    return realigned(target, every)
