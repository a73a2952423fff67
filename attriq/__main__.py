"""Commands: candidates, gate and submission, each from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attriq import sources
from attriq.config import Gate
from attriq.operators import arbiter, joins, recall, scorer, sets, subtype
from attriq.sources import sinks
from attriq.timing import Timer


def shard_of(text: str) -> tuple[int, int]:
    """k:n as (n, k)."""
    k, _, n = text.partition(":")
    if not 0 <= int(k) < int(n) <= 64:
        raise argparse.ArgumentTypeError("k:n with 0 <= k < n <= 64")
    return int(n), int(k)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attriq", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("candidates", help="similarity CSV to candidates and classes, as Parquet under --out")
    c.add_argument("similarities")
    c.add_argument("--out", required=True)
    c.add_argument("--title", type=float, default=recall.Recall().title)
    c.add_argument("--record")
    c.add_argument("--shard", type=shard_of)
    c.add_argument("--subtypes-limit", type=sets.parse_limits)
    c.add_argument("--limit", type=int)
    g = sub.add_parser("gate", help="decision CSV to decisions after the gate")
    g.add_argument("results")
    g.add_argument("--features", required=True, help="JSON lines")
    g.add_argument("--model", required=True, help="trees as text")
    g.add_argument("--out", required=True)
    g.add_argument("--theta-a", type=float, default=0.12)
    g.add_argument("--theta-b", type=float, default=0.50)
    g.add_argument("--relax-candidate-check", action="store_true")
    s = sub.add_parser("submission", help="decision CSV to papers by profile, one JSON object a line")
    s.add_argument("results")
    s.add_argument("--out", required=True)
    return top


def decisions(spark: SparkSession, path: str):
    """Decision rows from CSV, under this library's names."""
    raw = sources.decisions(spark, path)
    found = raw.select(*[F.col(v).alias(k) for k, v in sinks.RESULT_COLUMNS.items() if v in raw.columns])
    return found.withColumn("num_candidates", F.col("num_candidates").try_cast("int")) if "num_candidates" in found.columns else found


def candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    found = recall.recall(sources.pair_sims(spark, a.similarities), recall.Recall(a.title))
    found.write.mode("overwrite").parquet(f"{a.out}/candidates")
    found = spark.read.parquet(f"{a.out}/candidates")
    records = sources.pair_sims(spark, a.similarities).select("record_id").distinct()
    made = subtype.classify(records, found)
    kinds = list(a.subtypes_limit) if a.subtypes_limit else None
    limits = {k: v for k, v in (a.subtypes_limit or {}).items() if v is not None}
    # Subtypes without a number have no quota; the others go by theirs.
    kept = sets.run_filter(made, only=a.record, shard_of=a.shard, subtypes=kinds, order="record_id")
    if limits:
        kept = sets.per_group(kept, "subtype", "record_id", limits)
    if a.limit is not None:
        kept = kept.orderBy("record_id").limit(a.limit)
    kept.write.mode("overwrite").parquet(f"{a.out}/classified")


def gate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, features = decisions(spark, a.results), sources.feature_index(spark, a.features)
    bad = joins.check_candidates(rows, features, strict=not a.relax_candidate_check)
    print(f"records whose candidates differ: {bad.count()}")
    if not a.relax_candidate_check:
        bad.collect()
    out = arbiter.arbitrate(rows, scorer.score_text(scorer.load_text(spark, a.model), features), Gate(a.theta_a, a.theta_b))
    sinks.write_csv(out.withColumnRenamed("original", "original_predicted_author_id"), a.out)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    with Timer() as t:
        if a.command == "submission":
            sinks.write_submission(decisions(spark, a.results), a.out)
        else:
            {"candidates": candidates, "gate": gate}[a.command](spark, a)
    print(f"{a.command}: {t.elapsed:.1f} s")


if __name__ == "__main__":
    main()
