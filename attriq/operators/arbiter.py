"""The gate that keeps, withdraws or fills a decision by a learned score, and its replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import NIL, Gate
from attriq.operators.metrics import weighted_f1


def routed() -> Column:
    """Whether a decision passes the gate: not those made without judgement, nor errors."""
    return ~((F.col("subtype") == "NONE") | (F.col("strategy") == "auto") | (F.col("predicted") == "error"))


def best_scores(scores: DataFrame) -> DataFrame:
    """The best candidate of each record of scores(record_id, aid, score); ties go to the least aid."""
    w = Window.partitionBy("record_id").orderBy(F.col("score").desc(), "aid")
    return scores.withColumn("k", F.row_number().over(w)).filter("k = 1").select("record_id", F.col("aid").alias("top_aid"), F.col("score").alias("top_score"))


def with_scores(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """decisions with the score of what was predicted and the best candidate."""
    own = scores.select("record_id", F.col("aid").alias("predicted"), F.col("score").alias("own_score"))
    return decisions.join(own, ["record_id", "predicted"], "left").join(best_scores(scores), "record_id", "left")


def rule(withdraw: Column, fill: Column) -> Column:
    """A: an assigned candidate under `withdraw`; B: none where the best reaches `fill`; else null."""
    a = (F.col("predicted") != NIL) & F.col("own_score").isNotNull() & (F.col("own_score") < withdraw)
    b = (F.col("predicted") == NIL) & (F.col("top_score") >= fill)
    return F.when(routed() & a, "A").when(routed() & b, "B")


def arbitrate(decisions: DataFrame, scores: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """decisions with rule_applied (A, B, keep or skip) and predicted after the gate; no decision is sent to another profile."""
    out = with_scores(decisions, scores).withColumn("hit", rule(F.lit(gate.withdraw), F.lit(gate.fill)))
    after = F.when(F.col("hit") == "A", NIL).when(F.col("hit") == "B", F.col("top_aid")).otherwise(F.col("predicted"))
    proba = F.when(F.col("predicted") == NIL, F.col("top_score")).otherwise(F.col("own_score"))
    return out.select(
        "record_id", F.col("predicted").alias("original"), after.alias("predicted"), F.when(~routed(), "skip").otherwise(F.coalesce("hit", F.lit("keep"))).alias("rule_applied"),
        F.round(proba, 6).alias("model_proba"), *[c for c in decisions.columns if c not in ("record_id", "predicted")],
    )


def rule_counts(arbitrated: DataFrame) -> DataFrame:
    return arbitrated.agg(*[F.count_if(F.col("rule_applied") == r).alias(n) for r, n in (("A", "withdrawn"), ("B", "filled"), ("keep", "kept"), ("skip", "skipped"))], F.count_if((F.col("original") != NIL) & (F.col("predicted") != NIL) & (F.col("original") != F.col("predicted"))).alias("redirected"))


def score_only(records: DataFrame, scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Decisions by score alone: the best candidate, always or at the threshold; none without candidates."""
    top = records.select("record_id").join(best_scores(scores), "record_id", "left")
    good = F.col("top_aid").isNotNull() if threshold is None else F.col("top_score") >= threshold
    return top.select("record_id", F.when(good, F.col("top_aid")).otherwise(NIL).alias("predicted"))


def _steps(cases: DataFrame, steps: int) -> DataFrame:
    """decisions with what moves over the grid: a (withdrawn from step on), b (filled below step) or c (neither), and the profile given."""
    axis = F.sequence(F.lit(0), F.lit(steps - 1))
    keeps = F.size(F.filter(axis, lambda k: ~(F.col("own_score") < k / 100)))
    fills = F.size(F.filter(axis, lambda k: F.col("top_score") >= k / 100))
    assigned = routed() & (F.col("predicted") != NIL) & F.col("own_score").isNotNull()
    empty = routed() & (F.col("predicted") == NIL) & F.col("top_score").isNotNull()
    kind, step = F.when(assigned, "a").when(empty, "b").otherwise("c"), F.when(assigned, keeps).when(empty, fills)
    return cases.withColumns({"kind": kind, "step": step, "given": F.nullif(F.when(empty, F.col("top_aid")).otherwise(F.col("predicted")), F.lit(NIL))})


def grid(decisions: DataFrame, scores: DataFrame, steps: int = 31, *by: str) -> DataFrame:
    """Weighted F1 after the gate at each pair of thresholds of a grid from 0 by hundredths.

    What a profile is given and hits is a sum of what the first threshold withdraws and what the second
    fills. So each profile has one row of counts by step, and only profiles that both thresholds touch are
    spread over the whole grid, others over one axis or not at all.
    """
    axis = F.sequence(F.lit(0), F.lit(steps - 1))
    cases = _steps(with_scores(decisions, scores), steps)
    given = cases.filter(F.col("given").isNotNull()).select(*by, F.col("given").alias("aid"), "kind", "step", F.lit(1).alias("g"), (F.col("given") == F.col("truth")).cast("int").alias("h"), F.lit(0).alias("s"))
    true = cases.filter(F.col("truth") != NIL).select(*by, F.col("truth").alias("aid"), F.lit("c").alias("kind"), F.lit(None).cast("int").alias("step"), F.lit(0).alias("g"), F.lit(0).alias("h"), F.lit(1).alias("s"))
    counts = given.unionByName(true).groupBy(*by, "aid", "kind", "step").agg(*[F.sum(c).alias(c) for c in "ghs"])
    list_of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("step", "g", "h"))).alias(k)
    fixed = lambda c: F.sum(F.when(F.col("kind") == "c", F.col(c)).otherwise(0)).alias(c)
    profiles = counts.groupBy(*by, "aid").agg(fixed("g"), fixed("h"), F.sum("s").alias("s"), list_of("a"), list_of("b")).filter("s > 0")
    total = lambda rows, c, k: F.aggregate(F.filter(rows, lambda x: x["step"] > k), F.lit(0).cast("long"), lambda t, x: t + x[c])
    along = lambda c: F.explode(F.when(F.size(c) > 0, axis).otherwise(F.array(F.lit(None).cast("int"))))
    spread = profiles.withColumn("ia", along("a")).withColumn("ib", along("b"))
    at = lambda c: F.col(c) + total(F.col("a"), c, F.coalesce("ia", F.lit(0))) + total(F.col("b"), c, F.coalesce("ib", F.lit(0)))
    cells = spread.select(*by, "ia", "ib", "s", at("g").alias("given"), at("h").alias("hits"))
    sums = cells.groupBy(*by, "ia", "ib").agg(F.sum(F.col("s") * F.col("hits") / F.greatest("given", F.lit(1))).alias("p"), F.sum("hits").alias("r"), F.sum("s").alias("n"))
    # What depends on no or one threshold counts in each cell of the others; these are a few rows for each axis.
    every = lambda c: F.explode(F.when(F.col(c).isNull(), axis).otherwise(F.array(c)))
    out = sums.withColumn("ia", every("ia")).withColumn("ib", every("ib")).groupBy(*by, "ia", "ib").agg(*[F.sum(c).alias(c) for c in "prn"])
    p, r = F.col("p") / F.col("n"), F.col("r") / F.col("n")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select(*by, "ia", "ib", F.round(p, 6).alias("wp"), F.round(r, 6).alias("wr"), F.round(f, 6).alias("wf1"))


def best_cell(cells: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("wf1").desc(), "ia", "ib")
    return cells.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def transfer(decisions: DataFrame, scores: DataFrame, steps: int = 31, fixed: Gate = Gate()) -> DataFrame:
    """Thresholds tuned on one half of the records (by crc32 parity) and scored on the other, both ways; there also fixed ones and no gate."""
    half = lambda df: df.withColumn("half", (F.crc32(F.col("record_id").cast("binary")) % 2).cast("int"))
    halves = half(decisions)
    cells = grid(halves, scores, steps, "half")
    tuned = best_cell(cells, "half").select(F.col("half").alias("tuned_on"), "ia", "ib", F.col("wf1").alias("tuned_f1"))
    other = cells.select((1 - F.col("half")).alias("tuned_on"), "ia", "ib", F.col("wf1").alias("other_f1"))
    frozen = half(arbitrate(decisions, scores, fixed))
    named = lambda df, name: weighted_f1(df, "half").select((1 - F.col("half")).alias("tuned_on"), F.col("wf1").alias(name))
    return tuned.join(other, ["tuned_on", "ia", "ib"]).join(named(frozen, "fixed_f1"), "tuned_on").join(named(halves, "plain_f1"), "tuned_on")


def transfer_means(transferred: DataFrame) -> DataFrame:
    """The means of both directions: without a gate, with thresholds from the other half, with fixed ones, and the last two's difference."""
    mean = lambda c: F.avg(c)
    return transferred.agg(*[F.round(mean(c), 6).alias(n) for c, n in (("plain_f1", "plain"), ("other_f1", "transferred"), ("fixed_f1", "fixed"))], F.round(mean("fixed_f1") - mean("other_f1"), 6).alias("overfit"))
