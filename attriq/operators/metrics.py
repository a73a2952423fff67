"""Quality of decisions(record_id, predicted, truth, ...)."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import NIL


def _zero_safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b > 0, a / b), F.lit(0.0))


def _same(a: str = "predicted", b: str = "truth") -> Column:
    return F.lower(a) == F.lower(b)


def f1_columns(digits: int = 6) -> list[Column]:
    """tp, fp, fn, tn, precision, recall, f1: a wrong profile counts as a miss only, a profile for a record without one as a false hit."""
    nil, true_nil = F.lower("predicted") == NIL, F.lower("truth") == NIL
    tp, fp = F.count_if(~true_nil & _same()), F.count_if(true_nil & ~nil)
    fn, tn = F.count_if(~true_nil & ~_same()), F.count_if(true_nil & nil)
    p, r = _zero_safe(tp, tp + fp), _zero_safe(tp, tp + fn)
    f = _zero_safe(2 * p * r, p + r)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), *[F.round(x, digits).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))]]


def micro_f1(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*f1_columns())


def stratified_f1(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("subtype", F.coalesce("subtype", F.lit("unknown"))).groupBy("subtype").agg(*f1_columns(4))


def accuracy(decisions: DataFrame) -> DataFrame:
    """Exact and case-insensitive accuracy, share of `none`; 0 where there are no rows."""
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    return decisions.agg(F.count("*").alias("n"), share(F.col("predicted") == F.col("truth")).alias("accuracy"), share(_same()).alias("accuracy_any_case"), share(F.col("predicted") == NIL).alias("nil_rate"))


def accuracy_by(decisions: DataFrame, *keys: str) -> DataFrame:
    """Accuracy by each key alone and over all, in one pass: grouping sets."""
    ok = (F.col("predicted") == F.col("truth")).cast("double")
    return decisions.groupingSets([*[[F.col(k)] for k in keys], []], *map(F.col, keys)).agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


def stratified_gate(arbitrated: DataFrame) -> DataFrame:
    """(subtype, n, acc_llm_only, acc_gated) of the decisions that were judged: right before and after the gate."""
    judged = arbitrated.filter((F.col("subtype") != "NONE") & (F.col("strategy") != "auto"))
    share = lambda c: F.round(F.avg((F.col(c) == F.col("truth")).cast("double")), 4)
    return judged.groupBy("subtype").agg(F.count("*").alias("n"), share("original").alias("acc_llm_only"), share("predicted").alias("acc_gated"))


def case_totals(cases: DataFrame) -> DataFrame:
    """Counts of a judgement run: all, right, unfinished, unparsed and none, and tokens in, out and on average."""
    n = F.greatest(F.count("*"), F.lit(1))
    mean = lambda c: F.floor(F.coalesce(F.sum(c), F.lit(0)) / n)
    return cases.agg(
        F.count("*").alias("n"), F.count_if("match").alias("correct"), F.count_if(F.col("status") == "unfinished").alias("unfinished"), F.count_if(F.col("status") == "parse_fail").alias("parse_fail"),
        F.count_if(F.col("pred") == NIL).alias("none"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_tokens", "out_tokens")], mean("in_tokens").alias("mean_in"), mean("out_tokens").alias("mean_out"),
    )


def metrics_line(scores: DataFrame) -> DataFrame:
    """One line of text for each row of micro_f1."""
    p = [F.format_string("%.4f", c) for c in ("f1", "precision", "recall")]
    counts = F.format_string("TP=%d FN=%d FP=%d TN=%d", "tp", "fn", "fp", "tn")
    return scores.select(F.concat_ws("  ", F.concat(F.lit("F1="), p[0]), F.concat(F.lit("P="), p[1]), F.concat(F.lit("R="), p[2]), counts).alias("line"))


def token_totals(decisions: DataFrame, tokens: str, *keys: str) -> DataFrame:
    return decisions.groupingSets([*[[F.col(k)] for k in keys], []], *map(F.col, keys)).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"))


def author_counts(decisions: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """For each true profile: records that are its, that it was given, and both. weight: how many records a row stands for."""
    w = F.lit(1) if weight is None else F.col(weight)
    truth = decisions.filter(F.col("truth") != NIL).groupBy(*by, F.col("truth").alias("aid"))
    truth = truth.agg(F.sum(w).alias("support"), F.sum(F.when(F.col("predicted") == F.col("truth"), w).otherwise(0)).alias("hits"))
    given = decisions.filter(F.col("predicted") != NIL).groupBy(*by, F.col("predicted").alias("aid")).agg(F.sum(w).alias("given"))
    return truth.join(given, [*by, "aid"], "left").withColumn("given", F.coalesce("given", F.lit(0)))


def weighted_f1(decisions: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Precision and recall of each true profile, weighted by its records, and the F of the two."""
    c = author_counts(decisions, *by, weight=weight)
    return weighted_scores(c, *by)


def weighted_scores(counts: DataFrame, *by: str) -> DataFrame:
    """Weighted precision, recall and F of counts(aid, support, hits, given)."""
    n = F.sum("support")
    p = _zero_safe(F.sum(F.col("support") * F.col("hits") / F.greatest("given", F.lit(1))), n)
    r = _zero_safe(F.sum("hits").cast("double"), n)
    out = counts.groupBy(*by).agg(p.alias("p"), r.alias("r"))
    return out.select(*by, F.round("p", 6).alias("wp"), F.round("r", 6).alias("wr"), F.round(_zero_safe(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("wf1"))


def cross_tab(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many records of both runs each got right, and the first 20 records of each cell."""
    both = a.select("record_id", "truth", F.col("predicted").alias("pa")).join(b.select("record_id", F.col("predicted").alias("pb")), "record_id")
    both = both.withColumns({"a_ok": _same("pa"), "b_ok": _same("pb")})
    w = Window.partitionBy("a_ok", "b_ok").orderBy("record_id")
    few = both.withColumn("k", F.row_number().over(w)).filter("k <= 20").groupBy("a_ok", "b_ok").agg(F.array_sort(F.collect_list("record_id")).alias("sample"))
    return both.groupBy("a_ok", "b_ok").agg(F.count("*").alias("n")).join(few, ["a_ok", "b_ok"])


def discordant(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("record_id", "truth", F.col("predicted").alias("pa")).join(b.select("record_id", F.col("predicted").alias("pb")), "record_id")
    ok_a, ok_b = F.col("pa") == F.col("truth"), F.col("pb") == F.col("truth")
    return both.agg(F.count_if(ok_a & ~ok_b).alias("a_only"), F.count_if(~ok_a & ok_b).alias("b_only"), F.round(F.avg((F.col("pa") == F.col("pb")).cast("double")), 6).alias("agreement"))


def mcnemar(a: DataFrame, b: DataFrame) -> tuple[int, int, float]:
    """Discordant counts and the exact two-sided p; the counts come from Spark, the sum is two numbers' work."""
    row = discordant(a, b).first()
    x, y = row["a_only"], row["b_only"]
    n, k = x + y, min(x, y)
    p = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
    return x, y, p
