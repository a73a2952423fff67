"""Classes of records by the evidence of their candidates, and what follows from a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import DEFAULT_PROMPT, DEFAULT_STRATEGY, PROMPT_TYPES, RULE_FIRST_OF, STRATEGIES, RuleFirst, Subtype


def evidence(candidates: DataFrame) -> DataFrame:
    """What classification needs of each record: first coauthor match in the top three, rivals, and the values at that candidate and at the top.

    A table with the first candidates only, three by rank at least, has the number of all in n.
    """
    has = F.col("coauthor_count") > 0
    top3 = F.col("rank") <= 3
    at = F.struct("rank", "aid", "title_sim_max", "coauthor_count", "coauthor_org_match_count")
    first = F.min(F.when(has & top3, at))
    top = F.max(F.when(F.col("rank") == 1, F.struct("aid", "title_sim_max", "title_sim_top5_avg", "org_sim", "venue_sim", "coauthor_count")))
    second = F.max(F.when(F.col("rank") == 2, F.col("title_sim_max")))
    return candidates.groupBy("record_id").agg(
        (F.max("n") if "n" in candidates.columns else F.count("*")).alias("num_candidates"), first.alias("hit"), F.count_if(has & top3).alias("rivals"), top.alias("top"), second.alias("second_title"),
    )


def llm_first_subtype(c: Subtype = Subtype()) -> Column:
    """The class of a row of evidence(); ordered rules, the first that holds decides."""
    hit, top = (lambda n: F.col(f"hit.{n}")), (lambda n: F.col(f"top.{n}"))
    verified = hit("coauthor_org_match_count") > 0
    p0 = (
        F.when((top("title_sim_max") >= c.p0_high_title) & (top("org_sim") >= c.p0_high_org) & (top("venue_sim") >= c.p0_high_venue), "P0-High")
        .when((top("title_sim_max") >= c.p0_medium_title) & (top("title_sim_top5_avg") >= c.p0_medium_top5), "P0-Medium")
        .otherwise("P0-Low")
    )
    p1 = (
        F.when((hit("title_sim_max") >= c.p1_strong_title) & (hit("coauthor_count") >= c.p1_strong_coauthors) & verified, "P1-Strong")
        .when((hit("title_sim_max") >= c.p1_high_title) & (hit("coauthor_count") >= c.p1_high_coauthors), "P1-High")
        .when(hit("title_sim_max") >= c.p1_medium_title, "P1-Medium")
        .otherwise("P1-Weak")
    )
    comp = F.when(F.col("rivals") >= 2, "-Comp").otherwise("")
    return (
        F.when(F.coalesce("num_candidates", F.lit(0)) == 0, "NONE")
        .when(F.col("hit").isNull(), p0)
        .when(hit("rank") == 1, F.concat(p1, comp))
        .otherwise(F.concat(F.lit("P"), hit("rank").cast("string"), comp))
    )


def difficulty(subtype: Column) -> Column:
    return (
        F.when(subtype == "NONE", "L0")
        .when(subtype.isin("P1-Strong", "P1-High", "P0-High"), "L1")
        .when(subtype.isin("P1-Medium", "P1-Strong-Comp", "P1-High-Comp", "P0-Medium", "P2"), "L2")
        .otherwise("L3")
    )


def strategy(subtype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, subtype), F.lit(DEFAULT_STRATEGY))


def prompt_type(strategy: Column) -> Column:
    """The type of a strategy's system prompt."""
    table = F.create_map(*[F.lit(x) for kv in PROMPT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, strategy), F.lit(DEFAULT_PROMPT))


def rule_first_of(subtype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RULE_FIRST_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, subtype), F.lit("LLM-Co"))


def classify(records: DataFrame, candidates: DataFrame, c: Subtype = Subtype()) -> DataFrame:
    """records(record_id) with subtype, difficulty, strategy and the evidence; those without candidates are NONE."""
    out = records.select("record_id").join(evidence(candidates), "record_id", "left")
    out = out.withColumn("subtype", llm_first_subtype(c))
    reason = F.format_string("candidates=%d position=%d rivals=%d", F.coalesce("num_candidates", F.lit(0)), F.coalesce("hit.rank", F.lit(0)), F.coalesce("rivals", F.lit(0)))
    return out.withColumns({"difficulty": difficulty(F.col("subtype")), "strategy": strategy(F.col("subtype")), "reason": reason, "num_candidates": F.coalesce("num_candidates", F.lit(0))})


def top_gap(candidates: DataFrame, least: float = 0.05, many: int = 10) -> DataFrame:
    """Gap between the two best titles of each record (0 if there is no second) and whether candidates compete."""
    e = evidence(candidates)
    gap = F.round(F.coalesce(F.col("top.title_sim_max") - F.col("second_title"), F.lit(0.0)), 6)
    return e.select("record_id", "num_candidates", gap.alias("gap"), ((F.col("num_candidates") > many) | (gap < least)).alias("competition"))


def co_order(boolean_match: bool = False) -> list[Column]:
    """The order of candidates by coauthor evidence: bucket, org matches (or only whether any), org, venue, title, then aid."""
    bucket = F.when(F.col("coauthor_org_match_count") > 0, 0).when(F.col("coauthor_count") > 0, 1).otherwise(2)
    match = (F.col("coauthor_org_match_count") > 0).cast("int") if boolean_match else F.col("coauthor_org_match_count")
    return [bucket, match.desc(), F.col("org_sim").desc(), F.col("venue_sim").desc(), F.col("title_sim_max").desc(), F.col("aid")]


def order_by_coauthors(candidates: DataFrame, boolean_match: bool = False) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy(*co_order(boolean_match))
    return candidates.withColumn("co_rank", F.row_number().over(w))


def rule_first(records: DataFrame, candidates: DataFrame, c: RuleFirst = RuleFirst()) -> DataFrame:
    """records with the rule-first class of their best candidate by coauthor evidence."""
    best = order_by_coauthors(candidates).filter("co_rank = 1")
    co, match = F.col("coauthor_count"), F.col("coauthor_org_match_count")
    title, org, venue = F.col("title_sim_max"), F.col("org_sim"), F.col("venue_sim")
    rules = [
        (F.col("aid").isNull(), "NONE", "no_candidates"),
        ((co == 0) & (org < c.none_org), "NONE", "no_coauthor_weak_org_match"),
        ((co == 0) & (title < c.none_title) & (venue < c.none_venue) & (org < c.none_strong_org), "NONE", "weak_title_weak_venue_medium_org"),
        ((co >= c.auto_coauthors) & (match >= c.auto_matches), "AUTO", "multi_coauthor_org_verified"),
        ((co == 0) & (org >= c.auto_org) & (title >= c.auto_org_title), "AUTO", "strong_org_match"),
        ((match >= c.auto_matches) & (title >= c.auto_match_title), "AUTO", "org_verified_strong_title"),
        ((match >= c.auto_matches) & (title >= c.auto_mixed_title) & (venue >= c.auto_mixed_venue), "AUTO", "org_verified_strong_title_venue"),
        (co >= 1, "LLM-Co", None),
    ]
    kind, why = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, then, because in rules[1:]:
        kind, why = kind.when(when, then), why.when(when, F.lit(because))
    out = records.select("record_id").join(best, "record_id", "left")
    return out.select("record_id", F.col("aid").alias("top_aid"), kind.otherwise("LLM-NoCo").alias("kind"), why.alias("reason"))
