"""Candidates of each record: aggregates of pair similarities, threshold, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import Recall

TOPS = (3, 5, 10)


# Names of a candidate's columns in the tables of either split, the first that is there counts.
ALIASES = {"aid": ("aid", "candidate_aid"), "org_sim": ("org_sim", "org_sim_max", "main_org_sim"), "venue_sim": ("venue_sim", "venue_sim_max"), "title_sim_max": ("title_sim_max", "title_sim")}


def aliased(found: Callable[[str], Column], names: list[str]) -> dict[str, Column]:
    """The canonical columns of a candidate from whichever of its names are there; similarities that aren't are 0."""
    out = {}
    for name, among in ALIASES.items():
        there = [found(c) for c in among if c in names]
        out[name] = F.coalesce(*there, *([] if name == "aid" else [F.lit(0.0)])) if there else F.lit(None if name == "aid" else 0.0)
    return out


def normalized(candidates: DataFrame) -> DataFrame:
    """candidates with aid, org_sim, venue_sim and title_sim_max under these names, and without their aliases."""
    new = aliased(F.col, candidates.columns)
    others = [c for c in candidates.columns if all(c not in among for among in ALIASES.values())]
    return candidates.select(*[v.alias(k) for k, v in new.items()], *others)


def mean_of_first(k: int, value: str = "title_sim", place: str = "place") -> Column:
    """The mean of the values at the first k places, whatever order they are added in: sums of decimals."""
    first = F.when(F.col(place) <= k, F.col(value))
    return F.sum(first.cast("decimal(18,12)")).cast("double") / F.nullif(F.count(first), F.lit(0))


def aggregate_candidates(pair_sims: DataFrame) -> DataFrame:
    """One row for each (record, profile): greatest similarities, and means of the greatest 3, 5 and 10 titles.

    NaN counts as missing. Only the ten best papers of a group carry a rank past the sort; the other
    maxima come from the same pass.
    """
    def number(c: str) -> Column:
        return F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c)

    tidy = pair_sims.select("record_id", "aid", "pub_id", number("title_sim"), number("org_sim"), number("venue_sim"), "coauthor_count", "coauthor_org_match_count")
    w = Window.partitionBy("record_id", "aid").orderBy(F.col("title_sim").desc_nulls_last(), "pub_id")
    ranked = tidy.withColumn("place", F.row_number().over(w))
    means = [F.coalesce(mean_of_first(k), F.lit(0.0)).alias(f"title_sim_top{k}_avg") for k in TOPS]
    return ranked.groupBy("record_id", "aid").agg(
        F.max("title_sim").alias("title_sim_max"), *means, F.max("coauthor_count").alias("coauthor_count"),
        F.max("coauthor_org_match_count").alias("coauthor_org_match_count"), F.max("org_sim").alias("org_sim"), F.max("venue_sim").alias("venue_sim"),
    )


def recall(pair_sims: DataFrame, limits: Recall = Recall()) -> DataFrame:
    """Candidates over the title threshold, ranked within their record."""
    kept = aggregate_candidates(pair_sims).filter(F.col("title_sim_max") >= limits.title)
    w = Window.partitionBy("record_id").orderBy(F.col("title_sim_max").desc(), "aid")
    return kept.withColumn("rank", F.row_number().over(w))


def sim_features(pair_sims: DataFrame) -> DataFrame:
    """The seven aggregated similarity features of each (record, profile); missing ones 0."""
    agg = lambda f, c, n: F.coalesce(f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))), F.lit(0.0)).alias(n)
    return pair_sims.groupBy("record_id", "aid").agg(
        agg(F.max, "title_sim", "title_max"), agg(F.max, "venue_sim", "venue_max"), agg(F.avg, "venue_sim", "venue_avg"),
        agg(F.max, "coauthor_count", "coauthor_count_max"), agg(F.max, "coauthor_ratio", "coauthor_ratio_max"), agg(F.max, "org_sim", "org_max"),
        agg(F.max, "coauthor_org_match_count", "coauthor_org_match_max"),
    )
