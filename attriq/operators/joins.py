"""Joins between records, truth, profiles, papers and runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import NIL
from attriq.functions.names import answer_keys, name_parts, names_match, query_keys


def with_truth(records: DataFrame, truth: DataFrame) -> DataFrame:
    """records with the profile that is right, `none` where the truth names none."""
    return records.join(truth.select("record_id", F.col("aid").alias("truth")), "record_id", "left").withColumn("truth", F.coalesce("truth", F.lit(NIL)))


def profile_papers(profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """One row for each paper of each profile, in the profile's order; papers that don't exist are dropped."""
    flat = profiles.select("aid", F.posexplode("pubs").alias("pos", "pub_id"))
    return flat.join(papers, "pub_id")


def matched_coauthors(record_authors: DataFrame, profile_authors: DataFrame, similar: Column, threshold: float = 0.7) -> DataFrame:
    """Profile's authors that a record shares, by the names' normal form, and those whose organisation is similar too.

    record_authors(record_id, block, name_key, org) without the record's own slot; profile_authors(aid, block,
    name, name_key, org_b). similar compares org and org_b (a cosine, say), null where either is missing.
    Distinct names as they are written count; best is the greatest similarity over all.
    """
    met = record_authors.join(profile_authors, ["block", "name_key"]).groupBy("record_id", "aid", "name").agg(F.max(F.coalesce(similar, F.lit(0.0))).alias("org_sim"))
    return met.groupBy("record_id", "aid").agg(F.count("*").alias("matched"), F.count_if(F.col("org_sim") >= threshold).alias("verified"), F.max("org_sim").alias("best"))


def match_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left(id, name) and right(id_b, name_b) whose names match; names of left may be abbreviated.

    Two names only meet if they share two parts or initials (one where one is enough), so that an initial
    alone brings together none but names of one part. Equal normal forms are compared once.
    """
    a, b = left.withColumn("parts", name_parts(F.col("name"))), right.withColumn("parts_b", name_parts(F.col("name_b")))
    key = lambda keys: F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("key")
    x = a.select("parts").distinct().select("parts", key(query_keys(F.col("parts"))))
    y = b.select("parts_b").distinct().select("parts_b", key(answer_keys(F.col("parts_b"))))
    met = x.join(y, "key").filter(names_match(F.col("parts"), F.col("parts_b"))).select("parts", "parts_b").distinct()
    return a.join(met, "parts").join(b, "parts_b").select("id", "name", "id_b", "name_b")


def realigned(target: DataFrame, results: DataFrame) -> DataFrame:
    """results in the order of target(record_id, pos), with the target's rows only."""
    return target.select("record_id", "pos").join(results, "record_id").orderBy("pos").drop("pos")


def _products(queries: DataFrame, rows: DataFrame, keep: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], kinds: str, block: int, part: int) -> DataFrame:
    """What keep makes of each block of queries(q, vec), each part of rows(id, vec, ...) and the matrix of their cosines.

    A task's matrix has about block * part cells, whatever the sizes of the tables.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / part))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.withColumn("block", at("q", blocks)).withColumn("part", each(parts))
    b = rows.withColumn("part", at("id", parts)).withColumn("block", each(blocks))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        unit = []
        for f in (x, y):
            m = np.stack(f["vec"].to_numpy()).astype("float64")
            size = np.sqrt((m * m).sum(axis=1, keepdims=True))
            unit.append(np.divide(m, size, out=np.zeros_like(m), where=size > 0))
        return keep(x, y, unit[0] @ unit[1].T)

    return a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInPandas(product, kinds)


def vector_scores(queries: DataFrame, rows: DataFrame, least: float | None = None, block: int = 1024, part: int = 8192) -> DataFrame:
    """(q, id, score): the cosine of each vector of queries(q, vec) with each of rows(id, vec); 0 where a vector is zero.

    least: pairs that score less are left out where they meet. Queries are dealt in blocks of about `block`
    and rows in parts of about `part`; each block meets each part in one task, as one product of matrices.
    """

    def keep(x: pd.DataFrame, y: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(scores >= (-np.inf if least is None else least))
        return pd.DataFrame({"q": x["q"].to_numpy()[i], "id": y["id"].to_numpy()[j], "score": scores[i, j]})

    kinds = f"q {queries.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    return _products(queries, rows, keep, kinds, block, part)


def vector_top(queries: DataFrame, rows: DataFrame, most: int, digits: int = 6, block: int = 1024, part: int = 8192) -> DataFrame:
    """(q, group, id, score, place): the `most` best of rows(id, group, vec) by cosine for each query and group.

    Scores are rounded to `digits`; ties go to the least id; a null group is a group. Each task keeps its own
    best only, so what leaves it grows with queries * groups * most and not with the pairs.
    """

    def keep(x: pd.DataFrame, y: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        order = y["id"].argsort(kind="stable").to_numpy()
        y, scores = y.iloc[order], np.round(scores[:, order], digits)
        out = []
        for members in y.groupby("group", dropna=False, sort=False).indices.values():
            best = members[np.argsort(-scores[:, members], axis=1, kind="stable")[:, :most]]
            i = np.repeat(np.arange(len(x)), best.shape[1])
            j = best.ravel()
            out.append(pd.DataFrame({"q": x["q"].to_numpy()[i], "group": y["group"].to_numpy()[j], "id": y["id"].to_numpy()[j], "score": scores[i, j]}))
        return pd.concat(out)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = _products(queries, rows, keep, f"q {kind(queries, 'q')}, group {kind(rows, 'group')}, id {kind(rows, 'id')}, score double", block, part)
    place = F.row_number().over(Window.partitionBy("q", "group").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def not_done(records: DataFrame, *done: DataFrame) -> DataFrame:
    """Records that none of the done tables holds: one anti join with their union."""
    return records.join(done_ids(*done), "record_id", "left_anti") if done else records


def done_ids(*done: DataFrame) -> DataFrame:
    """The distinct ids of all the tables."""
    return reduce(DataFrame.unionByName, [d.select("record_id") for d in done]).distinct()


def merge_rule_first(records: DataFrame, auto: DataFrame, llm_co: DataFrame, llm_noco: DataFrame) -> DataFrame:
    """The prediction of each record(record_id, kind) from the run its class was sent to; `none` where that has no answer."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("record_id", F.col("aid").alias(name))

    out = records.join(side(auto, "a"), "record_id", "left").join(side(llm_co, "c"), "record_id", "left").join(side(llm_noco, "n"), "record_id", "left")
    said = F.when(F.col("kind") == "AUTO", F.col("a")).when(F.col("kind") == "LLM-Co", F.col("c")).when(F.col("kind") == "LLM-NoCo", F.col("n"))
    return out.select("record_id", "kind", F.coalesce(said, F.lit(NIL)).alias("predicted"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of keys(key, value) that only a has, only b has, and both have with the same or different values."""
    both = a.select("key", F.col("value").alias("va"), F.lit(True).alias("in_a")).join(b.select("key", F.col("value").alias("vb"), F.lit(True).alias("in_b")), "key", "full_outer")
    return both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(F.col("in_a") & F.col("in_b") & F.col("va").eqNullSafe(F.col("vb"))).alias("same"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("va").eqNullSafe(F.col("vb"))).alias("different"),
    )


def check_candidates(decisions: DataFrame, features: DataFrame, strict: bool = False) -> DataFrame:
    """Decisions whose number of candidates isn't that of the features(record_id, aid), or of these counted (record_id, featured); error rows are exempt, a missing number is -1."""
    pool = features if "featured" in features.columns else features.groupBy("record_id").agg(F.count_distinct("aid").alias("featured"))
    out = decisions.filter("predicted <> 'error'").join(pool, "record_id", "left")
    out = out.select("record_id", F.coalesce("num_candidates", F.lit(-1)).alias("num_candidates"), F.coalesce("featured", F.lit(0)).alias("featured"))
    bad = out.filter("num_candidates <> featured")
    if strict:
        bad = bad.withColumn("record_id", F.when(F.lit(True), F.raise_error(F.concat(F.lit("candidates differ for "), F.col("record_id")))))
    return bad
