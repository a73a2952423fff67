"""Unions with precedence, quotas, filters of a run, submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import CO_SUBTYPES, ERROR, NIL


def first_wins(*runs: DataFrame, key: str = "record_id") -> DataFrame:
    """Union of runs where the first that has a key gives its row; copies counts the rows of the key."""
    every = reduce(DataFrame.unionByName, [r.withColumn("priority", F.lit(k)) for k, r in enumerate(runs)])
    w = Window.partitionBy(key)
    return every.withColumns({"k": F.row_number().over(w.orderBy("priority", *[c for c in runs[0].columns if c != key])), "copies": F.count("*").over(w)}).filter("k = 1").drop("k", "priority")


def last_wins(*runs: DataFrame, key: str = "record_id") -> DataFrame:
    return first_wins(*reversed(runs), key=key)


def upsert(store: DataFrame, rows: DataFrame, key: str = "key", value: str = "vec") -> DataFrame:
    """The store after new rows: theirs win, a null value deletes."""
    return last_wins(store, rows, key=key).filter(F.col(value).isNotNull()).drop("copies")


def shard(records: DataFrame, n: int, k: int, key: str = "record_id") -> DataFrame:
    if not 0 <= k < n <= 64:
        raise ValueError("0 <= k < n <= 64")
    return records.filter(F.crc32(F.col(key).cast("binary")) % n == k)


def per_group(records: DataFrame, group: str, order: str, limits: dict[str, int], default: int | None = None) -> DataFrame:
    """The first rows of each group in order, as many as its limit says; groups without one stay whole or go (default 0)."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    limit = F.try_element_at(table, F.col(group))
    w = Window.partitionBy(group).orderBy(order)
    kept = F.coalesce(F.col("k") <= limit, F.lit(True) if default is None else F.col("k") <= default)
    return records.withColumn("k", F.row_number().over(w)).filter(kept).drop("k")


def sampled(records: DataFrame, n: int, seed: int, key: str = "record_id") -> DataFrame:
    """n rows without replacement, the same for the same seed: those of the least digests."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def run_filter(
    records: DataFrame, only: str | None = None, ids: DataFrame | None = None, shard_of: tuple[int, int] | None = None, subtypes: list[str] | None = None,
    quotas: dict[str, int] | None = None, done: DataFrame | None = None, order: str = "pos", limit: int | None = None,
) -> DataFrame:
    """Records of a run. The order shows: one record, id set, shard, subtypes, quotas, what is done already, then the limit."""
    if only is not None:
        records = records.filter(F.col("record_id") == only)
    if ids is not None:
        records = records.join(ids.select("record_id"), "record_id", "left_semi")
    if shard_of is not None:
        records = shard(records, *shard_of)
    if subtypes:
        records = records.filter(F.col("subtype").isin(subtypes))
    if quotas:
        records = per_group(records, "subtype", order, quotas, 0)
    if done is not None:
        records = records.join(done.select("record_id"), "record_id", "left_anti")
    return records if limit is None else records.orderBy(order).limit(limit)


def parse_limits(text: str) -> dict[str, int | None]:
    """'a:50,b' as {'a': 50, 'b': None}."""
    pairs = [x.strip().partition(":") for x in text.split(",") if x.strip()]
    return {k.strip(): int(v) if v else None for k, _, v in pairs}


def submission(decisions: DataFrame) -> DataFrame:
    """Each predicted profile's papers, sorted; records without one are left out."""
    pub = F.split(F.col("record_id"), "-", 2)[0]
    given = decisions.filter(~F.col("predicted").isin(NIL, ERROR))
    return given.groupBy(F.col("predicted").alias("aid")).agg(F.array_sort(F.collect_list(pub)).alias("pubs"))


def inverted(records: DataFrame, key: str = "subtype", value: str = "record_id") -> DataFrame:
    return records.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("members"))


def flat_truth(nested: DataFrame, order: str) -> DataFrame:
    """(record_id, aid) from nested(order, profiles: map of aid to papers); of several aids the last in order wins."""
    flat = nested.select(order, F.posexplode("profiles").alias("place", "aid", "pubs"))
    flat = flat.select(order, "place", "aid", F.posexplode("pubs").alias("at", "record_id"))
    return flat.groupBy("record_id").agg(F.max_by("aid", F.struct(order, "place", "at")).alias("aid"))


def by_record(decisions: DataFrame) -> DataFrame:
    """Output order: the whole table by record."""
    return decisions.orderBy("record_id")


def merged_answers(*chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, failed) of chunks(custom_id, content): the first chunk's content of each id, with copies; ids without content in any chunk."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    found = first_wins(*[c.filter(~blank).select("custom_id", "content") for c in chunks], key="custom_id")
    every = reduce(DataFrame.unionByName, [c.select("custom_id") for c in chunks]).distinct()
    return found, every.join(found, "custom_id", "left_anti")


def co_cases(records: DataFrame, truth: DataFrame, candidates: DataFrame, classified: DataFrame, papers: DataFrame, subtypes: list[str] | None = None, with_truth_only: bool = False) -> DataFrame:
    """(record_id, truth, subtype) of the records to judge by coauthors, in order.

    Those with candidates, a paper and a subtype among `subtypes` (those of the coauthor class, or none, by
    default); with_truth_only leaves out records whose truth is none.
    """
    pub = F.split(F.col("record_id"), "-", 2)[0]
    wanted = F.col("subtype").isin(*(subtypes or [*CO_SUBTYPES, NIL]))
    out = records.select("record_id").join(truth.select("record_id", F.col("aid").alias("truth")), "record_id", "left").withColumn("truth", F.coalesce("truth", F.lit(NIL)))
    if with_truth_only:
        out = out.filter(F.col("truth") != NIL)
    out = out.join(candidates.select("record_id"), "record_id", "left_semi").join(classified.select("record_id", "subtype"), "record_id", "left")
    out = out.filter(wanted).withColumn("pub_id", pub).join(papers.select("pub_id"), "pub_id", "left_semi")
    return out.select("record_id", "truth", "subtype").orderBy("record_id")


def record_parts(record_id: Column) -> tuple[Column, Column]:
    parts = F.split(record_id, "-", 2)
    return parts[0], F.try_element_at(parts, F.lit(2)).try_cast("int")
