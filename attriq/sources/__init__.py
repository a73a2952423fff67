"""Readers: everything becomes a typed DataFrame; a file that is absent an empty one."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attriq import schemas
from attriq.config import NIL
from attriq.operators import recall
from attriq.operators.features import feature_vector
from attriq.operators.sets import flat_truth
from attriq.stages import once as once
from attriq.stages import shared_dir as shared_dir


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON file that is one object keyed by id; a schema of all ids is never inferred."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def papers(spark: SparkSession, path: str) -> DataFrame:
    found = json_map(spark, path, f"struct<{schemas.PAPER}>").select("key", "value.*")
    return found.withColumn("pub_id", F.col("key")).drop("key")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, f"struct<{schemas.PROFILE}>").select(F.col("key").alias("aid"), "value.name", "value.pubs")


def pair_sims(spark: SparkSession, path: str) -> DataFrame:
    """Pair similarities from CSV; NaN counts as missing from here on."""
    raw = spark.read.csv(path, header=True, schema=schemas.PAIR_SIM, enforceSchema=False)
    doubles = [c for c, kind in raw.dtypes if kind == "double"]
    return raw.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions from quoted CSV, every column a string."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def _file_order() -> Column:
    """Where a row stands: its file, its part of the file, and its place in what a task reads of it."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def predictions(spark: SparkSession, path: str, uid: str, pred: str) -> DataFrame:
    """(record_id, predicted) from quoted CSV; of several rows with an id the last wins."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).withColumn("at", _file_order())
    return raw.groupBy(F.col(uid).alias("record_id")).agg(F.max_by(pred, "at").alias("predicted"))


_FEATURES = "unass_record string, candidate_aid string, sim_features array<double>, hand_features array<double>, org_available double, features array<double>, label int"


def features(spark: SparkSession, *paths: str) -> DataFrame:
    """(record_id, aid, features, label) of all rows of files of JSON lines; a missing label is 0."""
    raw = spark.read.schema(_FEATURES).json(list(paths))
    return raw.select(F.col("unass_record").alias("record_id"), F.col("candidate_aid").alias("aid"), feature_vector().alias("features"), F.coalesce("label", F.lit(0)).alias("label"))


def feature_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, aid, features) from JSON lines; of several rows of a candidate the last wins."""
    raw = spark.read.schema(_FEATURES).json(path).withColumns({"at": _file_order(), "v": feature_vector()})
    return raw.groupBy(F.col("unass_record").alias("record_id"), F.col("candidate_aid").alias("aid")).agg(F.max_by("v", "at").alias("features"))


def filtered_candidates(spark: SparkSession, path: str, default: str = "P0-Low") -> DataFrame:
    """(record_id, subtype, rank, aid, ...) of a file of records with their candidates in order, whichever names its columns have; empty if it is absent.

    A record without candidates has one row, with neither rank nor aid; a missing subtype is the default.
    """
    fields = ["aid string", "candidate_aid string", *[f"{c} double" for c in ("title_sim_max", "title_sim", "title_sim_top5_avg", "org_sim", "org_sim_max", "main_org_sim", "venue_sim", "venue_sim_max")]]
    fields += ["coauthor_count int", "coauthor_org_match_count int"]
    kind = f"struct<subtype:string,difficulty:string,candidates:array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>>"
    if exists(spark, path):
        found = json_map(spark, path, kind)
    else:
        found = spark.createDataFrame([], f"key string, value {kind}")
    rows = found.select(F.col("key").alias("record_id"), F.coalesce("value.subtype", F.lit(default)).alias("subtype"), "value.difficulty", F.posexplode_outer("value.candidates").alias("place", "c"))
    named = recall.aliased(lambda c: F.col(f"c.{c}"), [f.split()[0] for f in fields])
    counts = [F.coalesce(F.col(f"c.{c}"), F.lit(0)).alias(c) for c in ("coauthor_count", "coauthor_org_match_count")]
    return rows.select("record_id", "subtype", "difficulty", (F.col("place") + 1).alias("rank"), *[v.alias(k) for k, v in named.items()], F.coalesce("c.title_sim_top5_avg", F.lit(0.0)).alias("title_sim_top5_avg"), *counts)


def all_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, subtype, candidates) of a file of records: one row each, candidates as an array in order."""
    rows = filtered_candidates(spark, path)
    one = F.struct(*[c for c in rows.columns if c not in ("record_id", "subtype", "difficulty")])
    return rows.groupBy("record_id", "subtype").agg(F.array_sort(F.collect_list(F.when(F.col("aid").isNotNull(), one))).alias("candidates"))


def classified(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, subtype) from the CSV of classes; empty if it is absent. For the records of each class see sets.inverted."""
    if not exists(spark, path):
        return spark.createDataFrame([], "record_id string, subtype string")
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select(F.col("unass_record").alias("record_id"), "subtype")


def idf_tables(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(field, word, idf) from a JSON object of words for each field; files that are absent give no rows."""
    there = [json_map(spark, p, "double").select(F.lit(f).alias("field"), F.col("key").alias("word"), F.col("value").alias("idf")) for f, p in files.items() if exists(spark, p)]
    return reduce(DataFrame.unionByName, there, spark.createDataFrame([], "field string, word string, idf double"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, aid) from {name: {aid: [paper]}}: a paper that stands under several profiles is the last one's."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("name_place", "name", "profiles"))
    return flat_truth(rows, "name_place")


def vectors_of(texts: DataFrame, provider: Callable[[list[str]], list], length: int = 1024, batch: int = 32) -> DataFrame:
    """(key, vec) of texts(key, text) by a service that turns lists of texts into vectors.

    Texts are cut to `length` characters; a missing or empty one has no vector, nor has any of a batch
    that fails. Write the result to a table before using it twice: each use asks again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vec: list = [None] * len(f)
            valid = [i for i, t in enumerate(f["text"]) if isinstance(t, str) and t]
            for k in range(0, len(valid), batch):
                part = valid[k : k + batch]
                try:
                    got = provider([f["text"].iloc[i][:length] for i in part])
                except Exception as e:  # a batch that fails has no vectors; the others go on
                    print(f"{len(part)} texts without vectors: {e}", file=sys.stderr)
                    continue
                for i, v in zip(part, got, strict=True):
                    vec[i] = v
            yield pd.DataFrame({"key": f["key"], "vec": pd.Series(vec, dtype=object, index=f.index)})

    return texts.select("key", "text").mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, vec array<float>")


def truth(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.GROUND_TRUTH)
    return json_map(spark, path, "string").select(F.col("key").alias("record_id"), F.coalesce("value", F.lit(NIL)).alias("aid"))


def done(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "record_id string")
    return spark.read.parquet(path).select("record_id")


def embeddings(stores: list[DataFrame], keys: DataFrame) -> DataFrame:
    """keys(key) with their vectors from the first store that has them, else null."""
    out = keys
    for k, s in enumerate(stores):
        out = out.join(s.select("key", F.col("vec").alias(f"v{k}")), "key", "left")
    names = [f"v{k}" for k in range(len(stores))]
    return out.withColumn("vec", F.coalesce(*names)).drop(*names)


def paper_owner(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, "array<string>").select(F.explode("value").alias("pub_id"), F.col("key").alias("aid"))
