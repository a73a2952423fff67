"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel scores, the largest drawn."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attriq.llm.common import fresh, map_arrow, new_path, q, released
from attriq.llm.radix import radix_ranks

#: Digits, letters a-z and everything beyond ASCII; in UTF-8 the latter are the bytes from 0x80.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a text that are turned into features at a time.
_STRIDE = 65_536


def buckets(text: str | None, size: int = 10_000, longest: int = 3) -> tuple[np.ndarray, int]:
    """The bucket of each run of 1 to `longest` words of a text (runs of one length together), and the number of words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    crc, out = zlib.crc32, []
    for at in range(0, len(words), _STRIDE):
        # A run is its shorter beginning, a space and one more word, so its checksum goes on from there.
        part = words[at : at + _STRIDE + longest - 1]
        more = [b" " + w for w in part[1:]]
        runs = [crc(w) for w in part[:_STRIDE]]
        out.append(np.array(runs, dtype=np.uint32))
        for k in range(1, longest):
            runs = [crc(w, c) for w, c in zip(more[k - 1 :], runs, strict=False)]
            out.append(np.array(runs, dtype=np.uint32))
    return (np.concatenate(out) % size).astype(np.uint16) if out else np.empty(0, np.uint16), len(words)


def featurise(docs: DataFrame, text: str = "text", size: int = 10_000) -> DataFrame:
    """docs without the text, with n_words, n_features and features: two bytes for the bucket of each feature.

    Null and empty texts have no features. `size` is 65,536 at most. Columns of docs with the new names are replaced.
    """
    if not 0 < size <= 65_536:
        raise ValueError("size must be from 1 to 65536")
    new = "n_words long, n_features long, features binary"
    names = [c for c in docs.columns if c != text and c.lower() not in {"n_words", "n_features", "features"}]
    kept = docs.select(*map(q, names), q(text))
    (at,) = fresh(names, "text")
    kept = kept.withColumnRenamed(text, at)
    kind = StructType([*kept.drop(at).schema, *StructType.fromDDL(new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for begin in range(0, b.num_rows, 256):
                    part = b.slice(begin, 256)
                    found = [buckets(x, size) for x in part.column(part.num_columns - 1).to_pylist()]
                    arrays = [*part.columns[:-1], pa.array([n for _, n in found], pa.int64()), pa.array([len(f) for f, _ in found], pa.int64()), pa.array([f.astype("<u2").tobytes() for f, _ in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "n_features", "features"])

        return released(made())

    return kept.mapInArrow(run, kind)


def bucket_counts(features: DataFrame, size: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all features: each task sums an array, the arrays' cells are summed by bucket; `size` rows reach the driver."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for f in b["features"]:
                total += np.bincount(np.frombuffer(f, dtype="<u2"), minlength=size)
        at = np.flatnonzero(total)
        yield {"bucket": at.astype(np.int32), "n": total[at]}

    out = np.zeros(size, dtype=np.int64)
    for r in map_arrow(features.select("features"), "bucket int, n long", run).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log ratio of its smoothed shares, rounded down."""
    size, s, t = len(raw), raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, size: int = 10_000, seed: int = 42) -> DataFrame:
    """Each document's (id, n_words, n_features, weight, score, rank): the draw without replacement that resembles the target's texts.

    weight is the sum of the gains of a document's features; score adds a Gumbel variate that depends on
    seed and id alone, so the highest scores are a weighted draw and reruns agree. Of the N documents of
    `least_words` words or more, floor(percent * N / 100) are drawn; rank is their place, null for all
    others. Ties go to the smaller id, a missing id last; the id is cast to long. Rows that repeat an id and
    a text have one score and neighbouring ranks in no fixed order. Null and empty texts have weight 0. No
    documents or no target texts are no error: no counts then weigh in the ratios but the smoothing. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = featurise(docs.select(q(id).cast("long").alias("id"), q(text).alias("text")), "text", size)
    rows.write.parquet(path := new_path(spark, "features"))
    rows = spark.read.schema(rows.schema).parquet(path)
    gain = gains(bucket_counts(rows, size), bucket_counts(featurise(target.select(q(text).alias("text")), "text", size), size))

    def weigh(batches):
        for b in batches:
            yield {**{k: b[k] for k in ("id", "n_words", "n_features")}, "weight": [int(gain[np.frombuffer(f, dtype="<u2")].sum()) for f in b["features"]]}

    weighed = map_arrow(rows, "id long, n_words long, n_features long, weight long", weigh)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))
    scored.write.parquet(path := new_path(spark, "scores"))
    scored = spark.read.schema(scored.schema).parquet(path)
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    ranked = radix_ranks(scored.filter(able), [("score", True), ("id", False)])
    drawn = scored.filter(able).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id)
