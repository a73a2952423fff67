"""Connected components of a graph of links, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import new_path, remove_path


def _mins(pairs: DataFrame, of: str, what: str) -> DataFrame:
    """The least `what` for each `of`; named apart, so that the join that follows deals both sides and a hub can be split."""
    return pairs.groupBy(of).agg(F.min(what).alias("least"), F.max(of).alias("hub")).select("hub", "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written and read again, and where. Unlike a checkpoint, which keeps the plan's estimate of its size, a table has its own: estimates
    are products over joins, so over rounds they would become numbers of megabytes."""
    df.write.parquet(path := new_path(df.sparkSession, "links"))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b), both long: root is the least node of its component.

    Rounds of large stars (each node sends its larger neighbours to its least neighbour) and small stars
    (each sends its smaller ones there) end, after about log^2 n rounds, with each node linked to its root.
    A round is aggregates and joins on nodes; its links are written to the shared folder, and those of
    the round before removed. Self links and repeated links are allowed, nulls are not; no edges give no rows.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = _stored(now)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_mins(both, "a", "b"), F.col("a") == F.col("hub")).filter("b > a")
        large = large.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        small = large.join(_mins(large, "a", "b"), F.col("a") == F.col("hub"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        old = path
        now, path = _stored(small.filter("a <> b").distinct())
        remove_path(now.sparkSession, old)
        before, state = state, _state(now)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
