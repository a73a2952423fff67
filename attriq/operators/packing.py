"""Order-dependent packing without an ordered fold: where a chunk ends follows from where it begins, so chunks are the orbit of a pointer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriq.stages import once

#: Rows of a block, unless a chunk may hold more.
BLOCK = 4096


def _ends(sizes: np.ndarray, most: int, room: int) -> np.ndarray:
    """For a chunk that begins at each row, the row behind its last: a count or the room for items with a comma each is reached."""
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = len(sizes)
    fit = np.searchsorted(before, before[:n] + room, side="right") - 1
    at = np.arange(n)
    return np.minimum(np.maximum(at + 1, np.minimum(at + most, fit)), n)


def _sizes(f: pd.DataFrame) -> np.ndarray:
    return f["size"].fillna(0).to_numpy().astype(np.int64)


def places(items: DataFrame, by: str, order: str, place: str) -> DataFrame:
    """items with their place in their group from 0 on, in order; equal orders in one fixed way. Groups of any size are counted part by part."""
    rows = once(items.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_by", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part")))
    return out.withColumn(place, F.col("_before") + F.col("_at") - F.col("_first")).drop("_by", "_part", "_first", "_before", "_at")


def orbit(jumps: DataFrame) -> DataFrame:
    """(by, at, idx) of all that 0 reaches in each group by jumps(by, at, to, n), n steps each; to is null at the end. Pointers double each round."""
    reach = jumps.filter("at = 0").select("by", "at", F.lit(0).cast("long").alias("idx"))
    reach, jumps = once(reach), once(jumps)
    while not jumps.filter("to is not null").isEmpty():
        ahead = jumps.select(F.col("by").alias("by_j"), F.col("at").alias("at_j"), F.col("to").alias("to_j"), F.col("n").alias("n_j"))
        same = F.col("by").eqNullSafe(F.col("by_j"))
        more = reach.join(ahead.filter("to_j is not null"), same & (F.col("at") == F.col("at_j"))).select("by", F.col("to_j").alias("at"), (F.col("idx") + F.col("n_j")).alias("idx"))
        further = jumps.join(ahead, same & (F.col("to") == F.col("at_j")), "left").select("by", "at", F.col("to_j").alias("to"), (F.col("n") + F.coalesce("n_j", F.lit(0))).alias("n"))
        reach, jumps = once(reach.unionByName(more)), once(further)
    return reach


def pack(items: DataFrame, most: int, most_bytes: int, envelope: int = 120, by: str = "shard", order: str = "record_id", size: str = "bytes", block: int = BLOCK) -> DataFrame:
    """items with their chunk within each shard: filled in order until a count or a number of bytes is reached, the chunk's envelope and a comma after each item included.

    An item larger than the limit has a chunk of its own; a null size counts as 0. Each block of neighbouring
    rows works out, for each row of its first `most`, in which row of the next block a chunk begins if one
    begins here, and how many begin on the way: the first `most` rows are all where a chunk from before can
    end. (A last chunk that covers the whole last block points behind it, so that block's rows know their chunk.) Doubling these pointers gives each block's true first chunk after about log2(blocks) joins; then
    blocks number their rows. A task holds a block and `most` rows, however long a shard is.
    """
    if most < 1:
        raise ValueError("a chunk holds at least one item")
    block, room = max(block, most), most_bytes - envelope
    placed = once(places(items, by, order, "_place"))
    slim = placed.select(F.col(by).alias("by"), F.col("_place").alias("at"), F.col(size).alias("size"))
    kind = slim.schema["by"].dataType.simpleString()
    own = F.floor(F.col("at") / block).cast("long")
    seen = F.when((F.col("at") % block < most) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))

    def jumps(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        begin = int(f["block"].iloc[0]) * block
        ends, held = _ends(_sizes(f), most, room), int((f["at"] < begin + block).sum())
        exits, steps = ends.copy(), np.ones(len(ends), dtype=np.int64)
        for i in range(held - 1, -1, -1):
            if ends[i] < held:
                exits[i], steps[i] = exits[ends[i]], steps[ends[i]] + 1
        entries = 1 if begin == 0 else min(most, held)
        to = pd.array(begin + exits[:entries], dtype="Int64")
        if len(f) == held:
            to[exits[:entries] >= held] = pd.NA
        return pd.DataFrame({"by": f["by"].iloc[:entries].to_numpy(), "at": begin + np.arange(entries), "to": to, "n": steps[:entries]})

    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        ends, at = _ends(_sizes(f), most, room), int(f["entry"].iloc[0]) - int(f["at"].iloc[0])
        begins = np.zeros(len(f), dtype=np.int64)
        while at < len(f):
            begins[at], at = 1, int(ends[at])
        return pd.DataFrame({"by": f["by"], "at": f["at"], "chunk": int(f["idx"].iloc[0]) - 1 + np.cumsum(begins)})

    spread = slim.select("by", F.explode(seen).alias("block"), "at", "size")
    entered = orbit(spread.groupBy("by", "block").applyInPandas(jumps, f"by {kind}, at long, to long, n long"))
    entered = entered.select(F.col("by").alias("by_e"), own.alias("block_e"), F.col("at").alias("entry"), "idx")
    dealt = slim.withColumn("block", own).join(entered, F.col("by").eqNullSafe(F.col("by_e")) & (F.col("block") == F.col("block_e")))
    chunks = dealt.select("by", "block", "at", "size", "entry", "idx").groupBy("by", "block").applyInPandas(number, f"by {kind}, at long, chunk int")
    chunks = chunks.select(F.col("by").alias("_by"), F.col("at").alias("_at"), F.col("chunk").alias("_chunk"))
    out = placed.join(chunks, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_place") == F.col("_at")))
    return out.select(*items.columns, F.col("_chunk").alias("chunk"))
