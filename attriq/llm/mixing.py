"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.llm.common import cut, fresh, q

WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of the hash that each histogram resolves, and how many may be nested.
BITS, LEVELS = 12, 5
#: Sources whose one row each may be broadcast; beyond, the joins on the source shuffle.
FEW = 20_000
#: Rows equal in all columns that are spread at once, when only some of them are taken.
SPREAD = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """sizes(source, source_size) with each source's target.

    Sources in the order of their code points, null last, weigh `weights`, repeating, and share `percent`
    of all sizes. A target stops at `cap` times its source's size and the excess is shared anew by weight,
    until none is above. That ends with one level: sources with cap * size <= weight * level get their
    cap, the others weight * level. In the order of size / weight the first are a prefix, so the level
    follows from running sums over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    before = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # What would be left, in hundredths of a word, and the weights that would share it, if all before are capped.
    ranked = ranked.withColumn("left", percent * F.sum("source_size").over(every) - 100 * cap * F.coalesce(before, F.lit(0)))
    ranked = ranked.withColumn("sharing", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("capped", 100 * cap * F.col("source_size") * F.col("sharing") <= F.col("weight") * F.col("left"))
    ranked = ranked.withColumn("level", F.max(F.when(~F.col("capped"), F.struct("sharing", "left"))).over(every))
    full = (cap * F.col("source_size")).cast("double")
    shared = (F.col("weight") * F.col("level.left")) / (100 * F.col("level.sharing"))
    return ranked.select("source", "source_size", F.when(F.col("capped"), full).otherwise(shared).alias("target"))


def _with_source(left: DataFrame, bounds: DataFrame, few: bool, key: str, how: str) -> DataFrame:
    side = bounds.withColumnRenamed("source", key + "_b")
    return left.join(F.broadcast(side) if few else side, q(key).eqNullSafe(q(key + "_b")), how).drop(key + "_b")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2, seed: int = 9) -> DataFrame:
    """docs with size, source_size, target (of its source), copies and taken: size times copies.

    A document's size is its number of words (null: 0). Each source takes all its documents
    floor(target / source_size) times; the rest of its target is the words of those whose hash lies under
    the source's threshold, which get one copy more, `cap` in all at most. Thresholds come from nested
    histograms of words by source and hash bucket, each of which refines only the bucket that its
    predecessor's budget ends in; the last such bucket, if it is one document, is taken if that comes
    nearer. If it holds rows equal in all columns, they are counted and as many of them are taken as come
    nearest, whichever: nothing tells them apart. So a source misses its target by half of one document at
    most. No row of a document is sorted, and only such equal rows are moved.

    The hash is of seed and all columns, so reruns agree. A null source is a source, the last; null ids are ids. Sources without words have target 0 and take nothing. An empty table gives
    an empty table; input columns with the outputs' names are replaced, except the id, text and source.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c.lower() not in made]
    key, size, spot = fresh([*docs.columns, *made, "source_b"], "mix_source", "mix_size", "mix_hash")
    size_of = F.coalesce(F.regexp_count(q(text), F.lit(WORD)), F.lit(0)).cast("long")
    rest = [c for c in kept if c.lower() not in (id.lower(), text.lower())]
    told = lambda c, of: F.to_json(of) if {"map", "variant"} & set(re.findall(r"\w+", docs.schema[c].dataType.simpleString())) else of
    spot_of = F.shiftrightunsigned(F.xxhash64(F.lit(seed), q(id), q(text), *[told(c, q(c)) for c in rest]), 64 - BITS * LEVELS)
    sized = cut(docs.select(q(source).alias("source"), size_of.alias("size"), spot_of.alias("spot")))

    per_source = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, cap))
    few = per_source.count() <= FEW
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bounds = per_source.withColumn("whole", F.least(whole, F.lit(cap)))
    bounds = bounds.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    ends = bounds.filter((F.col("budget") > 0) & (F.col("whole") < cap)).select("source", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    taken_by, shift, equal = None, BITS * LEVELS, True
    for _ in range(LEVELS):
        shift -= BITS
        inside = _with_source(sized, ends, few, "source", "inner").filter(F.shiftright("spot", shift + BITS) == F.col("prefix"))
        counts = inside.groupBy("source", "budget", "below", F.shiftright("spot", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        run = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        taken_by = cut(counts.withColumn("upto", run).filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget"))).withColumn("below", F.col("upto") - F.col("words")))
        if not taken_by.filter("rows > 1").limit(1).count():
            equal = False  # each boundary bucket holds one document: nothing is left to refine
            break
        ends = taken_by.select("source", "budget", "below", F.col("bucket").alias("prefix"))
    nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("below")
    edge = taken_by.select(
        "source", F.when(F.col("rows") > 1, F.col("bucket")).alias("tie"), (F.col("budget") - F.col("below")).alias("wanted"),
        (F.col("bucket") + (nearer & (F.col("rows") == 1)).cast("long")).alias("edge"),
    )
    rules = _with_source(bounds, edge, few, "source", "left").select(
        "source", *[F.col(n).alias(f"{key}_{n}") for n in ("source_size", "target", "whole", "edge", "tie", "wanted")]
    )

    ready = docs.select(F.struct(*map(q, kept)).alias("row"), q(source).alias(key), size_of.alias(size), spot_of.alias(spot))
    done = _with_source(ready, rules, few, key, "left")

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        copies = q(f"{key}_whole").cast("long") + F.coalesce(extra.cast("long"), F.lit(0))
        return rows.withColumn("copies", copies).select(
            *[F.col("row").getField(c).alias(c) for c in kept], q(size).alias("size"), q(f"{key}_source_size").alias("source_size"),
            q(f"{key}_target").alias("target"), "copies", (q(size) * F.col("copies")).alias("taken"),
        )

    place = F.shiftright(q(spot), shift)
    if not equal:
        return out(done, place < q(f"{key}_edge"))
    tied = F.coalesce(place == q(f"{key}_tie"), F.lit(False))
    told_of = F.struct(*[told(c, F.col("row").getField(c)).alias(f"c{k}") for k, c in enumerate(kept)])
    groups = done.filter(tied).groupBy(key, size, *[f"{key}_{n}" for n in ("source_size", "target", "whole", "wanted")], told_of.alias("told"))
    groups = groups.agg(F.first("row").alias("row"), F.count("*").alias("n"))
    # One group a source, but for rows whose hashes collide.
    first = Window.partitionBy(key).orderBy(F.xxhash64("told"), F.col("n")).rowsBetween(Window.unboundedPreceding, -1)
    left = q(f"{key}_wanted") - F.coalesce(F.sum(F.col("n") * q(size)).over(first), F.lit(0))
    groups = groups.withColumn("most", F.round(left / F.greatest(q(size), F.lit(1))))
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD)))).repartition(key, "part")
    spread = parts.withColumn("at", F.explode(F.sequence(F.col("part") * SPREAD, F.least(F.col("n"), (F.col("part") + 1) * SPREAD) - 1)))
    return out(done.filter(~tied), place < q(f"{key}_edge")).union(out(spread, F.col("at") < F.col("most")))
