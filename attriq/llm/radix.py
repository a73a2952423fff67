"""A distributed radix sort: ranks of rows by stable counting-sort passes over the digits of a composite key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attriq.llm.common import fresh, new_path, q, remove_path

#: Rows of a part at least, and parts at most: parts grow with the rows beyond their product, so that there are PARTS * 2 ** bits counters at most.
PART_ROWS, PARTS = 4096, 65_536
_SIGN = -(2**63)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, "radix"))
    return spark.read.schema(df.schema).parquet(path), path


def _digit(key: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def counting_pass(rows: DataFrame, digit: Column, place: str, shift: int) -> DataFrame:
    """rows with new places: by digit, rows of one digit in the order of their old places.

    A part is the rows whose places share all but the last `shift` bits. Each part counts its digits; the
    count of all smaller digits plus that of the same digit in earlier parts is where a part's rows of a
    digit begin; within them the old order stands. Nothing larger than a part's rows of one digit is sorted.
    """
    part, value, start, part_s, value_s = fresh(rows.columns, "part", "digit", "start", "part_s", "digit_s")
    dealt = rows.withColumn(part, F.shiftright(q(place), shift)).withColumn(value, digit)
    counts = dealt.groupBy(part, value).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(value).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(value).agg(F.sum("n").alias("all"))
    # One row a digit, 2 ** bits at most.
    smaller = totals.select(F.col(value).alias(value_s), F.coalesce(F.sum("all").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    begins = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(smaller), F.col(value) == F.col(value_s))
    begins = begins.select(F.col(part).alias(part_s), F.col(value).alias(value_s), (F.col("base") + F.col("before")).alias(start))
    met = dealt.join(begins, (q(part) == q(part_s)) & (q(value) == q(value_s)))
    local = F.row_number().over(Window.partitionBy(part, value).orderBy(place))
    return met.withColumn(place, q(start) + local - 1).select(*map(q, rows.columns))


def radix_ranks(df: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank", bits: int = 11) -> DataFrame:
    """df with `rank` (1, 2, 3 and so on) in the order of the keys, (long column, descending) each; nulls come last.

    Least significant digits come first: one stable pass over each digit of each key, last key first. A
    key's high bits that all rows share take no pass. Rows that are equal in all keys have neighbouring
    ranks in no fixed order. No rows give no rows. df travels whole in each pass, so give slim rows. The
    last pass's table stays in the shared folder, as the result reads it.
    """
    place, *flipped = fresh(df.columns, "place", *[f"key{i}" for i in range(len(keys))], *[f"none{i}" for i in range(len(keys))])
    nones = flipped[len(keys) :]
    # As unsigned numbers longs keep their order once the sign bit is turned; that can't overflow.
    made = df.withColumn(place, F.monotonically_increasing_id())
    for (name, down), key, none in zip(keys, flipped, nones, strict=False):
        plain = q(name).bitwiseXOR(F.lit(_SIGN))
        made = made.withColumn(key, F.coalesce(F.bitwise_not(plain) if down else plain, F.lit(0))).withColumn(none, F.col(name).isNull().cast("long"))
    now, path = _written(made)
    spans = [x for key, none in zip(flipped, nones, strict=False) for x in (F.min(F.when(q(none) == 0, q(key)).bitwiseXOR(F.lit(_SIGN))), F.max(F.when(q(none) == 0, q(key)).bitwiseXOR(F.lit(_SIGN))), F.sum(none))]
    total, *spans = now.agg(F.count("*"), *spans).first()
    shift = (PART_ROWS - 1).bit_length()
    while total >> shift > PARTS:
        shift += 1
    passes = []
    for i in reversed(range(len(keys))):
        low, high, missing = spans[3 * i : 3 * i + 3]
        width = 0 if low is None else ((low ^ high) & (2**64 - 1)).bit_length()
        passes += [_digit(q(flipped[i]), at, min(bits, width - at)) for at in range(0, width, bits)]
        if missing:
            passes.append(q(nones[i]).cast("int"))
    # With no pass left, one over no digit at all still makes the places dense.
    for digit in passes or [F.lit(0)]:
        after, new = _written(counting_pass(now, digit, place, shift))
        remove_path(df.sparkSession, path)
        now, path = after, new
    return now.select(*map(q, df.columns), (q(place) + 1).alias(rank))
