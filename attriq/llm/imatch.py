"""Document fingerprints by I-Match over randomised lexicon subsets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.llm.common import cut, q

#: Document frequencies are counted in so many (2 ** SLOT_BITS) slots of the terms' hashes.
SLOT_BITS = 20
#: Random subsets of each density, and densities (each half the one before) of a signature.
SUBSETS, DENSITIES = 12, 3
#: A term outside the band is in one of 2 ** OUTSIDE_BITS of the subsets that it would be in if it were inside.
OUTSIDE_BITS = 3
#: Density at which a subset most likely holds what two half-equal texts share and nothing else, times the number of terms.
BEST = 0.81


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, lower-cased."""
    found = F.array_remove(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")), "")
    return F.transform(found, lambda t: F.xxhash64(t))


def slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - SLOT_BITS).cast("int")


def outside(docs: DataFrame, text: str, high: float, low: float = 0.0) -> Column:
    """A bit for each slot, seven a byte: 1 if terms of that slot are in over `high` or under `low` of all documents, so outside the band.

    Slots take the place of terms, so that counting takes bounded memory however large the vocabulary; a
    slot holds mean terms of a document / 2 ** SLOT_BITS of the documents by chance, far less than `high`
    at any size; a `low` below that share has no effect. There are at most (mean terms / high) slots over the
    band and (mean terms / low) in it, and never more than all of them.
    """
    n = docs.count()
    counted = docs.select(F.explode(terms(F.coalesce(q(text), F.lit("")))).alias("t")).groupBy(slot(F.col("t")).alias("slot")).agg(F.count("*").alias("df"))
    inside = (F.col("df") <= max(high * n, 1)) & (F.col("df") >= low * n)
    out = bytearray([127 * int(low > 0)]) * ((1 << SLOT_BITS) // 7 + 1)
    for r in counted.filter(inside if low > 0 else ~inside).select("slot").collect():
        out[r["slot"] // 7] ^= 1 << r["slot"] % 7
    return F.lit(bytes(out))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signature(text: Column, out: Column) -> Column:
    """struct(octave, whole, hashes) of a text; out as `outside` gives it.

    Each random lexicon subset takes the terms of the inverse document frequency band in one cell of a hash, and of
    the terms outside it one in 2 ** OUTSIDE_BITS of those in the cell; a hash of the sorted terms taken is the
    subset's, null if none is. Which subsets a term is in depends on the term alone, so a text and its
    edited text share one lexicon. The densest subsets take one of 2 ** (octave - 1) terms; the octave goes by the
    number of terms, those outside counted at their share. whole is the hash of all terms.
    """
    # Bytes below 128 are characters, whose codes are the bits.
    bits_at = lambda at: F.ascii(F.substring(out, F.floor(at / 7).cast("int") + 1, F.lit(1)).cast("string"))
    usual = lambda t: F.getbit(bits_at(slot(t)), slot(t) % 7) == 0
    # For terms outside the band, some high bits of the hash have to be zero too.
    high_bits = ((1 << OUTSIDE_BITS) - 1) << 40

    def taken(kept: Column, x: Column, fits) -> Column:
        chosen = lambda mask: lambda t: fits(F.xxhash64(t, x["seed"]).bitwiseAND(mask))
        return F.struct(F.filter(kept["band"], chosen(x["mask"])).alias("band"), F.filter(kept["rest"], chosen(x["mask"] + high_bits)).alias("rest"))

    def subset(few: Column, x: Column, j: Column) -> Column:
        # Of 2 ** bits cells of a random hash, a subset takes one; up to 16 subsets share a hash.
        split = F.least(x["mask"] + 1, F.lit(16).cast("long"))
        own = F.struct((x["seed"] + F.floor(j / split)).cast("int").alias("seed"), x["mask"].alias("mask"), F.pmod(j, split).alias("cell"))
        return let(own, lambda y: last(taken(few, y, lambda h: h == y["cell"])))

    def last(own: Column) -> Column:
        return let(own, lambda o: let(F.concat(o["band"], o["rest"]), lambda c: F.when(F.size(c) > 0, F.shiftright(F.xxhash64(c), 32).cast("int"))))

    def level(kept: Column, bits: Column) -> Column:
        def made(x: Column) -> Column:
            # Where one hash serves all subsets, most terms are in no cell of theirs and go at once.
            few = F.when(x["mask"] >= 15, taken(kept, x, lambda h: h < SUBSETS)).otherwise(kept)
            return let(few, lambda f: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: subset(f, x, j)))

        return let(F.struct((F.pow(F.lit(2.0), bits).cast("long") - 1).alias("mask"), (bits * 16).cast("int").alias("seed")), made)

    def signed(every: Column) -> Column:
        parts = let(F.filter(every, usual), lambda band: F.struct(band.alias("band"), F.array_except(every, band).alias("rest")))
        weight = lambda kept: F.size(kept["band"]) + F.size(kept["rest"]) / (1 << OUTSIDE_BITS)
        return let(parts, lambda kept: over(every, kept, F.greatest(F.round(F.log2(F.greatest(weight(kept), F.lit(1.0)) / BEST)), F.lit(1)).cast("int")))

    def over(every: Column, kept: Column, octave: Column) -> Column:
        hashes = F.flatten(F.transform(F.sequence(octave - 1, octave + (DENSITIES - 2)), lambda bits: level(kept, bits)))
        return F.struct(octave.alias("octave"), F.shiftright(F.xxhash64(every), 32).cast("int").alias("whole"), hashes.alias("hashes"))

    # Sorted once, so every part of them is.
    return let(F.array_sort(terms(text)), signed)


def likeness(a: Column, b: Column) -> Column:
    """1 for signatures of equal terms; else the share of equal hashes among those of the subsets common to both that either has, 0 if there are none."""
    last = SUBSETS * DENSITIES - 1
    step = (a["octave"] - b["octave"]) * SUBSETS
    mine = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda j: (j + step).between(0, last))
    pairs = F.transform(mine, lambda j: F.struct(F.get(a["hashes"], j).alias("x"), F.get(b["hashes"], j + step).alias("y")))
    known = F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(known, lambda p: p["x"] == p["y"])
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.coalesce(F.size(same) / F.nullif(F.size(known), F.lit(0)), F.lit(0.0)))


def written(s: Column) -> Column:
    """A signature as text: the octave, then hex digits of each hash, nothing for a null, with colons."""
    digits = F.transform(s["hashes"], lambda x: F.coalesce(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("")))
    return F.concat_ws(":", s["octave"].cast("string"), F.lower(F.hex(s["whole"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.array_join(digits, ":"))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", high: float = 0.01, low: float = 0.0) -> DataFrame:
    """(id, fingerprint) of each row: equal texts have equal fingerprints.

    A null text counts as empty, whole texts are read, repeated rows stay, null ids are kept and other
    columns don't matter; an empty table gives an empty table. Frequencies are counted over all documents.
    """
    out_of_band = outside(docs, text, high, low)
    return docs.select(q(id).alias(id), written(signature(F.coalesce(q(text), F.lit("")), out_of_band)).alias("fingerprint"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(k1, k2, id, n, next1, next2, prev1, prev2, want) of the distinct rows(k1, k2, id, half): each one's neighbours in descending order of id.

    Null ids come last, equal ids go by key; the last one's next is the first. want is the half of the one
    before. The keys alone are sorted, by ranges; one row of each range tells the others where it begins and ends.
    """
    spark = rows.sparkSession
    order = [F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    alike = cut(rows.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("half").alias("half"), F.count("*").alias("n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(alike.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*order)
    at = {"next1": F.lead("k1").over(w), "next2": F.lead("k2").over(w), "prev1": F.lag("k1").over(w), "prev2": F.lag("k2").over(w), "want": F.lag("half").over(w)}
    inside = cut(placed.withColumns(at))
    heads = inside.filter("prev1 is null").select("part", F.col("k1").alias("first1"), F.col("k2").alias("first2"))
    tails = inside.filter("next1 is null").select("part", F.col("k1").alias("last1"), F.col("k2").alias("last2"), F.col("half").alias("last_half"))
    ring, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a partition
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(f"after_{c}")
    before = lambda c: F.coalesce(F.lag(c).over(ring), F.last(c).over(whole)).alias(f"before_{c}")
    ends = heads.join(tails, "part").select("part", *map(after, ("first1", "first2")), *map(before, ("last1", "last2", "last_half")))
    out = inside.join(F.broadcast(ends), "part")
    pick = {"next1": "after_first1", "next2": "after_first2", "prev1": "before_last1", "prev2": "before_last2", "want": "before_last_half"}
    return out.select("k1", "k2", "id", "n", *[F.coalesce(k, v).alias(k) for k, v in pick.items()])


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text", high: float = 0.01, low: float = 0.0) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    A text's edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's, in descending order of id, the first's after the last. Null texts are empty; null
    ids come last; rows with equal ids go by a hash, equal rows follow each other; one row is its own next.
    An empty table gives an empty table. Other columns don't matter.

    Texts are dealt once, by a key; what a text needs of the next one, half its own length at most, comes to it.
    """
    out_of_band = outside(docs, text, high, low)
    whole = F.coalesce(q(text), F.lit(""))
    name = F.coalesce(q(id).cast("string"), F.lit("-"))
    rows = docs.select(q(id).alias("id"), whole.alias("text"), F.xxhash64(name, whole).alias("k1"), F.xxhash64(F.lit(7), whole, name).alias("k2"))
    half = F.floor(F.length("text") / 2).cast("int")
    order = cut(neighbours(rows.select("k1", "k2", "id", half.alias("half"))))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(order, ["k1", "k2"])
    lent = texts.select(F.col("prev1").alias("b1"), F.col("prev2").alias("b2"), F.substr("text", F.lit(1), F.col("want")).alias("lent"))
    both = texts.join(lent, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
    # Equal rows follow each other: all but the last of them have their own text next.
    copies = both.withColumn("inner", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: k < F.col("n"))))
    size = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.when(F.col("inner"), F.substr("text", F.lit(1), half)).otherwise(F.col("lent")))
    made = copies.select("k1", "k2", "next1", "next2", "inner", "id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    made = made.select(*[c for c in made.columns if c not in ("text", "edited")], F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text"), out_of_band).alias("own"), signature(F.col("edited"), out_of_band).alias("changed"))
    signed = cut(made)  # read twice below
    following = signed.filter(~F.col("inner")).select(F.col("k1").alias("next1_b"), F.col("k2").alias("next2_b"), F.col("own").alias("following"))
    out = signed.join(following, (F.col("next1") == F.col("next1_b")) & (F.col("next2") == F.col("next2_b")))
    following = F.when(F.col("inner"), F.col("own")).otherwise(F.col("following"))
    return out.select(
        F.col("id").alias(id), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), following).alias("near_next"),
    )
