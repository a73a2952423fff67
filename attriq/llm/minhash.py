"""MinHash near-duplicates: universal hash minima, bands, signature verification, whole sets, components by large and small stars."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attriq.llm.common import cut, map_arrow, new_path, only, q, released
from attriq.llm.components import components

#: A pair of similarity s shares one of BANDS bands of ROWS minima with probability 1 - (1 - s ** ROWS) ** BANDS: 0.999997 at 0.8.
BANDS, ROWS = 32, 5
#: Finer bands for buckets with more than CROWD members that are still apart: 0.9999994 at 0.8, and 0.36 at 0.6, where the above has 0.92.
FINE_BANDS, FINE_ROWS, CROWD = 200, 12, 256
#: Members of a bucket that all others of it are compared with before any other pair: least row ids, read under these masks.
_MASKS = (0, 0x0000_0005_2DA3_9C71, 0x0000_000A_D25C_638E)
#: Longs of a set's parity map.
MAP = 16
#: The bitmap of wanted rows has 2 ** FILTER places at most.
FILTER = 26
_CACHE = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1024


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 5)
        return value


_hashes = _Hashes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words, A-Z lowered; of fewer words, the whole sequence is one, of none there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(size, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + h[k : len(h) - n + 1 + k]
    return np.unique(out)


class Signer:
    """Minima of a set under bands * rows hashes a * x + b modulo 2 ** 32 with odd a."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(bands * 1000 + rows)
        n = bands * rows
        self.odd, self.plus = (rng.integers(0, 2**32, (n, 1), dtype=np.uint32) for _ in range(2))
        self.odd |= np.uint32(1)
        self.mix = rng.integers(0, 2**64, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 2**64, bands, dtype=np.uint64)
        self.room = np.empty((n, _PIECE), dtype=np.uint32)

    def minima(self, found: np.ndarray) -> np.ndarray:
        x = ((found >> np.uint64(32)) ^ (found & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        least = np.full(len(self.odd), 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(x), _PIECE):
            part = x[at : at + _PIECE]
            room = self.room[:, : len(part)]
            np.multiply(self.odd, part[None, :], out=room)
            room += self.plus
            np.minimum(least, room.min(axis=1), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        """A key for each band."""
        return ((least.reshape(self.mix.shape).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64) * _STEP ^ self.salt).view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """The last four bits of each minimum, sixteen to a long."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return np.ascontiguousarray(low[0::2] | (low[1::2] << 4)).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """The parity of the hashes at each of 64 * MAP places: maps of two sets differ in no more bits than the sets in members."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * MAP), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_signers: dict[tuple[int, int], Signer] = {}


def _signer(bands: int, rows: int) -> Signer:
    if (bands, rows) not in _signers:
        _signers[bands, rows] = Signer(bands, rows)
    return _signers[bands, rows]


def _most_differing(percent: int) -> int:
    """Places at which signatures of a pair of that similarity differ, plus six deviations: a pair beyond that is that similar once in 10^9."""
    n, p = BANDS * ROWS, (1 - percent / 100) * 15 / 16
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def _able(a: str, b: str, n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m members, by their sizes, parity maps and signatures (columns a and b), can have the similarity.

    Sizes and maps never mislead: sets that similar differ in (100 - percent) / (100 + percent) of n + m members at most.
    """
    from_sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    longs = BANDS * ROWS // 16
    places, bits = F.lit(0), F.lit(0)
    for k in range(longs):
        x = q(a)[k].bitwiseXOR(q(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        places += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    for k in range(longs, longs + MAP):
        bits += F.bit_count(q(a)[k].bitwiseXOR(q(b)[k]))
    return from_sizes & (bits * (100 + percent) <= (q(n) + q(m)) * (100 - percent)) & (places <= _most_differing(percent))


def _from_texts(texts: DataFrame, wanted: DataFrame, schema: str, make: Callable[[list], dict[str, list]]) -> DataFrame:
    """A row (node and what make returns for the text) for each row of texts(row, text) whose row is in wanted(want), distinct.

    So that texts needn't be shuffled, workers skip those that a bitmap of hashed places rules out: 16 places
    a wanted row up to FILTER, 8 MB, that alone is sent; beyond that more pass it. The join decides in any case.
    """
    places = 1 << max(16, min(FILTER, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    marked = wanted.select(place("want").alias("place")).groupBy(F.shiftright("place", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31L AS int))")).alias("bits"))
    found, words = marked.toArrow(), np.zeros(places // 32, dtype=np.uint32)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(kind)

        def made() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(2).to_numpy(zero_copy_only=False)
                held = b.filter(pa.array((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
                for k in range(0, held.num_rows, 256):
                    part = held.slice(k, 256)
                    out = {"node": part.column(0), **make(part.column(1).to_pylist())}
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in to], schema=to)

        return released(made())

    return texts.select("row", "text", place("row").alias("place")).mapInArrow(run, kind).join(wanted, F.col("node") == F.col("want"), "left_semi")


def sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, found, map): the whole set and its parity map of each row of texts(row, text) in wanted(want)."""

    def whole(part: list) -> dict[str, list]:
        found = [shingles(x, shingle) for x in part]
        return {"found": [s.view(np.int64) for s in found], "map": [parity(s) for s in found]}

    return _from_texts(texts, wanted, "node long, found array<long>, map array<long>", whole)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs(a, b) whose whole sets have a Jaccard similarity of at least `percent`; texts has (row, text), sets those sets if they are there."""

    def whole(part: list) -> dict[str, list]:
        return {"found": [shingles(x, shingle).view(np.int64) for x in part]}

    if sets is None:
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct())
        sets = cut(_from_texts(texts, wanted, "node long, found array<long>", whole))
    side = lambda s: sets.select(F.col("node").alias(f"node_{s}"), F.col("found").alias(f"found_{s}"))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    common = F.size(F.array_intersect("found_a", "found_b"))
    return both.filter(common * (100 + percent) >= (F.size("found_a") + F.size("found_b")) * percent).select("a", "b")


def _alike(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b), once each, but for those that sizes, maps or signatures keep apart."""
    side = lambda s: signed.select(F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    met = pairs.distinct().join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    return met.filter(_able("sig_a", "sig_b", "n_a", "n_b", percent)).select("a", "b")


def _apart(placed: DataFrame, texts: DataFrame, signed: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs(a, b) of nodes of one bucket and different roots that sizes, maps and signatures don't keep apart; placed has (bucket, node, root).

    Crowded buckets are dealt anew by finer bands of their members' sets, so what meets there is nearly as
    similar as a link.
    """
    sizes = placed.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    weight = placed.groupBy(F.col("root").alias("of_root")).agg(F.count("*").alias("weight"))
    left = placed.join(sizes, F.col("bucket") == F.col("of")).join(weight, F.col("root") == F.col("of_root"))
    left = cut(left.select("bucket", "node", "root", "weight", "members"))
    few = left.filter(F.col("members") <= CROWD).select("bucket", "node", "root", "weight")

    def fine(part: list) -> dict[str, list]:
        signer = _signer(FINE_BANDS, FINE_ROWS)
        return {"bands": [signer.bands(signer.minima(shingles(x, shingle))) for x in part]}

    crowd = left.filter(F.col("members") > CROWD).groupBy(F.col("node").alias("want")).agg(F.min("root").alias("root"), F.min("weight").alias("weight"))
    crowd = cut(crowd)
    if not crowd.isEmpty():
        banded = _from_texts(texts, crowd.select("want"), "node long, bands array<long>", fine)
        again = banded.join(crowd, F.col("node") == F.col("want")).select(F.explode("bands").alias("bucket"), "node", "root", "weight")
        few = cut(few.unionByName(again))
    # Of two members of different roots one at least isn't of the bucket's weightiest root, so that root's members needn't meet each other.
    major = few.groupBy(F.col("bucket").alias("of")).agg(F.max_by("root", F.struct("weight", "root")).alias("major"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("of", "major")
    known = few.join(major, F.col("bucket") == F.col("of")).drop("of").join(signed.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    known = cut(known.select("bucket", "node", "root", "major", "n", "sig"))
    other = known.select(F.col("bucket").alias("bucket_b"), F.col("node").alias("other"), F.col("root").alias("root_b"), F.col("n").alias("m"), F.col("sig").alias("sig_b"))
    once = (F.col("root_b") == F.col("major")) | (F.col("root") < F.col("root_b"))
    met = known.filter("root <> major").join(other, (F.col("bucket") == F.col("bucket_b")) & (F.col("root") != F.col("root_b")) & once & _able("sig", "sig_b", "n", "m", percent))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def labelled(made: DataFrame, classes: DataFrame, roots: DataFrame, more: DataFrame, texts: DataFrame, percent: int, shingle: int, sets: DataFrame | None = None) -> DataFrame:
    """(row, id, n_shingles, component) of made(row, id, n, k1, k2): classes(k1, k2, node) by their roots(node, root), which those of more(a, b) that whole sets confirm join."""
    label = classes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():
        # These links join components, so what is left to search is a graph of their roots.
        root_of = lambda c: roots.select(F.col("node").alias(f"of_{c}"), F.col("root").alias(f"root_{c}"))
        links = verified(more, texts, percent, shingle, sets).join(root_of("a"), F.col("a") == F.col("of_a"), "left").join(root_of("b"), F.col("b") == F.col("of_b"), "left")
        above = components(cut(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()))
        above = above.select(F.col("node").alias("below"), F.col("root").alias("above"))
        label = label.join(above, F.col("root") == F.col("below"), "left").select("k1", "k2", F.coalesce("above", "root").alias("root"))
    label = label.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("root").alias("component"))
    out = made.select("row", "id", F.col("n").alias("n_shingles"), "k1", "k2").join(label, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")))
    return out.select("row", "id", "n_shingles", "component")


def near_groups(rows: DataFrame, row: str, id: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """(row, id, n_shingles, component) of each row: rows are linked at a shingle Jaccard similarity of `percent` or more.

    `row` is a long that tells rows apart and stays the same when rows is read again; ids take no part.
    component is the row of one member, the same for all. Rows with equal sets fall together before the
    search, so copies cost nothing more; null and empty texts are such copies of each other.

    Rows that share a band of minima meet: first all members of a bucket meet three of them, then all that
    are not yet connected meet each other, so no pair of a bucket is left out and a bucket of near-copies
    isn't squared. Sizes, parity maps and signatures discard pairs, and each link is verified on the whole sets. A pair
    is missed only where no band agrees or the signatures mislead.
    """

    def sign(batches):
        signer = _signer(BANDS, ROWS)
        for b in batches:
            found = [shingles(x, shingle) for x in b["text"]]
            least = [signer.minima(s) for s in found]
            keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in found], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield {"row": b["row"], "id": b["id"], "n": [len(s) for s in found], "k1": keys[:, 0], "k2": keys[:, 1], "bands": [signer.bands(m) if len(s) else [] for s, m in zip(found, least, strict=True)], "sig": [np.concatenate([signature(m), parity(s)]) for s, m in zip(found, least, strict=True)]}

    spark, kind = rows.sparkSession, rows.schema[id].dataType.simpleString()
    given = only(rows, row=row, id=id, text=text)
    texts = given.select("row", "text")
    made = map_arrow(given, f"row long, id {kind}, n long, k1 long, k2 long, bands array<long>, sig array<long>", sign)
    made.write.parquet(path := new_path(spark, "signed"))
    made = spark.read.schema(made.schema).parquet(path)
    classes = cut(made.groupBy("k1", "k2").agg(F.min("row").alias("node")))
    signed = made.select(F.col("row").alias("node"), "n", "sig")
    spread = made.join(classes.select(F.col("node").alias("one")), F.col("row") == F.col("one"), "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    heads = [F.min(F.col("node").bitwiseXOR(F.lit(m))).alias(f"h{i}") for i, m in enumerate(_MASKS)]
    shared = spread.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("members"), *heads).filter("members > 1")
    members = cut(spread.join(shared, F.col("bucket") == F.col("of")).select("bucket", "node", *[F.col(f"h{i}").bitwiseXOR(F.lit(m)).alias(f"h{i}") for i, m in enumerate(_MASKS)]))
    first = members.select("node", F.explode(F.array(*[f"h{i}" for i in range(len(_MASKS))])).alias("head")).filter("node <> head")
    first = cut(_alike(first.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")), signed, percent))
    roots = cut(components(cut(verified(first, texts, percent, shingle))))
    placed = members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    more = cut(_apart(placed, texts, signed, percent, shingle).join(first, ["a", "b"], "left_anti"))
    return labelled(made, classes, roots, more, texts, percent, shingle)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 4) -> DataFrame:
    """One row per row of docs: the id, n_shingles (the size of its set), component_id and kept.

    component_id is the least id that links of at least `percent` reach, itself included. Null and empty
    texts have no shingles and are linked with nothing. Rows that repeat an id are linked each by its own
    text; a null id is never the least unless all are null, and kept is then true. kept is whether the
    row's id is the component's. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id, text=text).withColumn("row", F.monotonically_increasing_id())
    rows.write.parquet(path := new_path(spark, "rows"))
    groups = near_groups(spark.read.schema(rows.schema).parquet(path), "row", "id", "text", percent, shingle)
    groups = groups.withColumn("component", F.when(F.col("n_shingles") == 0, F.col("row")).otherwise(F.col("component")))
    least = groups.groupBy(F.col("component").alias("of")).agg(F.min("id").alias("component_id"))
    out = groups.join(least, F.col("component") == F.col("of"))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
