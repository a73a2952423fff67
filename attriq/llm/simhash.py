"""Near-duplicates by SimHash: fingerprints, links by pivot distance tables, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attriq.llm.common import cut, map_arrow, new_path, only, released
from attriq.llm.components import components
from attriq.llm.minhash import MAP, labelled, sets_of, shingles, verified

#: Rows that a group of the search holds on average at most, before it is split.
GROUP = 4096


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is in over half the XXH64 hashes of its word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[shingle - 1 :]) if len(words) >= shingle else [(0, len(body))]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(body[a:b], seed) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def pivots(number: int) -> np.ndarray:
    """Reference fingerprints: Walsh words, between each two of which half the bits differ, so that their tables tell different things."""
    return np.array([sum(1 << x for x in range(64) if bin(x & (2 * k + 1)).count("1") % 2) for k in range(number)], dtype=np.uint64)


def blocks_for(n: int, bits: int) -> int:
    """Blocks to cut 64 bits into so that random fingerprints that agree on all but `bits` of them fill groups of about GROUP."""
    blocks = bits + 1
    while blocks < 2 * bits and n > GROUP * 2 ** (64 * (blocks - bits) // blocks):
        blocks += 1
    return blocks


def masks(blocks: int, bits: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - bits)]


class Forest:
    """Union by least index over arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (up := self.up[r]).tolist() != r.tolist() if len(r) < 64 else not np.array_equal(up := self.up[r], r):
            r = up
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as two arrays of fingerprints) of the links inside each group.

    group: ids of groups, in order; side: -1, or the half of a split group, of which only pairs across
    count. The distances to each reference are the rows of a table. Sorted by the first, only a window of
    rows can be near; a pair is discarded once any coordinate differs by more than `bits`, and the survivors'
    own distance is verified. Pairs that are already connected need no look.
    """
    table = np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)
    order = np.lexsort((table[0], group))
    group, side, fp, table = group[order], side[order], fp[order], np.ascontiguousarray(table[:, order])
    forest, step, alive = Forest(len(fp)), 0, np.arange(len(fp))
    while len(alive):
        step += 1
        alive = alive[alive < len(fp) - step]
        b = alive + step
        alive = alive[(group[alive] == group[b]) & (table[0][b] - table[0][alive] <= bits)]
        a, b = alive, alive + step
        keep = (side[a] < 0) | (side[a] != side[b])
        a, b = a[keep], b[keep]
        for k in range(1, len(refs)):
            if not len(a):
                break
            keep = np.abs(table[k][a] - table[k][b]) <= bits
            a, b = a[keep], b[keep]
        if len(a):
            keep = np.bitwise_count(fp[a] ^ fp[b]) <= bits
            forest.link(a[keep], b[keep])
    every = np.arange(len(fp))
    roots = forest.roots(every)
    child = roots != every
    return fp[child], fp[roots[child]]


def links(prints: DataFrame, n: int, bits: int = 4, references: int = 16) -> DataFrame:
    """(a, b): links that connect all of the n distinct prints(fp) that are connected by pairs within `bits` bits.

    The pairs that meet: of so many blocks, two fingerprints within `bits` bits agree on all but `bits`, so
    they share a group of one of the tables of kept blocks. Within groups the pivot tables decide. A group
    of over GROUP rows is split in parts, and each pair of parts becomes a group of its own: no task holds
    more than about two parts, and every pair still meets.
    """
    keep = masks(blocks_for(n, bits), bits)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in keep])).alias("band", "key"))
    large = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.max("band").alias("band_b"), F.max("key").alias("key_b")).filter(F.col("n") > GROUP)
    large = cut(large.select("band_b", "key_b", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")))
    number = large.count()
    if number:
        side = F.broadcast(large) if number <= 50_000 else large
        rows = rows.join(side, (F.col("band") == F.col("band_b")) & (F.col("key") == F.col("key_b")), "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        with_all = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("lo"), F.greatest(k, part).alias("hi"), F.when(k == part, -1).otherwise(part).alias("side")))
        whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("side")))
        rows = rows.select("fp", "band", "key", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(with_all)).alias("at")).select("fp", "band", "key", "at.*")
    else:
        rows = rows.select("fp", "band", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("side"))
    # One number a group; groups that share a number by chance only meet more pairs.
    rows = rows.select(F.xxhash64("band", "key", "lo", "hi").alias("grp"), "side", "fp")
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n * len(keep) // 1_000_000)

    def search(batches):
        refs = pivots(references)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def done(last: bool):
            nonlocal held, size
            if not held:
                return
            group, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(group) if last else int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            held, size = ([(group[end:], side[end:], fp[end:])], len(group) - end) if end < len(group) else ([], 0)
            if end:
                a, b = linked(group[:end], side[:end], fp[:end].view(np.uint64), bits, refs)
                yield {"a": a.view(np.int64), "b": b.view(np.int64)}

        for b in batches:
            held.append((np.array(b["grp"], dtype=np.int64), np.array(b["side"], dtype=np.int32), np.array(b["fp"], dtype=np.int64)))
            size += len(b["grp"])
            if size >= 50_000:
                yield from done(False)
        yield from done(True)

    dealt = rows.repartition(partitions, "grp").sortWithinPartitions("grp")
    return map_arrow(dealt, "a long, b long", search, rows=10_000)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at `bits` or fewer differing bits; component_id is the least id that links reach,
    itself included. A null or empty text has fingerprint 0 and is linked like any other; of fewer words
    than a shingle, the whole sequence is one. Rows are told apart by fingerprint, so repeated ids or rows
    do no harm; null ids never are the least unless all are null. An empty table gives an empty table. Only
    ids and fingerprints travel, so other columns can't clash.

    Copies fall together before the search: a group of copies is one fingerprint, joined back at the end by
    a join that Spark can split.
    """

    def prints(batches):
        for b in batches:
            yield {"id": b["id"], "fp": np.array([fingerprint(x, shingle) for x in b["text"]], dtype=np.uint64).view(np.int64)}

    rows = cut(map_arrow(only(docs, id=id, text=text), "id long, fp long", prints))
    alike = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(alike.select("fp"), alike.count(), bits))
    known = alike.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.max("root").alias("root_b")).select("root_b", "component_id")
    classes = known.join(least, F.col("root") == F.col("root_b")).select(F.col("fp").alias("fp_b"), "component_id")
    out = rows.join(classes, F.col("fp") == F.col("fp_b"))
    return out.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Search at a Jaccard similarity: there 64 bits are too few, so fingerprints are wide and tables of some of their bits bring pairs together.

#: Longs of a wide fingerprint.
WIDE = 16
#: A pair at the least similarity asked for shares no table once in 1 / MISS.
MISS = 1e-5
#: Tables in which members meet heads of their group before the search.
FIRST = 8
#: Nodes of a family of which all pairs are looked at; larger ones meet by the rarest members of their sets.
FEW = 8
_ODD = np.random.default_rng(7).integers(0, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)
_MASKS = (0, 0x0000_0005_2DA3_9C71, 0x0000_000A_D25C_638E)


def wide_print(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes in 64 * WIDE bits: a bit is set if it is in over half of the hashes mixed anew for each long."""
    counts = np.zeros(64 * WIDE, dtype=np.int64)
    for k in range(0, len(found), 255):
        h = found[k : k + 255, None] * _ODD
        for step in (32, 29):
            h ^= h >> np.uint64(step)
            h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").view(np.int64)


def differing(percent: int) -> float:
    """The most of their bits in which fingerprints of two sets of that Jaccard similarity are expected to differ: their angle over pi, the widest for equal sizes."""
    return math.acos(2 * percent / (100 + percent)) / math.pi


@lru_cache(maxsize=8)
def tables_for(n: int, percent: int) -> np.ndarray:
    """The bits of each table: so many that groups of random fingerprints have some 32 to 64 of n, in so many tables that a pair misses all by MISS."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 6)
    number = math.ceil(math.log(MISS) / math.log1p(-((1 - differing(percent)) ** bits)))
    rng = np.random.default_rng(11)
    dealt = np.concatenate([rng.permutation(64 * WIDE) for _ in range(1 + number * bits // (64 * WIDE))])
    return dealt[: number * bits].reshape(number, bits)


def _heads(g: np.ndarray, node: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places: each row of a group with the group's three heads."""
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
    for mask in _MASKS:
        order = np.lexsort((node ^ mask, g))
        yield np.arange(len(g)), order[starts][group]


def _across(g: np.ndarray, node: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places: all rows of a group that have different roots, each pair once, some million at a time."""
    order = np.lexsort((root, g))
    g, root, at = g[order], root[order], np.arange(len(g))
    last = lambda new: np.r_[at[1:][new], len(g)][np.cumsum(np.r_[0, new])]  # noqa: E731  (the place behind each row's run)
    end = last(g[1:] != g[:-1])
    after = last((g[1:] != g[:-1]) | (root[1:] != root[:-1]))
    total = np.cumsum(end - after)
    begin = 0
    while begin < len(g):
        done = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + 1_000_000, "right")))
        number = (end - after)[begin:stop]
        a = np.repeat(at[begin:stop], number)
        b = np.arange(len(a)) - np.repeat(total[begin:stop] - number - done, number) + np.repeat(after[begin:stop], number)
        yield order[a], order[b]
        begin = stop


def _joined(g: np.ndarray, node: np.ndarray, root: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A spanning forest of the near pairs of each group, as two rows of roots; rows of one root are one from the start."""
    every, forest = np.arange(len(g)), Forest(len(g))
    order = np.lexsort((root, g))
    new = np.r_[True, (g[order[1:]] != g[order[:-1]]) | (root[order[1:]] != root[order[:-1]])]
    forest.link(order, order[np.maximum.accumulate(np.where(new, every, 0))])
    for a, b in _heads(g, node, root):
        keep = near(a, b)
        forest.link(a[keep], b[keep])
    for a, b in _across(g, node, forest.roots(every)):
        keep = near(a, b)
        forest.link(a[keep], b[keep])
    return np.stack([root, root[forest.roots(every)]])


def _in_groups(rows: DataFrame, parts: int, pairs: Callable[[np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """(a, b), once each, of the pairs (two rows of an array) that `pairs` yields for whole groups; rows has long columns, the group first. A group is in one task."""
    kind, width = StructType.fromDDL("a long, b long"), len(rows.columns)
    to = to_arrow_schema(kind)

    def search(batches):
        def found(part):
            for both in pairs(part):
                both = both[:, both[0] != both[1]]
                if both.size:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.sort(both, axis=0), axis=1)], schema=to)

        def made():
            held, size, ready = [], 0, 100_000
            for b in batches:
                held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(width)]))
                size += b.num_rows
                if size >= ready:
                    part = np.concatenate(held, axis=1)
                    end = int(np.searchsorted(part[0], part[0, -1]))  # where the last group begins; it may go on
                    yield from found(part[:, :end]) if end else ()
                    held, size = [part[:, end:]], part.shape[1] - end
                    ready = max(100_000, 2 * size)
            if size:
                yield from found(np.concatenate(held, axis=1))

        return released(made())

    group = rows.columns[0]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    return rows.repartition(parts, group).sortWithinPartitions(group).mapInArrow(search, kind).distinct()


def candidates(prints: DataFrame, tables: np.ndarray, number: int, percent: int, heads: bool = False) -> DataFrame:
    """(a, b), once each, of prints(node, root, n, fp) that share a group of a table, have different roots and can have the similarity.

    With heads, the nodes of the pairs in which one of the two is one of three heads of the group. Otherwise the roots of a spanning
    forest of all such pairs, so that a group of m rows makes m - 1 at most. Sizes and 128 bits of the fingerprints discard pairs.
    Rows travel with those bits only.
    """
    rate, places = differing(percent), 1 << np.arange(tables.shape[1], dtype=np.int64)
    most = math.ceil(128 * rate + 5 * math.sqrt(128 * rate * (1 - rate)))
    spread_kind = StructType.fromDDL("grp long, node long, root long, n long, s0 long, s1 long")
    column = lambda b, k: b.column(k).to_numpy(zero_copy_only=False)
    above = np.arange(len(tables), dtype=np.int64) << 40

    def spread(batches):
        def made():
            for whole in batches:
                for k in range(0, whole.num_rows, 256):
                    b = whole.slice(k, 256)
                    fp = np.ascontiguousarray(b.column(3).flatten().to_numpy(zero_copy_only=False)).reshape(-1, WIDE)
                    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
                    keys = bits[:, tables].astype(np.int64) @ places | above
                    arrays = [keys.ravel(), *[np.repeat(x, len(tables)) for x in (column(b, 0), column(b, 1), column(b, 2), fp[:, 0], fp[:, 1])]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=to_arrow_schema(spread_kind))

        return released(made())

    def pairs(rows):
        (g, node, root, n), (s0, s1) = rows[:4], rows[4:].view(np.uint64)

        def near(a, b):
            keep = np.flatnonzero(np.bitwise_count(s0[a] ^ s0[b]).astype(np.int64) + np.bitwise_count(s1[a] ^ s1[b]) <= most)
            a, b = a[keep], b[keep]
            return keep[(root[a] != root[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)]

        if not heads:
            yield _joined(g, node, root, near)
            return
        for a, b in _heads(g, node, root):
            keep = near(a, b)
            yield np.stack([node[a[keep]], node[b[keep]]])

    rows = prints.select("node", "root", "n", "fp").mapInArrow(spread, spread_kind)
    return _in_groups(rows, 1 + number * len(tables) // 1_000_000, pairs)


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(grp, node, n, at, m0, m1, ...): the rarest members of each set of sets(node, family, n, found, map) that another set of its family holds too.

    Members are ordered by the number of the family's sets that hold them; `at` is the place in that order and grp stands for the member in
    its family. Sets with the similarity share one of their first members, as many as a set can lack and one more, so only those are returned.
    """
    held = sets.select("node", F.explode("found").alias("member"), F.xxhash64("family").alias("salt")).select("node", F.col("member").bitwiseXOR(F.col("salt")).alias("grp"))
    often = held.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("often")).filter("often > 1")
    shared = held.join(often, F.col("grp") == F.col("of")).groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_list(F.struct("often", "grp"))).alias("shared"))
    first = sets.join(shared, F.col("node") == F.col("of")).withColumn("own", F.col("n") - F.size("shared"))
    first = first.withColumn("taken", F.expr(f"cast(greatest(0, n - (n * {percent} + 99) div 100 + 1 - own) as int)"))
    first = first.select("node", "n", "own", "map", F.posexplode(F.slice("shared", F.lit(1), F.col("taken"))).alias("k", "one"))
    return first.select("one.grp", "node", "n", (F.col("own") + F.col("k")).alias("at"), *[F.col("map")[k].alias(f"m{k}") for k in range(MAP)])


def meetings(first: DataFrame, percent: int, heads: bool = False) -> DataFrame:
    """(a, b), once each: pairs of the nodes of rarest(), placed as (grp, node, root, n, at, m0, ...), that meet at a member, have different roots and can have the similarity.

    With heads, one of the two is one of three heads of the group. Sizes, places and maps never mislead: behind the first member that
    two sets share, they share no more than what the shorter rest holds.
    """

    def pairs(rows):
        (g, node, root, n, at), maps = rows[:5], np.ascontiguousarray(rows[5:].T).view(np.uint64)
        for a, b in (_heads if heads else _across)(g, node, root):
            both = n[a] + n[b]
            keep = (root[a] != root[b]) & (np.minimum(n[a] - at[a], n[b] - at[b]) * (100 + percent) >= both * percent)
            a, b, both = a[keep], b[keep], both[keep]
            for k in range(0, len(a), 100_000):
                x, y = a[k : k + 100_000], b[k : k + 100_000]
                apart = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
                keep = (apart * (100 + percent) <= both[k : k + 100_000] * (100 - percent)) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
                yield np.stack([node[x[keep]], node[y[keep]]])

    return _in_groups(first, 1, pairs)


def similar_groups(rows: DataFrame, row: str, id: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """(row, id, n_shingles, component) of each row: rows are linked at a shingle Jaccard similarity of `percent` or more.

    `row` is a long that tells rows apart and stays the same when rows is read again; ids take no part. component is the
    row of one member, the same for all. Rows with equal sets fall together before the search; null and empty texts are such copies.

    SimHash brings rows together that agree on all bits of a table of their wide fingerprints. First members meet heads
    of their groups, and what can be near of these is a family from the start; then spanning forests of what can be near in a group join
    such families, so that edits of one text that aren't similar enough to each other aren't paired. Within a small family all meet, within a large one those that share one of their
    sets' rarest members, which loses none; there too they meet heads first. Each link is verified on the whole sets. A pair is missed
    only where no table agrees or 128 bits mislead.
    """

    def sign(batches):
        for b in batches:
            found = [shingles(x, shingle) for x in b["text"]]
            keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in found], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield {"row": b["row"], "id": b["id"], "n": [len(s) for s in found], "k1": keys[:, 0], "k2": keys[:, 1], "fp": [wide_print(s) for s in found]}

    spark, kind = rows.sparkSession, rows.schema[id].dataType.simpleString()
    given = only(rows, row=row, id=id, text=text)
    texts = given.select("row", "text")
    made = map_arrow(given, f"row long, id {kind}, n long, k1 long, k2 long, fp array<long>", sign)
    made.write.parquet(path := new_path(spark, "signed"))
    made = spark.read.schema(made.schema).parquet(path)
    classes = cut(made.groupBy("k1", "k2").agg(F.min("row").alias("node")))
    prints = cut(made.filter("n > 0").join(classes, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "n", "fp"))
    number = prints.count()
    tables = tables_for(number, percent)
    first = cut(candidates(prints.withColumn("root", F.col("node")), tables[:FIRST], number, percent, heads=True))
    links = cut(verified(first, texts, percent, shingle))
    roots = cut(components(links))
    rooted = lambda df, roots: df.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
    # Pairs of the first tables join families, verified or not; what all tables add is a graph of those.
    begun = cut(components(first))
    family = components(cut(candidates(rooted(prints, begun), tables, number, percent))).select(F.col("node").alias("of"), F.col("root").alias("family"))
    placed = rooted(prints.select("node", "n"), begun).withColumnRenamed("root", "begun").join(family, F.col("begun") == F.col("of"), "left")
    placed = rooted(placed.select("node", "n", F.coalesce("family", "begun").alias("family")), roots)
    whole = placed.groupBy("family").agg(F.max("family").alias("of"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("of")
    members = cut(placed.join(whole, F.col("family") == F.col("of")).select("node", "root", "family", "n"))
    sets = cut(sets_of(texts, members.select(F.col("node").alias("want")), shingle))
    sizes = members.groupBy("family").agg(F.max("family").alias("of"), F.count("*").alias("members")).select("of", "members")
    few = members.join(sizes.filter(F.col("members") <= FEW), F.col("family") == F.col("of")).select("node", "root", "family", "n")
    other = few.select(F.col("node").alias("other"), F.col("root").alias("root_b"), F.col("family").alias("of"), F.col("n").alias("m"))
    able = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    more = few.join(other, (F.col("family") == F.col("of")) & (F.col("root") < F.col("root_b")) & able).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    many = cut(members.join(sizes.filter(F.col("members") > FEW), F.col("family") == F.col("of")).select(F.col("node").alias("of"), "family", "n"))
    if not many.isEmpty():
        rare = cut(rarest(sets.join(many, F.col("node") == F.col("of")).drop("of"), percent))
        ready = lambda: rooted(rare, roots).select("grp", "node", "root", "n", "at", *[f"m{k}" for k in range(MAP)])
        again = cut(meetings(ready(), percent, heads=True).join(first, ["a", "b"], "left_anti"))
        roots = cut(components(cut(links.unionByName(verified(again, texts, percent, shingle, sets)))))
        more = more.unionByName(meetings(ready(), percent).join(again, ["a", "b"], "left_anti"))
    more = cut(more.join(first, ["a", "b"], "left_anti"))
    return labelled(made, classes, roots, more, texts, percent, shingle, sets)
