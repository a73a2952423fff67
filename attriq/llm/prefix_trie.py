"""Prefix trie of conversations: vertical bitmaps by (position, turn), intersected depth first, shard by shard, and merged by node."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attriq.llm.common import cut, only, released

#: Conversations and turns of a shard; one conversation of more turns is a shard of its own that isn't held in memory.
CONVS, TURNS = 4096, 65_536
_ROOT = (0, 0)
_PART = "ka long, kb long, pa long, pb long, ta long, tb long, depth long, len long, n long, least long, w1 long, w2 long, ends array<struct<first: long, lows: binary>>"
_NO_ENDS = hashlib.sha256().hexdigest()


def number_turns(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, ta, tb, len) of each turn: its place from 1 on, 128 bits that stand for role and text, and the text's code points.

    Turns go by `turn` (null first), then role, then text; a null role or text is empty. Rows without a
    conversation id belong to no conversation and are left out.
    """
    given = only(rows, conv=id, turn=turn, role=role, text=text).filter("conv is not null")
    given = given.select(F.col("conv").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return given.select("conv", place.cast("long").alias("pos"), F.xxhash64("role", "text").alias("ta"), F.xxhash64(F.lit(1), "text", "role").alias("tb"), F.length("text").cast("long").alias("len"))


def turn_texts(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """(ta, tb, role, text) of each different turn, to be joined to nodes for their last turns."""
    given = only(rows, role=role, text=text).select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return given.select(F.xxhash64("role", "text").alias("ta"), F.xxhash64(F.lit(1), "text", "role").alias("tb"), "role", "text").dropDuplicates(["ta", "tb"])


def lend_starts(turns: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """turns, with the first h of each conversation c replaced by those of conversation c - c % group.

    h is the crc32 of c in decimal, modulo `most`. A lender with fewer turns gives all of them, an absent
    one none; c's own turns after its first h follow. convs has (conv, n): each conversation and its number
    of turns. A conversation may be left without turns.
    """
    borrowed = convs.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    lent = convs.select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    borrowed = borrowed.join(lent, F.col("base") == F.col("lender"), "left").select("conv", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("got"))
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "of")
    heads = borrowed.filter("got > 0").join(first, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("h"))).select("conv", "pos", "ta", "tb", "len")
    own = borrowed.withColumnRenamed("conv", "of")
    tails = turns.join(own, (F.col("conv") == F.col("of")) & (F.col("pos") > F.col("h"))).withColumn("pos", F.col("pos") - F.col("h") + F.col("got"))
    return heads.unionByName(tails.select("conv", "pos", "ta", "tb", "len"))


def _key(above: tuple[int, int], turn: tuple[int, int, int]) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(struct.pack("<qqqq", *above, turn[0], turn[1])))


def _lists(ids: list[int]) -> list[dict]:
    """Ascending ids as runs that share all but their last 16 bits: the first id, and the last 16 bits of each."""
    at = np.array(ids, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(at >> 16)) + 1
    return [{"first": int(run[0]), "lows": (run & 0xFFFF).astype("<u2").tobytes()} for run in np.split(at, cuts)]


def _bits(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


class Shard:
    """Conversations in ascending order of their ids, indexed as one bitset a (position, turn)."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.weights: list[tuple[int, int]] = []
        self.turns: list[list[tuple[int, int, int]]] = []
        self.held = 0

    def nodes(self) -> Iterator[tuple]:
        """The nodes of the shard's own trie, depth first, as rows of _PART."""
        index: list[dict[tuple[int, int, int], int]] = []
        ends: list[int] = [0]
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            while len(index) < len(turns):
                index.append({})
                ends.append(0)
            for d, t in enumerate(turns):
                index[d][t] = index[d].get(t, 0) | bit
            ends[len(turns)] |= bit
        stack = [((1 << len(self.ids)) - 1, 0, _ROOT, (0, 0), (0, 0, 0))]
        while stack:
            members, depth, key, above, last = stack.pop()
            done = members & ends[depth]
            single = members & (members - 1) == 0
            first = (members & -members).bit_length() - 1
            weights = self.weights[first] if single else tuple(map(sum, zip(*(self.weights[i] for i in _bits(members)), strict=True)))
            yield (*key, *above, last[0], last[1], depth, last[2], members.bit_count(), self.ids[first], *weights, _lists([self.ids[i] for i in _bits(done)]) if done else None)
            rest = members ^ done
            while rest:
                # The lowest member's turn names the posting; what it meets of the parent's bits is one child.
                t = self.turns[(rest & -rest).bit_length() - 1][depth]
                child = rest & index[depth][t]
                rest ^= child
                stack.append((child, depth + 1, _key(key, t), key, t))


def _lone(rows: Iterator[tuple], held: list[tuple[int, int, int]], conv: int, weights: tuple[int, int]) -> Iterator[tuple]:
    """The nodes of one long conversation, whose further turns come from rows, until the iterator ends."""
    key, above, depth = _ROOT, (0, 0), 0
    last: tuple[int, int, int] = (0, 0, 0)
    for part in (held, rows):
        for t in part:
            yield (*key, *above, last[0], last[1], depth, last[2], 1, conv, *weights, None)
            above, key, last, depth = key, _key(key, t), t, depth + 1
    yield (*key, *above, last[0], last[1], depth, last[2], 1, conv, *weights, _lists([conv]))


def _parts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of all shards; rows are (conv, pos, ta, tb, len, w1, w2) by conv and pos, each conversation with a row at place 0."""
    shard, row = Shard(), next(rows, None)
    while row is not None:
        conv, weights, turns = row[0], (row[5], row[6]), []
        row = next(rows, None)
        while row is not None and row[0] == conv and len(turns) <= TURNS:
            turns.append((row[2], row[3], row[4]))
            row = next(rows, None)
        if row is not None and row[0] == conv:

            def more() -> Iterator[tuple[int, int, int]]:
                nonlocal row
                while row is not None and row[0] == conv:  # noqa: B023
                    yield row[2], row[3], row[4]
                    row = next(rows, None)

            yield from _lone(more(), turns, conv, weights)
            continue
        if shard.ids and (len(shard.ids) >= CONVS or shard.held + len(turns) > TURNS):
            yield from shard.nodes()
            shard = Shard()
        shard.ids.append(conv)
        shard.weights.append(weights)
        shard.turns.append(turns)
        shard.held += len(turns)
    if shard.ids:
        yield from shard.nodes()


def _shards(rows: DataFrame) -> DataFrame:
    """Nodes of each shard of rows(conv, pos, ta, tb, len, w1, w2); shards are neighbouring conversations."""
    kind = StructType.fromDDL(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(kind)

        def read() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 4096).columns), strict=True)

        def made() -> Iterator[pa.RecordBatch]:
            ready: list[tuple] = []
            for node in _parts(read()):
                ready.append(node)
                if len(ready) == 4096:
                    yield batch(ready)
                    ready.clear()
            if ready:
                yield batch(ready)

        def batch(ready: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), to, strict=True)], schema=to)

        return released(made())

    dealt = rows.select("conv", "pos", "ta", "tb", "len", "w1", "w2").repartitionByRange("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInArrow(run, kind)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(ea, eb, ends_sha256) of nodes at which conversations end; a node's ids stream through the hash in order and are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            now, digest = None, None
            for b in batches:
                out: list[tuple[int, int, str]] = []
                for a, c, first, lows in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    text = ",".join(map(str, ((first >> 16 << 16) + np.frombuffer(lows, dtype="<u2").astype(np.int64)).tolist()))
                    if now == (a, c):
                        digest.update(b"," + text.encode())
                        continue
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, c), hashlib.sha256(text.encode())
                if out:
                    yield batch(out)
            if now is not None:
                yield batch([(*now, digest.hexdigest())])

        def batch(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
            a, b, s = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=["ea", "eb", "ends_sha256"])

        return released(made())

    runs = parts.filter("ends is not null").select("ka", "kb", F.explode("ends").alias("e")).select("ka", "kb", "e.first", "e.lows")
    return runs.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(run, "ea long, eb long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns: the nodes of the trie of conversations, the textless root included.

    turns has (conv, pos, ta, tb, len) as from `number_turns`, places 1, 2, 3 and so on; convs has conv, once
    for each conversation, with or without turns. All ids are longs and not null. Columns:

    conv_id, the smallest member (a conversation that starts so); depth; parent_conv_id (root: null); n_convs,
    members; n_children; n_leaves, childless nodes in the subtree, itself included; saved_tokens, the sum over
    the subtree of (members - 1) times the code points of the last text; ends_sha256, of the ids of members
    that end here, ascending, in decimal, joined by commas; ta and tb, its last turn (`turn_texts` has the texts).

    Each shard of neighbouring conversations yields its nodes with member counts and end lists; equal nodes
    of different shards merge by 128 bits of the path. A node belongs to its smallest member, so each member
    owns a run of nodes down to its end, or none. Sums over a subtree are the owner's from the node down and
    all of what other members own; a second pass over the shards adds the latter, so no chain is walked.
    No conversations give no rows.
    """
    given = turns.select("conv", "pos", "ta", "tb", "len")
    zero = F.lit(0).cast("long")
    starts = convs.select("conv", zero.alias("pos"), zero.alias("ta"), zero.alias("tb"), zero.alias("len"))
    parts = cut(_shards(given.unionByName(starts).withColumns({"w1": zero, "w2": zero})).drop("w1", "w2"))
    same = [F.min(c).alias(c) for c in ("pa", "pb", "ta", "tb", "depth", "len")]
    nodes = cut(parts.groupBy("ka", "kb").agg(*same, F.sum("n").alias("n"), F.min("least").alias("least")))
    below = nodes.filter("depth > 0").groupBy(F.col("pa").alias("ca"), F.col("pb").alias("cb")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, (F.col("ka") == F.col("ca")) & (F.col("kb") == F.col("cb")), "left").drop("ca", "cb")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    gain = (F.col("n") - 1) * F.col("len")
    down = Window.partitionBy("least").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = cut(nodes.withColumn("gain", gain).withColumn("from_here", F.sum("gain").over(down)).withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    owned = nodes.groupBy(F.col("least").alias("owner")).agg(F.sum("gain").alias("w1"), F.sum("leaf").alias("w2"))
    weighed = starts.join(owned, F.col("conv") == F.col("owner"), "left").select("conv", "pos", "ta", "tb", "len", F.coalesce("w1", zero).alias("w1"), F.coalesce("w2", zero).alias("w2"))
    sums = _shards(given.withColumns({"w1": zero, "w2": zero}).unionByName(weighed)).groupBy(F.col("ka").alias("sa"), F.col("kb").alias("sb")).agg(F.sum("w1").alias("all"), F.sum("w2").alias("n_leaves"))
    above = nodes.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("least").alias("parent_conv_id"))
    totals = owned.select("owner", F.col("w1").alias("own"))
    out = nodes.join(sums, (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb"))).join(_end_digests(parts), (F.col("ka") == F.col("ea")) & (F.col("kb") == F.col("eb")), "left")
    out = out.join(above, (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub")) & (F.col("depth") > 0), "left").join(totals, F.col("least") == F.col("owner"))
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        (F.col("from_here") + F.col("all") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        "ta",
        "tb",
    )
