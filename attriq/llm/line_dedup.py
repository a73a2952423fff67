"""Lines that many documents share, dropped from all but one of them."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import map_arrow, only, q, with_arrow


def key_of(line: bytes, least: int) -> bytes | None:
    """The key of a line: stripped of ASCII white space, A-Z lower-cased; None if under `least` code points."""
    key = line.strip().lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key


def drop_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """docs with text without the lines that `documents` or more documents share, n_lines and n_dropped.

    A line's key is hashed to 128 bits. Keys of `least` code points or more that are found in at least
    `documents` distinct ids lose all their lines, except in the largest id that holds them. Other lines
    stay in their places, joined by newlines. A null or empty text is one empty line and stays as it is
    (null stays null). Rows with the same id count as one document and each is returned; a null id is one
    id of its own, below all others. An empty table gives an empty table; input columns named n_lines or
    n_dropped are replaced, all others stay.

    Lines of a document count once each before the shuffle; counts are combined on the map side, so that a
    line in every document is one row a task. The join that finds the lines to drop is a plain join of two
    shuffles, which Spark splits where a key is hot, and is a broadcast join where few lines are shared.
    """

    def lines(batches):
        for b in batches:
            ids, hashes = [], []
            for i, x in zip(b["id"], b["text"], strict=True):
                if x:
                    own = {xxhash.xxh3_128_digest(k) for line in x.encode().split(b"\n") if (k := key_of(line, least)) is not None}
                    hashes += own
                    ids += [i] * len(own)
            pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield {"id": ids, "h1": np.ascontiguousarray(pair[:, 0]), "h2": np.ascontiguousarray(pair[:, 1])}

    held = map_arrow(only(docs, id=id, text=text), "id long, h1 long, h2 long", lines)
    # k1, k2: the keys again, as values; the join then deals both its sides anew and Spark can split a hot key.
    shared = (
        held.groupBy("h1", "h2")
        .agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n"), F.max("id").alias("keeper"), F.max("h1").alias("k1"), F.max("h2").alias("k2"))
        .filter(F.col("n") >= documents)
        .select("k1", "k2", "keeper")
    )
    lost = (
        held.join(shared, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("lost_by"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    )

    def assemble(batches):
        for texts, losses in batches:
            out = {"text": [], "n_lines": [], "n_dropped": []}
            for x, lost in zip(texts, losses, strict=True):
                parts = (x or "").encode().split(b"\n")
                kept = parts
                if lost is not None and len(lost):
                    gone = {np.array([r["h1"], r["h2"]], dtype="<i8").tobytes() for r in lost}
                    kept = [p for p in parts if (k := key_of(p, least)) is None or xxhash.xxh3_128_digest(k) not in gone]
                out["text"].append(x if kept is parts else b"\n".join(kept).decode())
                out["n_lines"].append(len(parts))
                out["n_dropped"].append(len(parts) - len(kept))
            yield out

    both = docs.alias("whole").join(lost.alias("found"), q(id).eqNullSafe(F.col("found.lost_by")), "left")
    return _assemble(both, docs, text, assemble)


def _assemble(both: DataFrame, docs: DataFrame, text: str, assemble) -> DataFrame:
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    packed = both.select(F.struct("whole.*").alias("row"), F.col("found.lost").alias("lost"))
    done = with_arrow(packed, "text string, n_lines long, n_dropped long", assemble, F.col("row").getField(text), F.col("lost"))
    return done.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in order], "n_lines", "n_dropped")
