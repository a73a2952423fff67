"""Passages of a benchmark in documents, up to a budget of word edits."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import map_arrow, only

WORD = re.compile(r"\w+")
#: Words of a piece that are looked up at once; the rest of the piece is compared after a hit.
PROBE = 4
#: Bytes of benchmark text that are searched for in one pass over the documents.
BLOCK_BYTES = 32 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 100_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower().encode(), 4)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall(text or "")
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _ODD + h[k : len(h) - n + 1 + k]
    return out


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distances between the pattern and the best piece of text that ends after each symbol (anchored: that starts at 0)."""
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    top, plus, minus, score, out = 1 << len(pattern) - 1, full, 0, len(pattern), []
    for c in text:
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        out.append(score)
    return out


class Benchmark:
    """Items cut into budget-plus-one pieces: of a passage within the budget, one piece at least is whole."""

    def __init__(self, items: list[tuple], errors: float, least: int):
        self.items = [(i, word_hashes(x)) for i, x in items]
        self.items = [(i, h, int(errors * len(h)) if len(h) >= least else 0) for i, h in self.items if len(h)]
        found: dict[int, tuple[list, list]] = {}
        for k, (_, h, budget) in enumerate(self.items):
            edges = [len(h) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(edges, edges[1:]):
                n = min(PROBE, b - a)
                hashes, places = found.setdefault(n, ([], []))
                hashes.append(_grams(h[a : a + n], n)[0])
                places.append((k, a, b))
        self.probes = {}
        for n, (hashes, places) in found.items():
            order = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
            keys = np.array(hashes, dtype=np.uint64)[order]
            hint = np.zeros(1 << 20, dtype=bool)
            hint[keys >> np.uint64(44)] = True
            self.probes[n] = keys, [places[i] for i in order], hint

    def search(self, h: np.ndarray) -> list[tuple]:
        """(item id, words of the item, distance, first word, word after the last) of each item in a text of these words."""
        near: dict[int, set[int]] = {}
        for n, (keys, places, hint) in self.probes.items():
            if len(h) < n:
                continue
            grams = _grams(h, n)
            at = np.flatnonzero(hint[grams >> np.uint64(44)])
            lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            for p, x, y in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for k, a, b in places[x:y]:
                    if p + b - a <= len(h) and np.array_equal(h[p : p + b - a], self.items[k][1][a:b]):
                        near.setdefault(k, set()).add(p - a)
        out: dict = {}
        for k, starts in near.items():
            name, item, budget = self.items[k]
            pattern, best, order = item.tolist(), None, sorted(starts)
            while order:
                # Starts that lie close together share a window; it reaches the budget further on both sides.
                first = last = order.pop(0)
                while order and order[0] - last <= 2 * budget + 1 and order[0] - first <= 4 * len(item):
                    last = order.pop(0)
                a, b = max(0, first - budget), min(len(h), last + len(item) + budget)
                scores = myers(pattern, window := h[a:b].tolist())
                if scores and min(scores) <= budget and (best is None or min(scores) < best[0]):
                    end = scores.index(min(scores)) + 1
                    back = myers(pattern[::-1], window[:end][::-1], anchored=True)
                    best = min(scores), a + end - 1 - back.index(min(back)), a + end
                    if not best[0]:
                        break
            if best and (name not in out or best[0] < out[name][2]):
                out[name] = (name, len(item), *best)
        return list(out.values())


_made: dict[str, Benchmark] = {}


def find_passages(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = 0.2, least: int = 5) -> DataFrame:
    """One row per document row and benchmark item in it: id, item id, item_words, distance, start, end.

    Texts are compared as runs of \\w+ in lower case. An item of n words, n at least `least`, is found where
    floor(errors * n) word edits or fewer make it a passage of the text; shorter items must be whole, and items
    without words are never found. distance is the least, start and end (code points, end exclusive) are of the
    first passage with it. Null and empty texts hold nothing. A null id is kept as it is; items that share
    an id count as one, by the nearer; repeated document rows each give their rows. No documents or no
    items: no rows. Other columns don't matter.

    The items go to all workers in blocks of BLOCK_BYTES, one pass over the documents each, so that what is
    broadcast doesn't grow with the benchmark. Documents are never moved.
    """
    spark = docs.sparkSession
    items = only(benchmark, i=item, x=item_text).filter("x is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    kind = benchmark.schema[item].dataType.simpleString()
    source = only(docs, id=id, text=text)
    out = None
    for k in range(blocks):
        mine = sorted(items.filter(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == k).collect(), key=str)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine])
        token = f"{id}-{xxhash.xxh64_hexdigest(repr(sent.value).encode())}-{errors}-{least}"

        def run(batches, sent=sent, token=token):
            if token not in _made:
                _made.clear()
                _made[token] = Benchmark(sent.value, errors, least)
            own = _made[token]
            for b in batches:
                rows: dict[str, list] = {c: [] for c in ("id", "item", "item_words", "distance", "start", "end")}
                for i, x in zip(b["id"], b["text"], strict=True):
                    found = own.search(word_hashes(x)) if x and own.items else []
                    if not found:
                        continue
                    spans = [m.span() for m in WORD.finditer(x)]
                    for name, n, distance, first, end in found:
                        for c, v in zip(rows, (i, name, n, distance, spans[first][0], spans[end - 1][1] if end > first else spans[first][0]), strict=True):
                            rows[c].append(v)
                yield rows

        part = map_arrow(source, f"id {docs.schema[id].dataType.simpleString()}, item {kind}, item_words int, distance int, start int, end int", run)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        # An item's rows may lie in several blocks if they share an id.
        nearest = F.min(F.struct("distance", "start", "end", "item_words")).alias("n")
        out = out.groupBy("id", "item").agg(nearest).select("id", "item", "n.item_words", "n.distance", "n.start", "n.end")
    return out.select(F.col("id").alias(id), F.col("item").alias(item), "item_words", "distance", "start", "end")
