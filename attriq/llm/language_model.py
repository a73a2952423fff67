"""An interpolated modified Kneser-Ney model: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

The order is three by default: a word depends on the two before it. All words, pairs and triples of the
training texts are kept, however rare.

Words are numbered first, frequent ones low, so that triples travel in few bytes. A triple (u, v, w) is
dealt by its middle word, which brings the followers of (u, v) and what comes before (v, w) together; the
triples of frequent middle words are dealt by (v, u) and by (v, w) instead, each for one of these ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import map_arrow, new_path, only, q, remove_path, with_python
from attriq.llm.store import Buckets, Columns

#: Hashes that stand for a text's begin and end; no word hashes to them but by chance (1 in 2**64).
BEGIN, END = (xxhash.xxh64_intdigest(x, 11) for x in (b" begin", b" end"))
#: Training tokens that a task counts before it hands on sums; bytes of text scored at once.
FLUSH, BATCH = 2_000_000, 2_000_000
#: Bytes of input for each shard of the tables, about.
SHARD_BYTES = 8 << 20
#: Words over this share of a shard's tokens are dealt with their neighbours.
HOT = 4
#: Numbers of no word (before the first), of begin, and of the first word; an unknown word has one beyond all.
NONE, START, FIRST, UNKNOWN = 0, 1, 2, 1 << 62
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: A word of the vocabulary: its hash, how often it occurs, and its place among its shard's by frequency.
VOCABULARY = [("key", "<u8"), ("count", "<u8"), ("rank", "<u4")]
#: The same words by place: distinct words before it; followers in all, and those found once, twice, more often.
WORDS = [("before", "<u8"), ("total", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")]
#: How often, or after how many words, a pair occurs; how often a triple occurs; followers of a pair found more than once.
PAIRS, TRIPLES, CONTEXTS = ["count"], ["count"], ["total", "n1", "n2", "n3"]


#: The white space between words, and powers of an odd number and of its inverse, for hashes of all words of a text at once.
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PIECE = 1 << 20
_ODD_BASE = 0x9E6C63D0876A9A47


def _powers(x: int) -> np.ndarray:
    out = np.full(_PIECE + 1, x, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_ODD_BASE), _powers(pow(_ODD_BASE, -1, 1 << 64))


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of at most _PIECE bytes: a polynomial of its bytes, by differences of running sums, then mixed."""
    b = np.frombuffer(raw, dtype=np.uint8)
    gap = np.ones(len(b) + 2, dtype=bool)
    gap[1:-1] = _SPACES[b]
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _INVERSES[start], (end - start).astype(np.uint64))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of begin, the words (split at ASCII white space, A-Z lower-cased) and end."""
    raw = (text or "").encode().lower()
    pieces, at = [np.array([BEGIN], dtype=np.uint64)], 0
    while at < len(raw):
        end = len(raw)
        if end - at > _PIECE:  # cut at white space; a longer word is hashed on its own
            end = max((raw.rfind(bytes([c]), at, at + _PIECE) for c in np.flatnonzero(_SPACES)), default=-1)
            if end <= at:
                ends = [k for c in np.flatnonzero(_SPACES) if (k := raw.find(bytes([c]), at + 1)) >= 0]
                end = min(ends, default=len(raw))
                if end - at > _PIECE:
                    pieces.append(np.array([xxhash.xxh64_intdigest(raw[at:end].strip(), 11)], dtype=np.uint64))
                    at = end
                    continue
        pieces.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate([*pieces, np.array([END], dtype=np.uint64)])


def mixed(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    x = np.full(len(numbers[0]), 0x243F6A8885A308D3, dtype=np.uint64)
    for n in numbers:
        x = (x ^ n) * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(columns: list[np.ndarray], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct rows of the columns, and the values' sums for each."""
    if not len(columns[0]):
        return columns, [v.astype(np.uint64) for v in values]
    # Rows packed in one number each sort faster; a column takes the bits of its largest number or of its places among its distinct ones.
    bits, parts = [int(c.max()).bit_length() for c in columns], list(columns)
    for i in np.argsort(bits)[::-1] if sum(bits) > 64 else []:
        known, parts[i] = np.unique(columns[i], return_inverse=True)
        bits[i] = (len(known) - 1).bit_length()
        if sum(bits) <= 64:
            break
    if sum(bits) <= 64:
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for part, n in zip(parts, bits, strict=True):
            key = (key << np.uint64(n)) | part.astype(np.uint64) if n < 64 else part.astype(np.uint64)
        del parts
        order = np.argsort(key, kind="stable")
        del key
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = _runs(*columns)
    return [c[first] for c in columns], [np.add.reduceat(v[order].astype(np.uint64), first) for v in values]


_squeeze = zstandard.ZstdCompressor(level=1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one byte string: steps of the first, which is sorted; bytes of like weight together, compressed."""
    parts = [np.array([len(arrays)], dtype="<u4").tobytes()]
    for i, x in enumerate(arrays):
        x = np.diff(x.astype(np.uint64), prepend=np.uint64(0)) if i == 0 else x
        kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
        planes = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), kind.itemsize).T
        parts += [np.array([len(x), kind.itemsize], dtype="<u4").tobytes(), np.ascontiguousarray(planes).tobytes()]
    return _squeeze.compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 4
    for i in range(int(np.frombuffer(data, "<u4", 1)[0])):
        n, size = (int(x) for x in np.frombuffer(data, "<u4", 2, at))
        planes = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n).T
        x = np.ascontiguousarray(planes).view(f"<u{size}").reshape(n).astype(np.uint64)
        out.append(np.cumsum(x, dtype=np.uint64) if i == 0 else x)
        at += 8 + n * size
    return out


def _dealt(kind: str, shard: np.ndarray, shards: int, columns: list[np.ndarray], out: dict[str, list]) -> None:
    """Adds the columns to out, a packed row for each shard that has any; their order within a shard stays."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        at = order[edges[s] : edges[s + 1]]
        out["kind"].append(kind)
        out["shard"].append(int(s))
        out["data"].append(_packed(*[c[at] for c in columns]))


def _empty() -> dict[str, list]:
    return {"kind": [], "shard": [], "data": []}


ROW = "kind string, shard int, data binary"


def _flushed(texts: Iterator[list], size: int) -> Iterator[np.ndarray]:
    """Token hashes of the texts, as many at once as make about `size`."""
    held, n = [], 0
    for batch in texts:
        for x in batch:
            held.append(token_hashes(x))
            n += len(held[-1])
            if n >= size:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _range_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards by ranges of the hash, so that sorted keys meet them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count_words(texts: Iterator[list], shards: int) -> Iterator[dict]:
    for every in _flushed(texts, FLUSH):
        key, n = np.unique(every[every != np.uint64(BEGIN)], return_counts=True)
        out = _empty()
        _dealt("word", _range_of(key, shards), shards, [key, n], out)
        yield out


def _collected(batches: Iterator[dict]) -> dict[str, list[np.ndarray]]:
    """The columns of each kind of row of one shard."""
    blobs: dict[str, list] = {}
    for b in batches:
        for kind, data in zip(b["kind"], b["data"], strict=True):
            blobs.setdefault(kind, []).append(_unpacked(data))
    return {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in blobs.items()}


def _of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _store_words(batches: Iterator[dict], store: Columns) -> Iterator[dict]:
    """A shard of the vocabulary, stored."""
    key, n = _collected(batches).get("word", [np.zeros(0, dtype=np.uint64)] * 2)
    (key,), (n,) = _summed([key], n)
    rank = np.empty(len(key), dtype=np.uint32)
    rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(key))
    store.write(TaskContext.get().partitionId(), {"key": key, "count": n, "rank": rank})
    yield {"types": [len(key)], "tokens": [int(n.sum())]}


class Numbers:
    """Words by number: rank * shards + shard, from FIRST on; known words and their counts from the stored vocabulary."""

    def __init__(self, model: Model):
        self.shards, self.store = model.shards, model.vocabulary()
        self.hot = max(1, model.tokens // (HOT * model.shards))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted distinct hashes; unknown ones count 0."""
        number = np.arange(len(words), dtype=np.uint64) + np.uint64(UNKNOWN)
        count = np.zeros(len(words), dtype=np.uint64)
        mine = _range_of(words, self.shards)
        edges = [0, *np.flatnonzero(np.diff(mine)) + 1, len(words)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            t = self.store.read(int(mine[a]))
            if not len(t["key"]):
                continue
            at = np.minimum(np.searchsorted(t["key"], words[a:b]), len(t["key"]) - 1)
            hit = np.flatnonzero(t["key"][at] == words[a:b])
            number[a + hit] = t["rank"][at[hit]].astype(np.uint64) * np.uint64(self.shards) + np.uint64(int(mine[a]) + FIRST)
            count[a + hit] = t["count"][at[hit]]
        number[words == np.uint64(BEGIN)], count[words == np.uint64(BEGIN)] = START, UNKNOWN
        return number, count

    def owners(self, middle: np.ndarray, hot: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The shard of rows about a middle word: its own, or that of it and its neighbour if it is frequent."""
        n = np.uint64(self.shards)
        return (np.where(hot, mixed(middle, other), mixed(middle)) % n).astype(np.int64)


def _grams(number: np.ndarray, hot: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, u) of each token w of texts laid end to end, and whether v is frequent; u is NONE behind begin, or for order two."""
    ends = np.flatnonzero(number[1:] != START) + 1
    v, w = number[ends - 1], number[ends]
    u = np.full(len(ends), NONE, dtype=np.uint64)
    if order > 2:
        inner = v != START
        u[inner] = number[ends[inner] - 2]
    return v, w, u, hot[ends - 1]


def _count_grams(texts: Iterator[list], model: Model) -> Iterator[dict]:
    """Sums of triples, dealt; those of frequent middle words twice, for what follows (u, v) and for what comes before (v, w)."""
    numbers = Numbers(model)
    for every in _flushed(texts, FLUSH):
        words, at = np.unique(every, return_inverse=True)
        number, count = numbers.find(words)
        v, w, u, hot = _grams(number[at], (count > numbers.hot)[at], model.order)
        (v, w, u), (n, hot) = _summed([v, w, u], np.ones(len(v), dtype=np.uint64), hot)
        hot = hot > 0
        out = _empty()
        for kind, rows, other in (("both", ~hot, w), ("context", hot & (u != NONE), u), ("suffix", hot, w)):
            if rows.any():
                own = [x[rows] for x in (v, w, u, n)]
                _dealt(kind, numbers.owners(own[0], hot[rows], other[rows]), model.shards, own, out)
        yield out


def _store_grams(batches: Iterator[dict], model: Model) -> Iterator[dict]:
    """A shard of triples, pairs and contexts, stored; what it knows of each word goes to the word's shard, in the rows it yields."""
    part, shard = _collected(batches), TaskContext.get().partitionId()
    none = [np.zeros(0, dtype=np.uint64)] * 4
    rows = lambda *kinds: [np.concatenate(c) for c in zip(none, *[part[k] for k in kinds if k in part], strict=True)]
    stats = []

    v, w, u, n = rows("both", "context")
    (v, u, w), (n,) = _summed([x[u != NONE] for x in (v, u, w)], n[u != NONE])
    model.triples().write(shard, mixed(v, u, w), [n])
    stats += _of(n)
    first = _runs(v, u) if len(v) else np.zeros(0, dtype=np.int64)
    add = lambda x: np.add.reduceat(x.astype(np.uint64), first) if len(first) else x[:0].astype(np.uint64)
    total, *parts = add(n), add(n == 1), add(n == 2), add(n >= 3)
    more = total > 1  # a context found once has one follower, which needs no row
    model.contexts().write(shard, mixed(v[first][more], u[first][more]), [x[more] for x in (total, *parts)])
    del v, u, w, n, first, total, parts

    v, w, u, n = rows("both", "suffix")
    (v, w, u), (n,) = _summed([v, w, u], n)
    (v, w), (count,) = _summed([v, w], np.where(u == NONE, n, np.uint64(1)))  # distinct words before the pair; how often, behind begin
    model.pairs().write(shard, mixed(v, w), [count])
    stats += _of(count)
    out = _empty()
    (w,), (before,) = _summed([w], np.ones(len(w), dtype=np.uint64))
    _dealt("before", ((w - np.uint64(FIRST)) % np.uint64(model.shards)).astype(np.int64), model.shards, [(w - np.uint64(FIRST)) // np.uint64(model.shards), before], out)
    (v,), after = _summed([v], count, count == 1, count == 2, count >= 3)
    words = v >= FIRST
    _dealt("after", ((v[words] - np.uint64(FIRST)) % np.uint64(model.shards)).astype(np.int64), model.shards, [(v[words] - np.uint64(FIRST)) // np.uint64(model.shards), *[x[words] for x in after]], out)
    begin = [int(x[v == START].sum()) for x in after]
    out["kind"].append("stat")
    out["shard"].append(shard)
    out["data"].append(np.array([*stats, *begin], dtype="<u8").tobytes())
    yield out


def _store_counts(batches: Iterator[dict], model: Model) -> Iterator[dict]:
    """What a shard of words is counted for, stored by place; its sums, and those of a shard of pairs."""
    shard, sums = TaskContext.get().partitionId(), np.zeros(12, dtype=np.int64)
    size = len(model.vocabulary().read(shard)["key"])
    table = {c: np.zeros(size, dtype=np.uint64) for c, _ in WORDS}
    for b in batches:
        for kind, data in zip(b["kind"], b["data"], strict=True):
            if kind == "stat":
                sums += np.frombuffer(data, "<u8").astype(np.int64)
                continue
            at, *values = _unpacked(data)
            for c, x in zip(["before"] if kind == "before" else ["total", "n1", "n2", "n3"], values, strict=True):
                table[c][at.astype(np.int64)] += x
    model.words().write(shard, table)
    found = [int(table["before"].sum()), *_of(table["before"]), int((table["before"] > 2).sum()), *sums.tolist()]
    yield {c: [v] for c, v in zip(STATS, found, strict=True)}


STATS = ["pairs", "w1", "w2", "w3", "w4", "w_more", "t1", "t2", "t3", "t4", "p1", "p2", "p3", "p4", "begin_total", "begin_n1", "begin_n2", "begin_n3"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and over; plain halves where the counts of counts are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    uri: str
    shards: int
    order: int
    tokens: int = 0
    types: int = 0
    stats: dict | None = None

    def vocabulary(self) -> Columns:
        return Columns(f"{self.uri}/vocabulary", VOCABULARY)

    def words(self) -> Columns:
        return Columns(f"{self.uri}/words", WORDS)

    def pairs(self) -> Buckets:
        return Buckets(f"{self.uri}/pairs", PAIRS)

    def triples(self) -> Buckets:
        return Buckets(f"{self.uri}/triples", TRIPLES)

    def contexts(self) -> Buckets:
        return Buckets(f"{self.uri}/contexts", CONTEXTS)


def remove(spark, model: Model) -> None:
    """Removes the model's files; scores that aren't written by then can't be computed any more."""
    remove_path(spark, model.uri)


def train(docs: DataFrame, text: str = "text", shards: int | None = None, order: int = 3) -> Model:
    """A model of order two or three of all texts of docs (null: empty), in files of the shared folder; see remove.

    Tasks add up what they read before they hand it on. Every row goes to the task of its shard, each shard
    is one task's; words that make up over a quarter of a shard's tokens are spread by their neighbours, so
    no word, however frequent, fills a task. Shards grow in number with the input. Each shard's file is
    written even if it has no rows, and a file that is missing later is an error.
    """
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    spark = docs.sparkSession
    if shards is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        size = 0 if size >= 1 << 52 else size  # what Spark says where it doesn't know
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    texts = lambda batches: (b["text"] for b in batches)
    given = only(docs, text=text)
    model = Model(new_path(spark, "lm"), shards, order)
    words = map_arrow(given, ROW, lambda batches: _count_words(texts(batches), shards), rows=256).repartitionById(shards, "shard")
    n = map_arrow(words, "types long, tokens long", lambda batches: _store_words(batches, model.vocabulary()), rows=64).agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    model = Model(model.uri, shards, order, n["tokens"], n["types"])
    grams = map_arrow(given, ROW, lambda batches: _count_grams(texts(batches), model), rows=256).repartitionById(shards, "shard")
    counts = map_arrow(grams, ROW, lambda batches: _store_grams(batches, model), rows=16).repartitionById(shards, "shard")
    stats = map_arrow(counts, ", ".join(f"{c} long" for c in STATS), lambda batches: _store_counts(batches, model), rows=64)
    found = stats.agg(*[F.sum(c).alias(c) for c in STATS]).first()
    return Model(model.uri, shards, order, n["tokens"], n["types"], found.asDict())


class Scorer:
    def __init__(self, model: Model):
        self.model, self.numbers, self.words = model, Numbers(model), model.words()
        self.tables = {"pairs": model.pairs(), "triples": model.triples(), "contexts": model.contexts()}
        s = model.stats
        self.d_word, self.d_pair, self.d_triple = (np.array([0.0, *discounts(*[s[f"{k}{i}"] for i in range(1, 5)])]) for k in "wpt")
        self.spare = float(self.d_word[1:] @ [s["w1"], s["w2"], s["w_more"]])

    def known(self, number: np.ndarray) -> dict[str, np.ndarray]:
        """What words, sorted and distinct, are counted for; 0 for unknown ones."""
        out = {c: np.zeros(len(number)) for c, _ in WORDS}
        for c in ("total", "n1", "n2", "n3"):
            out[c][number == START] = self.model.stats[f"begin_{c}"]
        real = np.flatnonzero((number >= FIRST) & (number < UNKNOWN))
        at, shard = np.divmod(number[real] - np.uint64(FIRST), np.uint64(self.model.shards))
        for s in np.unique(shard):
            mine = shard == s
            t = self.words.read(int(s))
            for c, _ in WORDS:
                out[c][real[mine]] = t[c][at[mine].astype(np.int64)]
        return out

    def lookup(self, table: str, shard: np.ndarray, key: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """The table's columns at the keys of the rows, 0 elsewhere and where a key is absent; each distinct key is looked up once, in order."""
        store = self.tables[table]
        at = np.flatnonzero(rows)
        order = at[np.lexsort((key[at], shard[at]))]
        first = _runs(shard[order], key[order]) if len(order) else order
        once = order[first]
        found = store.find(shard[once], key[once])
        sizes = np.diff(np.append(first, len(order)))
        out = [np.zeros(len(key)) for _ in found]
        for x, y in zip(out, found, strict=True):
            x[order] = np.repeat(y, sizes)
        return out

    def score(self, texts: list) -> dict[str, list]:
        """n_tokens, n_known, base_score and score of each text."""
        every = np.concatenate([token_hashes(x) for x in texts])
        words, at = np.unique(every, return_inverse=True)
        number, count = self.numbers.find(words)
        hot = count > self.numbers.hot
        by_number = np.argsort(number)
        place = np.empty_like(by_number)
        place[by_number] = np.arange(len(number))
        known = {c: x[place] for c, x in self.known(number[by_number]).items()}  # now by word, as number and count are
        ends = np.flatnonzero(every != np.uint64(BEGIN))
        iv, iw = at[ends - 1], at[ends]
        v, w, hot_v = number[iv], number[iw], hot[iv]
        s, m = self.model.stats, self.model
        floor = 1 / (m.types + 1)
        cut = lambda d, x: d[np.minimum(x, 3).astype(np.int64)]
        single = (known["before"] - cut(self.d_word, known["before"]) + self.spare * floor) / s["pairs"] if s["pairs"] else np.full(len(words), floor)
        spare = self.d_pair[1] * known["n1"] + self.d_pair[2] * known["n2"] + self.d_pair[3] * known["n3"]
        base = np.log10((np.where(words == np.uint64(BEGIN), 0, count).astype(float) + 1) / (m.tokens + m.types + 1))
        real = (v < UNKNOWN) & (w < UNKNOWN)
        (pair,) = self.lookup("pairs", self.numbers.owners(v, hot_v, w), mixed(v, w), real)
        total, lower = known["total"][iv], single[iw]
        p = np.where(total > 0, (pair - cut(self.d_pair, pair) + spare[iv] * lower) / np.maximum(total, 1), lower)
        if m.order > 2:
            # The pair before, seen as such, is the context; it has no row if it was found once.
            inner = v != START
            seen = np.zeros(len(v), dtype=bool)
            seen[1:] = inner[1:] & (pair[:-1] > 0)
            u = np.full(len(v), NONE, dtype=np.uint64)
            u[inner] = number[at[ends[inner] - 2]]
            owner = self.numbers.owners(v, hot_v, u)
            total, n1, n2, n3 = self.lookup("contexts", owner, mixed(v, u), seen)
            (triple,) = self.lookup("triples", owner, mixed(v, u, w), seen & (pair > 0))
            once = total == 0
            total, n1 = np.where(once, 1, total), np.where(once, 1, n1)
            gamma = self.d_triple[1] * n1 + self.d_triple[2] * n2 + self.d_triple[3] * n3
            p = np.where(seen, (triple - cut(self.d_triple, triple) + gamma * p) / total, p)
        starts = np.flatnonzero(v == START)
        add = lambda x: np.add.reduceat(x, starts).tolist()
        return {"n_tokens": add(np.ones(len(v), dtype=np.int64)), "n_known": add((count[iw] > 0).astype(np.int64)), "base_score": add(base[iw]), "score": add(np.log10(p))}


_scorers: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    A text's tokens are its words and one end; a null or empty text has the end alone. score is the model's
    log10 probability of the tokens, perplexity 10 ** (-score / n_tokens); base_score is that of add-one
    unigrams. Whole texts are scored. Repeated rows stay with equal scores, an empty table gives an empty
    table, a model of no texts gives every token an even chance; input columns with the outputs' names are
    replaced. Workers map the tables from the shared folder and look up each distinct row of a batch once,
    in order; no worker holds a table.
    """

    def run(batches):
        if model.uri not in _scorers:
            _scorers.clear()
            _scorers[model.uri] = Scorer(model)
        own = _scorers[model.uri]
        for (texts,) in batches:
            out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
            part, size = [], 0
            for k, x in enumerate(texts):
                part.append(x)
                size += len(x or "")
                if size > BATCH or k + 1 == len(texts):
                    for c, v in own.score(part).items():
                        out[c] += v
                    part, size = [], 0
            out["train_tokens"] = [model.tokens] * len(texts)
            out["perplexity"] = [10 ** min(-s / n, 300) for s, n in zip(out["score"], out["n_tokens"], strict=True)]
            yield out

    return with_python(docs, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", run, q(text))
