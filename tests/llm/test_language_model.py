import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attriq.llm import language_model
from attriq.llm.language_model import _packed, _unpacked, discounts, remove, score_texts, token_hashes, train
from attriq.llm.queries import QUERIES
from attriq.llm.store import Buckets, Columns, local_path


def tokens(x):
    return [*(x or "").encode().lower().split(), None]


class Plain:
    """The model by its formulas, over dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for x in texts:
            t = tokens(x)
            self.words.update(t)
            self.pairs.update(zip(["begin", *t], t))
        self.after, self.before = defaultdict(list), Counter()
        for (a, b), n in self.pairs.items():
            self.after[a].append(n)
            self.before[b] += 1
        of = lambda c: [sum(v == k for v in c.values()) for k in range(1, 5)]
        self.sums, self.spare = {}, None
        self.d1, self.d2 = (0, *discounts(*of(self.before))), (0, *discounts(*of(self.pairs)))

    def single(self, w):
        if not self.pairs:
            return 1 / (len(self.words) + 1)
        d = lambda n: self.d1[min(n, 3)]
        if self.spare is None:
            self.spare = sum(d(n) for n in self.before.values())
        spare = self.spare
        n = self.before.get(w, 0)
        return (n - d(n) + spare / (len(self.words) + 1)) / len(self.pairs)

    def prob(self, a, w):
        if a not in self.after:
            return self.single(w)
        d = lambda n: self.d2[min(n, 3)]
        n = self.pairs.get((a, w), 0)
        if a not in self.sums:
            self.sums[a] = sum(map(d, self.after[a])), sum(self.after[a])
        return (n - d(n) + self.sums[a][0] * self.single(w)) / self.sums[a][1]

    def row(self, x):
        t, total = tokens(x), sum(self.words.values())
        return {
            "n_tokens": len(t), "n_known": sum(w in self.words for w in t), "train_tokens": total,
            "base_score": sum(math.log10((self.words.get(w, 0) + 1) / (total + len(self.words) + 1)) for w in t),
            "score": sum(math.log10(self.prob(a, w)) for a, w in zip(["begin", *t], t)),
        }


class PlainThree(Plain):
    """Order three by its formulas: pairs count by the words before them, but behind begin by how often they occur."""

    def __init__(self, texts):
        super().__init__(texts)
        self.triples, raw = Counter(), self.pairs
        for x in texts:
            t = ["begin", *tokens(x)]
            self.triples.update(zip(t, t[1:], t[2:]))
        self.pairs = Counter({p: n for p, n in raw.items() if p[0] == "begin"})
        self.pairs.update(Counter((v, w) for _, v, w in self.triples))
        self.after, self.contexts = defaultdict(list), defaultdict(list)
        for (a, b), n in self.pairs.items():
            self.after[a].append(n)
        for (u, v, _), n in self.triples.items():
            self.contexts[u, v].append(n)
        of = lambda c: [sum(v == k for v in c.values()) for k in range(1, 5)]
        self.d2, self.d3 = (0, *discounts(*of(self.pairs))), (0, *discounts(*of(self.triples)))

    def prob3(self, u, v, w):
        lower = self.prob(v, w)
        found = self.contexts.get((u, v))
        if not found:
            return lower
        d = lambda n: self.d3[min(n, 3)]
        n = self.triples.get((u, v, w), 0)
        return (n - d(n) + sum(map(d, found)) * lower) / sum(found)

    def row(self, x):
        t = ["begin", *tokens(x)]
        score = math.log10(self.prob("begin", t[1])) + sum(math.log10(self.prob3(*three)) for three in zip(t, t[1:], t[2:]))
        return super().row(x) | {"score": score}


def same(got, want):
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()), (got, want)


@settings(deadline=None)
@given(st.lists(st.text("abc ", max_size=20), min_size=1, max_size=9))
def test_plain_sums_to_one(texts):
    m = Plain(texts)
    for a in ["begin", *m.words, "unseen"]:
        assert sum(m.prob(a, w) for w in m.words) + m.prob(a, "another") == pytest.approx(1)
    m = PlainThree(texts)
    for u, v in [*list(m.contexts)[:20], ("unseen", "unseen")]:
        assert sum(m.prob3(u, v, w) for w in m.words) + m.prob3(u, v, "another") == pytest.approx(1)


def test_model(spark):
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), p=np.arange(26, 0, -1) / 351, size=rnd.integers(0, 30))) for _ in range(80)]
    texts += [None, "", "É é\x0bA a\x85b", "rare", "w " * 60_000, "twice", "twice"]
    df = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(texts)], "doc_id long, text string, score float").repartition(5)
    seen = texts[:70] + texts[80:]
    for shards, order, plain in ((None, 3, PlainThree(seen)), (1, 3, PlainThree(seen)), (13, 3, PlainThree(seen)), (3, 2, Plain(seen))):
        model = train(df.filter("doc_id < 70 or doc_id >= 80"), shards=shards, order=order)
        out = score_texts(df, model).collect()
        assert len(out) == len(texts)
        for r in out:
            same(r, plain.row(r["text"]))
    assert score_texts(df.limit(0), model).count() == 0
    for r in score_texts(df.limit(5), train(df.limit(0))).collect():
        same(r, PlainThree([]).row(r["text"]))
    with pytest.raises(ValueError):
        train(df, order=4)


def test_lost_file(spark):
    df = spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(50)], "doc_id long, text string")
    model = train(df, shards=4)
    assert score_texts(df, model).count() == 50
    folder = local_path(model.triples().uri)
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["0", "1", "2", "3"]
    os.remove(f"{folder}/2")
    language_model._scorers.clear()
    with pytest.raises(Exception, match="No such file"):
        score_texts(df.withColumn("text", F.concat("text", F.lit(" a1"))), model).collect()
    remove(spark, model)
    assert not os.path.exists(os.path.dirname(folder))


def test_word_hashes():
    """Words and only words: as many as split() has, equal ones alike, others apart, whatever is around them and wherever texts are cut."""
    rnd = np.random.default_rng(3)
    words = ["".join(rnd.choice(list("abcdé日"), rnd.integers(1, 9))) for _ in range(40_000)] + ["a", "aa", "aaa", "ab", "ba"]
    text = "".join(w.upper() + str(rnd.choice(list(" \t\n\x0b\x0c\r"))) * int(rnd.integers(1, 3)) for w in words)
    for x in (text * 5, "x" * (1 << 20) + " b", "y" * (3 << 20) + "\tb " + "z" * (2 << 20), " " * (2 << 20) + "a", "", " ", None):
        want = (x or "").encode().lower().split()
        got = token_hashes(x)
        assert len(got) == len(want) + 2
        pairs = set(zip(want, got[1:-1].tolist()))
        assert len(pairs) == len(set(want)) == len({h for _, h in pairs})
    assert token_hashes("A b")[1] == token_hashes("q a")[2] == token_hashes("x" * (1 << 20) + " a")[2]


def test_store(tmp_path):
    rnd = np.random.default_rng(0)
    for n in (0, 1, 40, 100_000):
        s = Buckets(f"file://{tmp_path}/t{n}", ["a", "b"], maps=2)
        keys = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        a, b = rnd.integers(0, 300, len(keys)).astype(np.uint64), np.full(len(keys), 10**12, dtype=np.uint64)
        shard = (keys % np.uint64(7)).astype(np.int64)
        for k in range(7):
            s.write(k, keys[shard == k], [a[shard == k], b[shard == k]])
        asked = np.concatenate([keys, keys + np.uint64(1 << 40)])
        at = np.concatenate([shard, shard])
        order = np.lexsort((asked, at))
        x, y = s.find(at[order], asked[order])
        back = np.argsort(order)[: len(keys)]
        assert (x[back] == a).all() and (y[back] == b).all() and (y > 0).sum() == len(keys)
    with pytest.raises(FileNotFoundError):
        s.find(np.array([9]), np.array([1], dtype=np.uint64))
    c = Columns(f"{tmp_path}/c", [("key", "<u8"), ("n", "<u4")])
    c.write(3, {"key": keys, "n": np.arange(len(keys))})
    assert (c.read(3)["key"] == keys).all() and c.read(3)["n"][-1] == len(keys) - 1
    packed = _unpacked(_packed(keys, keys[::-1], np.arange(len(keys))))
    assert (packed[0] == keys).all() and (packed[1] == keys[::-1]).all() and packed[2][-1] == len(keys) - 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = PlainThree([x for i, x in docs.items() if not held(i)])
    out = QUERIES["op2_lm_scoring"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["held_out"] == held(r["doc_id"])
        same(r, plain.row(docs[r["doc_id"]]))
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])
