"""A quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import io
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import map_arrow, only, q, with_python

#: Hashed n-grams are told apart by so many bits.
BITS = 18
_CACHE = 100_000


class _Known(dict):
    """A cache of a fixed size over a function of a word."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= _CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


def shape(word: bytes) -> bytes:
    """The word with runs of letters and digits cut to one mark for each case, so that other characters stand out."""
    s = word.decode()
    s = re.sub("[0-9]+", "0", re.sub("[^\\W\\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", s))
    return re.sub(r"(.)\1+", r"\1\1", s, flags=re.S)[:12].encode()


_words = _Known(lambda w: xxhash.xxh64_intdigest(w, 1))
_shapes = _Known(lambda w: xxhash.xxh64_intdigest(shape(w), 2))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams: words and their pairs; shapes of words, their pairs and triples.

    A word's shape tells too whether the word repeats the one before it.
    """
    raw = (text or "").encode().split()
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int32)
    words = np.fromiter(map(_words.__getitem__, (w.lower() for w in raw)), dtype=np.uint64, count=n)
    marks = np.fromiter(map(_shapes.__getitem__, raw), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        marks[1:] ^= np.where(words[1:] == words[:-1], _ODD[2], np.uint64(0))
        grams = [words, words[:-1] * _ODD[0] ^ words[1:], marks, marks[:-1] * _ODD[0] ^ marks[1:], (marks[:-2] * _ODD[1] ^ marks[1:-1]) * _ODD[0] ^ marks[2:]]
        every = np.concatenate([g * _ODD[1] + np.uint64(k) for k, g in enumerate(grams)])
    return np.unique((every * _ODD[0] >> np.uint64(64 - BITS)).astype(np.int32))


def _descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """L1-loss support vector machine by dual coordinate descent over rows scaled by r to unit length, with a bias input."""
    w, bias, alpha = np.zeros(len(r), dtype=np.float64), 0.0, np.zeros(len(rows))
    size = np.array([np.sqrt(r[x] @ r[x]) or 1.0 for x in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            v = r[x] / size[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[x] += step * y[i] * v
                bias += step * y[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to probability (Newton steps, smoothed targets)."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(texts: list[str | None], good: np.ndarray, epochs: int = 12, cost: float = 1.0, smooth: float = 1.0) -> bytes:
    """The model as bytes: scaled weights, bias, slope and offset. A fifth of the rows only sets slope and offset.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    rows = [features(x) for x in texts]
    good = np.asarray(good, dtype=bool)
    fold = np.array([xxhash.xxh64_intdigest((x or "").encode(), 5) % 5 == 0 for x in texts], dtype=bool)
    if not good[~fold].any() or good[~fold].all():
        fold[:] = False
    weights, bias, slope, offset = np.zeros(1 << BITS, dtype=np.float32), 0.0, 1.0, float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
    if good.any() and not good.all():
        use = np.flatnonzero(~fold)
        count = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
        for i in use:
            count[int(good[i])][rows[i]] += 1
        r = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        share = good[use].mean()
        costs = cost * np.where(good[use], 0.5 / share, 0.5 / (1 - share))
        w, bias = _descend([rows[i] for i in use], np.where(good[use], 1.0, -1.0), r, costs, epochs)
        weights = np.stack([w, r]).astype(np.float32)
        held = np.flatnonzero(fold) if fold.any() else use
        slope, offset = _platt(np.array([_margin(rows[i], weights, bias) for i in held]), good[held])
    out = io.BytesIO()
    np.savez(out, weights=weights, bias=bias, slope=slope, offset=offset)
    return out.getvalue()


def _margin(x: np.ndarray, weights: np.ndarray, bias: float) -> float:
    if not len(x) or weights.ndim == 1:
        return float(bias)
    v = weights[1][x].astype(np.float64)
    return float(weights[0][x] @ v / (np.sqrt(v @ v) or 1.0) + bias)


class Model:
    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as f:
            self.weights, self.bias, self.slope, self.offset = f["weights"], float(f["bias"]), float(f["slope"]), float(f["offset"])

    def score(self, text: str | None) -> float:
        m = _margin(features(text), self.weights, self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 8000) -> bytes:
    """A model of label from the docs that labels name and train (of the label's id column) admits.

    The fit takes a bounded sample: the `sample` ids with the least hashes, each once, with whole texts;
    that bound holds for the broadcast of the ids, for the task that fits and for the model. Labels that
    are null or name no document are left out; of several labels of an id the largest counts, of several
    texts of an id the least.
    """
    known = labels.filter(train & q(label).isNotNull() & q(id).isNotNull()).groupBy(q(id).alias("id_b")).agg(F.max(q(label).cast("int")).alias("label"))
    ids = known.orderBy(F.xxhash64("id_b", F.lit(3)), "id_b").limit(sample)
    rows = only(docs, id=id, text=text).join(F.broadcast(ids), F.col("id") == F.col("id_b"))
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches):
        texts, good = [], []
        for b in sorted((r for x in batches for r in zip(x["id"], x["text"], x["label"], strict=True)), key=lambda r: r[0]):
            texts.append(b[1])
            good.append(b[2] > 0)
        yield {"model": [fit(texts, np.array(good, dtype=bool))]}

    made = map_arrow(rows.repartition(1), "model binary", run).collect()
    return bytes(made[0]["model"]) if made else fit([], np.zeros(0, dtype=bool))




def score_quality(docs: DataFrame, model: bytes, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (probability of label 1, from the text alone) and predicted (1 if score >= threshold).

    A null text counts as empty; an empty text scores by the bias alone. Whole texts are read. Repeated
    rows stay with equal scores, an empty table gives an empty table, and an input column named score or
    predicted is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, fixed by BITS

    def run(batches):
        own = Model(sent.value)
        for (texts,) in batches:
            scores = list(map(own.score, texts))
            yield {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return with_python(docs, "score double, predicted int", run, q(text))
