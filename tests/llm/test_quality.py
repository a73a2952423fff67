import zlib

import numpy as np
from pyspark.sql import functions as F

from attriq.llm.common import crc_mod
from attriq.llm.quality import Model, _descend, features, fit, learn, score_quality
from attriq.llm.queries import QUERIES


def test_features():
    assert len(features(None)) == len(features(" \t")) == 0
    f = features("The the 12!! word")
    assert (np.diff(f) > 0).all() and (features("The the 12!! word " * 2000)[-1] < 1 << 18)


def test_dual_descent():
    """Against the primal optimum by subgradient search on a tiny problem."""
    rnd = np.random.default_rng(0)
    rows = [np.unique(rnd.integers(0, 6, 3)).astype(np.int32) for _ in range(40)]
    y = np.where(np.array([0 in x for x in rows]), 1.0, -1.0) * np.where(rnd.random(40) < 0.1, -1, 1)
    r = np.array([1.0, -0.5, 0.3, 0.8, -1.0, 0.6])
    w, b = _descend(rows, y, r, np.ones(40), 500)
    x = np.zeros((40, 7))
    for i, k in enumerate(rows):
        x[i, k] = r[k] / np.sqrt((r[k] ** 2).sum())
        x[i, 6] = 1
    primal = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    best = v = np.append(w, b)
    for k in range(20_000):
        v = v - (v - x.T @ (y * (y * (x @ v) < 1))) / (k + 100)
        best = min(best, v, key=primal)
    assert primal(np.append(w, b)) <= primal(best) + 1e-2


def test_cases(spark):
    rows = [(i, "good words here " * (i % 3 + 1) if i % 2 else "BAD!! %%% ###", 1) for i in range(40)]
    rows += [(None, None, 1), (50, "", 1), (51, "w " * 60_000, 1), (51, "good words", 1), (1, "good words here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = learn(docs, labels, F.lit(True))
    out = score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(rows)
    got = out.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all((r["score"] > 0.5) == ("good" in r["text"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    assert learn(docs, labels, F.lit(True)) == learn(docs.repartition(5), labels.repartition(3), F.lit(True))
    none = learn(docs, labels.limit(0), F.lit(True))
    assert Model(none).score("x") == 0.5 and Model(fit(["a"], np.array([True]))).score("") > 0.5
    assert score_quality(docs.limit(0), model).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_classifier"](spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.95 and spark.range(1).select(crc_mod(F.lit(None).cast("long"), 5)).first()[0] == 0


def test_scores_by_brute_force(spark):
    """Log-count ratios by counting, and every score of the query from weights and ratios by plain loops."""
    import math

    import xxhash

    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    use = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5 != 0)
    model = Model(fit([texts[i] for i in use], np.array([labels[i] for i in use])))
    folds = [xxhash.xxh64_intdigest((texts[i] or "").encode(), 5) % 5 == 0 for i in use]
    counts = [[1.0] * (1 << 18), [1.0] * (1 << 18)]
    for i, held in zip(use, folds, strict=True):
        if not held:
            for k in features(texts[i]).tolist():
                counts[labels[i]][k] += 1
    totals = [sum(c) for c in counts]
    ratio = [math.log(counts[1][k] / totals[1]) - math.log(counts[0][k] / totals[0]) for k in range(1 << 18)]
    assert np.allclose(model.weights[1], ratio, atol=1e-5)

    def score(text):
        places = features(text).tolist()
        size = math.sqrt(sum(ratio[k] ** 2 for k in places)) or 1.0
        margin = sum(float(model.weights[0][k]) * ratio[k] / size for k in places) + model.bias
        return 1 / (1 + math.exp(-(model.slope * margin + model.offset)))

    out = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = score(texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-4 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
