import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriq.llm import decontaminate
from attriq.llm.decontaminate import Benchmark, find_passages, myers, word_hashes
from attriq.llm.queries import QUERIES


def ends(pattern, text, anchored=False):
    """Edit distances by the plain table."""
    col = list(range(len(pattern) + 1))
    out = []
    for j, c in enumerate(text, 1):
        new = [j if anchored else 0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (p != c)))
        col = new
        out.append(col[-1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90), st.booleans())
def test_myers(p, t, anchored):
    assert myers(p, t, anchored) == ends(p, t, anchored)


def tokens(x):
    return [w.lower() for w in re.findall(r"\w+", x or "")]


def brute(docs, items, errors=0.2, least=5):
    out = {}
    for d, (_, x) in enumerate(docs):
        for i, y in items:
            p, t = tokens(y), tokens(x)
            if p and t:
                best = min(ends(p, t))
                if best <= (int(errors * len(p)) if len(p) >= least else 0) and best < out.get((d, i), 1 << 30):
                    out[d, i] = best
    return out


def passages(rnd, n):
    words = ["w%d" % i for i in range(30)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 9, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(n):
        body = rnd.choices(words, k=rnd.randint(0, 40))
        for _, y in rnd.sample(items, 2):
            p = y.split()
            for _ in range(rnd.randint(0, len(p) // 3)):
                k = rnd.randrange(len(p) + 1)
                p[k : k + rnd.randint(0, 1)] = rnd.choices(words, k=rnd.randint(0, 1))
            body[rnd.randint(0, len(body)) : 0] = p
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(body)))
    return docs, items


def test_against_tables():
    rnd = random.Random(5)
    for _ in range(15):
        docs, items = passages(rnd, 12)
        own = Benchmark(items, 0.2, 5)
        got = {(d, m[0]): m[2] for d, (_, x) in enumerate(docs) for m in own.search(word_hashes(x))}
        assert got == brute(docs, items)


@pytest.mark.parametrize("size", [32 << 20, 200])
def test_operator(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    docs, items = passages(random.Random(9), 20)
    docs += [(100, None), (101, ""), (None, items[4][1]), (102, "x " * 60_000 + items[5][1].upper()), (102, "x " * 60_000 + items[5][1].upper())]
    items += [(50, None), (51, " .,"), (4, "other text that shares an id")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    out = find_passages(df, bench).collect()
    want = brute(docs, [i for i in items if i[1]])
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in out if r["doc_id"] != 102), key=str) == sorted(((docs[d][0], i, n) for (d, i), n in want.items() if docs[d][0] != 102), key=str)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            part = tokens(docs[r["doc_id"]][1][r["start"] : r["end"]])
            assert any(ends(tokens(y), part, True)[-1:] == [r["distance"]] for i, y in items if i == r["item_id"] and y)
    assert find_passages(df, bench.limit(0)).count() == 0 == find_passages(df.limit(0), bench).count()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:60]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op4_decontamination"](spark, sf).collect()}
    short = [(d, x) for d, x in docs if len(x) < 2000]
    want = {(short[d][0], i): n for (d, i), n in brute(short, items).items()}
    ids = {d for d, _ in short}
    assert {k: v for k, v in got.items() if k[0] in ids} == want and got
