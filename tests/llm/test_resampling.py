import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriq.llm.common import table
from attriq.llm.queries import ORACLE_SQL, QUERIES
from attriq.llm.radix import radix_ranks
from attriq.llm.resampling import buckets, resample


def brute_buckets(text, size=10_000):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % size for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, percent=5, least=20):
    raw, aim = Counter(), Counter()
    for _, x in docs:
        raw.update(brute_buckets(x)[0])
    for x in target:
        aim.update(brute_buckets(x)[0])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in raw}
    out = []
    for i, x in docs:
        found, words = brute_buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBz09 .-_é你 \n~")))
def test_buckets(text):
    found, words = buckets(text)
    assert (sorted(found.tolist()), words) == (sorted(brute_buckets(text)[0]), brute_buckets(text)[1])


def test_buckets_of_long_texts():
    text = " ".join(f"w{i % 977} x" for i in range(70_000))
    found, words = buckets(text)
    assert (sorted(found.tolist()), words) == (sorted(brute_buckets(text)[0]), 140_000)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, sf, "benchmark").select("text").collect()]
    got = rows_of(QUERIES["op11_importance_resampling"](spark, sf))
    assert sorted(got) == sorted(brute(docs, target))
    assert sum(r[4] is not None for r in got) >= 5
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as from '{sf}/{name}.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op11_importance_resampling"]).fetchall(), key=str) == sorted(got, key=str)


def test_odd_rows(spark):
    long = " ".join(f"a{i % 50}" for i in range(3000))
    docs = [(i, f"{'one two three ' * 9} {i % 3}") for i in range(60)]
    docs += [(None, long), (None, None), (100, None), (101, ""), (102, "... !!"), (-5, long), (7000000000, long), (3, "x " * 25), (3, "x " * 25), (-(2**63), long), (2**63 - 1, "y " * 30)]
    frame = spark.createDataFrame([(*r, 1, "r", b"f") for r in docs], "doc_id long, text string, `rank` int, score string, features binary").repartition(5)
    got = rows_of(resample(frame, spark.createDataFrame([(None,), ("one two",), ("",)], "text string"), percent=50))
    want = brute(docs, [None, "one two", ""], percent=50)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert rows_of(resample(none, some)) == []
    assert rows_of(resample(some, none.select("text"), percent=100)) == brute([(1, "one two " * 20)], [], percent=100)


@pytest.mark.parametrize("bits", [9, 11])
def test_radix_ranks(spark, bits):
    import random

    rnd = random.Random(bits)
    edge = [None, 0, -1, 2**63 - 1, -(2**63), 5]
    rows = [(rnd.choice([rnd.randrange(-40, 40), rnd.choice(edge)]), rnd.choice([rnd.randrange(3000), rnd.choice(edge)]), k) for k in range(9000)]
    df = spark.createDataFrame(rows, "a long, b long, place long").repartition(7)
    got = sorted(radix_ranks(df, [("a", True), ("b", False)], bits=bits).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    order = lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0)
    assert [order(r) for r in got] == sorted(map(order, rows))
    assert sorted(r["place"] for r in got) == list(range(9000))


def test_radix_ranks_of_equal_or_no_rows(spark):
    df = spark.createDataFrame([(4, "x")] * 300, "a long, b string").repartition(3)
    assert sorted(r["rank"] for r in radix_ranks(df, [("a", False)]).collect()) == list(range(1, 301))
    assert radix_ranks(df.filter("a > 9"), [("a", False)]).collect() == []
