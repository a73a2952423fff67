import random
import re
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from attriq.llm.mixing import mix
from attriq.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, source string, size int, spot string"


def words(x):
    return len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out = {s: Fraction(0) for s in names}
    left, open_ = Fraction(3, 2) * sum(sizes.values()), set(names)
    while left and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / total
        left = Fraction(0)
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA)
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, x, s in rows:
        sizes[s] += words(x)
        largest[s] = max(largest[s], words(x))
    want = brute_targets(sizes)
    for r in out:
        assert r["size"] == words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], want[s])
    again = mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_cases(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(0, 30), rnd.choice(["a", "b", "c", "é", "z", None])) for i in range(300)]
    check(spark, rows + [(None, None, None), (None, "x y", "a"), (1, "x y", "a"), (1, "x y", "a"), (2, "w " * 5000, "b"), (3, "", "empty")])
    check(spark, [(1, None, "a")])
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_equal_rows(spark):
    rnd = random.Random(2)
    others = [(i, "w " * rnd.randint(1, 5000), "b") for i in range(100)]
    check(spark, [(None, "same words " * 500, "b")] * 300 + others + [(1000, "w " * 30_000, "a")])
    check(spark, [(7, "x y z", "b")] * 2500 + [(8, "w " * 100, "a")] * 40)

    rows = [(None, "a b c", "s", {"k": i % 2}) for i in range(40)] + [(1, "w " * 300, "r", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    out = mix(df).collect()
    assert len(out) == 41 and sum(r["more"].get("k", 0) for r in out) == 20
    for s in "rs":
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["", "a", "a b c", "d " * 9]), st.sampled_from(["p", "q", "r", "s", None])), min_size=1, max_size=20))
def test_random(spark, rows):
    check(spark, rows)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    out = QUERIES["op9_mix_sources"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    rows = con.execute("select doc_id, text, source from documents").fetchall()
    got = {r["doc_id"]: r for r in out.collect()}
    sizes = defaultdict(int)
    for _, x, s in rows:
        sizes[s] += words(x)
    want = brute_targets(sizes)
    assert all(abs(got[i]["target"] - want[s]) < 1e-6 and got[i]["size"] == words(x) for i, x, s in rows)
    assert "op9_mix_sources" not in ORACLE_SQL
