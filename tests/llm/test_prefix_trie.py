import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from attriq.llm import prefix_trie
from attriq.llm.common import table
from attriq.llm.prefix_trie import lend_starts, number_turns, prefix_nodes, turn_texts
from attriq.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        path = ()
        members[path].append(c)
        for t in convs[c]:
            children[path].add(path + (t,))
            path += (t,)
            members[path].append(c)
        ends[path].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    return [
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p in members
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def trie_of(spark, rows, schema="conv_id long, turn long, role string, text string, pos int, `LEN` string"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(5)
    turns = number_turns(df)
    convs = turns.groupBy("conv").count().withColumnRenamed("count", "n")
    return prefix_nodes(lend_starts(turns, convs), convs)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(QUERIES["op12_prefix_trie"](spark, sf))
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got == sorted(brute(rebuilt(rows)), key=str)
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op12_prefix_trie"])
    at = [[x[0] for x in found.description].index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("convs,turns", [(4096, 65_536), (3, 40), (2, 2)])
def test_shared_starts_and_odd_rows(spark, monkeypatch, convs, turns):
    # The patched limits travel with the functions only where they are read in this process, so the shards are tested here too.
    monkeypatch.setattr(prefix_trie, "CONVS", convs)
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rnd = random.Random(convs)
    rows = []
    for c in [*range(-210, 330, 3), 100, 200, 65_535, 65_536, 131_072, 2**62, -(2**63)]:
        for t in range(rnd.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["hi", "ok", "é你", "", None, "x" * 50])))
    rows += [(None, 1, "user", "lost"), (500, 0, "user", "same"), (500, 0, "user", "same"), (500, 0, "user", "a")]
    want = sorted(brute(rebuilt(rows)), key=str)
    assert rows_of(trie_of(spark, rows)) == want


@pytest.mark.parametrize("convs,turns", [(1, 1), (3, 5), (4096, 65_536)])
def test_shards_merge(monkeypatch, convs, turns):
    monkeypatch.setattr(prefix_trie, "CONVS", convs)
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rnd = random.Random(turns)
    given = {c: [(rnd.randrange(2), 0, 3) for _ in range(rnd.choice([0, 1, 4, 12]))] for c in range(80)}
    rows = [x for c in sorted(given) for x in [(c, 0, 0, 0, 0, c, 1), *[(c, i + 1, *t, 0, 0) for i, t in enumerate(given[c])]]]
    n, weight, ends = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in prefix_trie._parts(iter(rows)):
        n[r[0], r[1], r[6]] += r[8]
        weight[r[0], r[1], r[6]] += r[10]
        for e in r[12] or []:
            ends[r[0], r[1], r[6]] += [(e["first"] >> 16 << 16) + int.from_bytes(e["lows"][k : k + 2], "little") for k in range(0, len(e["lows"]), 2)]
    members = defaultdict(list)
    for c, ts in given.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    key = lambda p: len(p)
    assert sorted((k[2], v, weight[k]) for k, v in n.items()) == sorted((key(p), len(m), sum(m)) for p, m in members.items())
    assert sorted(x for v in ends.values() for x in v) == sorted(given) and all(v == sorted(v) for v in ends.values())


def test_many_turns_and_many_copies(spark):
    rows = [(7, t, "user", f"t{t % 5}") for t in range(70_000)] + [(c, 0, "user", "t0") for c in range(1000, 6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = number_turns(df)
    got = rows_of(prefix_nodes(turns, turns.select("conv").distinct()))
    assert len(got) == 70_001
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    assert max(r[1] for r in got) == 70_000
    node = next(r for r in got if r[1] == 1)
    assert node == (7, 1, 7, 5001, 1, 1, 5000 * 2, hashlib.sha256(",".join(map(str, range(1000, 6000))).encode()).hexdigest())


def test_empty_and_texts(spark):
    assert rows_of(trie_of(spark, [])) == []
    df = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    turns = number_turns(df)
    nodes = prefix_nodes(turns, turns.select("conv").distinct())
    named = nodes.join(turn_texts(df), ["ta", "tb"], "left")
    assert sorted((r["depth"], r["role"], r["text"]) for r in named.filter("depth > 0").collect()) == [(1, "user", "hi"), (2, "", "")]
