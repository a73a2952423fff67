import random
from collections import defaultdict

import pytest

from attriq.operators.packing import pack


def fold(rows, most, most_bytes, envelope=120):
    out, state = {}, {}
    for shard, name, size in sorted(rows, key=lambda r: r[1]):
        chunk, n, total = state.get(shard, (0, 0, envelope))
        if n and (n >= most or total + (size or 0) + 1 > most_bytes):
            chunk, n, total = chunk + 1, 0, envelope
        state[shard] = (chunk, n + 1, total + (size or 0) + 1)
        out[name] = chunk
    return out


@pytest.mark.parametrize("most,most_bytes,block", [(5, 900, 8), (1, 900, 4), (7, 300, 7), (50, 10**9, 64), (3, 0, 16), (20, 2500, 4096)])
def test_against_the_fold(spark, most, most_bytes, block):
    rnd = random.Random(most)
    rows = [(rnd.choice([0, 0, 0, 0, 1, None]), f"{k:05d}", rnd.choice([0, 5, 80, 200, 950, None])) for k in range(700)] + [(9, "one", 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "shard int, record_id string, bytes int, block string").repartition(6)
    out = pack(df, most, most_bytes, block=block)
    assert out.columns == ["shard", "record_id", "bytes", "block", "chunk"]
    assert {r["record_id"]: r["chunk"] for r in out.collect()} == fold(rows, most, most_bytes)


def test_one_long_shard(spark):
    """All rows in one shard, over many blocks; equal rows too."""
    rows = [(0, f"{k // 2:06d}", 300 + k // 2 * 37 % 700) for k in range(30_000)]
    out = pack(spark.createDataFrame(rows, "shard int, record_id string, bytes int").repartition(8), 50, 20_000, block=512)
    got, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r["record_id"], r["chunk"]] += 1
    state = (0, 0, 120)
    for _, name, size in rows:
        chunk, n, total = state
        if n and (n >= 50 or total + size + 1 > 20_000):
            chunk, n, total = chunk + 1, 0, 120
        state = (chunk, n + 1, total + size + 1)
        want[name, chunk] += 1
    assert got == want


def test_no_rows(spark):
    assert pack(spark.createDataFrame([], "shard int, record_id string, bytes int"), 5, 100).collect() == []
