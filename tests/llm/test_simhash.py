import random

import numpy as np
import pytest
import xxhash

from attriq.llm import simhash
from attriq.llm.components import components
from attriq.llm.queries import QUERIES
from attriq.llm.simhash import blocks_for, fingerprint, links, masks, near_duplicates, pivots


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits=4):
    """(id, fp) rows to their component ids."""
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def test_prints():
    for x in (None, "", " \t", "A", "é É b", "a b c d", "The quick Brown fox jumps over the lazy dog " * 9, "x\x0by\x85z w v"):
        assert fingerprint(x) == brute_print(x), x


def test_pivots_and_blocks():
    p = pivots(16)
    assert all(int(a ^ b).bit_count() == 32 for i, a in enumerate(p) for b in p[:i])
    assert blocks_for(1000, 4) == 5 and blocks_for(10**9, 4) == 6 and len(masks(6, 4)) == 15
    rnd = random.Random(0)
    for blocks in (5, 6, 7):
        for _ in range(50):
            x, diff = rnd.getrandbits(64), sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(x & m == (x ^ diff) & m for m in masks(blocks, 4))


def near_set(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(20)]
    out = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for x in base for _ in range(n // 20)}
    return sorted(out | {rnd.getrandbits(64) for _ in range(n)} | {0, 2**64 - 1})


@pytest.mark.parametrize("group", [4096, 6])
def test_links(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    prints = near_set(random.Random(group), 120)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in links(df, len(prints) if group > 6 else 10**5).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    root = {x: x for x in prints}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in found:
        root[find(a)] = find(b)
    want = {p: c for p, (_, _, c) in zip(prints, sorted(brute_classes(list(enumerate(prints)))), strict=True)}
    groups = lambda f: sorted(sorted(x for x in prints if f(x) == r) for r in {f(y) for y in prints})
    assert groups(find) == groups(lambda x: want[x])


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(7, 7), (5, -3), (5, -3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark):
    text = "a text of some words that is long enough to be near to its copy " * 6
    rows = [(5, text), (3, text.upper()), (9, text + "more"), (None, text), (7, None), (7, ""), (7, "one"), (2, "one"), (None, "lonely text"), (8, "w " * 50_000), (8, "w " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == brute_classes([(i, brute_print(x)) for i, x in rows])
    assert near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op7_simhash"](spark, sf).collect()), key=str)
    assert got == brute_classes([(i, fingerprint(x)) for i, x in rows])


def test_wide_prints_and_tables():
    """Fingerprints of pairs at 0.8 differ as the angle says, and the tables bring such pairs together."""
    rng = np.random.default_rng(3)
    tables = simhash.tables_for(200_000, 80)
    unpacked = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")
    share, met = [], 0
    for _ in range(300):
        both = rng.integers(0, 2**64, 240, dtype=np.uint64)
        a, b = (unpacked(simhash.wide_print(np.concatenate([both, rng.integers(0, 2**64, 30, dtype=np.uint64)]))) for _ in range(2))
        share.append((a != b).mean())
        met += (a[tables] == b[tables]).all(axis=1).any()
    assert met == 300 and abs(np.mean(share) - simhash.differing(80)) < 0.01


def test_pairs_across_roots():
    rng = np.random.default_rng(4)
    g, root = np.sort(rng.integers(0, 6, 90)), rng.integers(0, 5, 90)
    got = [tuple(sorted((int(p), int(q)))) for a, b in simhash._across(g, np.arange(90), root) for p, q in zip(a, b, strict=True)]
    assert sorted(got) == [(p, q) for p in range(90) for q in range(p + 1, 90) if g[p] == g[q] and root[p] != root[q]]


def test_joined_by_near_pairs():
    """The forest connects roots as all near pairs of a group do, with fewer links than rows."""
    rng = np.random.default_rng(6)
    g, root, node = np.sort(rng.integers(0, 5, 120)), rng.integers(0, 60, 120), rng.permutation(120)
    near = lambda a, b: (node[a] * node[b]) % 11 == 3
    a, b = simhash._joined(g, node, root, near)
    assert len(a) <= 120

    def groups(pairs):
        up = {int(r): int(r) for r in root}
        for x, y in pairs:
            old, new = up[int(x)], up[int(y)]
            up = {k: new if v == old else v for k, v in up.items()}
        return sorted(sorted(k for k in up if up[k] == v) for v in set(up.values()))

    want = [(root[x], root[y]) for x in range(120) for y in range(x) if g[x] == g[y] and near(x, y)]
    assert groups(zip(a, b, strict=True)) == groups(want)
    assert 1 < len(groups(want)) < len(set(root.tolist()))
