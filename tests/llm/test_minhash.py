import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriq.llm import minhash
from attriq.llm.common import table
from attriq.llm.minhash import BANDS, ROWS, Signer, near_duplicates, shingles, signature
from attriq.llm.queries import QUERIES


def brute_set(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, percent=80, size=4):
    """(id, n, component id, kept) of each row, all pairs compared."""
    sets = [brute_set(x, size) for _, x in docs]
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    holding = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holding[x].append(k)
    common = defaultdict(int)
    for ks in holding.values():
        for i, b in enumerate(ks):
            for a in ks[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(docs)]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \n\té\x1c\xa0")))
def test_sets(text):
    assert len(shingles(text, 4)) == len(brute_set(text))


def test_signatures_estimate():
    signer, rnd = Signer(BANDS, ROWS), np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = rnd.integers(0, 2**64, 3000, dtype=np.uint64)
        cut = int(3000 * (1 - share) / 2)
        a, b = signer.minima(pool[cut:]), signer.minima(pool[: 3000 - cut])
        same = np.mean(a == b)
        assert abs(same - share) < 0.13
        nibbles = lambda m: np.unpackbits(signature(m).view(np.uint8)).reshape(-1, 4)
        assert abs((nibbles(a) == nibbles(b)).all(axis=1).mean() - (share + (1 - share) / 16)) < 0.13
        assert ((signer.bands(a) == signer.bands(b)) == (a == b).reshape(BANDS, ROWS).all(axis=1)).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_minhash"](spark, sf))
    assert got == sorted(brute(docs), key=str)
    assert any(not r[3] for r in got)


def edited(rnd, words, share):
    return " ".join(f"x{rnd.randrange(10**9)}" if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("crowd", [256, 4])
def test_groups_of_near_copies(spark, monkeypatch, crowd):
    """Chains of edits, texts around the threshold and pages of one template; a low CROWD sends them through the finer bands."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rnd = random.Random(5)
    docs, word = [], lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(300)]
    for _ in range(150):
        docs.append(edited(rnd, base, rnd.choice([0.005, 0.02, 0.03, 0.06])))
    for _ in range(60):
        base = base[:]
        base[rnd.randrange(300)] = word()
        docs.append(" ".join(base))
    page = [word() for _ in range(200)]
    docs += [" ".join(page + [word() for _ in range(50)]) for _ in range(120)]
    docs += [" ".join(word() for _ in range(rnd.randrange(1, 40))) for _ in range(100)]
    docs += [d for d in docs[:30]] + ["One two THREE", "one two three", "one two three four", "one", ""]
    rows = [(rnd.randrange(10**9), x) for x in docs]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    long = " ".join(f"a{i % 7000}" for i in range(50_000))
    rows = [(None, "a b c d e f"), (4, "A b C d\te f"), (None, None), (None, ""), (5, None), (5, " \n"), (6, long), (7, long + " end"), (8, "x"), (8, "x"), (8, "y"), (None, "lone words of a text"), (-3, "x")]
    df = spark.createDataFrame([(*r, 1, [2]) for r in rows], "doc_id long, text string, `row` int, bands array<int>").repartition(3)
    assert rows_of(near_duplicates(df)) == sorted(brute(rows), key=str)
    assert rows_of(near_duplicates(df.filter("doc_id > 99"))) == []
    named = spark.createDataFrame([("b", "one two three four five"), ("a", "one two three four five")], "doc_id string, text string")
    assert rows_of(near_duplicates(named)) == [("a", 2, "a", True), ("b", 2, "a", False)]
