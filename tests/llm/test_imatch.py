import hashlib
import math
import random
import re
from collections import Counter

import regex
import xxhash

from attriq.llm.imatch import compare_edited, fingerprints
from attriq.llm.queries import QUERIES


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, x) in enumerate(order):
        x, y = x or "", order[(k + 1) % len(order)][1] or ""
        half = len(x) // 2
        out.append((i, len(x), hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows):
    got = compare_edited(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edited(rows)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    return got


def test_cases(spark):
    rnd = random.Random(2)
    words = [f"t{k}" for k in range(3000)]
    rows = [(k * k, " ".join(rnd.choices(words, k=rnd.randint(1, 200)))) for k in range(150)]
    rows += [(None, "no id"), (-5, None), (-6, ""), (7, "é日本 x"), (7, "é日本 x"), (10**15, "long " * 60_000 + "t1 t2 t3")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, term int")
    got = check(df, rows)
    same = [r for r in got if r["doc_id"] == 7]
    assert len({r["fingerprint"] for r in same}) == 1
    plain = {(r["doc_id"], r["fingerprint"]) for r in fingerprints(df).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got}
    check(df.limit(1), [tuple(df.first())[:2]])
    assert compare_edited(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op8_imatch_fingerprints"](spark, sf)
    assert not re.search("Python|Pandas|ArrowEval|MapIn", out._jdf.queryExecution().toString())
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edited(rows)
    for least, most, share in ((0, 10**9, 0.9), (200, 1000, 0.9), (1000, 10**9, 0.9)):  # recall by length
        some = [r for r in got if least <= r["n_chars"] < most]
        assert sum(r["near_edited"] > r["near_next"] for r in some) >= share * len(some)
    assert sum(r["near_next"] for r in got) < 0.02 * len(got)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def xx(data, seed=42):
    if isinstance(data, list):
        for x in data:
            seed = xx(x, seed)
        return seed
    if isinstance(data, int):
        data = (data & (2**64 - 1)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - 2**64 if x >> 63 else x


class Brute:
    """Signatures and likeness by plain loops."""

    def __init__(self, texts, high, low=0.0):
        self.df = Counter(s for x in texts for s in (t >> 44 for t in self.terms(x)))
        self.inside = lambda s: low * len(texts) <= self.df[s] <= max(high * len(texts), 1)

    def terms(self, text):
        return list(dict.fromkeys(xx(t.encode()) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t))

    def sign(self, text):
        every = sorted(self.terms(text), key=signed)
        band, rest = [[t for t in every if self.inside(t >> 44) == kind] for kind in (True, False)]
        octave = max(1, math.floor(math.log2(max(len(band) + len(rest) / 8, 1) / 0.81) + 0.5))
        hashes = []
        for bits in (octave - 1, octave, octave + 1):
            for j in range(12):
                f, cell = divmod(j, min(2**bits, 16))
                place = lambda t: xx((bits * 16 + f).to_bytes(4, "little"), xx(t))  # noqa: E731, B023
                own = [t for t in band if place(t) % 2**bits == cell] + [t for t in rest if place(t) % 2**bits == cell and (place(t) >> 40) % 8 == 0]
                hashes.append(f"{xx(own) >> 32:x}" if own else "")
        return octave, f"{xx(every) >> 32:x}", hashes

    @staticmethod
    def like(a, b):
        if a[1] == b[1]:
            return 1.0
        mine = {(a[0] - 1) * 12 + k: x for k, x in enumerate(a[2])}
        theirs = {(b[0] - 1) * 12 + k: x for k, x in enumerate(b[2])}
        known = [k for k in mine.keys() & theirs.keys() if mine[k] or theirs[k]]
        return sum(mine[k] == theirs[k] for k in known) / len(known) if known else 0.0


def by_brute_force(rows, high, low=0.0):
    own = Brute([x or "" for _, x in rows], high, low)
    order = sorted(rows, reverse=True)
    want = []
    for k, (i, x) in enumerate(order):
        x, y = x or "", order[(k + 1) % len(order)][1] or ""
        half = len(x) // 2
        a, b, c = own.sign(x), own.sign(x[: len(x) - half] + y[:half]), own.sign(y)
        text = lambda s: ":".join([str(s[0]), s[1], *s[2]])
        want.append((i, text(a), text(b), round(own.like(a, b), 9), round(own.like(a, c), 9)))
    return sorted(want)


def collected(df):
    return sorted((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(QUERIES["op8_imatch_fingerprints"](spark, sf)) == by_brute_force(rows, 0.01)


def test_band_of_two_sides(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join(f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(rnd.randint(1, 80)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(compare_edited(df, high=0.2, low=0.02)) == by_brute_force(rows, 0.2, 0.02)


def test_recall_by_share_of_frequent_terms(spark):
    """Texts of 100 terms of which some are rare: an edited text stays nearer than the next one, whatever the share."""
    rnd = random.Random(1)
    common = [f"f{k}" for k in range(500)]
    for percent in (0, 10, 17, 20, 23, 30, 50, 100):
        rows = []
        for k in range(300):
            words = rnd.sample(common, 100 - percent) + [f"r{rnd.randrange(10**6)}" for _ in range(percent)]
            rows.append((k, " ".join(rnd.sample(words, 100))))
        got = compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.9 * len(got), percent


def test_hot_group_of_edited_copies(spark):
    """A third of all rows are copies of one text with one or two other words: they stay alike, though all their terms are frequent."""
    rnd = random.Random(4)
    base = [f"hot{k}" for k in range(60)]
    rows = []
    for k in range(200):
        words = list(base)
        for at in rnd.sample(range(60), 1 + k % 2):
            words[at] = f"edit{rnd.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"w{rnd.randrange(20_000)}" for _ in range(60))) for k in range(400)]
    got = [r for r in compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect() if 0 < r["doc_id"] < 200]
    assert sum(r["near_next"] > 0.3 for r in got) >= 0.95 * len(got)


def test_equal_rows(spark):
    rows = [(5, "one two three four")] * 3 + [(4, "five six seven eight"), (6, "nine ten")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 5)[1:] == [1.0, 1.0]
