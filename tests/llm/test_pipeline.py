import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from attriq.llm import simhash
from attriq.llm.decontaminate import Benchmark, word_hashes
from tests.llm.test_line_dedup import brute as brute_lines


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.lines(spark, docs, sf)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted((i, x) for i, _, _, x in brute_lines(rows))

    own = Benchmark([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.2, 5)
    left = {r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, sf).collect()}
    assert left == {i for i, x in rows if not own.search(word_hashes(x))} and len(left) < len(rows)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.quality(spark, docs, sf)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum((i in kept) == bool(v) for i, v in labels.items()) > 0.95 * len(labels) and len(kept) < docs.count()


def test_nulls_and_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, "s", 0)], docs.schema)
    for part in (docs.limit(0), docs.limit(3).unionByName(odd)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, part, "/root/testdata/sf0.001").collect()


def test_clashing_columns(spark):
    """Columns of the documents that have the names of what stages add stay as they are."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["row", "kept", "keep_id", "lost", "predicted", "score", "id", "component", "found", "set", "first"]
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, sf), stage(spark, more, sf)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.select("doc_id").collect()), name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "text", "copies", "taken"} <= set(out.columns)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def jaccard_groups(texts):
    """Groups of indexes of texts linked at a five-word-shingle Jaccard similarity of 0.8 or more, by brute force."""
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = up[b], up[a]
                up = [new if r == old else r for r in up]
    return up


def test_edited_copies(spark):
    rnd = random.Random(5)
    texts = []
    for k in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            again = list(base)
            for at in rnd.sample(range(len(base)), edits):
                again[at] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(again))
    # A large group of which many pairs are under 0.8, linked in chains.
    base = [f"h{k}" for k in range(120)]
    for k in range(120):
        texts.append(" ".join(x if rnd.random() > 0.012 else f"e{rnd.randrange(10**6)}" for x in base))
    texts += [None, "", "one two", "One  two", "one three"]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = jaccard_groups(texts)
    first = {}
    for k, g in enumerate(groups):
        first.setdefault(g, k)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.copies(spark, docs, None).collect())
    assert kept == sorted(first.values()) and len(kept) < len(texts) - 100


def test_rows_without_own_id(spark):
    sf = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    words = [f"the only text number {k} with words of its own {k * 7} and {k * 11}" for k in range(6)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (3, words[1]), (3, words[2]), (3, words[3]), (3, words[3]), (None, None), (None, "")]
    held = [(None, f"see {passage} there"), (3, f"{passage} too")]
    frame = lambda x: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in x], "doc_id long, text string, lang string, source string, n_chars long")
    read = lambda df: sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)
    want = [(None, words[0]), (3, words[1]), (3, words[2]), (3, words[3]), (None, "")]
    assert read(corpus_pipeline.copies(spark, frame(rows), sf)) == sorted(want, key=str)
    assert read(corpus_pipeline.benchmark(spark, frame(rows + held), sf)) == sorted(((i, t or "") for i, t in rows), key=str)


def test_copies_against_brute_jaccard(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    first = {}
    for (i, _), g in zip(rows, jaccard_groups([x for _, x in rows]), strict=True):
        first.setdefault(g, i)
    again = docs.unionByName(docs.filter("doc_id < 5"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.copies(spark, again, sf).collect()) == sorted(first.values())


def test_copies_by_simhash(spark, monkeypatch):
    """SimHash tables bring the pairs together: where none agrees, edited copies stay; equal sets fall together before."""
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (2, text.replace("w50", "new")), (3, text.upper())]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.copies(spark, docs, None).collect())
    assert kept() == [1]
    monkeypatch.setattr(simhash, "tables_for", lambda n, percent: np.zeros((0, 6), dtype=np.int64))
    assert kept() == [1, 2]


def test_edits_of_one_text_are_not_paired(spark, monkeypatch):
    """Edits of one text that are seldom similar enough to each other: few pairs come to the whole sets, and no group is lost."""
    rnd = random.Random(8)
    base = [f"h{k}" for k in range(140)]
    texts = [" ".join(x if rnd.random() > rnd.choice([0.02, 0.05, 0.07]) else f"e{rnd.randrange(10**6)}" for x in base) for _ in range(400)]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    groups, seen, labelled = jaccard_groups(texts), [], simhash.labelled
    monkeypatch.setattr(simhash, "labelled", lambda made, classes, roots, more, *rest: seen.append(more.count()) or labelled(made, classes, roots, more, *rest))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.copies(spark, docs, None).collect())
    first = {}
    for k, g in enumerate(groups):
        first.setdefault(g, k)
    assert kept == sorted(first.values()) and 1 < len(kept) < len(texts)
    assert seen[0] < 5 * len(texts)


def test_large_group_is_a_family_from_the_start(spark, monkeypatch):
    """What can be near in the first tables joins families, so the forests of all tables don't link a large group once more in each table."""
    rnd = random.Random(9)
    base = [f"h{k}" for k in range(140)]
    texts = [" ".join(x if rnd.random() > rnd.choice([0.02, 0.05, 0.07]) else f"e{rnd.randrange(10**6)}" for x in base) for _ in range(300)]
    texts += [" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(50)]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen, candidates = [], simhash.candidates

    def counted(*args, heads=False):
        pairs = candidates(*args, heads=heads)
        seen.append((heads, pairs.count()))
        return pairs

    monkeypatch.setattr(simhash, "candidates", counted)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.copies(spark, docs, None).collect())
    first = {}
    for k, g in enumerate(jaccard_groups(texts)):
        first.setdefault(g, k)
    assert kept == sorted(first.values()) and 50 < len(kept) < len(texts)
    (heads, met), (others, joined) = seen
    assert heads and not others and 0 < met <= 3 * simhash.FIRST * len(texts) and joined < len(texts)
