import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attriq.llm.token_counts import PrefixCounter, count_tokens, longest_within

PATH = P.path("byte_bpe_50k.json")
OWN, LIB = PrefixCounter(PATH), Tokenizer.from_file(PATH)
PARTS = st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "'s", "'ll", "'re", "''", "a", "the", " the", "Ångström", "12", "!!", "<|endoftext|>", "<|endo", "é", "日本", "🙂", "́", "ſ", "x" * 9, "\x1c", "\u0085"])
TEXTS = st.one_of(st.text(max_size=30), st.lists(PARTS, max_size=12).map("".join))


def number(x: str) -> int:
    return len(LIB.encode(x, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_every_prefix(x):
    assert OWN.count(x) == number(x)
    assert list(OWN.table(x)) == [number(x[:i]) for i in range(len(x) + 1)]


def test_budget():
    x = "The quick brown fox, jumping over 12 lazy dogs.\n" * 5
    t = OWN.table(x)
    for n in (0, 1, 7, 30, 10_000):
        assert longest_within(t, n) == max(i for i in range(len(x) + 1) if number(x[:i]) <= n)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 12))
def test_longest_prefix(x, budget):
    assert OWN.within(x, OWN.count(x), budget) == max(i for i in range(len(x) + 1) if number(x[:i]) <= budget)


def test_pairs_by_undone_merges():
    """Which tokens stay apart side by side, against the encoding itself; no text is encoded for it."""
    rnd = random.Random(3)
    tokens = sorted(OWN.vocab, key=lambda t: OWN.parts.get(t, (-1,))[0])[256:]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)]
    pairs += [(t[:k], t[k:]) for t in rnd.sample(tokens, 2000) for k in range(1, len(t)) if t[:k] in OWN.vocab and t[k:] in OWN.vocab]
    pairs += [(t, t) for t in rnd.sample(tokens, 500)]
    encoding = [OWN._merge(a + b) == [a, b] for a, b in pairs]
    assert 0.05 < sum(encoding) / len(encoding) < 0.95
    own = PrefixCounter(PATH)
    own._merge = None
    assert [own._pair(own.vocab[a] << 32 | own.vocab[b]) for a, b in pairs] == encoding


def test_longest_prefix_reads_one_table_of_a_unit():
    x = "Ångström the quick, 12 lazy\n dogs'll 日本語 run \nfast. " * 300
    own, seen = PrefixCounter(PATH), []
    table = own.table
    own.table = lambda part: seen.append(len(part)) or table(part)
    for budget in (0, 1, 17, 512, 1999):
        assert own.within(x, own.count(x), budget) == longest_within(table(x), budget)
    assert max(seen) < 30


def test_shared_prefixes():
    """A prefix that words of a batch share goes through the table once, and the counts are the library's."""
    own, texts = PrefixCounter(PATH), [" ".join(f"overwhelming{a}{b}ly" for b in "abcdefgh") + f" été{a} 日本{a}" for a in "abcdefgh"] + ["", " ", "a\n b", "x" * 300]
    steps, extend = [], own._extend
    own._extend = lambda piece, last, count: steps.append(len(piece) + 1 - len(count)) or extend(piece, last, count)
    own.learn(texts)
    assert sum(steps) < 0.4 * sum(len(p.encode()) for p in own.pieces)
    assert [own.count(x) for x in texts] == list(map(number, texts))


def test_words_outlive_a_full_cache():
    """When the kept words are too many, those still in use are taken over and not counted again."""
    own, seen = PrefixCounter(PATH, cache=60), []
    extend = own._extend
    own._extend = lambda piece, last, count: seen.append(piece) or extend(piece, last, count)
    often = [f"often{a}{b}" for a in "abcdef" for b in "ghijk"]
    for k in range(6):
        texts = [" " + " ".join(often + [f"once{k}{a}{b}" for a in "lmnop" for b in "qrs"])]
        own.learn(texts)
        assert [own.count(x) for x in texts] == list(map(number, texts))
    assert len(seen) == len(set(seen)) and len(own.units) <= 60 and len(own.old_units) <= 60


def test_operator(spark):
    rows = [(1, "hello world", 5), (None, None, 6), (3, "", 7), (3, "", 7), (4, "ab " * 40_000, 8), (5, "z" * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = {r["doc_id"]: r for r in count_tokens(df, PATH, keep_table=True).collect()}
    assert out[1]["n_tokens"] == 2 and out[None]["n_tokens"] == 0 and out[4]["n_tokens"] == number("ab " * 40_000)
    assert out[5]["n_tokens"] == number("z" * 50_000) and out[5]["over_limit"] and out[1]["n_bytes"] == 11
    assert out[1]["prefix_tokens"][-1] == 2 and len(out[5]["prefix_tokens"]) == 50_001
    assert count_tokens(df.limit(0), PATH).count() == 0 and count_tokens(df, PATH).count() == 6


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    from attriq.llm.queries import QUERIES

    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(out) == len(texts) and all(r["n_tokens"] == number(texts[r["doc_id"]]) for r in out)
    for r in out:
        x, n = texts[r["doc_id"]], r["fit_chars"]
        assert number(x[:n]) <= 512 and (n == len(x) or all(number(x[:k]) > 512 for k in range(n + 1, min(len(x), n + 4) + 1)))
