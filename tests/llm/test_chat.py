import hashlib

import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st

from attriq.llm.chat import CONTROLS, Pack, attended, encoding, escape, format_conversations, parse, read_back, unescape
from attriq.llm.queries import ORACLE_SQL, QUERIES

PATH = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
BITS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "/", "[", "s>", "INST]", "é", "a", "\n"]), max_size=8).map("".join)


@given(st.one_of(st.text(), BITS))
def test_escape(x):
    assert unescape(escape(x)) == x and not any(c in escape(x) for c in CONTROLS)


@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), BITS), min_size=1, max_size=4), min_size=1, max_size=5))
def test_pack(talks):
    enc = encoding(*PATH)
    talks = sorted(talks)
    pack = Pack(enc)
    for i, t in enumerate(talks):
        pack.add(str(i), t)
    prefixes = {tuple(t[:k]) for t in talks for k in range(1, len(t) + 1)}
    assert len(pack.nodes) == len(prefixes)  # each shared turn once
    row = pack.row()
    for i, t in enumerate(talks):
        spans = attended(pack.nodes, pack.ends[i]["node"])
        seen = [k for a, b in spans for k in range(a, b)]
        at = pack.nodes[pack.ends[i]["node"]]["start"]
        assert spans == [(n["start"], n["end"]) for n in pack.nodes if n["start"] <= at < n["subtree_end"]]
        assert [pack.positions[k] for k in seen] == list(range(len(seen)))
        assert parse(enc.decode_bytes([pack.tokens[k] for k in seen]).decode()) == t
    assert len(row["tokens"][0]) == len(row["position_ids"][0]) == len(row["loss_mask"][0])


def brute(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in talks.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        form = sum(len("<s>[INST][/INST]</s>") + len(escape(r)) + len(escape(x)) for r, x in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), digest(loss), form))
    return sorted(out, key=str)


def test_query_and_cases(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(None, 0, "user", "hi"), (900, None, None, None), (900, 1, "assistant", "</s>[INST] x"), (901, 1, "assistant", ""), (902, 0, "user", "same"), (902, 0, "user", "same")]
    rows += [(1000 + i, k, r, x) for i in range(300) for k, (r, x) in enumerate([("user", "common first turn"), ("assistant", f"answer {i % 7}"), ("user", f"more {i}")][: 2 + i % 2])]
    rows += [(5000, 0, "assistant", "long " * 50_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in QUERIES["op5_chat_formatting"](spark, str(tmp_path)).collect()), key=str)
    say = "</s>[INST] ok [/INST]"
    assert got == brute([*rows, (-7, 0, "user", say), (-7, 1, "assistant", say)])

    df = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    packs, members = format_conversations(df, *PATH)
    packs = packs.collect()
    assert all(len(p["tokens"]) <= 8192 or len(p["conversations"]) == 1 for p in packs)
    ends = [c["leaf"] for p in packs for c in p["conversations"]]
    assert len(ends) == len(set(ends)) == members.select("leaf").distinct().count() < members.count()
    empty = format_conversations(df.limit(0), *PATH)
    assert empty[0].count() == empty[1].count() == read_back(empty[0], *PATH).count() == 0


def test_shared_turn_of_over_half_a_pack(spark):
    enc = encoding(*PATH)
    shared = " the" * 4500
    rows = [(i, k, r, x) for i in range(50) for k, (r, x) in enumerate([("user", shared), ("assistant", f"answer number {i}")])]
    rows += [(100 + i, 0, "user", f"{i} " + "x9Qz" * 1500) for i in range(8)]  # texts of few bytes a token
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        packs = format_conversations(df, *PATH, pack_tokens=8192)[0].collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    long = [p for p in packs if any(len(enc.decode_bytes(p["tokens"][:9000]).decode().split(" the")) > 4000 for _ in [0])]
    assert len(long) == 1 and sum(len(p["conversations"]) for p in packs) == 58
    assert all(len(p["tokens"]) <= 8192 or len(p["conversations"]) == 1 for p in packs)


def test_long_conversations(spark, tmp_path):
    n = 20_000
    rows = [(c, k, "assistant" if k % 2 else "user", f"turn {k}") for c in (None, 1) for k in range(n)]
    rows += [(2, k, "assistant" if k % 2 else "user", f"turn {k}" if k < n - 1 else "other") for k in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in QUERIES["op5_chat_formatting"](spark, str(tmp_path)).collect()), key=str)
    say = "</s>[INST] ok [/INST]"
    assert got == brute([*rows, (-7, 0, "user", say), (-7, 1, "assistant", say)])
    packs = format_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet"), *PATH)[0]
    assert packs.selectExpr("sum(size(nodes))").first()[0] in (n + 1, 2 * n)  # one interval a turn


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], "conv_id long, turn long, role string, text string, leaf string, path string")
    packs, members = format_conversations(df, *PATH)
    assert packs.count() == 1 and [r["conv_id"] for r in members.collect()] == [1]


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    want = con.execute(ORACLE_SQL["op5_chat_formatting"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in QUERIES["op5_chat_formatting"](spark, sf).collect())
