import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from attriq.llm.line_dedup import drop_shared_lines
from attriq.llm.queries import ORACLE_SQL, QUERIES

WHITE = " \t\n\x0b\x0c\r"
UP = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=20, documents=3):
    key = lambda x: x.strip(WHITE).translate(UP)
    held = defaultdict(set)
    low = lambda i: (i is not None, i or 0)
    for i, x in rows:
        for line in (x or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        kept = [v for v in lines if len(held.get(key(v), ())) < documents or max(held[key(v)], key=low) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, H1 string, n_lines int")
    out = drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "H1", "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()), key=str)


A, B = "A common Line of more than twenty", "é" * 20


def test_cases(spark):
    rows = [(1, f"{A}\nx\n  {A.upper()}\t\n{A}"), (2, f"{B}\n{A}\r"), (3, f"\x0b{A}\n{A}"), (3, A), (None, A), (4, None), (5, ""), (6, B), (7, f"{B}\n" * 3), (8, "short\nshort"), (9, "short"), (10, "short"), (11, "y" * 100_000 + "\n" + A), (11, A)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, A), (None, B), (1, A), (2, A)]) == brute([(None, A), (None, B), (1, A), (2, A)])
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.sampled_from([A, A.lower() + " ", B, "", "b" * 19, "c" * 20]), max_size=5).map("\n".join)), max_size=12))
def test_random(spark, rows):
    assert run(spark, rows) == brute(rows) if rows else True


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op1_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op1_line_dedup"](spark, sf).collect())
    assert got == want and any(r[2] for r in got)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((i, n, d, hashlib.sha256(x.encode()).hexdigest()) for i, n, d, x in brute([tuple(r) for r in texts]))
