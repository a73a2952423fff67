"""Sinks, streams and progress across failures."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from attriq.operators import decide
from attriq.plans import fixtures as fx
from attriq.plans import pipeline, registry
from attriq.plans.progress import Progress, StreamProgress, status_line, table_of
from attriq.sources import sinks
from attriq.streaming import attribution

SF = "/root/testdata/sf0.001"


class Lost(Exception):
    pass


def ids(df):
    return sorted(r["record_id"] for r in df.select("record_id").collect())


def rows(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "record_id string")


def test_a_lost_writer_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert sinks.replace(rows(spark, "a", "b"), path) == 0
    real = sinks._move
    monkeypatch.setattr(sinks, "_move", lambda *_: (_ for _ in ()).throw(Lost()))
    with pytest.raises(Lost):
        sinks.replace(rows(spark, "c"), path)
    assert ids(sinks.current(spark, path)) == ["a", "b"]
    monkeypatch.setattr(sinks, "_move", real)
    sinks.remove_records(spark, path, rows(spark, "a"))
    assert ids(sinks.current(spark, path)) == ["b"] and ids(sinks.current(spark, path, 0)) == ["a", "b"]
    assert sinks.drop_old(spark, path) == 1 and ids(sinks.current(spark, path)) == ["b"]
    assert len(list(tmp_path.glob("t/_data-*"))) == 1
    # Of two writers of one version the second fails and leaves the first one's.
    monkeypatch.setattr(sinks, "_versions", lambda *_: [0])
    with pytest.raises(Exception, match="exists"):
        sinks.replace(rows(spark, "z"), path)
    monkeypatch.undo()
    assert ids(sinks.current(spark, path)) == ["b"]


@pytest.mark.parametrize("lost_at", [0, 1, 2])
def test_a_swap_cut_short(spark, tmp_path, monkeypatch, lost_at):
    path, done, real = str(tmp_path / "t"), [], sinks._move
    sinks.append(rows(spark, "a", "b"), path)

    def move(*args):
        if len(done) == lost_at:
            raise Lost
        done.append(args)
        real(*args)

    monkeypatch.setattr(sinks, "_move", move)
    if lost_at < 2:
        with pytest.raises(Lost):
            sinks.remove_records(spark, path, rows(spark, "a"))
    else:
        sinks.remove_records(spark, path, rows(spark, "a"))
    monkeypatch.setattr(sinks, "_move", real)
    assert ids(sinks.current(spark, path)) == (["a", "b"] if lost_at == 0 else ["b"])
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "vectors")
    made = lambda *r: spark.createDataFrame(list(r), "key string, vec array<double>")
    sinks.upsert_table(spark, path, made(("a", [1.0]), ("b", [2.0])))
    sinks.upsert_table(spark, path, made(("a", None), ("c", [3.0]), ("b", [4.0])))
    assert sorted(map(tuple, sinks.current(spark, path).collect())) == [("b", [4.0]), ("c", [3.0])]


def start(spark, base, sims, sink=None):
    records = fx.records(spark, SF)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return attribution.start(stream, sims, lambda c, _: registry._said(c), fx.scores, f"{base}/out", f"{base}/checkpoint", sink=sink)


def test_attribution_survives_a_restart(spark, tmp_path):
    """The driver is lost after a batch is written and before it is committed; records also come twice."""
    base, sims = str(tmp_path), pipeline.once(fx.pair_sims(spark, SF))
    records = fx.records(spark, SF)
    records.repartition(3, "record_id").write.parquet(f"{base}/in")
    records.limit(5).coalesce(1).write.mode("append").parquet(f"{base}/in")
    real = sinks.append_store(f"{base}/out")

    def lost(df, number):
        real(df, number)
        if number == 1:
            raise Lost

    with pytest.raises(Exception, match="Lost"):
        start(spark, base, sims, lost).awaitTermination()
    seen = []
    spark.streams.addListener(listener := StreamProgress(seen.append))
    start(spark, base, sims).awaitTermination()
    want = sorted(map(str, registry._arbitrated(spark, SF).drop("batch").select("record_id", "original", "predicted", "rule_applied").collect()))
    got = spark.read.parquet(f"{base}/out")
    assert sorted(map(str, got.select("record_id", "original", "predicted", "rule_applied").collect())) == want
    assert {r["batch"] for r in got.select("batch").distinct().collect()} >= {0, 1}
    for _ in range(50):
        if any(e["event"] == "ended" for e in seen):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [e["batch"] for e in seen if e["event"] == "batch"][0] == 1 and all(e.get("error") is None for e in seen)


def test_progress_of_a_run(spark, tmp_path):
    asked = spark.createDataFrame([(f"{k}", "s", f"p{k}") for k in range(40)], "record_id string, system string, prompt string")

    def client(pairs):
        time.sleep(0.4)
        return [("" if p == "p7" else "answer", 2, 1) for _, p in pairs]

    seen, path, save = [], str(tmp_path / "done"), table_of(spark, str(tmp_path / "progress"))

    def told(now):
        seen.append(now)
        save(now)

    left = pipeline.resume(spark, asked, path, lambda b: decide.call(b, client, decide.Retry(tries=1), tasks=8), every=10, on_progress=told)
    assert left == 1
    assert (seen[-1].total, seen[-1].done, seen[-1].success, seen[-1].error, seen[-1].in_tokens) == (40, 40, 39, 1, 78)
    between = [s for s in seen if 0 < s.done < 40]
    assert between and between[0].left > 0 and [s.done for s in seen] == sorted(s.done for s in seen)
    assert spark.read.parquet(str(tmp_path / "progress")).agg(F.max("done")).first()[0] == 40
    assert status_line(seen[-1]).startswith("40/40 done, 39 well, 1 failed, 78+39 tokens")


def test_snapshots_while_tasks_run(spark):
    """One job of slow tasks: another thread sees some rows done before all are."""
    answers = spark.range(32).repartition(32).selectExpr("cast(id AS string) AS record_id", "'ok' AS status", "cast(1 AS long) AS in_tokens", "cast(1 AS long) AS out_tokens")
    progress, seen = Progress(spark, 32), []

    def slow(batches):
        for b in batches:
            time.sleep(0.3 * len(b))
            yield b

    with progress.watch(seen.append, every=0.05):
        work = threading.Thread(target=lambda: progress.counted(answers.mapInPandas(slow, answers.schema)).write.format("noop").mode("overwrite").save())
        work.start()
        work.join()
    assert seen[-1].success == 32 and any(0 < s.done < 32 for s in seen)
