"""Outcomes of a judgement run."""

from attriq.operators import decide


def test_a_candidate_that_was_not_listed_is_no_place(spark):
    asked = spark.createDataFrame([("r1", ["20", "30", "40"]), ("r2", ["20", "30", "40"]), ("r3", ["2", "30", "40"])], "record_id string, aids array<string>")
    said = [("r1", "ok", "answer: 2"), ("r2", "ok", "answer: 2"), ("r3", "ok", "answer: 2")]
    answers = spark.createDataFrame([(*s, None, 1, 1) for s in said], "record_id string, status string, content string, kind string, in_tokens long, out_tokens long")
    truth = spark.createDataFrame([("r1", "2"), ("r2", "30"), ("r3", "2")], "record_id string, aid string")
    # r1 has a candidate 2 behind those listed, r2 has none.
    own = [("r1", a) for a in ("20", "30", "40", "2")] + [("r2", a) for a in ("20", "30", "40")] + [("r3", a) for a in ("2", "30", "40")]
    candidates = spark.createDataFrame(own, "record_id string, aid string")
    rows = {r.case_id: (r.pred, r.match) for r in decide.cases(answers, asked, truth, by_number=True, candidates=candidates).collect()}
    assert rows == {"r1": ("2", True), "r2": ("30", True), "r3": ("2", True)}
