"""The judgement step: prompts, deciders, confidence, packing, outcomes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attriq.config import ERROR, NIL
from attriq.functions.text import estimate_tokens, parse_answer, resolve_answer
from attriq.operators.packing import pack as pack

FATAL = (401, 402, 403)


def verified() -> Column:
    return F.col("coauthor_org_match_count") > 0


def quantified_confidence() -> Column:
    """high, medium or low by the evidence of the predicted candidate."""
    co, org, venue, title = (F.col(c) for c in ("coauthor_count", "org_sim", "venue_sim", "title_sim_max"))
    high = (verified() & (org >= 0.7)) | ((co >= 2) & (org >= 0.7) & (venue >= 0.8)) | ((title >= 0.9) & (org >= 0.8))
    return F.when(F.col("predicted") == NIL, "low").when(high, "high").when((co >= 1) | (venue >= 0.8) | (org >= 0.7), "medium").otherwise("low")


def calibrated_confidence(said: Column) -> Column:
    """The decider's confidence, demoted where the evidence is thinner; the first rule that fires decides."""
    level = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    co, org, venue, s = (F.col(c) for c in ("coauthor_count", "org_sim", "venue_sim", "subtype"))
    by_evidence, high, ver = quantified_confidence(), said == "high", verified()
    p1_cut = F.when(s == "P1-High", 2).otherwise(1)
    narrow = s.isin("P1-High", "P1-Medium")
    comp = s.isin("P1-Strong-Comp", "P1-High-Comp", "P1-Medium-Comp") & ~((co >= 3) & (venue >= 0.9))
    rules = [
        (F.col("predicted") == NIL, said),
        (level(by_evidence) < level(said), by_evidence),
        (high & (org < 0.5) & (co < 2), "medium"),
        (high & (org < 0.5) & (venue < 0.8), "medium"),
        (s.rlike("^P[23]") & ~ver & high, "medium"),
        (s.rlike("^P[23]") & (org < 0.5), "low"),
        (s.startswith("P1-Weak") & ~ver & high, "medium"),
        (s.startswith("P1-Weak") & (org < 0.7), "low"),
        (s.startswith("P1-Weak") & (co == 1) & (org < 0.9), "low"),
        (narrow & (venue < 0.9) & (org < 0.5), "low"),
        (narrow & (venue < 0.9) & (co == 1) & ~ver, "low"),
        (narrow & (co >= p1_cut) & ~ver & (org < 0.7) & (venue < 0.9), "medium"),
        ((s == "P0-Medium") & (org < 0.85), "low"),
        ((s == "P0-Medium") & (venue < 0.8) & (org < 0.8), "low"),
        (comp & ~ver & high, "medium"),
        (comp & (org < 0.5), "low"),
        (comp & (co < 2) & (org < 0.7), "low"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for when, then in rules[1:]:
        out = out.when(when, then)
    return out.otherwise(said)


def rule_decision() -> Column:
    """Whether rules accept the candidate, as the strategies' criteria put it; no language model is asked."""
    co, org, venue, title, strategy = (F.col(c) for c in ("coauthor_count", "org_sim", "venue_sim", "title_sim_max", "strategy"))
    ver = verified()
    p1 = ((co >= 2) & (ver | ((org >= 0.7) & (venue >= 0.8)) | (venue >= 0.9))) | ((co >= 1) & (org >= 0.85) & (venue >= 0.9))
    standard = ver | ((org >= 0.7) & (venue >= 0.8) & (title > 0.8)) | ((title > 0.9) & (org >= 0.7))
    return (
        F.when(strategy == "none", F.lit(False))
        .when(strategy == "auto", F.lit(True))
        .when(strategy == "p0_low", (title >= 0.70) & (org >= 0.85) & (venue >= 0.90))
        .when(strategy == "p0_medium", ((title >= 0.80) & (org >= 0.85) & (venue >= 0.80)) | ((title >= 0.85) & (org >= 0.90)))
        .when(strategy.isin("p1_high", "p1_medium", "p1_comp"), p1)
        .when(strategy == "p1_weak", ((co >= 3) & (venue >= 0.8)) | ((co >= 2) & ver & (org >= 0.7)) | ((co == 1) & ver & (org >= 0.9) & (venue >= 0.8)))
        .when(strategy == "p2_p3", ver | ((co >= 2) & (org >= 0.7) & (venue >= 0.8)))
        .otherwise(standard)
    )


def decide_by_rules(classified: DataFrame, candidates: DataFrame) -> DataFrame:
    """decisions of classified records: the first candidate in rank order that the rules accept, else none."""
    both = classified.select("record_id", "subtype", "strategy").join(candidates, "record_id", "left")
    ok = F.coalesce(rule_decision(), F.lit(False))
    pick = F.min(F.when(ok, F.struct("rank", "aid")))
    return both.groupBy("record_id", "subtype", "strategy").agg(pick.alias("pick"), F.count("aid").cast("int").alias("num_candidates")).select(
        "record_id", "subtype", "strategy", F.coalesce("pick.aid", F.lit(NIL)).alias("predicted"), "num_candidates"
    )


def auto_assign(candidates: DataFrame) -> DataFrame:
    """The top candidate with high confidence, where no judgement is needed."""
    return candidates.filter("rank = 1").select("record_id", F.col("aid").alias("predicted"), F.lit("high").alias("confidence"))


def estimated_tokens(prompted: DataFrame, classified: DataFrame) -> DataFrame:
    """Tokens that judging each record would take: none for those that need no judgement."""
    free = F.col("strategy").isin("none", "auto")
    out = classified.select("record_id", "subtype", "strategy").join(prompted.select("record_id", "tokens"), "record_id", "left")
    return out.withColumn("tokens", F.when(free, 0).otherwise(F.coalesce("tokens", F.lit(0))))


def prompts(candidates: DataFrame, template: str, most: int = 10, width: int = 500) -> DataFrame:
    """One prompt a record: the template with its candidates listed in rank order, the aids in that order, and a token estimate."""
    line = F.format_string("[%d] %s title=%.3f coauthors=%d org=%.2f venue=%.2f", "rank", "aid", "title_sim_max", "coauthor_count", "org_sim", "venue_sim")
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "aid")))
    out = candidates.filter(F.col("rank") <= most).groupBy("record_id").agg(listed.alias("l"))
    text = F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, width * most)
    out = out.select("record_id", F.format_string(template, F.col("record_id"), text).alias("prompt"), F.transform("l", lambda x: x["aid"]).alias("aids"))
    return out.withColumn("tokens", estimate_tokens(F.col("prompt")))


def messages(system: Column, prompt: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def requests(prompted: DataFrame, system: str | None = None, temperature: float | None = None, **extra: object) -> DataFrame:
    """(record_id, request): a bulk service's request for each prompt, with its system prompt or a given one, a temperature if wanted, and extra keys."""
    more = {**({"temperature": temperature} if temperature is not None else {}), **extra}
    said = F.col("system") if system is None else F.lit(system)
    body = F.struct(messages(said, F.col("prompt")).alias("messages"), *[F.lit(v).alias(k) for k, v in more.items()])
    return prompted.select("record_id", F.to_json(F.struct(F.col("record_id").alias("custom_id"), body.alias("body"))).alias("request"))


@dataclass(frozen=True)
class Retry:
    """How often a prompt is asked again, and for how long to wait: doubling after a blank, growing by error_wait after an error (None: an error isn't tried again)."""

    tries: int = 3
    blank_wait: float = 2.0
    error_wait: float | None = None


#: Judgement by coauthors leaves errors to its client; the one without waits longer each time.
CO_RETRY, NOCO_RETRY = Retry(), Retry(error_wait=5.0)

# Kinds of errors and what they are called.
ERROR_KINDS = {
    "timeout": "请求超时", "rate_limit": "API 限流", "connection": "连接错误", "empty_response": "LLM 空响应", "api_error": "API 错误 ({code})",
    "data_error": "数据错误", "runtime_error": "运行时错误", "unknown": "未知错误 ({name})",
}


class EmptyAnswer(RuntimeError):
    """A blank answer of a service."""


def error_kind(e: Exception) -> tuple[str, str]:
    """The kind of an error and what it is called; errors of a service tell their status_code."""
    code = getattr(e, "status_code", None)
    if isinstance(e, TimeoutError):
        kind = "timeout"
    elif code == 429:
        kind = "rate_limit"
    elif isinstance(e, ConnectionError):
        kind = "connection"
    elif isinstance(e, EmptyAnswer):
        kind = "empty_response"
    elif code is not None:
        kind = "api_error"
    elif isinstance(e, ValueError):
        kind = "data_error"
    else:
        kind = "runtime_error" if isinstance(e, RuntimeError) else "unknown"
    return kind, ERROR_KINDS[kind].format(code=code, name=type(e).__name__)


ANSWER = "record_id string, status string, content string, kind string, in_tokens long, out_tokens long"


def asked(f: pd.DataFrame, client: Callable[[list[tuple[str, str]]], list], retry: Retry, sleep: Callable[[float], None]) -> list[tuple]:
    """The rows of call for a frame of (record_id, system, prompt)."""
    todo = {r: (s, p) for r, s, p in zip(f["record_id"], f["system"], f["prompt"], strict=True)}
    done: dict[str, tuple] = {}
    for k in range(retry.tries):
        left = [r for r in todo if r not in done]
        if not left:
            break
        try:
            got = client([todo[r] for r in left])
        except Exception as e:
            if getattr(e, "status_code", None) in FATAL:
                raise
            if retry.error_wait is not None and k + 1 < retry.tries:
                sleep(retry.error_wait * (k + 1))
                continue
            kind, what = error_kind(e)
            done |= {r: (ERROR, f"[{r}] {what}: {str(e)[:100]}", kind, 0, 0) for r in left}
            break
        for r, x in zip(left, got, strict=True):
            text, *used = x if isinstance(x, tuple) else (x, 0, 0)
            if text and text.strip():
                done[r] = ("ok", text, None, *used)
        if len(done) < len(todo) and k + 1 < retry.tries:
            sleep(retry.blank_wait ** (k + 1))
    return [(r, *done.get(r, ("unfinished", "", "empty_response", 0, 0))) for r in f["record_id"]]


def call(prompted: DataFrame, client: Callable[[list[tuple[str, str]]], list], retry: Retry = CO_RETRY, tasks: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(record_id, status, content, kind, in_tokens, out_tokens) of each prompt, by a client called in batches; at most `tasks` calls run at once.

    prompted(record_id, prompt[, system]). The client takes (system, prompt) pairs and returns texts, or
    (text, tokens in, tokens out). A status is ok, unfinished (blank after all tries) or error, with its kind
    and what it says in content; an error without access or money fails the job. Blank answers and, if retry
    says so, errors are asked again after a wait. Write the result to a table before using it twice: each use
    calls again.
    """
    system = F.coalesce(F.col("system"), F.lit("")) if "system" in prompted.columns else F.lit("")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(asked(f, client, retry, sleep), columns=["record_id", "status", "content", "kind", "in_tokens", "out_tokens"])

    return prompted.select("record_id", system.alias("system"), "prompt").repartition(tasks).mapInPandas(run, ANSWER)


def by_place(answer: Column, aids: Column) -> Column:
    """An answer that is none of the aids but the number of a place among them names the aid there."""
    return F.when(F.array_contains(aids, answer), answer).otherwise(resolve_answer(answer, aids))


def read_answers(answers: DataFrame, by_number: bool = False) -> DataFrame:
    """answers(record_id, content, aids) parsed: predicted, confidence, reasoning; by_number reads numbers as places of aids."""
    out = answers.withColumn("a", parse_answer(F.col("content")))
    said = by_place(F.col("a.answer"), F.col("aids")) if by_number else F.col("a.answer")
    return out.select("record_id", said.alias("predicted"), "a.confidence", "a.reasoning")


def cases(answers: DataFrame, asked: DataFrame, truth: DataFrame, by_number: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """(case_id, gt, pred, match, status, raw, in_tokens, out_tokens): outcomes of a judgement run.

    answers: see call; asked(record_id, aids). An answer that came is parsed: status ok, or parse_fail where
    it says nothing; else UNFINISHED. by_number reads numbers as places of aids, but not those that are the
    id of one of candidates(record_id, aid), listed or not.
    """
    out = answers.join(asked.select("record_id", "aids"), "record_id").join(truth.select("record_id", F.col("aid").alias("gt")), "record_id", "left")
    said = parse_answer(F.col("content"))["answer"]
    if by_number and candidates is not None:
        out = out.withColumn("said", said)
        own = candidates.select("record_id", F.col("aid").alias("said"), F.lit(True).alias("own")).distinct()
        out = out.join(own, ["record_id", "said"], "left")
        said = F.when(F.col("own"), F.col("said")).otherwise(by_place(F.col("said"), F.col("aids")))
    elif by_number:
        said = by_place(said, F.col("aids"))
    came = F.col("status") == "ok"
    pred = F.when(came, F.coalesce(F.nullif(said, F.lit("")), F.lit("PARSE_FAIL"))).otherwise("UNFINISHED")
    out = out.withColumns({"pred": pred, "gt": F.coalesce("gt", F.lit(NIL))})
    status = F.when(~came, "unfinished").when(F.col("pred") == "PARSE_FAIL", "parse_fail").otherwise("ok")
    return out.select(
        F.col("record_id").alias("case_id"), "gt", "pred", (F.lower("pred") == F.lower("gt")).alias("match"), status.alias("status"), F.substring("content", 1, 200).alias("raw"), "in_tokens", "out_tokens",
    )


def unfinished_cases(wanted: DataFrame, stored: DataFrame, only_ok: bool = True) -> DataFrame:
    """The cases of wanted(record_id) that a run must still judge: those stored don't count unless they are ok (or at all, if not only_ok)."""
    kept = stored.filter("status = 'ok'") if only_ok else stored
    return wanted.join(kept.select(F.col("case_id").alias("record_id")), "record_id", "left_anti")


# What decisions without judgement say.
NO_CANDIDATES, ASSIGNED = "无候选作者", "自动分配: title_sim=%.2f, coauthor=%d, 机构验证=%s"


def result_rows(classified: DataFrame, candidates: DataFrame, stats: DataFrame, answers: DataFrame, prompted: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows of a decision run, in the columns and order of schemas.DECISION.

    Records without candidates are none and strong ones get their top candidate, both without judgement;
    others get what answers (see call) say, with calibrated confidence. An error becomes a row of its own
    kind with no numbers; a record whose answer is missing has none. The evidence for calibration is
    that of the candidate with the first coauthor match.
    """
    top = candidates.filter("rank = 1").select("record_id", F.col("aid").alias("top_aid"), F.col("title_sim_max").alias("t"), F.col("coauthor_count").alias("c"), F.col("coauthor_org_match_count").alias("m"))
    best = top.select("record_id", F.col("top_aid").alias("aid")).join(stats, ["record_id", "aid"], "left").drop("aid", "coauthor_org_match_count")
    said = read_answers(answers.join(prompted.select("record_id", "aids"), "record_id")).withColumnRenamed("confidence", "said")
    out = classified.select("record_id", "subtype", "strategy", "num_candidates", F.coalesce("hit.coauthor_count", F.lit(0)).alias("coauthor_count"), F.coalesce("hit.coauthor_org_match_count", F.lit(0)).alias("coauthor_org_match_count"))
    out = out.join(top, "record_id", "left").join(best, "record_id", "left").join(said, "record_id", "left")
    out = out.join(answers.select("record_id", "status", "content", "kind"), "record_id", "left").join(prompted.select("record_id", "tokens"), "record_id", "left")
    out = out.join(truth.select("record_id", F.col("aid").alias("gt")), "record_id", "left")
    none, auto = F.col("strategy") == "none", F.col("strategy") == "auto"
    out = out.filter(none | auto | F.col("status").isNotNull())
    bad = ~none & ~auto & (F.coalesce("status", F.lit("")) != "ok")
    evidence = {"org_sim": F.coalesce("max_org_sim", F.lit(0.0)), "venue_sim": F.coalesce("max_venue_sim", F.lit(0.0)), "title_sim_max": F.coalesce("max_title_sim", F.lit(0.0))}
    out = out.withColumns(evidence)
    level = F.when(none | auto, "high").when(bad, ERROR).otherwise(calibrated_confidence(F.col("said")))
    told = F.format_string(ASSIGNED, "t", "c", F.when(F.col("m") > 0, "True").otherwise("False"))
    why = F.when(none, NO_CANDIDATES).when(auto, told).when(bad, F.concat(F.lit("["), F.coalesce("kind", F.lit("unknown")), F.lit("] "), F.coalesce("content", F.lit("")))).otherwise(F.col("reasoning"))
    zero = lambda c: F.when(none | bad, 0).otherwise(F.coalesce(c, F.lit(0)))
    who = F.when(none, NIL).when(auto, F.col("top_aid")).when(bad, ERROR).otherwise(F.coalesce("predicted", F.lit(NIL)))
    return out.select(
        "record_id", who.alias("predicted"), level.alias("confidence"), why.alias("reasoning"), F.coalesce("gt", F.lit(NIL)).alias("truth"), F.when(none, 0).otherwise(F.col("num_candidates")).cast("int").alias("num_candidates"), "subtype",
        F.when(bad, ERROR).otherwise(F.col("strategy")).alias("strategy"), zero("max_title_sim").cast("double").alias("top1_title_sim"), zero("total_coauthor_count").cast("int").alias("top1_coauthor_count"),
        zero("max_org_sim").cast("double").alias("top1_org_sim"), zero("max_venue_sim").cast("double").alias("top1_venue_sim"), F.when(none | auto | bad, 0).otherwise(F.coalesce("tokens", F.lit(0))).cast("int").alias("estimated_prompt_tokens"),
    )
