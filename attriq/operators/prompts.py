"""Texts for the judgement: a record's paper, its candidates with their papers, and the messages around them.

The labels are fixed values of the format. System prompts and instructions are no part of it: they come as
a table (type, text) and as an argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attriq.config import DEFAULT_PROMPT
from attriq.functions.names import AUTHORS, strip
from attriq.functions.text import estimate_tokens
from attriq.operators.ranking import relevance_order
from attriq.operators.subtype import prompt_type

# Labels and line formats of the texts.
NEW_PAPER = "【待消歧论文】"
ABSENT = "N/A"
CANDIDATE = "【作者ID: %s】%s"
HAS_COAUTHORS = "⚠️ 有合作者匹配"
CANDIDATE_LINES = ["论文总数: %d", "主要机构: %s", "合作者匹配: %d (机构验证✓: %d)", "标题相似度: %.2f", "机构相似度: %.2f", "期刊相似度: %.2f"]
ORG_LIKE = "%s (相似度: %.2f%s)"
KEYWORD_COUNT, KEYWORDS_SHARED = "关键词匹配数: %d", "匹配关键词: %s"
SHOWN_PAPERS = "代表性论文（展示前 %d 篇）:"
PAPER_LINES = ["\n  - 论文ID: %s", "    标题: %s (相似度: %.2f)", "    摘要相似度: %.2f", "    作者列表:"]
PAPER_AUTHOR, PAPER_PLACE = "      - %s (%s)", "    发表: %s, %s (相似度: %.2f)"
QUERY_LINES = ["标题: %s", "摘要: %s", "发表: %s, %s"]
QUERY_ORG, QUERY_KEYWORDS, QUERY_AUTHORS, QUERY_AUTHOR = "待消歧作者机构: %s", "关键词: %s", "完整作者列表（标记 * 的为待消歧作者）:", "  %d. %s%s - %s"
HUMAN = "候选作者列表:\n%s\n\n待消歧论文信息:\n%s"
COMPETITION = "【竞争检测信息】\n总候选作者数: %d\nTop1标题相似度: %.3f\nTop2标题相似度: %.3f\n差距: %.3f\n是否存在竞争: %s\n\n"
YES, NO = "是", "否"
LIST_HEAD, LIST_MORE = "候选作者列表（按可能性排序，编号仅用于引用）：", "... 共 %d 个候选"
LIST_LINE = "[%d] aid=%s | title_sim=%.3f | org_sim=%.3f | venue_sim=%.3f | coauthor=%d | org_match=%d"
BRIEF = "候选作者列表:\n%s\n\n待消歧论文信息: （简略信息）"
CO_HEAD, CO_CANDIDATES, CO_TASK = "# 待消歧论文", "\n# 候选作者", "\n# 任务"
CO_LINES = {"title": "标题：%s", "author": "作者：%s", "org": "机构：%s", "year": "年份：%s", "venue": "发表：%s", "keywords": "关键词：%s", "abstract": "\n摘要：%s"}
CO_AUTHORS, CO_AUTHOR, CO_MORE_AUTHORS = "\n完整作者列表（共 %d 人）：", "  %d. %s%s - %s", "  ... (其余 %d 人省略)"
CO_CANDIDATE, CO_MARK = "\n## 候选 [%s] %s%s", " ⚠️有合作者匹配"
CO_STATS = "合作者匹配：%d 篇（机构验证 %d 篇） | title_sim=%.2f org_sim=%.2f venue_sim=%.2f"
CO_NONE, CO_SAMPLES = "  （无可用论文）", "代表性论文（Top-%d）："
CO_PAPER, CO_TAG = "  [%d] %s - %s", "      [co=%d ts=%.2f vs=%.2f os=%.2f yr=%s] score=%.0f"
CO_PLACE, CO_PEOPLE = "      发表：%s", "      合作者：%s"


def _or(c: Column, other: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(other))


def _lines(*parts: Column) -> Column:
    """The parts that aren't null, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def _if(when: Column, text: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), text)


def _authors(paper: Column) -> Column:
    return F.coalesce(paper["authors"], F.array().cast(AUTHORS))


def shortened(text: Column, most: int) -> Column:
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise(""))


def main_org(papers: Column, least: int = 3) -> Column:
    """The most frequent trimmed organisation longer than `least` of all authors of an array of papers; ties go to the first seen, none is N/A."""
    every = F.filter(F.flatten(F.transform(papers, lambda p: F.transform(_authors(p), lambda a: strip(F.coalesce(a["org"], F.lit("")))))), lambda o: F.length(o) > least)
    counted = F.transform(F.array_distinct(every), lambda o, i: F.struct(F.size(F.filter(every, lambda x: x == o)).alias("n"), (-i).alias("early"), o.alias("org")))
    return F.coalesce(F.array_max(counted)["org"], F.lit(ABSENT))


def keyword_words(keywords: Column) -> Column:
    """Distinct keywords in lower case, trimmed."""
    return F.array_distinct(F.transform(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != ""), lambda k: strip(F.lower(k))))


def query_text(paper: Column, author_order: Column) -> Column:
    """A record's paper: title, abstract (500 characters), venue and year, organisation of its slot, keywords, authors with the slot marked."""
    authors = _authors(paper)
    org = F.get(authors, author_order)["org"]
    each = F.transform(authors, lambda a, i: F.format_string(QUERY_AUTHOR, i + 1, _or(a["name"], ABSENT), F.when(i == author_order, " *").otherwise(""), _or(a["org"], "")))
    keywords = F.slice(F.coalesce(paper["keywords"], F.array().cast("array<string>")), 1, 10)
    return _lines(
        F.lit(NEW_PAPER), F.format_string(QUERY_LINES[0], _or(paper["title"], ABSENT)), F.format_string(QUERY_LINES[1], shortened(_or(paper["abstract"], ""), 500)),
        F.format_string(QUERY_LINES[2], _or(paper["venue"], ABSENT), _or(paper["year"], ABSENT)), _if(org != "", F.format_string(QUERY_ORG, org)),
        _if(F.size(keywords) > 0, F.format_string(QUERY_KEYWORDS, F.array_join(keywords, ", "))), F.lit(""), F.lit(QUERY_AUTHORS), _if(F.size(each) > 0, F.array_join(each, "\n")),
    )


def _paper_text(x: Column) -> Column:
    p = x["paper"]
    people = F.transform(F.slice(_authors(p), 1, 10), lambda a: F.format_string(PAPER_AUTHOR, _or(a["name"], ABSENT), _or(a["org"], ABSENT)))
    sim = lambda c: F.coalesce(x[c], F.lit(0.0))
    return _lines(
        F.format_string(PAPER_LINES[0], x["pub_id"]), F.format_string(PAPER_LINES[1], _or(p["title"], ABSENT), sim("title_sim")), F.format_string(PAPER_LINES[2], sim("abstract_sim")),
        F.lit(PAPER_LINES[3]), _if(F.size(people) > 0, F.array_join(people, "\n")), F.format_string(PAPER_PLACE, _or(p["venue"], ABSENT), _or(p["year"], ABSENT), sim("venue_sim")),
    )


def candidate_texts(pairs: DataFrame, queries: DataFrame, profile_papers: DataFrame, pair_sims: DataFrame, stats: DataFrame, org_likeness: Callable[[Column, Column], Column] | None = None, shown: int = 10, org_cut: float = 0.7) -> DataFrame:
    """(record_id, aid, text) of each pair: numbers, main organisation, shared keywords and the `shown` most relevant papers.

    queries(record_id, author_order, paper), profile_papers(aid, pub_id, pos, paper), pair_sims with
    abstract_sim, stats: see features.candidate_stats. org_likeness compares the record's organisation with
    the profile's main one where no paper has a similarity. Papers without similarities come as if all were
    0; papers that don't exist take no place in the text. A profile's papers count whether they exist or not
    if profile_papers has rows for them with a null paper.
    """
    sims = pair_sims.select("record_id", "aid", "pub_id", "title_sim", "abstract_sim", "venue_sim", "org_sim", "coauthor_count", "coauthor_org_match_count", "year_diff")
    met = pairs.select("record_id", "aid").join(profile_papers, "aid").join(sims, ["record_id", "aid", "pub_id"], "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("title_sim", "venue_sim", "org_sim", "coauthor_count", "coauthor_org_match_count")})
    w = Window.partitionBy("record_id", "aid")
    met = met.withColumns({"place": F.row_number().over(w.orderBy(*relevance_order()[:-1], "pos")), "total": F.count("*").over(w)}).filter(F.col("place") <= shown)
    told = F.array_sort(F.collect_list(F.when(F.col("paper").isNotNull(), F.struct("place", "pub_id", "paper", "title_sim", "abstract_sim", "venue_sim"))))
    told = met.groupBy("record_id", "aid").agg(told.alias("papers"), F.max("total").alias("total"))
    out = pairs.select("record_id", "aid").join(told, ["record_id", "aid"], "left").join(stats, ["record_id", "aid"], "left")
    out = out.join(queries.select("record_id", "author_order", F.col("paper").alias("query")), "record_id")
    none = F.array().cast(told.schema["papers"].dataType)
    papers = F.coalesce("papers", none)
    org = main_org(F.transform(papers, lambda x: x["paper"]))
    n = lambda c: F.coalesce(c, F.lit(0))
    like = F.coalesce("max_org_sim", F.lit(0.0))
    query_org = F.coalesce(F.get(_authors(F.col("query")), F.col("author_order"))["org"], F.lit(""))
    seen = like if org_likeness is None else F.when((like == 0) & (query_org != "") & (F.col("org") != ABSENT), org_likeness(query_org, F.col("org"))).otherwise(like)
    out = out.withColumn("papers", papers).withColumn("org", org).withColumn("like", seen)
    org_text = F.when(F.col("like") > 0, F.format_string(ORG_LIKE, "org", "like", F.when(F.col("like") >= org_cut, "✓").otherwise("?"))).otherwise(F.col("org"))
    words = F.flatten(F.transform("papers", lambda x: keyword_words(x["paper"]["keywords"])))
    shared = F.array_sort(F.array_intersect(keyword_words(F.col("query.keywords")), words))
    co = n("total_coauthor_count")
    text = _lines(
        F.format_string(CANDIDATE, "aid", F.when(co > 0, HAS_COAUTHORS).otherwise("")), F.format_string(CANDIDATE_LINES[0], n("total")), F.format_string(CANDIDATE_LINES[1], org_text),
        F.format_string(CANDIDATE_LINES[2], co, n("coauthor_org_match_count")),
        *[F.format_string(f, F.coalesce(c, F.lit(0.0))) for f, c in zip(CANDIDATE_LINES[3:], ("max_title_sim", "max_org_sim", "max_venue_sim"), strict=True)],
        F.format_string(KEYWORD_COUNT, F.size(shared)), _if(F.size(shared) > 0, F.format_string(KEYWORDS_SHARED, F.array_join(F.slice(shared, 1, 10), ", "))),
        F.lit(SHOWN_PAPERS % shown), _if(F.size("papers") > 0, F.array_join(F.transform("papers", _paper_text), "\n")),
    )
    return out.select("record_id", "aid", text.alias("text"))


def competition(candidates: DataFrame, gap: float = 0.05, many: int = 10) -> DataFrame:
    """(record_id, competition): the block that tells how close the two best titles are."""
    title = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("title_sim_max"))), F.lit(0.0))
    g = candidates.groupBy("record_id").agg(F.count("*").alias("n"), title(1).alias("a"), title(2).alias("b"))
    apart = F.col("a") - F.col("b")
    return g.select("record_id", F.format_string(COMPETITION, "n", "a", "b", apart, F.when((F.col("n") > many) | (apart < gap), YES).otherwise(NO)).alias("competition"))


def record_prompts(
    classified: DataFrame, candidates: DataFrame, queries: DataFrame, texts: DataFrame, system: DataFrame, most: int = 10, competing: bool = False, tokens: Callable[[Column], Column] = estimate_tokens,
) -> DataFrame:
    """(record_id, strategy, prompt_type, system, prompt, aids, tokens) of the records that need judgement.

    classified(record_id, strategy), candidates(record_id, aid, rank, title_sim_max), queries: see query_text,
    texts: see candidate_texts; system(type, text) gives the system prompts, the standard one for types it
    lacks. competing puts the competition block before p0_high prompts (it is counted, not sent, by default).
    tokens is the token count of a text.
    """
    listed = candidates.filter(F.col("rank") <= most).select("record_id", "aid", "rank").join(texts, ["record_id", "aid"])
    listed = listed.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "aid"))).alias("l"))
    out = classified.filter(~F.col("strategy").isin("none", "auto")).select("record_id", "strategy").withColumn("prompt_type", prompt_type(F.col("strategy")))
    out = out.join(queries, "record_id").join(listed, "record_id", "left").join(competition(candidates), "record_id", "left")
    every = F.broadcast(system.select(F.col("type").alias("prompt_type"), F.col("text").alias("own")))  # one row a type of prompt
    standard = F.broadcast(system.filter(F.col("type") == DEFAULT_PROMPT).select(F.col("text").alias("standard")).limit(1))
    out = out.join(every, "prompt_type", "left").join(standard, F.lit(True), "left")
    l = F.coalesce("l", F.array().cast(listed.schema["l"].dataType))  # noqa: E741
    human = F.format_string(HUMAN, F.array_join(F.transform(l, lambda x: x["text"]), "\n\n"), query_text(F.col("paper"), F.col("author_order")))
    shown = F.when(F.col("strategy") == "p0_high", F.concat(F.coalesce("competition", F.lit("")), human)).otherwise(human)
    said = F.coalesce("own", "standard", F.lit(""))
    return out.select(
        "record_id", "strategy", "prompt_type", said.alias("system"), (shown if competing else human).alias("prompt"), F.transform(l, lambda x: x["aid"]).alias("aids"), (tokens(said) + tokens(shown)).alias("tokens"),
    )


def listed_candidates(candidates: DataFrame, most: int = 10) -> DataFrame:
    """(record_id, prompt, aids): candidates in co_rank order, one a line by number, and the aids those numbers stand for."""
    line = F.format_string(LIST_LINE, "co_rank", "aid", "title_sim_max", "org_sim", "venue_sim", "coauthor_count", "coauthor_org_match_count")
    few = candidates.filter(F.col("co_rank") <= most).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("co_rank", line.alias("line"), "aid"))).alias("l"))
    n = candidates.groupBy("record_id").agg((F.max("n") if "n" in candidates.columns else F.count("*")).alias("n"))
    text = _lines(F.lit(LIST_HEAD), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), _if(F.col("n") > most, F.format_string(LIST_MORE, "n")))
    return few.join(n, "record_id").select("record_id", F.format_string(BRIEF, text).alias("prompt"), F.transform("l", lambda x: x["aid"]).alias("aids"))


def co_prompts(candidates: DataFrame, queries: DataFrame, samples: DataFrame, task: str, most: int = 5) -> DataFrame:
    """(record_id, prompt, aids): a record's paper, its first candidates by co_rank with their sampled papers, and the task.

    candidates(record_id, aid, name, co_rank, ...), samples: see ranking.samples_of_candidates.
    """
    named = samples.join(candidates.select("record_id", "aid", "name"), ["record_id", "aid"])
    people = F.slice(F.filter(F.transform(_authors(F.col("paper")), lambda a: F.coalesce(a["name"], F.lit(""))), lambda n: (n != "") & (F.lower(n) != F.lower("name"))), 1, 6)
    sample = _lines(
        F.format_string(CO_PAPER, "place", _or(F.col("paper.year"), "?"), F.substring(_or(F.col("paper.title"), ""), 1, 100)),
        F.format_string(CO_TAG, "coauthor_count", "title_sim", "venue_sim", "org_sim", _or(F.col("year_diff"), "None"), F.bround("score", 0)),
        _if(F.col("paper.venue") != "", F.format_string(CO_PLACE, "paper.venue")), _if(F.size(people) > 0, F.format_string(CO_PEOPLE, F.array_join(people, ", "))),
    )
    told = named.groupBy("record_id", "aid").agg(F.array_sort(F.collect_list(F.struct("place", sample.alias("text")))).alias("s"))
    few = candidates.filter(F.col("co_rank") <= most).join(told, ["record_id", "aid"], "left")
    head = F.format_string(CO_CANDIDATE, "aid", _or(F.col("name"), "?"), F.when(F.col("coauthor_count") > 0, CO_MARK).otherwise(""))
    stats = F.format_string(CO_STATS, "coauthor_count", "coauthor_org_match_count", "title_sim_max", "org_sim", "venue_sim")
    body = F.when(F.col("s").isNull(), F.lit(CO_NONE)).otherwise(_lines(F.format_string(CO_SAMPLES, F.size("s")), F.array_join(F.transform("s", lambda x: x["text"]), "\n")))
    few = few.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("co_rank", _lines(head, stats, body).alias("text"), "aid"))).alias("l"))
    paper, order = F.col("paper"), F.col("author_order")
    authors, own = _authors(paper), F.get(_authors(paper), order)
    keywords = F.slice(F.coalesce(paper["keywords"], F.array().cast("array<string>")), 1, 8)
    each = F.transform(F.slice(authors, 1, 15), lambda a, i: F.format_string(CO_AUTHOR, i + 1, _or(a["name"], "?"), F.when(i == order, " *").otherwise(""), _or(a["org"], "")))
    query = _lines(
        F.lit(CO_HEAD), F.format_string(CO_LINES["title"], _or(paper["title"], ABSENT)), F.format_string(CO_LINES["author"], _or(own["name"], ABSENT)), _if(own["org"] != "", F.format_string(CO_LINES["org"], own["org"])),
        _if(paper["year"].isNotNull(), F.format_string(CO_LINES["year"], paper["year"].cast("string"))), _if(paper["venue"] != "", F.format_string(CO_LINES["venue"], paper["venue"])),
        _if(F.size(keywords) > 0, F.format_string(CO_LINES["keywords"], F.array_join(keywords, ", "))), _if(paper["abstract"] != "", F.format_string(CO_LINES["abstract"], shortened(paper["abstract"], 400))),
        F.format_string(CO_AUTHORS, F.size(authors)), _if(F.size(each) > 0, F.array_join(each, "\n")), _if(F.size(authors) > 15, F.format_string(CO_MORE_AUTHORS, F.size(authors) - 15)),
    )
    out = queries.join(few, "record_id")
    text = _lines(query, F.lit(CO_CANDIDATES), F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(CO_TASK), F.lit(task))
    return out.select("record_id", text.alias("prompt"), F.transform("l", lambda x: x["aid"]).alias("aids"))
