"""Titles, organisations, similarities of word sets, answers of a decider. Column to Column."""

from __future__ import annotations

from operator import ne

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from attriq.functions.names import AUTHORS, strip


def clean_title(title: Column) -> Column:
    """The title without numbers inside its tokens and without tokens left empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, "(?U)\\d+(?:\\.\\d+)?", ""), "(?U)\\s+", " "))


def clean_punctuation(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?U)[\\W_]", " "), " +", " "))


def word_set(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(s)), "\\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / either), F.lit(0.0))


def words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, "(?U)\\s+"), lambda w: w != ""))


# A paper's own fields, from authors (name, org structs) and venue.


def author_set(authors: Column) -> Column:
    """Distinct lower-case names of those authors that have one."""
    named = F.filter(F.coalesce(authors, F.array().cast(AUTHORS)), lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return F.array_distinct(F.transform(named, lambda a: strip(F.lower(a["name"]))))


def first_org(authors: Column) -> Column:
    """The first author's organisation in lower case, or empty."""
    return F.lower(F.coalesce(F.get(authors, F.lit(0))["org"], F.lit("")))


def lower_venue(venue: Column) -> Column:
    return F.lower(F.coalesce(venue, F.lit("")))


def coauthor_overlap(authors_a: Column, authors_b: Column) -> Column:
    return F.size(F.array_intersect(author_set(authors_a), author_set(authors_b)))


def venue_likeness(a: Column, b: Column) -> Column:
    return jaccard(words(lower_venue(a)), words(lower_venue(b)))


def org_likeness(authors_a: Column, authors_b: Column) -> Column:
    return jaccard(words(first_org(authors_a)), words(first_org(authors_b)))


def elapsed(seconds: Column) -> Column:
    """Seconds as 1h 2m 3s, without leading zero parts; below zero 0s."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(r, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(r, "s"))).otherwise(part(r, "s"))


def org_key(org: Column, length: int = 150) -> Column:
    return F.md5(F.substring(strip(org), 1, length).cast("binary"))


def year_value(year: Column) -> Column:
    return F.when(F.trim(year.cast("string")).rlike("^[0-9]+$"), F.trim(year.cast("string")).try_cast("int"))


def year_diff(a: Column, b: Column) -> Column:
    return F.abs(year_value(a) - year_value(b))


def estimate_tokens(text: Column) -> Column:
    """A bound by words and characters, where no tokenizer is given."""
    s = F.coalesce(text, F.lit(""))
    return F.when(s == "", 0).otherwise(F.greatest(F.ceil(F.length(s) / 4), F.size(F.split(F.trim(s), "\\s+")))).cast("int")


def _places(b: str) -> dict[str, int]:
    """For each character a number whose bits say where it stands."""
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    return at


def _jaro_winkler(a: str, b: str, at: dict[str, int]) -> float:
    """at = _places(b). Each character of a takes the first place still free within reach, found as the lowest bit."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    if reach < 0:
        return 0.0
    free, window, hits = (1 << len(b)) - 1, (1 << 2 * reach + 1) - 1, []
    for i, c in enumerate(a):
        here = at.get(c, 0) & free
        if here:
            here &= window << i >> reach
            if here:
                free ^= here & -here
                hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    others = [c for c, left in zip(b, f"{free:0{len(b)}b}"[::-1], strict=True) if left == "0"]
    swaps = sum(map(ne, hits, others)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + prefix * 0.1 * (1 - jaro)


class _Likeness:
    """Likenesses within one batch of rows, each pair of texts once."""

    def __init__(self) -> None:
        self.places: dict[str, dict[str, int]] = {}
        self.known: dict[tuple[str, str], float] = {}

    def __call__(self, a: str | None, b: str | None) -> float:
        pair = (a or "", b or "")
        if pair not in self.known:
            if pair[1] not in self.places:
                self.places[pair[1]] = _places(pair[1])
            self.known[pair] = _jaro_winkler(*pair, self.places[pair[1]])
        return self.known[pair]


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler likeness; Spark has no such function, so Arrow batches."""
    return pd.Series(list(map(_Likeness(), a, b)), dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def jaro_winkler_all(a: pd.Series, items: pd.Series) -> pd.Series:
    """The likeness of a text to each of an array of texts."""
    like = _Likeness()
    return pd.Series([[like(x, y) for y in ys] for x, ys in zip(a, items)], dtype=object)


# The names under which a decider's fields may stand, the first found counts.
ANSWER_NAMES = ["author_id", "作者ID", "预测作者", "answer"]
CONFIDENCE_NAMES = ["confidence", "置信度"]
REASON_NAMES = ["reasoning", "理由", "判断理由", "reason"]


def _field(s: Column, names: list[str]) -> Column:
    """What stands behind the first name found at a line's start with a colon, up to the next such line; empty if none."""
    found = [F.nullif(F.regexp_extract(s, f"(?isuU)(?:^|\\n)\\s*{n}\\s*[:：]\\s*(.+?)(?=\\n\\s*\\w+\\s*[:：]|\\z)", 1), F.lit("")) for n in names]
    return F.coalesce(*[strip(f) for f in found], F.lit(""))


def parse_answer(text: Column) -> Column:
    """struct(answer, confidence, reasoning) from a decider's text.

    The first flat {...}, if it is JSON whose fields are texts: author_id (or answer), confidence and
    reasoning (or reason), which are none, medium and empty where absent. Else `name: value` lines; else the
    answer is the first word of eight letters and digits or none, and the confidence is high or low if the
    text has that word, else medium.
    """
    s = strip(F.coalesce(text, F.lit("")))
    js = F.try_parse_json(F.regexp_extract(s, "(?s)\\{[^{}]*\\}", 0))
    raw = lambda n: F.try_variant_get(js, f"$.{n}", "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    both = lambda a, b: F.coalesce(raw(a), raw(b))
    parts = [(both("author_id", "answer"), "none"), (raw("confidence"), "medium"), (both("reasoning", "reason"), "")]
    is_json = js.isNotNull() & (kind(js) != "ABSENT")
    for v, _ in parts:
        is_json = is_json & kind(v).isin("ABSENT", "STRING")
    said = [F.coalesce(v.cast("string"), F.lit(d)) for v, d in parts]
    bare = F.coalesce(F.nullif(F.regexp_extract(s, "(?U)\\b[a-zA-Z0-9]{8}\\b", 0), F.lit("")), F.lit("none"))
    low = F.lower(s)
    level = F.when(low.contains("high"), "high").when(low.contains("low"), "low").otherwise("medium")
    answer, confidence = (F.coalesce(F.nullif(_field(s, n), F.lit("")), other) for n, other in ((ANSWER_NAMES, bare), (CONFIDENCE_NAMES, level)))
    lines = [answer, confidence, _field(s, REASON_NAMES)]
    return F.struct(*[F.when(is_json, a).otherwise(b).alias(n) for a, b, n in zip(said, lines, ("answer", "confidence", "reasoning"), strict=True)])


def resolve_answer(answer: Column, aids: Column) -> Column:
    """An answer that is a number names the candidate at that place of aids (from 1)."""
    return F.coalesce(F.when(answer.rlike("^[0-9]{1,6}$"), F.get(aids, answer.try_cast("int") - 1)), answer)
