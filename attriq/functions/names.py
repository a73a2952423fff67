"""Author names: normal forms, abbreviation matches, blocking keys, attributes of a paper. Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORS = "array<struct<name:string,org:string>>"

# One-word names that match alone.
MONONYMS = ["yamaguchi", "martini", "hirano"]

# Words that are no part of a name, and short forms of given names.
NAME_STOP_WORDS = ["jr", "iii", "dr", "mr", "junior"]
SHORT_NAMES = {
    "al": "albert", "andy": "andrew", "tony": "anthony", "art": "arthur", "arty": "arthur", "bernie": "bernard", "bern": "bernard",
    "charlie": "charles", "chuck": "charles", "danny": "daniel", "dan": "daniel", "don": "donald", "ed": "edward", "eddie": "edward",
    "gene": "eugene", "fran": "francis", "freddy": "frederick", "fred": "frederick", "hank": "henry", "irv": "irving", "jimmy": "james",
    "jim": "james", "joe": "joseph", "jacky": "john", "jack": "john", "jeff": "jeffrey", "ken": "kenneth", "larry": "lawrence",
    "leo": "leonard", "matt": "matthew", "mike": "michael", "nate": "nathan", "nat": "nathan", "nick": "nicholas", "pat": "patrick",
    "pete": "peter", "ray": "raymond", "dick": "richard", "rick": "richard", "bob": "robert", "bobby": "robert", "rob": "robert",
    "ron": "ronald", "ronny": "ronald", "russ": "russell", "sam": "samuel", "sammy": "samuel", "steve": "stephan", "stu": "stuart",
    "teddy": "theodore", "ted": "theodore", "tom": "thomas", "thom": "thomas", "tommy": "thomas", "timmy": "timothy", "tim": "timothy",
    "walt": "walter", "wally": "walter", "bill": "william", "billy": "william", "will": "william", "willy": "william", "mandy": "amanda",
    "cathy": "catherine", "cath": "catherine", "chris": "christopher", "chrissy": "christine", "cindy": "cynthia", "cynth": "cynthia",
    "debbie": "deborah", "deb": "deborah", "betty": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "bess": "elizabeth",
    "flo": "florence", "francie": "frances", "jan": "janet", "kate": "katherine", "kathy": "katherine", "janice": "janice",
    "nan": "nancy", "pam": "pamela", "bobbie": "roberta", "sophie": "sophia", "sue": "susan", "suzie": "susan", "terry": "teresa",
    "val": "valerie", "ronnie": "veronica", "vonna": "yvonne", "peggy": "margaret", "sally": "sarah", "harry": "henry",
}

#: Letters whose plain form is no single letter under them, or isn't found by decomposing.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
STROKES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H"}


def _marked_letters() -> dict[str, str]:
    """Latin letters with marks and the plain letter that each decomposes to."""
    out = dict(STROKES)
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            out[chr(k)] = plain
    return out


_MARKED = _marked_letters()


def strip(s: Column) -> Column:
    return F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it (inside lambdas Spark doesn't share expressions)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_letters(s: Column) -> Column:
    """s with Latin letters in their plain ASCII forms; letters of other scripts stay."""
    out = F.translate(F.regexp_replace(s, "\\p{M}", ""), "".join(_MARKED), "".join(_MARKED.values()))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def name_parts(name: Column) -> Column:
    """Parts of a name.

    Trimmed; no-break space is a space, U+2010 and hyphens go, u-umlaut is u, GS is G S, commas are spaces.
    A name with letters beyond ASCII keeps only those, one part each.
    """
    s = F.translate(strip(name), " ü‐", " u")
    beyond = F.transform(F.filter(F.split(s, ""), lambda c: F.ascii(c) > 127), lambda c: strip(F.lower(c)))
    plain = F.translate(F.lower(F.replace(s, F.lit("GS"), F.lit("G S"))), ",-", " ")
    plain = F.split(strip(F.replace(plain, F.lit("  "), F.lit(" "))), " ")
    return F.when(F.size(beyond) > 0, beyond).otherwise(plain)


def name_key(name: Column) -> Column:
    return F.array_join(name_parts(name), "_")


def spaced_name(name: Column) -> Column:
    """The parts of a name with spaces."""
    return F.array_join(name_parts(name), " ")


def profile_parts(name: Column) -> Column:
    """Parts of a profile's name, which underscores hold apart."""
    return F.split(F.replace(F.lower(name), F.lit("-"), F.lit("")), "_")


def without_ascii(s: Column) -> Column:
    return F.regexp_replace(s, "[\\x00-\\x7F]", "")


def clean_name(name: Column) -> Column:
    """Plain lower-case letters, everything else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(plain_letters(name)), "[^\\p{L}]+", " "))


def is_abbreviation(part: Column) -> Column:
    return (F.length(part) == 1) | part.contains(".")


def names_match(a: Column, b: Column) -> Column:
    """Whether the parts a, which may be abbreviated, name the same person as the parts b.

    An abbreviated part of a meets any part of b with that initial, another part its equal. Two hits are
    enough; one is where a has one part or holds a known one-word name.
    """
    def decide(a: Column, b: Column) -> Column:
        hits = F.size(F.filter(a, lambda p: F.when(is_abbreviation(p), F.exists(b, lambda x: x.startswith(F.substring(p, 1, 1)))).otherwise(F.array_contains(b, p))))
        alone = (F.size(a) == 1) | F.arrays_overlap(a, F.array(*map(F.lit, MONONYMS)))
        return hits >= F.when(alone, 1).otherwise(2)

    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: decide(x["a"], x["b"]))


def matched_names(mine: Column, theirs: Column, clean: Callable[[Column], Column] = spaced_name) -> Column:
    """The names of mine, in the form clean gives, that match any name of theirs."""
    hit = let(F.transform(theirs, name_parts), lambda parts: F.filter(mine, lambda m: let(name_parts(m), lambda own: F.exists(parts, lambda p: names_match(own, p)))))
    return F.array_sort(F.array_distinct(F.transform(hit, clean)))


def index_keys(parts: Column, most: int = 12) -> Column:
    """Keys of the parts' initials: for each choice of two or more (and for all of them) in order, reversed and sorted, and one for each alone.

    Names of more than `most` parts (a name beyond ASCII has one a letter) have keys for each choice of two
    and for all instead of for all 2 ** parts choices. No meeting is lost: names with a key of a larger
    choice in common have one of each two of its initials in common.
    """
    initials = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring(p, 1, 1))
    n = F.size(initials)
    choices = F.sequence(F.lit(1), F.pow(F.lit(2), F.when(n <= most, n).otherwise(0)).cast("int"))
    choices = F.slice(choices, 1, F.greatest(F.size(choices) - 1, F.lit(0)))
    bit = lambda m, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1
    chosen = F.filter(F.transform(choices, lambda m: F.filter(initials, lambda c, i: bit(m, i))), lambda x: (F.size(x) > 1) | (n == 1))
    pairs = F.flatten(F.transform(initials, lambda a, i: F.transform(F.slice(initials, i + 2, n), lambda b: F.array(a, b))))
    chosen = F.when(n <= most, chosen).otherwise(F.concat(pairs, F.array(initials)))
    keys = F.flatten(F.transform(chosen, lambda x: F.array(F.array_join(x, "_"), F.array_join(F.reverse(x), "_"), F.array_join(F.array_sort(x), "_"))))
    return F.when(n > 0, F.array_distinct(F.concat(keys, F.transform(initials, lambda c: F.concat(F.lit("single_"), c))))).otherwise(F.array().cast("array<string>"))


def _pair_keys(tokens: Column, again: bool) -> Column:
    """A key for each two of the tokens, whatever their order; again: for each with itself too."""
    from_ = (lambda i: i + 1) if again else (lambda i: i + 2)
    each = lambda every: F.transform(every, lambda a, i: F.transform(F.slice(every, from_(i), F.size(every)), lambda b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))))
    return F.flatten(let(tokens, each))


def query_keys(parts: Column) -> Column:
    """Keys of a name whose parts may be abbreviated: what a name must hold to match it (two of its parts; one where one is enough)."""
    tokens = F.transform(parts, lambda p: F.when(is_abbreviation(p), F.concat(F.lit("^"), F.substring(p, 1, 1))).otherwise(F.concat(F.lit("="), p)))
    alone = (F.size(parts) == 1) | F.arrays_overlap(parts, F.array(*map(F.lit, MONONYMS)))
    return F.array_distinct(F.concat(_pair_keys(tokens, False), F.when(alone, tokens).otherwise(F.array().cast("array<string>"))))


def answer_keys(parts: Column) -> Column:
    """All keys that a name can be asked for by query_keys: two of its parts and initials, or one."""
    tokens = F.array_distinct(F.concat(F.transform(parts, lambda p: F.concat(F.lit("="), p)), F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit("^"), F.substring(p, 1, 1)))))
    return F.array_distinct(F.concat(_pair_keys(tokens, True), tokens))


def first_author(target: Column, authors: Column) -> Column:
    """0-based index of the first of authors (name, org) whose name matches the parts target; -1 if none does."""
    named = F.transform(authors, lambda a: (F.coalesce(a["name"], F.lit("")) != "") & names_match(name_parts(a["name"]), target))
    return F.coalesce(F.array_position(named, F.lit(True)), F.lit(0)).cast("int") - 1


def name_tokens(name: Column) -> Column:
    """Tokens of a name in one string: two capitals and dotted initials apart, quotes gone, titles dropped, short forms written out."""
    words = F.filter(F.split(name, "(?U)\\s+"), lambda w: w != "")
    capitals = lambda w: (F.length(w) == 2) & ~w.contains(".") & (F.upper(w) == w) & (F.lower(w) != w)
    apart = F.array_join(F.transform(words, lambda w: F.when(capitals(w), F.concat_ws(" ", F.substring(w, 1, 1), F.substring(w, 2, 1))).otherwise(w)), " ")
    tidy = plain_letters(F.lower(F.regexp_replace(F.replace(apart, F.lit("'"), F.lit("")), "(?U)[^\\w.]", " ")))
    full = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])
    kept = F.filter(F.split(tidy, "(?U)\\s+"), lambda w: (w != "") & ~F.replace(w, F.lit("."), F.lit("")).isin(NAME_STOP_WORDS))
    said = F.transform(kept, lambda w: F.coalesce(F.try_element_at(full, w), w))
    dots = lambda w: F.length(w) - F.length(F.replace(w, F.lit("."), F.lit("")))
    spread = F.transform(said, lambda w: F.when(dots(w) > 1, F.replace(w, F.lit("."), F.lit(" "))).otherwise(w))
    return F.regexp_replace(F.regexp_replace(F.array_join(spread, " "), "[^\\x00-\\x7F]", ""), " +", " ")


def joined_keywords(keywords: Column) -> Column:
    """Keywords in one string, without empty ones and the words null and None."""
    return F.array_join(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k.isNotNull() & ~k.isin("", "null", "None")), " ")


def _others(authors: Column, slot: Column) -> Column:
    named = F.filter(authors, lambda a, i: (i != slot) & (F.coalesce(a["name"], F.lit("")) != ""))
    return F.array_sort(F.array_distinct(F.transform(named, lambda a: a["name"])))


def paper_attributes(name: Column, authors: Column, venue: Column, keywords: Column, title: Column) -> Column:
    """struct(slot, coauthors, org, venue, keywords, title) of a paper for the author whose profile has that name, its parts held apart by underscores."""
    given = F.coalesce(authors, F.array().cast(AUTHORS))

    def at(slot: Column) -> Column:
        return F.struct(
            slot.alias("slot"), _others(given, slot).alias("coauthors"), F.coalesce(F.get(given, F.when(slot >= 0, slot))["org"], F.lit("")).alias("org"),
            F.coalesce(venue, F.lit("")).alias("venue"), joined_keywords(keywords).alias("keywords"), F.coalesce(title, F.lit("")).alias("title"),
        )

    return let(let(profile_parts(name), lambda target: first_author(target, given)), at)


def paper_attributes_of_all(authors: Column, venue: Column, keywords: Column, title: Column) -> Column:
    """As paper_attributes, of no author in particular: all are coauthors, the organisation is the first that any has."""
    given = F.coalesce(authors, F.array().cast(AUTHORS))
    orgs = F.filter(F.transform(given, lambda a: a["org"]), lambda o: F.coalesce(o, F.lit("")) != "")
    return F.struct(
        _others(given, F.lit(-1)).alias("coauthors"), F.coalesce(F.get(orgs, F.lit(0)), F.lit("")).alias("org"), F.coalesce(venue, F.lit("")).alias("venue"),
        joined_keywords(keywords).alias("keywords"), F.coalesce(title, F.lit("")).alias("title"),
    )
