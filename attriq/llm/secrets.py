"""Secrets in texts: key patterns and a token-efficiency test."""

from __future__ import annotations

import base64
import re

import tiktoken
from pyspark.sql import DataFrame

from attriq.llm.common import q, with_python

# The patterns of the base kinds, the least length of each, and their order in a tie.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "random"]

#: Strings that the efficiency test looks at: runs of key characters, and their parts between / and =.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
#: Known digests (MD5, SHA-1, SHA-224/256/384/512 in hex) and identifiers (UUID, plain numbers, dates, digests with their names).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
KNOWN = [
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    re.compile(r"[0-9_=+/-]+"),
    re.compile(r"(?i)(?:sha1|sha224|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/=]+"),
]
#: Words with separators between them, and a number behind at most.
WORDS = re.compile(r"[A-Za-z]+(?:[_/-]+[A-Za-z]+)+[_/-]?[0-9]{0,4}")
#: A run in one case, the first letter aside, may be a long word: (least length, characters a token) under which it isn't.
ONE_CASE = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
WORD_RATIOS = ((20, 2.0), (16, 1.6))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Runs of hex digits are maximal, so that asking for the least length at once finds the same runs.
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{%d,}" % LEAST["hex"], text)]
    return found


class Efficiency:
    """Characters per token under a tiktoken vocabulary: prose has many, random strings few."""

    def __init__(self, ranks_path: str, pattern: str, ratio: float):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("efficiency", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ratio = ratio

    def known(self, s: str) -> bool:
        if any(p.fullmatch(s) for p in KNOWN):
            return True
        if WORDS.fullmatch(s):  # an identifier, if each of its words is short or tokenises as words do
            return all(len(w) <= 3 or len(w) >= 2 * len(self.encoding.encode_ordinary(w)) for w in re.findall("[A-Za-z]+", s))
        return len(s) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) is not None

    def random(self, s: str) -> bool:
        ratio = self.ratio
        if ONE_CASE.fullmatch(s):
            ratio = min(ratio, next(r for least, r in WORD_RATIOS if len(s) >= least))
        return len(s) < ratio * len(self.encoding.encode_ordinary(s)) and not self.known(s)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in RUN.finditer(text):
            s = m[0].strip("=-_/+")
            at = m.start() + m[0].index(s)
            if len(s) >= 16 and self.random(s):
                found.append((at, at + len(s), "random"))
            elif "/" in s or "=" in s:
                for part in PART.finditer(s):
                    x = part[0].strip("-_+")
                    if len(x) >= 16 and self.random(x):
                        a = at + part.start() + part[0].index(x)
                        found.append((a, a + len(x), "random"))
        return found


_made: dict[tuple, Efficiency] = {}


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find_secrets(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ratio: float = 2.2) -> DataFrame:
    """docs with base_spans and spans: arrays of struct(kind, start, end), sorted by start, then kind.

    Offsets are code points, the end exclusive. spans holds the base spans and those of the efficiency
    test: runs of at least 16 key characters, or parts of them between / and =, with fewer than `ratio`
    characters a token that are neither known digests nor identifiers and do not overlap a base span. A run
    of letters in one case counts by the lower WORD_RATIOS, as it may be a long word. A null or empty text has none. Whole
    texts are searched. Repeated rows stay; an input column with an output's name is replaced.
    """

    def search(batches):
        key = ranks_path, pattern, ratio
        if key not in _made:
            _made[key] = Efficiency(*key)
        test = _made[key]
        for (texts,) in batches:
            base, every = [], []
            for x in texts:
                own = base_spans(x or "")
                more = [s for s in test.spans(x or "") if not any(s[0] < b and a < s[1] for a, b, _ in own)]
                order = lambda s: (s[0], KINDS.index(s[2]), s[1])
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(own, key=order)])
                every.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(own + more, key=order)])
            yield {"base_spans": base, "spans": every}

    one = "array<struct<kind:string,start:int,end:int>>"
    return with_python(docs, f"base_spans {one}, spans {one}", search, q(text))
