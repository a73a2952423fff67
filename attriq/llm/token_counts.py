"""Exact token counts of texts and of all their prefixes under a byte-level BPE vocabulary."""

from __future__ import annotations

import gc
import json
from array import array
from bisect import bisect_right

import regex
from pyspark.sql import DataFrame

from attriq.llm.common import q, with_python

# The white space of Unicode and the split rule of the vocabulary's byte-level pre-tokenizer.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The white space beyond ASCII, a space behind other white space of ASCII, and one between such.
OTHER = [c for c in map(chr, range(0x80, 0x3001)) if regex.match(f"[{WHITE}]", c)]
ENDS = [c + " " for c in "\t\n\x0b\x0c\r"]
BETWEEN = regex.compile("[\t-\r] [\t-\r]")

#: Texts whose new words are counted together.
AT_ONCE = 2000
#: Last bytes by which the sizes of tokens are known, and how many more endings are kept.
ENDING, KEPT = 4, 200_000


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Sizes(dict):
    """Sizes of the tokens that end with given last bytes, ENDING where there are as many, the largest first."""

    def __init__(self, vocab: dict[bytes, int]) -> None:
        found: dict[bytes, set[int]] = {}
        for t in vocab:
            if len(t) >= ENDING:
                found.setdefault(t[-ENDING:], set()).add(len(t))
        self.vocab = vocab
        super().__init__((k, (*sorted(v, reverse=True), *self.short(k))) for k, v in found.items())
        self.most = len(self) + KEPT

    def short(self, end: bytes) -> list[int]:
        return [n for n in range(ENDING - 1, 0, -1) if len(end) >= n and end[-n:] in self.vocab]

    def __missing__(self, end: bytes) -> tuple[int, ...]:
        found = tuple(self.short(end))
        if len(self) < self.most:
            self[end] = found
        return found


class PrefixCounter:
    """Token counts by dynamic programming over prefixes.

    The encoding of a prefix of a piece is the encoding of a shorter prefix plus one last token; that
    token is the only one that ends there and stays unmerged beside the token before it. So
    count[i] = count[i - len(last[i])] + 1 for each i, and one pass stores the count of every prefix.
    """

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        #: The two parts that each token is merged from, and the rank of that merge; single bytes have none.
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), r in self.rank.items():
            self.parts.setdefault(a + b, (r, a, b))
        #: Tokens that several merges make, or that aren't their own encoding: pairs with them are merged anew.
        self.unsure = {t for t in self.vocab if len(t) > 1 and t not in self.parts}
        if len(self.parts) < len(self.rank):
            seen: set[bytes] = set()
            for a, b in self.rank:
                self.unsure |= {a + b} & seen
                seen.add(a + b)
        self.unsure |= {t for t, (r, a, b) in self.parts.items() if not self._beside(a, b, r)}
        self.sizes = _Sizes(self.vocab)
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.blank = regex.compile(f"[{WHITE}]+").fullmatch
        self.limit = cache
        self.units: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        #: Those of before the last overflow: frequent ones are taken from there, the others go with the next.
        self.old_units: dict[str, int] = {}
        self.old_pieces: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.tables: dict[bytes, list[int]] = {}

    def _merge(self, text: bytes) -> list[bytes]:
        """The encoding itself, by merging the pair of least rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _beside(self, a: bytes, b: bytes, limit: int = 1 << 60) -> bool:
        """Whether no merge across their border comes before the tokens a and b are made, nor one of lower rank than limit after.

        The merges are undone from the last on; of each state, the parts at the border are looked up as a pair.
        """
        rank, parts = self.rank, self.parts
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]  # a pair of equal rank that begins further left goes first

    def _pair(self, key: int) -> bool:
        """Whether two tokens stay apart side by side; key has the number of the first above that of the second."""
        if len(self.fits) > self.limit:
            self.fits.clear()
        a, b = self.token[key >> 32], self.token[key & 0xFFFFFFFF]
        sure = a not in self.unsure and b not in self.unsure
        known = self.fits[key] = self._beside(a, b) if sure else self._merge(a + b) == [a, b]
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of a piece of the split rule; those of short pieces are kept."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        count = self._prefixes(piece)
        if len(piece) <= 32:
            if len(self.tables) > self.limit // 4:
                self.tables.clear()
            self.tables[piece] = count
        return count

    def _prefixes(self, piece: bytes) -> list[int]:
        self._extend(piece, [0], count := [0])
        return count

    def _extend(self, piece: bytes, last: list[int], count: list[int]) -> None:
        """Goes on from the prefixes that last (the number of each one's last token) and count hold to the whole piece."""
        number, sizes, fits, pair = self.vocab.get, self.sizes, self.fits, self._pair
        for i in range(len(count), len(piece) + 1):
            for size in sizes[piece[i - ENDING if i > ENDING else 0 : i]]:
                at = i - size
                if at < 0 or (token := number(piece[at:i])) is None:
                    continue
                if at:
                    key = last[at] << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = pair(key)
                    if not fit:
                        continue
                last.append(token)
                count.append(count[at] + 1)
                break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {i} of {piece[:40]!r}")

    def learn(self, texts: list[str]) -> None:
        """Counts of the texts' units that aren't known yet. Pieces are taken in order, so that a prefix that several share is counted once."""
        new: set[str] = set()
        for x in texts:
            new.update(x.split(" "))
        if len(self.units) + len(new) > self.limit:
            self.units, self.old_units = {}, self.units
        if len(self.pieces) + len(new) > self.limit:
            self.pieces, self.old_pieces = {}, self.pieces
        units, pieces = self.units, self.pieces
        new.difference_update(units)
        for x in new & self.old_units.keys():
            units[x] = self.old_units[x]
        new.difference_update(units)
        split = {x: [" " + x] if x.isascii() and x.isalpha() else self.split.findall(" " + x) for x in new if len(x) <= 64}
        wanted = {p for found in split.values() for p in found}.difference(pieces)
        for p in wanted & self.old_pieces.keys():
            pieces[p] = self.old_pieces[p]
        wanted.difference_update(pieces)
        last, count, before = [0], [0], b""
        for piece in sorted(map(str.encode, wanted)):
            same, most = 0, min(len(piece), len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self._extend(piece, last, count)
            pieces[piece.decode()], before = count[-1], piece
        for x, found in split.items():
            units[x] = pieces[found[0]] if len(found) == 1 else sum(map(pieces.__getitem__, found))

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            n = self._prefixes(piece.encode())[-1]
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n

    def tangled(self, text: str) -> bool:
        """Whether cutting at single spaces would not cut at a piece's border. Most texts are told by searches for single characters."""
        return "  " in text or any(c in text for c in OTHER) or (any(x in text for x in ENDS) and BETWEEN.search(text) is not None)

    def _unit(self, unit: str) -> int:
        return sum(map(self._piece, self.split.findall(unit)))

    def _plain(self, text: str) -> int:
        """Count of a text without special strings. Between single spaces, units are counted once and kept."""
        if self.tangled(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        total, units = self._unit(first), self.units
        try:
            return total + sum(map(units.__getitem__, rest))
        except KeyError:
            pass  # long ones aren't kept
        for x in rest:
            n = units.get(x)
            if n is None:
                if len(units) > self.limit:
                    units.clear()
                n = self._unit(" " + x)
                if len(x) <= 64:
                    units[x] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return sum(1 if i % 2 else self._plain(x) for i, x in enumerate(self.at_special.split(text)))

    def table(self, text: str) -> array:
        """Exact token counts of text[:0], text[:1], ..., text[:len(text)], in one array.

        A prefix that ends inside white space, a contraction or a special string is split otherwise than
        the whole text is; there only the last few pieces are counted again.
        """
        out = array("i", [0])
        parts = self.at_special.split(text) if self.at_special else [text]
        base, tail = 0, ""  # tokens before the current segment; its text from a point where the split is certain
        for k, part in enumerate(parts):
            if k % 2:
                for j in range(1, len(part)):
                    out.append(base_seg + self._segment(seg + part[:j]))
                base = base + 1
                out.append(base)
                continue
            base_seg, seg = base, part
            if part:
                self._fill(out, base, part)
                base = out[-1]
            if k + 1 < len(parts):
                # The prefixes within the special string continue this segment: keep its last pieces only.
                pieces = self.split.findall(part)
                keep = len(pieces)
                while keep and (keep > len(pieces) - 2 or self.blank(pieces[keep - 1])):
                    keep -= 1
                seg = "".join(pieces[keep:])
                base_seg = base - sum(map(self._piece, pieces[keep:]))
        return out

    def within(self, text: str, total: int, budget: int) -> int:
        """Most code points of a prefix of text, which has `total` tokens, whose count is within the budget: read from the table of the prefixes that come near it.

        The split has a border before each single space behind other than white space, whatever follows, so counts up to there add up. The
        prefix ends between the last of these within the budget and the next: each that is longer has the tokens up to that one at least.
        """
        if total <= budget:
            return len(text)
        if not self.tangled(text) and not (self.special and any(s in text for s in self.special)):
            first, *rest = text.split(" ")
            done, sure, base, at = self._unit(first), 0, 0, len(first)  # tokens so far; the last border within the budget, tokens up to there
            for x in rest:
                if at and text[at - 1] not in "\t\n\x0b\x0c\r":
                    if done > budget:
                        break
                    sure, base = at, done
                done += n if (n := self.units.get(x)) is not None else self._unit(" " + x)
                at += 1 + len(x)
            return sure + longest_within(self.table(text[sure:at]), budget - base)
        # A prefix has no more tokens than its bytes; the count seldom falls from one prefix to the next, and by a few at most.
        end = min(len(text), 4 * budget + 64)
        while True:
            table = self.table(text[:end])
            if end == len(text) or table[-1] > budget + 32:
                return longest_within(table, budget)
            end = min(len(text), 2 * end)

    def _segment(self, text: str) -> int:
        return sum(map(self._piece, self.split.findall(text)))

    def _fill(self, out: array, base: int, part: str) -> None:
        pieces = self.split.findall(part)
        done = base  # tokens of all pieces so far
        run, run_base = "", base  # white space that runs up to here, tokens before it
        for piece in pieces:
            if self.blank(piece):
                if not run:
                    run_base = done
                for c in piece:
                    run += c
                    out.append(run_base + self._piece(run))
                done = done + self._piece(piece)
                continue
            body = piece
            if piece[0] == " ":
                if not run:
                    run_base = done
                run += " "
                out.append(run_base + self._piece(run))
                body = piece[1:]
            run = ""
            counts = self.prefixes(piece.encode())
            at = len(piece.encode()) - len(body.encode())
            for j, c in enumerate(body, 1):
                at += len(c.encode())
                out.append(done + counts[at])
                if body is piece and piece[0] == "'" and 1 < j < len(piece) and piece[1].isalpha():
                    out[-1] = done + self._segment(piece[:j])  # within a contraction
            done = done + counts[-1]


def longest_within(table: array, budget: int) -> int:
    """Most code points of a prefix whose count is within the budget, from its table alone."""
    if all(table[i] <= table[i + 1] for i in range(len(table) - 1)):
        return bisect_right(table, budget) - 1
    return max(i for i, n in enumerate(table) if n <= budget)


_made: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _made:
        _made[path] = PrefixCounter(path)
        gc.collect()
        gc.freeze()  # its tables stay, so later collections needn't go through them
    return _made[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep_table: bool = False, fit: bool = False) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (and prefix_tokens: the count of every prefix; and fit_chars).

    fit_chars is the number of code points of the longest prefix that has at most `limit` tokens, read from
    the prefix counts; nothing is encoded for it.

    A null text counts as empty: 0 bytes, 0 tokens. Whole texts are counted, however long. Repeated rows
    stay, with equal counts; an empty table gives an empty table. An input column with the name of an
    output column is replaced. Memory: a batch of texts and caches of a fixed size per worker.
    """

    def counts(batches):
        own = counter(tokenizer)
        for (texts,) in batches:
            texts = ["" if x is None else x for x in texts]
            out = {"n_bytes": [len(x.encode()) for x in texts]}
            if keep_table:
                out["prefix_tokens"] = [own.table(x).tolist() for x in texts]
                out["n_tokens"] = [t[-1] for t in out["prefix_tokens"]]
            else:
                out["n_tokens"] = []
                for k in range(0, len(texts), AT_ONCE):
                    own.learn(texts[k : k + AT_ONCE])
                    out["n_tokens"] += map(own.count, texts[k : k + AT_ONCE])
            if fit:
                out["fit_chars"] = [own.within(x, n, limit) for x, n in zip(texts, out["n_tokens"], strict=True)]
            yield out | {"over_limit": [n > limit for n in out["n_tokens"]]}

    return with_python(docs, "n_bytes long, n_tokens long, over_limit boolean" + ", prefix_tokens array<int>" * keep_table + ", fit_chars long" * fit, counts, q(text))
