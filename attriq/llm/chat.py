"""Conversations formatted as packed prefix trees: shared first turns once, with positions and attention intervals."""

from __future__ import annotations

import base64
import re

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriq.llm.common import map_arrow, only, q

#: The template's control strings. A turn is <s>[INST]role[/INST]text</s>.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
_ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
TRAINED = "assistant"


def escape(text: str) -> str:
    """The text without control strings: a backslash goes before each backslash and behind the first character of each control string."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    at, out = 0, []
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


_made: dict[tuple, tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    key = ranks_path, pattern
    if key not in _made:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 1
        _made[key] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={c: first + i for i, c in enumerate(CONTROLS)})
    return _made[key]


class Pack:
    """A forest of turns, filled depth first."""

    def __init__(self, enc: tiktoken.Encoding):
        self.enc, self.control = enc, [enc.encode_single_token(c) for c in CONTROLS]
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.nodes: list[dict] = []
        self.ends: list[dict] = []
        self.stack: list[tuple[tuple[str, str], int]] = []  # the turns from a root to the last node

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """How many first turns the pack's last conversation has in common with these."""
        n = 0
        while n < min(len(self.stack), len(turns)) and self.stack[n][0] == turns[n]:
            n += 1
        return n

    def encoded(self, turn: tuple[str, str]) -> tuple[list[int], list[int]]:
        """The tokens of a turn before its text and those of the text."""
        begin, _, open_, close = self.control
        role, text = (self.enc.encode_ordinary(escape(x)) for x in turn)
        return [begin, open_, *role, close], text

    def add(self, leaf: str, turns: list[tuple[str, str]], encoded: list[tuple[list[int], list[int]]] | None = None) -> None:
        """A conversation; encoded: the tokens of its turns, if they are at hand."""
        shared = self.shared(turns)
        self.close(shared)
        for k in range(shared, len(turns)):
            turn = turns[k]
            head, text = self.encoded(turn) if encoded is None else encoded[k]
            parent = self.stack[-1][1] if self.stack else -1
            at, start = len(self.tokens), self.positions[self.nodes[parent]["end"] - 1] + 1 if self.stack else 0
            self.tokens += [*head, *text, self.control[1]]
            size = len(self.tokens) - at
            self.positions += range(start, start + size)
            self.loss += [False] * len(head) + [turn[0] == TRAINED] * len(text) + [False]
            self.nodes.append({"parent": parent, "start": at, "end": at + size, "subtree_end": -1})
            self.stack.append((turn, len(self.nodes) - 1))
        self.ends.append({"leaf": leaf, "node": self.stack[-1][1] if self.stack else -1})

    def close(self, depth: int) -> None:
        """Ends the subtrees of the path's nodes from this depth on."""
        for _, node in self.stack[depth:]:
            self.nodes[node]["subtree_end"] = len(self.tokens)
        del self.stack[depth:]

    def row(self) -> dict[str, list]:
        self.close(0)
        return {"pack_id": [self.ends[0]["leaf"]], "tokens": [self.tokens], "position_ids": [self.positions], "loss_mask": [self.loss], "nodes": [self.nodes], "conversations": [self.ends]}


def attended(nodes: list[dict], node: int) -> list[tuple[int, int]]:
    """The token intervals, from the root's on, that a node attends to: its ancestors' and, causally, its own."""
    out = []
    while node >= 0:
        out.append((nodes[node]["start"], nodes[node]["end"]))
        node = nodes[node]["parent"]
    return out[::-1]


PACK = "pack_id string, tokens array<int>, position_ids array<int>, loss_mask array<boolean>, nodes array<struct<parent:int,start:int,end:int,subtree_end:int>>, conversations array<struct<leaf:string,node:int>>"


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", pack_tokens: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(packs, members) of conversations, whose turns are rows.

    members(id, leaf): each conversation and the digest of its turns. packs: for each distinct conversation,
    its path through a tree of turns. A pack's tokens hold each turn of its trees once, depth first;
    position_ids count along the path from the root; nodes name each turn's parent, the interval [start,
    end) of its tokens, and the end of its subtree: the tokens of [start, end) are attended to, causally, by
    all of [start, subtree_end) and by no others. So a pack grows with its tokens, however deep its trees
    are; `attended` lists a node's intervals. loss_mask marks the text of assistant
    turns; conversations tell at which node each distinct conversation ends.

    Turns go by turn (null first), ties by role and text; repeated rows are repeated turns. A null role or
    text is empty, null ids are one conversation. A conversation is one training text and must fit in a
    row. No rows, no packs. Other columns don't matter.

    Copies of a conversation fall together by partial aggregates, so many of them weigh no more than one. The
    distinct ones are range-partitioned in the order of their turns' hashes, which is depth-first order: a
    tree with a third of all conversations spreads over partitions. A pack ends before a conversation whose
    new turns would take it over pack_tokens, by their real tokens; the next repeats the turns above its
    first one. Only a single conversation can make a pack larger.
    """
    tidy = only(rows, id=id, turn=turn, role=role, text=text)
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", say("role").alias("role"), say("text").alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    talks = tidy.groupBy("id").agg(turns.alias("turns"))
    talks = talks.withColumn("leaf", F.sha2(F.to_json("turns"), 256))
    members = talks.select(F.col("id").alias(id), "leaf")
    one = talks.groupBy("leaf").agg(F.first("turns").alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = one.withColumn("path", path).repartitionByRange(partitions, "path", "leaf").sortWithinPartitions("path", "leaf").select("leaf", "turns")

    def build(batches):
        enc = encoding(ranks_path, pattern)
        pack, last, made = Pack(enc), [], []  # the turns of the last conversation and their tokens
        for b in batches:
            for leaf, turns in zip(b["leaf"], b["turns"], strict=True):
                talk = [(t["role"], t["text"]) for t in turns]
                same = 0
                while same < min(len(last), len(talk)) and last[same] == talk[same]:
                    same += 1
                last, made = talk, made[:same] + [pack.encoded(t) for t in talk[same:]]
                more = sum(len(head) + len(text) + 1 for head, text in made[pack.shared(talk) :])
                if pack.ends and len(pack.tokens) + more > pack_tokens:
                    yield pack.row()
                    pack = Pack(enc)
                pack.add(leaf, talk, made)
        if pack.ends:
            yield pack.row()

    return map_arrow(ordered, PACK, build), members


def read_back(packs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(leaf, formatted, turns, loss) of each distinct conversation, from the tokens, intervals and masks alone."""

    def read(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            out: dict[str, list] = {"leaf": [], "formatted": [], "turns": [], "loss": []}
            for tokens, mask, nodes, ends in zip(b["tokens"], b["loss_mask"], b["nodes"], b["conversations"], strict=True):
                told = {}  # what each interval says, by its start: read once, however many conversations share it
                for node in nodes:
                    at, end = node["start"], node["end"]
                    formatted = enc.decode_bytes(tokens[at:end]).decode()
                    loss = enc.decode_bytes([t for t, m in zip(tokens[at:end], mask[at:end], strict=True) if m]).decode()
                    told[at] = formatted, [{"role": r, "text": x} for r, x in parse(formatted)], unescape(loss)
                for end in ends:
                    seen = [told[at] for at, _ in attended(nodes, end["node"])]
                    out["leaf"].append(end["leaf"])
                    out["formatted"].append("".join(x[0] for x in seen))
                    out["turns"].append([t for x in seen for t in x[1]])
                    out["loss"].append("".join(x[2] for x in seen))
            yield out

    return map_arrow(packs, "leaf string, formatted string, turns array<struct<role:string,text:string>>, loss string", read, rows=16)


def digests(talks: DataFrame) -> DataFrame:
    """(leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back returns."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_members(found: DataFrame, members: DataFrame, id: str = "conv_id") -> DataFrame:
    """found, by leaf, for each conversation; a plain join of two shuffles, which Spark splits where a leaf has many copies."""
    return members.withColumnRenamed("leaf", "leaf_of").join(found, F.col("leaf_of") == F.col("leaf")).select(q(id), *[q(c) for c in found.columns if c != "leaf"])


