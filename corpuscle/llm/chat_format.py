"""Chat formatting as a prefix tree.

Conversations are sorted by the content of their turns over the whole table, so each range of the sort is a depth-first
walk of the tree: a turn is emitted once, where it first differs from the conversation before, and later conversations
refer to it. Each range is cut into packs (turns shared across a cut are emitted once in each pack), so a first turn that a
third of all conversations share is split like any other; what the next conversation may share doesn't count towards a pack's size.

A pack is a text, its token ids, and one node for each turn: where the node stands, the position id of its first code point
or token (that of its parent's end), the parent, the loss span, and the attention intervals: the node and its ancestors,
adjacent ones joined. All of these are given in code points of the text and, with a vocabulary, in tokens as well; a turn's head, text and
end are encoded apart, so the loss mask starts and stops between tokens.

Template: `<s>role[INST]text[/INST]</s>`. Inside roles and texts a backslash is doubled and a backslash is put after the
first character of each control string, which unescape() takes back.

Turns are ordered by turn, role and text (null first); repeated rows are repeated turns. Null roles and texts are empty;
null conversation ids are one conversation. An empty table gives no packs; other columns are not read. One conversation's
turns meet in one task, as its digest needs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import bpe
from corpuscle.llm.common import narrow

#: Control strings of the template and of templates near it.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
#: Code points and conversations from which a pack is closed, entries of the encoder's cache.
PACK_CHARS, PACK_CONVERSATIONS, CACHE = 200_000, 2_000, 100_000

_SPAN = "struct<start bigint, stop bigint>"
_PLACE = f"struct<start bigint, stop bigint, position bigint, loss_start bigint, loss_stop bigint, attend array<{_SPAN}>>"
#: chars: in code points of text; tokens: in ids (null without a vocabulary).
PACK_SCHEMA = f"text string, ids array<int>, nodes array<struct<parent int, chars {_PLACE}, tokens {_PLACE}>>, conversations array<struct<conv_id bigint, leaf int>>"
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_ARROW_PLACE = pa.struct([*((c, pa.int64()) for c in ("start", "stop", "position", "loss_start", "loss_stop")), ("attend", pa.list_(_ARROW_SPAN))])
_ARROW_NODE = pa.struct([("parent", pa.int32()), ("chars", _ARROW_PLACE), ("tokens", _ARROW_PLACE)])
_ARROW_PACK = pa.schema([("text", pa.string()), ("ids", pa.list_(pa.int32())), ("nodes", pa.list_(_ARROW_NODE)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, text and end of the formatted turn."""
    return f"<s>{escape(role)}[INST]", escape(text), "[/INST]</s>"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _place(above: dict | None, start: int, sizes: list[int], loss: bool) -> dict:
    """A node of parts of the given sizes that is appended at start, below another."""
    stop, attend = start + sum(sizes), [dict(x) for x in above["attend"]] if above else []
    if attend and attend[-1]["stop"] == start:
        attend[-1]["stop"] = stop
    else:
        attend.append({"start": start, "stop": stop})
    first = start + sizes[0]
    return {"start": start, "stop": stop, "position": above["position"] + above["stop"] - above["start"] if above else 0, "loss_start": first if loss else None, "loss_stop": first + sizes[1] if loss else None, "attend": attend}


class Pack:
    """A prefix tree that grows depth first. encoded: the ids of heads, texts and ends, if there is a vocabulary."""

    def __init__(self, loss_roles: tuple[str, ...], encoded: dict[str, list[int]] | None = None):
        self.loss_roles, self.encoded = loss_roles, encoded
        self.parts, self.size, self.ids, self.nodes, self.conversations, self.stack = [], 0, [], [], [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.stack)) and self.stack[shared][0] == turns[shared]:
            shared += 1
        del self.stack[shared:]
        for turn in turns[shared:]:
            parent = self.stack[-1][1] if self.stack else -1
            above = self.nodes[parent] if parent >= 0 else {"chars": None, "tokens": None}
            parts, loss = format_turn(*turn), turn[0] in self.loss_roles
            node = {"parent": parent, "chars": _place(above["chars"], self.size, list(map(len, parts)), loss), "tokens": None}
            if self.encoded is not None:
                own = [self.encoded[x] for x in parts]
                node["tokens"] = _place(above["tokens"], len(self.ids), list(map(len, own)), loss)
                for x in own:
                    self.ids += x
            self.stack.append((turn, len(self.nodes)))
            self.nodes.append(node)
            self.parts += parts
            self.size = node["chars"]["stop"]
        self.conversations.append({"conv_id": conv_id, "leaf": self.stack[-1][1]})

    def full(self) -> bool:
        path = sum(x["stop"] - x["start"] for x in (self.nodes[k]["chars"] for _, k in self.stack))
        return self.size - path >= PACK_CHARS or len(self.conversations) >= PACK_CONVERSATIONS

    def row(self) -> pa.RecordBatch:
        row = ["".join(self.parts), self.ids if self.encoded is not None else None, self.nodes, self.conversations]
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _ARROW_PACK, strict=True)], schema=_ARROW_PACK)


def _encoded(turns: set[tuple[str, str]], vocabulary: tuple[str, str]) -> dict[str, list[int]]:
    """The ids of all parts of the formatted turns."""
    own = bpe.codec(*vocabulary)
    own.cache = CACHE
    parts = sorted({x for t in turns for x in format_turn(*t)})
    return {x: np.frombuffer(ids, "<u4").tolist() for x, ids in zip(parts, own.encode(parts), strict=True)}


def _pack(batches: Iterator[pa.RecordBatch], loss_roles: tuple[str, ...], vocabulary: tuple[str, str] | None) -> Iterator[pa.RecordBatch]:
    pack = Pack(loss_roles, {} if vocabulary else None)
    for batch in batches:
        own = [[(t["role"], t["text"]) for t in turns] for turns in batch.column(1).to_pylist()]
        if vocabulary:
            pack.encoded = _encoded({t for turns in own for t in turns}, vocabulary)
        for conv, turns in zip(batch.column(0).to_pylist(), own, strict=True):
            pack.add(conv, turns)
            if pack.full():
                yield pack.row()
                pack = Pack(loss_roles, pack.encoded)
    if pack.conversations:
        yield pack.row()


def pack_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each pack: text, ids, nodes and conversations (the leaf of each). vocabulary: a rank file and its pattern."""
    empty = F.lit("")
    given = narrow(rows, conv_id="conv_id", turn="turn", role="role", text="text").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    whole = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.hex(F.xxhash64(t["role"], t["text"]))), "")
    walk = whole.withColumn("path", path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return walk.select("conv_id", "turns").mapInArrow(partial(_pack, loss_roles=loss_roles, vocabulary=vocabulary), PACK_SCHEMA)


def path_of(nodes: list[dict], leaf: int) -> list[dict]:
    """The nodes of a conversation from its first turn to its leaf."""
    out = []
    while leaf >= 0:
        out.append(nodes[leaf])
        leaf = nodes[leaf]["parent"]
    return out[::-1]


def conversation_text(text: str, nodes: list[dict], leaf: int) -> tuple[str, str]:
    """What the leaf attends to, and the text under its loss mask, unescaped."""
    formatted = "".join(text[s["start"] : s["stop"]] for s in nodes[leaf]["chars"]["attend"])
    own = (n["chars"] for n in path_of(nodes, leaf))
    return formatted, "".join(unescape(text[n["loss_start"] : n["loss_stop"]]) for n in own if n["loss_start"] is not None)


def conversation_ids(ids: np.ndarray, nodes: list[dict], leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, position ids and loss mask of a conversation, as its leaf attends to them."""
    own = np.concatenate([ids[s["start"] : s["stop"]] for s in nodes[leaf]["tokens"]["attend"]])
    path = [n["tokens"] for n in path_of(nodes, leaf)]
    positions = np.concatenate([np.arange(n["stop"] - n["start"]) + n["position"] for n in path])
    mask, at = np.zeros(len(positions), bool), 0
    for n in path:
        if n["loss_start"] is not None:
            mask[at + n["loss_start"] - n["start"] : at + n["loss_stop"] - n["start"]] = True
        at += n["stop"] - n["start"]
    return own, positions, mask


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens", "tokens_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for k in range(batch.num_rows):
            text, nodes, conversations = (batch.column(c)[k].as_py() for c in (0, 2, 3))
            ids = batch.column(1)[k].values.to_numpy() if batch.column(1)[k].is_valid else None
            out = []
            for c in conversations:
                formatted, loss = conversation_text(text, nodes, c["leaf"])
                turns = read_turns(formatted)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                tokens = (None, None, None)
                if ids is not None:
                    own, positions, mask = conversation_ids(ids, nodes, c["leaf"])
                    if len(positions) != len(own) or (positions != np.arange(len(own))).any():
                        raise ValueError("attention intervals and position ids differ")
                    tokens = len(own), int(mask.sum()), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest()
                out.append((c["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), *tokens))
            yield pa.record_batch([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(packs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens and tokens_sha256, from
    the packs alone; the last three are null in packs without ids."""
    return packs.mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint, tokens_sha256 string")
