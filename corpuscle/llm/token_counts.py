"""Token counts by rank-synchronous array merging.

Distinct words lie end to end in one symbol array (a ragged array: symbols and the word of each). In every round each
word's pair of lowest rank is applied at all its places at once, and the symbols that survive are counted. That equals
merging one place at a time because a merged symbol only enters pairs of higher rank, which is checked when a vocabulary
is read. Counts of chunks are kept in a bounded cache between batches.

Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows give repeated results, an empty table
an empty one, and other columns are not read. Strings of added tokens count as one token each, the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpuscle.llm.common import CHUNK, by_bytes, hold_cache, narrow

CACHE, CHARS, SYMBOLS = 400_000, 4_000_000, 2_000_000
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible Latin-1, else the next from U+0100."""
    out, n = [], 0
    for b in range(256):
        visible = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b) if visible else chr(0x100 + n))
        n += not visible
    return out


class PieceCounter:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("end_of_word_suffix") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only plain byte-level BPE vocabularies are counted")
        vocab = model["vocab"]
        self.size = len(vocab)
        self.base = np.array([vocab[s] for s in byte_symbols()], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its parts")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[order, 0].astype(np.int32), np.r_[made[order], 0].astype(np.int32)
        self.new_of = made.astype(np.int32)
        self.pattern = regex.compile(pattern)
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.cache: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """The symbols that survive of each word; no word may be empty."""
        counts = np.zeros(len(words), np.int64)
        ids = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        last = np.r_[word[1:] != word[:-1], True]
        rank = np.full(len(ids), NONE, np.int32)  # of the pair that a symbol makes with the next
        rank[~last] = self._rank(ids[:-1], ids[1:])[~last[:-1]]
        while len(ids):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            counts[word[starts[done]]] = sizes[done]
            stay = np.repeat(~done, sizes)
            low = np.repeat(low[~done], sizes[~done])
            ids, word, last, rank = ids[stay], word[stay], last[stay], rank[stay]
            if not len(ids):
                break
            hit = np.flatnonzero(rank == low)
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])  # places that overlap follow one another
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            ids[hit] = self.new_of[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols come to lie
            ids, word, last, rank = ids[keep], word[keep], last[keep], rank[keep]
            touched = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            rank[touched] = NONE
            touched = touched[~last[touched]]
            rank[touched] = self._rank(ids[touched], ids[touched + 1])
        return counts

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        parts, extra = [], []
        for t in texts:
            own = self.added.split(t) if self.added else [t]
            extra.append(len(own) - 1)
            parts.append(CHUNK.findall(own[0]) if len(own) == 1 else list(chain.from_iterable(map(CHUNK.findall, own))))
        new = list(set(chain.from_iterable(parts)) - self.cache.keys())
        pieces = [self.pattern.findall(c) for c in new]
        distinct = dict.fromkeys(chain.from_iterable(pieces))
        words, at = list(distinct), 0
        while at < len(words):
            n, size, raw = at, 0, []
            while n < len(words) and (n == at or size < SYMBOLS):
                raw.append(words[n].encode())
                size, n = size + len(raw[-1]), n + 1
            distinct.update(zip(words[at:n], self.count_words(raw).tolist(), strict=True))
            at = n
        get = distinct.__getitem__
        self.cache.update((c, sum(map(get, p))) for c, p in zip(new, pieces, strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, p)) + n for p, n in zip(parts, extra, strict=True)]


_COUNTERS: dict[tuple[str, str], PieceCounter] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, limit: int) -> Iterator[pa.RecordBatch]:
    hold_cache("counts", _COUNTERS.clear)
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = PieceCounter(path, pattern)
    own = _COUNTERS[path, pattern]
    for batch in batches:
        n = pa.array(chain.from_iterable(own.count(t) for t in by_bytes(batch.column(1).to_pylist(), CHARS)), pa.int64())
        size = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_string())), 0).cast(pa.int64())
        yield pa.record_batch([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(df: DataFrame, vocab_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether these are over limit, for each whole text."""
    given = narrow(df, doc_id=id_col, text=text_col)
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(partial(_count, path=vocab_path, pattern=pattern, limit=limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
