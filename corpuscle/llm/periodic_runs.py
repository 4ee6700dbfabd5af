"""Periodic runs of words, found by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of consecutive words with smallest period q, at least max(least, 2 q) words long, that no neighbouring
word extends with that period. Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0.

For two prefixes that end q words apart, the state where their end positions first meet in the tree of suffix links is as
long as what they have in common at the end. So neighbours of a merged set that weren't neighbours before, at a distance q
of no more than the state's length n, are a square whose run starts at n words before the first of them, and has no
smaller period (else another end position would lie between). The last such pair of a run ends where the run ends, and
its state has at least half of the run's words: states below least / 2 needn't be merged, and the seeds of one start and
period are one run, whose end is that of the last.

An exact sieve goes before it: in a run of at least `least` words each word lies in some (least / 2)-gram that stands in
the run twice. Words in no such gram cut a text; what is left is sieved again within its own stretch until it stays as it is.

A null or empty text has no words and no runs, and collapses to the empty text; repeated rows come out as often as they
occur, null ids stay, an empty table gives an empty one, and other columns are not read. A text of any length is one
automaton a stretch: its memory is in proportion to the words that may lie in runs.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import WORD, narrow, no_collection

LEAST = 12
#: Bytes of text that are sieved at once.
BYTES = 2_000_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves few of them."""

    BLOCK = 512

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops[k : k + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[k] = block[-1]
        self.size += 1

    def beside(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.tops[k - 1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after


def suffix_automaton(words: list[int]) -> tuple[array, array, array]:
    """Length and suffix link of each state, and the state of each prefix. State 0 is the root, with link -1.

    Most states have one transition: it stands in two arrays, and only further ones in a dict of the state.
    """
    size = 2 * len(words) + 2
    length, link, first, goto = (array("q", [v]) * size for v in (0, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    prefix, last, n = array("q", bytes(8 * len(words))), 0, 1
    for at, c in enumerate(words):
        new, n = n, n + 1
        length[new] = at + 1
        p, q = last, -1
        while p >= 0:
            if first[p] == c:
                q = goto[p]
                break
            if first[p] < 0:
                first[p], goto[p] = c, new
            elif p in more:
                if (q := more[p].get(c, -1)) >= 0:
                    break
                more[p][c] = new
            else:
                more[p] = {c: new}
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[p] + 1 == length[q]:
            link[new] = q
        else:
            clone, n = n, n + 1
            length[clone], link[clone], first[clone], goto[clone] = length[p] + 1, link[q], first[q], goto[q]
            if q in more:
                more[clone] = dict(more[q])
            link[q] = link[new] = clone
            while p >= 0:
                if first[p] == c and goto[p] == q:
                    goto[p] = clone
                elif p in more and more[p].get(c) == q:
                    more[p][c] = clone
                else:
                    break
                p = link[p]
        prefix[at] = last = new
    return length[:n], link[:n], prefix


def stretch_runs(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    length, link, prefix = suffix_automaton(words)
    own = {s: at for at, s in enumerate(prefix)}
    sizes = np.frombuffer(length, np.int64)
    states = np.flatnonzero(2 * sizes >= least)
    states = states[np.argsort(-sizes[states], kind="stable")].tolist()
    kids: dict[int, list[Ends]] = {}
    ends: dict[tuple[int, int], int] = {}
    for s in states:
        sets = kids.pop(s, [])
        if s in own:
            sets.append(Ends(own[s]))
        if len(sets) > 1:
            sets.sort(key=lambda x: x.size)
            merged, n = sets.pop(), length[s]
            came = {x: k for k, small in enumerate(sets) for x in small}
            for x in came:
                merged.add(x)
            for x, k in came.items():
                before, after = merged.beside(x)
                if before is not None and x - before <= n and came.get(before) != k:
                    key = before - n + 1, x - before
                    ends[key] = max(ends.get(key, 0), x)
                if after is not None and after - x <= n and came.get(after) != k:
                    key = x - n + 1, after - x
                    ends[key] = max(ends.get(key, 0), after)
            sets = [merged]
        kids.setdefault(link[s], []).extend(sets)
    return sorted((start, end - start + 1, q) for (start, q), end in ends.items() if end - start + 1 >= max(least, 2 * q))


def sieve(marks: np.ndarray, cuts: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (start, end) of words, in order, that hold all runs. marks: a number for each word, equal for equal words; cuts: the first words of texts.

    Grams are compared by a sum of powers that wraps around: unequal ones that agree only let more through.
    """
    k = (least + 1) // 2
    edges = np.zeros(len(marks) + 1, bool)
    edges[cuts] = edges[0] = edges[-1] = True
    at = np.flatnonzero(edges)
    a, b = at[:-1], at[1:]
    gram = np.zeros(len(marks), np.uint64)
    for j in range(min(k, len(marks))):
        gram[: len(marks) - j] += marks[j:].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
    while len(a):
        keep = b - a >= least
        a, b = a[keep], b[keep]
        n = b - a
        if not len(n):
            break
        first = np.cumsum(n) - n
        place = np.repeat(a - first, n) + np.arange(n.sum())
        which = np.repeat(np.arange(len(a)), n)
        whole = place + k <= b[which]
        mixed = (gram[place] ^ (which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        place, mixed = place[whole], mixed[whole]
        order = np.argsort(mixed)
        same = mixed[order[1:]] == mixed[order[:-1]]
        twice = np.zeros(len(place), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(len(marks) + 1, np.int32)
        np.add.at(step, place[twice], 1)
        np.add.at(step, place[twice] + k, -1)
        covered = np.cumsum(step[:-1]) > 0
        # texts that stand side by side stay apart
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        starts[a] |= covered[a]
        stops = np.flatnonzero(np.r_[(covered[:-1] & ~covered[1:]) | (covered[:-1] & starts[1:]), covered[-1:]]) + 1
        new_a = np.flatnonzero(starts)
        if len(new_a) == len(a) and (new_a == a).all() and (stops == b).all():
            break
        a, b = new_a, stops
    return list(zip(a.tolist(), b.tolist(), strict=True))


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cuts = np.cumsum(sizes) - sizes
    marks = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(marks):
        return out
    filled = np.flatnonzero(sizes)
    for a, b in sieve(marks, cuts[filled], least):
        t = int(filled[np.searchsorted(cuts[filled], a, "right") - 1])
        base = a - int(cuts[t])
        ids: dict[bytes, int] = {}
        words = [ids.setdefault(w, len(ids)) for w in texts[t][base : b - int(cuts[t])]]
        out[t] += [(s + base, n, q) for s, n, q in stretch_runs(words, least)]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int32)
    for start, n, q in runs:
        step[start + q] += 1
        step[start + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and then period) and the collapsed text.

    The collapsed text has the words, joined by one space, that lie in no run after its first period.
    """
    if least < 2:
        raise ValueError("runs have two words at least")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()), 0
            while at < len(texts):
                parts, size, begin = [], 0, at
                while at < len(texts) and size < BYTES:
                    text = texts[at].as_py() or b""
                    parts.append(text.split())  # of bytes: at 20 and 09 to 0D, as WORD has it
                    size += len(text)
                    at += 1
                with no_collection():
                    runs = text_runs(parts, least)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, at - begin),
                    pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], pa.list_(RUN)),
                    pa.array([collapse(p, rs) for p, rs in zip(parts, runs, strict=True)], pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(solve, SCHEMA)


def repeat_tail(text: Column, first: Column, period: Column) -> Column:
    """The text's words joined by a space, those from word `first` on replaced by the `period` words there, again and again."""

    def tail(w: Column) -> Column:
        n = F.size(w)
        again = F.flatten(F.array_repeat(F.slice(w, first(n) + 1, period(n)), (F.floor((n - first(n)) / period(n)) + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), first(n)), F.slice(again, F.lit(1), n - first(n))), " ")

    words = F.regexp_extract_all(text, F.lit(f"({WORD.pattern})"), F.lit(1))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))[0]


def digests(found: DataFrame) -> DataFrame:
    """find_runs() as one row of numbers and digests a document, with the longest run (ties: least start, then period)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.a")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"), F.expr("1000 * best.n div -best.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
