"""Quality classifier: multiple-instance learning with gated attention.

A text is a bag of passages of PASSAGE words. Every passage is encoded: hashed words, pairs of words and word endings have
learnt embeddings, whose mean, with that of some rates, is a passage's representation h. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), is learnt from document labels alone, and the weighted passage representation is
scored. Training takes a sample of labelled rows, those of least hash: at most `sample` rows and, with all their passages, at most
`budget` of these; the first row that would go beyond is where the sample ends (the first row always counts). They are encoded on the
executors, so the driver, which trains by numpy, gets a bounded number of bounded rows. budget=None: rows alone are bounded.
Scores take all passages of whole texts, in Arrow batches with the weights alone broadcast.

Null and empty texts are one empty passage and get a score too. Labels that are null don't train, and rows of held-out ids
never do; without any label, or with one class only, the score is the share of label 1 (0.5 without labels). Repeated
rows get repeated results; an empty table gives an empty one; labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import WORD, by_bytes, hold_cache, materialize, narrow

PASSAGE, HIDDEN, GATE = 64, 24, 12
#: Buckets of word endings, words and pairs of words.
ENDINGS, WORDS, PAIRS = 64, 192, 256
SYMBOLS = frozenset("#*$%&|<>")
STATS = 8
WIDTH = STATS + ENDINGS + WORDS + PAIRS
SAMPLE, BUDGET, EPOCHS, CHARS = 3000, 40_000, 30, 2_000_000
#: Odd multiplier that mixes the hashes of two words into a pair's.
MIX = 0x9E3779B97F4A7C15

_HASHES: dict[str, int] = {}


def _hash(text: str) -> int:
    """A word's 64-bit hash; the cache is bounded."""
    if (k := _HASHES.get(text)) is None:
        if len(_HASHES) > 400_000:
            _HASHES.clear()
        k = _HASHES[text] = xxhash.xxh64_intdigest(text)
    return k


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of each word with the next one."""
    with np.errstate(over="ignore"):
        return (words[:-1] * np.uint64(MIX) ^ words[1:]) * np.uint64(MIX)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of each whole text, and the passages of each text."""
    cut = [WORD.findall(t) for t in texts]
    n = np.array([len(c) for c in cut])
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.r_[0, np.cumsum(bags)]
    place = np.repeat(first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)) // PASSAGE
    words = list(chain.from_iterable(cut))
    rows = first[-1]
    total = lambda values: np.bincount(place, values, rows)
    size = np.bincount(place, minlength=rows)
    per = 1 / np.maximum(size, 1)
    length = np.fromiter(map(len, words), float, len(words))
    last = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:" for w in words), float, len(words))
    stats = [
        size / PASSAGE,
        total(length) * per / 10,
        total(np.fromiter(map(str.isupper, words), float, len(words))) * per,
        total(last) * per,
        total(np.fromiter((not SYMBOLS.isdisjoint(w) for w in words), float, len(words))) * per,
        total(np.fromiter(map(str.isdigit, words), float, len(words))) * per,
        total(np.fromiter((w.isalpha() for w in words), float, len(words))) * per,
        1 - np.bincount(place[_firsts(place, words)], minlength=rows) * per,
    ]
    hold_cache("classifier", _HASHES.clear)
    ends = np.fromiter((_hash(w[-2:]) for w in words), np.uint64, len(words))
    own = np.fromiter(map(_hash, words), np.uint64, len(words))
    # pairs within a passage
    inside = np.flatnonzero(place[:-1] == place[1:]) if len(words) else np.zeros(0, np.int64)
    parts = [(place, ends >> np.uint64(40), ENDINGS), (place, own >> np.uint64(40), WORDS), (place[inside], pair_hashes(own)[inside] >> np.uint64(40), PAIRS)]
    out = np.empty((rows, WIDTH), np.float32)
    out[:, :STATS] = np.stack(stats, 1)
    at = STATS
    for where, hashes, n in parts:
        counts = np.bincount(where * n + (hashes % np.uint64(n)).astype(np.int64), minlength=rows * n).reshape(rows, n)
        out[:, at : at + n] = np.sqrt(counts * per[:, None])
        at += n
    return out, bags


def _firsts(place: np.ndarray, words: list[str]) -> np.ndarray:
    """Where a word stands in its passage for the first time."""
    if not words:
        return np.zeros(0, np.int64)
    code: dict[str, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    return np.unique(place * len(code) + ids, return_index=True)[1]


class GatedAttention:
    """Weights of the network; bags are consecutive rows of x."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = {"e": (WIDTH, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": ()}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if s and len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.r_[0, np.cumsum(bags)[:-1]]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), bags))
        a /= np.repeat(np.add.reduceat(a, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bags)
        d = (f["s"] - y) * weight / weight.sum()
        dz = np.repeat(d[:, None] * p["c"], bags, 0)
        da = (dz * f["h"]).sum(1)
        starts = np.r_[0, np.cumsum(bags)[:-1]]
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), bags))
        dt, dg = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"e": f["x"].T @ dh, "eb": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ d, "b": d.sum()}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 11) -> GatedAttention:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        starts, r = np.r_[0, np.cumsum(bags)], np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
                step += 1
                for name, g in self.gradients(x[rows].astype(float), bags[own], y[own], np.ones(len(own))).items():
                    g = g + decay * self.p[name]
                    m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        x, bags = passages(texts)
        return self.forward(x.astype(float), bags)["s"]


class Constant:
    """What is left without labels of both classes."""

    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column) -> Column:
    """The fold that never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: text, y, h. Out: the number of passages of each text and the features of all of them, y, h."""
    for batch in batches:
        at = 0
        for texts in by_bytes(batch.column(0).to_pylist(), CHARS):
            x, bags = passages(texts)
            ends = np.cumsum(bags)
            own = [x[e - n : e].tobytes() for e, n in zip(ends, bags, strict=True)]
            yield pa.record_batch([pa.array(bags.astype(np.int64)), pa.array(own, pa.binary()), batch.column(1).slice(at, len(texts)), batch.column(2).slice(at, len(texts))], names=["n", "x", "y", "h"])
            at += len(texts)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", sample: int = SAMPLE, budget: int | None = BUDGET) -> GatedAttention | Constant:
    """Trains on whole rows of docs whose ids are labelled and not held out: at most sample rows, with at most budget passages."""
    marks = narrow(labels, _id="doc_id", y=label_col).where(F.col("y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.min("y").cast("int").alias("y")).withColumn("h", F.xxhash64("_id")).orderBy("h", "_id").limit(sample)
    # at most `sample` rows of three numbers, so the documents stay where they are
    rows = narrow(docs, doc_id="doc_id", text=text_col).join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "y", "h")
    rows = materialize(rows.mapInArrow(_encode, "n bigint, x binary, y int, h bigint").withColumn("k", F.md5("x")), "bags")
    sizes = rows.select("h", "k", "n").orderBy("h", "k").limit(sample).collect()
    total = np.cumsum([r["n"] for r in sizes])
    fit = len(sizes) if budget is None else max(1, int(np.searchsorted(total, budget, "right")))
    last = F.lit(sizes[min(fit, len(sizes)) - 1]["h"]) if sizes else F.lit(0)
    rows = rows.where(F.col("h") <= last).select("x", "y", "h", "k").orderBy("h", "k").limit(min(fit, len(sizes))).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    bags = np.array([len(r["x"]) // (4 * WIDTH) for r in rows])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, WIDTH)
    return GatedAttention().fit(x, bags, y)


def _score(batches: Iterator[pa.RecordBatch], model: GatedAttention | Constant, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = np.concatenate([model.score(t) for t in by_bytes(batch.column(2).to_pylist(), CHARS)])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_texts(docs: DataFrame, model: GatedAttention | Constant, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text."""
    given = narrow(docs, doc_id="doc_id", text=text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    return score_texts(docs, train(docs, labels, sample=sample), threshold)
