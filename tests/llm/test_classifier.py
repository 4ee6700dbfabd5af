"""The classifier against a forward pass in plain Python, and the bounds of its sample."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpuscle.llm import quality_classifier as q
from corpuscle.llm.common import WORD


def brute_features(words):
    """Rates and hashed shares of one passage."""
    n, per = len(words), 1 / max(1, len(words))
    count = lambda test: sum(map(test, words)) * per
    out = [n / q.PASSAGE, sum(map(len, words)) * per / 10, count(str.isupper), count(lambda w: not w[-1].isalnum() and w[-1] not in ".,;:"), count(lambda w: any(c in q.SYMBOLS for c in w)), count(str.isdigit), count(str.isalpha), 1 - len(set(words)) * per]
    full = 1 << 64
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    pairs = [((a * q.MIX % full ^ b) * q.MIX) % full for a, b in zip(hashes, hashes[1:])]
    for values, size in (([xxhash.xxh64_intdigest(w[-2:]) for w in words], q.ENDINGS), (hashes, q.WORDS), (pairs, q.PAIRS)):
        seen = Counter((v >> 40) % size for v in values)
        out += [math.sqrt(seen[k] * per) for k in range(size)]
    return out


def brute_score(model, text):
    words = WORD.findall(text or "")
    bag = [words[k : k + q.PASSAGE] for k in range(0, len(words), q.PASSAGE)] or [[]]
    p = {k: np.asarray(v).tolist() for k, v in model.p.items()}
    dot = lambda row, matrix, j: sum(a * matrix[i][j] for i, a in enumerate(row))
    hidden, logits = [], []
    for part in bag:
        x = [max(-8, min(8, (float(np.float32(v)) - m) / s)) for v, m, s in zip(brute_features(part), model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(dot(x, p["e"], j) + p["eb"][j]) for j in range(q.HIDDEN)]
        gate = [math.tanh(dot(h, p["v"], j)) / (1 + math.exp(-dot(h, p["u"], j))) for j in range(q.GATE)]
        hidden.append(h)
        logits.append(sum(g * w for g, w in zip(gate, p["w"])))
    weight = [math.exp(v - max(logits)) for v in logits]
    z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, p["c"])) + p["b"])))


def texts():
    rng = random.Random(8)
    words = ["the", "Cat", "SAT,", "on", "mat.", "42", "$$$", "über", "x|y", "日本語", "a\x1cb", "—"]
    return [None, "", " \n", "one", *[" ".join(rng.choice(words) for _ in range(rng.choice([3, 63, 64, 65, 128, 700]))) for _ in range(40)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", 0.5) for k, t in enumerate(texts())] + [(7, texts()[7], "en", 0.5), (None, "x " * 90, "en", 0.5)], "doc_id long, text string, lang string, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int("$$$" not in (t or "")[:40])) for k, t in enumerate(texts())], "doc_id long, quality int")


def test_scores_equal_a_plain_forward_pass(docs, labels):
    model = q.train(docs, labels)
    assert isinstance(model, q.GatedAttention) and len(set(model.mean.tolist())) > 20
    for r in q.score_texts(docs, model).collect():
        text = next((d["text"] for d in docs.where("doc_id is null").collect()), None) if r["doc_id"] is None else texts()[r["doc_id"]]
        want = brute_score(model, text)
        assert r["score"] == pytest.approx(want, abs=1e-6) and (r["predicted"] == int(want >= 0.7) or abs(want - 0.7) < 1e-6)


def test_rows_of_the_sample_are_whole(docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(q.GatedAttention, "fit", lambda self, x, bags, y: seen.append((len(x), bags.tolist())) or self)
    size = lambda t: max(1, -(-len(WORD.findall(t or "")) // q.PASSAGE))
    for budget in (None, 60, 25):
        q.train(docs, labels, budget=budget)
    every, some, few = (b for _, b in seen)
    fold = [k for k in range(len(texts())) if __import__("zlib").crc32(str(k).encode()) % 4 != 2]
    assert sorted(every) == sorted([size(texts()[k]) for k in fold] + ([size(texts()[7])] if 7 in fold else []))
    assert some == every[: len(some)] and few == every[: len(few)] and sum(few) <= 25 < sum(few) + every[len(few)] and sum(some) <= 60 < sum(some) + every[len(some)]
    assert [n for n, _ in seen] == [sum(b) for _, b in seen]
    q.train(docs, labels, sample=4)
    assert seen[-1][1] == every[:4]
