"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpuscle.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v array<int>, cluster string, e string"


def plain(rows, k, rounds, size, scale=64):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    for left in range(rounds, -1, -1):
        owned = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
        if left:
            for n in range(len(centres)):
                own = [v for (_, v), (_, o) in zip(kept, owned) if o == n]
                centres[n] = [sum(x) // len(own) for x in zip(*own)] if own else centres[n]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    spread = [sum(d for d, o in owned if o == n) for n in range(len(centres))] if kept else []
    return [(i, o, d, spread[o], sum(spread), sha[o]) for (i, _), (d, o) in zip(kept, owned)] if kept else []


@pytest.mark.parametrize("size,k,rounds", [(3, 5, 3), (2, 16, 6), (64, 16, 3), (3, 4, 0)])
def test_report_equals_plain_rounds(spark, size, k, rounds):
    rng = random.Random(size * k)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5]) if size < 4 else rng.uniform(-1, 1) for _ in range(size)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 3 + [(None, [0.5] * size), (200, None), (201, []), (202, [0.1] * (size + 1)), (203, [None] + [0.0] * (size - 1)), (204, [math.nan] + [0.0] * (size - 1)), (205, [math.inf] + [0.0] * (size - 1)), (206, [1000.7] * size)]
    df = spark.createDataFrame([(i, v, 1, [1], "c", "e") for i, v in rows], SCHEMA).repartition(3)
    found = centroids.cluster_report(df, k=k, rounds=rounds, size=size)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows, k, rounds, size), key=str)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [1.0, -1.0]), (3, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, [1], "c", "e") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, centroids.cluster_report(df, size=2).collect())) == sorted(plain(rows, 16, 3, 2))
    assert centroids.cluster_report(df.limit(0), size=2).collect() == []
    assert centroids.cluster_report(df, size=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_comparisons_are_exact_and_few(monkeypatch):
    """Any change of some centroids: the result is that of all comparisons, though only the needed ones are made."""
    rng = np.random.default_rng(5)
    full, made = centroids.squares, []
    for _ in range(60):
        x, old = rng.integers(-3, 4, (80, 2)), rng.integers(-3, 4, (6, 2))
        owner, distance = centroids.compare(x, np.full(80, -1), np.zeros(80, np.int64), old, np.ones(6, bool))
        new = np.where((rng.random(6) < 0.3)[:, None], rng.integers(-3, 4, (6, 2)), old)
        changed = (new != old).any(1)
        monkeypatch.setattr(centroids, "squares", lambda a, b: made.append(len(a) * len(b)) or full(a, b))
        made.clear()
        now, far = centroids.compare(x, owner, distance, new, changed)
        monkeypatch.setattr(centroids, "squares", full)
        every = full(x, new)
        assert (now == every.argmin(1)).all() and (far == every.min(1)).all()
        lost = int(changed[owner].sum())
        assert sum(made) == lost * 6 + (80 - lost) * int(changed.sum())


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_report(df, size=2).collect()
    big = np.full((1, 64), centroids.LIMIT, np.int64)
    assert centroids.squares(big, -big)[0, 0] == 64 * (2 * centroids.LIMIT) ** 2
