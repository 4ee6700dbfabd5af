"""Superposition and divergence of many frames: no group a frame, no row a pair."""

from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import learn, trajectory


def table(spark, x, first=0):
    return spark.createDataFrame([(first + f, a, *map(float, p)) for f, frame in enumerate(x) for a, p in enumerate(frame)], "frame bigint, idx bigint, x double, y double, z double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_superimpose_in_batches(spark):
    """Frames of different atoms, mirrored ones, and a fit on some atoms, as rotation() moves each alone."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(7, 6, 3)) * 5
    x[3] = x[0] * [1, 1, -1]
    s = table(spark, x).where("not (frame = 5 and idx = 2) and not (frame = 6 and idx < 2)")
    for some in (None, [0, 2, 3, 4, 5]):
        found = trajectory.superimpose_trajectory(s, 0, some and s.select("idx").where(F.col("idx").isin(some)).distinct())
        assert "FlatMapGroupsInPandas" not in plan(found)
        rows = {(r["frame"], r["idx"]): (r["x"], r["y"], r["z"]) for r in found.collect()}
        assert len(rows) == 7 * 6 - 3
        for f in range(7):
            own = [a for a in range(6) if (f, a) in rows]
            fit = [a for a in own if not some or a in some]
            r, t = trajectory.rotation(x[f][fit], x[0][fit])
            assert np.allclose([rows[f, a] for a in own], x[f][own] @ r.T + t)


@pytest.mark.parametrize("block", [None, 5])
def test_divergent_frames_equal_brute_force(spark, block):
    """Copies, whose distance is zero and which tie, and frames far from the origin; no row leaves a pair of blocks for a pair of frames."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 3, 3)) + 1e4
    x = np.concatenate([x, x[[0, 3, 3, 7]], x[:4]])
    want = sorted((-float(np.sqrt(((x[i] - x[j]) ** 2).sum() / 3)), i, j) for i in range(20) for j in range(i + 1, 20))
    s = table(spark, x)
    for top in (3, 10):
        pairs, mean = trajectory.divergent_frames(s, top, block=block)
        rows = sorted((-r["rmsd"], r["i"], r["j"]) for r in pairs.collect())
        assert [r[1:] for r in rows] == [w[1:] for w in want[:top]] and np.allclose([r[0] for r in rows], [w[0] for w in want[:top]])
    above = [-w[0] for w in want if w[0] < 0]
    assert len(above) < len(want) and mean.first()["mean"] == pytest.approx(np.mean(above), rel=1e-9)
    assert trajectory.divergent_frames(table(spark, x[:1]))[1].first()["mean"] is None
    # equal frames alone: all pairs are ties at zero
    pairs, mean = trajectory.divergent_frames(table(spark, x[[0] * 6]), 4, block=block)
    assert [(r["i"], r["j"], r["rmsd"]) for r in pairs.collect()] == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (0, 4, 0)] and mean.first()["mean"] is None


def test_divergent_frames_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "TILE_ROWS", 4)
    monkeypatch.setattr(trajectory, "TILE_COLUMNS", 8)
    x = np.random.default_rng(6).integers(0, 3, (40, 2, 3)).astype(float)
    s = table(spark, x)
    for align in (False, True):
        matrix = trajectory.rmsd_matrix(s, align)
        t = pd.DataFrame({"coords": list(x.reshape(40, -1)), "n": [1] * 40, "ids": [[k] for k in range(40)]})
        count, total, best = trajectory.block_divergence(t, t, True, 5, align)
        want = sorted((-round(r["rmsd"], 6), r["i"], r["j"]) for r in matrix.collect())
        assert total == pytest.approx(-sum(w[0] for w in want), rel=1e-5) and len(best) == 5
        assert [round(b[0], 5) for b in best] == [round(-w[0], 5) for w in want[:5]]
        if not align:
            assert [b[1:] for b in best] == [w[1:] for w in want[:5]]


def test_ward_blocks_grow_slower_than_frames(monkeypatch):
    """A round shuffles each frame once a block: blocks are no more than before for few frames, and a quarter for many."""
    made = []
    monkeypatch.setattr(learn, "deal_blocks", lambda rows, key, blocks: made.append(blocks) or (_ for _ in ()).throw(StopIteration))
    for count, most in ((5000, 4), (10256, 4), (102564, 13), (615384, 19)):
        with pytest.raises(StopIteration):
            learn._ward_round(MagicMock(), count, min(learn.WARD_BLOCK, learn.WARD_VALUES // 63))
        assert made[-1] <= most


def test_aligned_matrices_decompose_few_pairs(monkeypatch):
    r = np.random.default_rng(4)
    a, b = r.normal(0, 5, (40, 7, 3)), r.normal(0, 5, (30, 7, 3))
    b[0], b[1], b[2] = a[0], -a[1], a[2] * [1, 1, 0]  # alike, mirrored, flat
    svd, seen = np.linalg.svd, []
    x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    h = np.einsum("ikc,jkd->ijcd", x, y)
    values = svd(h, compute_uv=False)
    values[..., 2] *= np.sign(np.linalg.det(h))
    want = np.sqrt(np.maximum((x * x).sum((1, 2))[:, None] + (y * y).sum((1, 2))[None] - 2 * values.sum(-1), 0) / 7)
    monkeypatch.setattr(np.linalg, "svd", lambda h, **k: (seen.append(len(h)), svd(h, **k))[1])
    assert np.abs(trajectory.block_rmsd(a, b, True) - want).max() < 1e-6 and 0 < sum(seen) < 200


def test_matrices_shuffle_few_copies(spark, monkeypatch):
    counts = []
    deal = trajectory.deal_blocks
    monkeypatch.setattr(trajectory, "deal_blocks", lambda rows, key, blocks: (counts.append(blocks), deal(rows, key, blocks))[1])
    s = spark.range(3000).select("id", F.col("id").alias("frame"), F.lit(0).alias("idx"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    assert trajectory.rmsd_matrix(s, False).agg(F.count("*"), F.max("j"), F.sum((F.col("rmsd") > 0).cast("int"))).first() == (3000 * 2999 // 2, 2999, 3000 * 2999 // 2) and counts == [3]
    assert {(r['i'], r['j'], r['rmsd']) for r in trajectory.rmsd_matrix(s.where('id < 3'), False, digits=4).collect()} == {(0, 1, 1.7321), (0, 2, 3.4641), (1, 2, 1.7321)}
