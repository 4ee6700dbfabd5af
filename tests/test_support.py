"""Support vectors fitted by rounds over all rows, held against one solver over one kernel."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuscle.operators import kernels, learn


def _direct(x, y, held):
    """Predictions of the rows by the rows outside held, by one dual over one kernel."""
    own = ~held
    mean, std = x[own].mean(0), x[own].std(0, ddof=1)
    z = (x - mean) * np.divide(1, std, out=np.zeros_like(std), where=std > 0)
    gamma = 1 / (z[own].var() * x.shape[1])
    w, b = kernels.support_weights(kernels.radial(z[own], z[own], gamma), y[own], 1.0, 0.1, 1e-5)
    return kernels.radial(z, z[own], gamma) @ w + b


@pytest.mark.parametrize("working", [2000, 12])
def test_rounds_find_the_optimum_of_all_rows(spark, working):
    r = np.random.default_rng(5)
    x = np.c_[r.normal(size=(90, 2)), np.full(90, 3.0)]  # the last feature tells nothing
    x[40:45] = x[0]  # repeated rows, and ties
    y = np.sin(x[:, 0] * 2) + x[:, 1] ** 2
    y[40:43] = y[0]
    rows = spark.createDataFrame([(k, [float(v) for v in a], float(b)) for k, (a, b) in enumerate(zip(x, y))], "n int, v array<double>, y double").repartition(3)
    model, scores = learn.fit_model(rows, "v", "y", "n", "svr", working=working)
    fold = np.arange(90) // 18
    r2 = lambda seen, true: 1 - ((seen - true) ** 2).sum() / ((true - true.mean()) ** 2).sum()
    whole = _direct(x, y, fold < 0)
    found = {p["n"]: p["predicted"] for p in learn.predict(model, rows, "v").collect()}
    assert max(abs(found[k] - whole[k]) for k in range(90)) < 2e-2
    assert scores["train_r2"] == pytest.approx(r2(whole, y), abs=2e-3)
    held = [_direct(x, y, fold == k)[fold == k] for k in range(5)]
    assert scores["cv_r2"] == pytest.approx(np.mean([r2(h, y[fold == k]) for k, h in enumerate(held)]), abs=1e-2)


def test_support_in_blocks(spark, monkeypatch):
    """A model whose vectors are sent in blocks predicts as one that sends them at once; one value everywhere has no vectors."""
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 5 * k)) for k in range(40)], "n int, a double, y double")
    model, _ = learn.fit_model(rows, ["a"], "y", "n", "svr")
    at_once = {r["n"]: r["predicted"] for r in learn.predict(model, rows, ["a"]).collect()}
    monkeypatch.setattr(kernels, "WORKING", 7)
    blocks = {r["n"]: r["predicted"] for r in learn.predict(model, rows, ["a"]).collect()}
    assert blocks == pytest.approx(at_once)
    flat, scores = learn.fit_model(rows.withColumn("y", F.lit(2.0)), ["a"], "y", "n", "svr")
    assert scores["cv_rmse"] == pytest.approx(0, abs=0.1) and model.stages[0].support.count() > 0
    assert {r["predicted"] for r in learn.predict(flat, rows, ["a"]).collect()} == {2.0}
    assert flat.transform(rows.limit(0).withColumn("raw", array_to_vector(F.array("a")))).count() == 0


def test_features_never_pass_the_driver(spark, monkeypatch):
    """What the driver gets of a round is weights and a few slopes of each block; a set is no larger than it may be, however many rows tie."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, [float(v) for v in r.normal(size=5)], float(k % 9)) for k in range(120)], "n int, v array<double>, y double")
    seen, kind = [], type(rows)
    given = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda df: (seen.append(df.columns), given(df))[1])
    learn.fit_model(rows, "v", "y", "n", "svr", working=40)
    assert seen and not any("raw" in columns for columns in seen)

    flat = [kernels._Block(np.arange(k, k + 300), np.zeros((300, 1)), np.full(300, float(k)), np.zeros(300, int), np.zeros((300, 2)), np.zeros((300, 2))) for k in (0, 300)]
    known = pd.DataFrame([{"first": int(b.ids[0]), "slopes": b.written(1.0, 0.1)[-1]} for b in flat])
    gaps, offsets, quotas = kernels._quotas(known, 2, 250, 1e-3)
    # fold 0 leaves all rows out; of the other fit one block rises most and the other falls most, 250 rows each
    assert [q.tolist() for q in quotas.values()] == [[[0, 0], [0, 250]], [[0, 0], [250, 0]]] and gaps[1] == pytest.approx(299.8) and offsets[1] == pytest.approx(150)
