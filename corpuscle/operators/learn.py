"""Clustering, regression and sequence alignment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.operators.kernels import WIDE, Scale, SupportVectorModel, fit_support
from corpuscle.operators.residues import reindex
from corpuscle.operators.trajectory import block_count, deal_blocks, pack_frames, superimpose_packed
from corpuscle.sources.store import discard, materialize

# Amino acids that count as similar.
SIMILAR = ("DE", "KR", "KH", "RH", "IL", "IV", "LV", "IM", "LM", "FY", "FW", "YW", "ST", "NQ", "ND", "QE")


def _packed(positions: DataFrame, align_first: bool) -> DataFrame:
    """Packed frames, written once; align_first: each superposed on the first."""
    frames = materialize(pack_frames(positions), "packed")
    return materialize(superimpose_packed(frames), "superposed") if align_first else frames


def by_system(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator for each system apart, with the system's keys in its result: a model a system, so a fit a system.

    The names of the systems pass the driver, which fits one after another; a result has the columns of one system's, and its keys.
    """

    @wraps(operator)
    def each(rows: DataFrame, *args: object, **options: object) -> DataFrame:
        own = m.system_keys(rows)
        if not own:
            return operator(rows, *args, **options)
        parts = []
        for system in rows.select(*own).distinct().orderBy(*own).collect():
            alone = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.lit(system[k])), own, F.lit(True))
            found = operator(rows.where(alone).drop(*own), *args, **options)
            parts.append(found.select(*(F.lit(system[k]).alias(k) for k in own), *found.columns))
        return reduce(DataFrame.unionByName, parts) if parts else operator(rows.drop(*own), *args, **options)

    return each


@by_system
def cluster_frames(positions: DataFrame, k: int = 5, seed: int = 42, align_first: bool = True) -> DataFrame:
    """frame, cluster, and whether the frame is its cluster's medoid (the member nearest the centre).

    align_first: frames are superposed on the first before they are clustered.
    """
    frames = _packed(positions, align_first).select("frame", "coords", array_to_vector("coords").alias("v"))
    if k > frames.count():
        raise ValueError("more clusters than frames")
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(frames)
    labelled = model.transform(frames).select("frame", "coords", "cluster")
    table = positions.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    d2 = F.aggregate(F.zip_with("coords", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = labelled.join(F.broadcast(table), "cluster").select("frame", "cluster", d2.alias("d2"))
    medoid = near.groupBy("cluster").agg(F.min(F.struct("d2", "frame")).alias("m")).select("cluster", F.col("m.frame").alias("medoid"))
    return near.join(F.broadcast(medoid), "cluster").select("frame", "cluster", (F.col("frame") == F.col("medoid")).alias("is_medoid"))


#: Clusters that are linked in one group at most, frames of a block where there are few, and at most, coordinates of a group or block, and rows of distances at a time.
WARD_GROUP, WARD_FEW, WARD_BLOCK, WARD_VALUES, WARD_ROWS = 4096, 8192, 32768, 4_000_000, 128


def ward_costs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """What joining each of a with each of b adds to the squares within clusters; a and b are centres."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    d *= size_a[:, None]
    d *= size_b[None]
    d /= size_a[:, None] + size_b[None]
    return np.maximum(d, 0.0, out=d)


def ward_merges(x: np.ndarray, size: np.ndarray, height: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges (kept row, row that goes, height) of clusters with centres x, the lowest first.

    A nearest-neighbour chain with the Lance-Williams update. height: that at which each cluster was made.
    """
    n = len(x)
    x, size, height, merges, chain = x - x.mean(0), size.astype(float), height.astype(float), [], []
    d = ward_costs(x, x, size, size)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) < 2 or d[i, j] < d[i, chain[-2]]:
            if not d[i, j] < np.inf:
                raise ValueError("coordinates are missing")
            chain.append(j)
            continue
        i, j = sorted(chain[-2:])
        del chain[-2:]
        low, a, b = d[i, j], size[i], size[j]
        alive[j] = False
        others = np.flatnonzero(alive)
        c = size[others]
        d[i, others] = d[others, i] = ((a + c) * d[i, others] + (b + c) * d[j, others] - c * low) / (a + b + c)
        d[i, i] = d[j, :] = d[:, j] = np.inf
        size[i], height[i] = a + b, max(low, height[i], height[j])
        merges.append((i, j, float(height[i])))
    return sorted(merges, key=lambda m: m[2])


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward's clusters of the rows of x."""
    n = len(x)
    root = np.arange(n)
    for i, j, _ in ward_merges(x, np.ones(n), np.zeros(n))[: n - k]:
        root[root == root[j]] = root[i]
    return np.unique(root, return_inverse=True)[1]


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair of ids, the same either way round: the order of pairs of equal cost."""
    with np.errstate(over="ignore"):
        z = np.minimum(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.maximum(a, b).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        z = (z ^ z >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(29)) >> np.uint64(1)).astype(np.int64)


def _nearer(best: dict[str, np.ndarray], at: slice, d: np.ndarray, others: np.ndarray) -> None:
    """Replaces the best partners of the rows `at` where a column of d is nearer."""
    own, rows = best["id"][at], np.arange(len(d))
    j = d.argmin(1)
    m = d[rows, j]
    if np.count_nonzero(same := d == m[:, None]) > len(d):
        for r in np.flatnonzero((same.sum(1) > 1) & (m < np.inf)):
            c = np.flatnonzero(same[r])
            j[r] = c[np.argmin(_pair_order(own[r], others[c]))]
    order = _pair_order(own, others[j])
    new = (m < best["d"][at]) | (m < np.inf) & (m == best["d"][at]) & (order < best["pair"][at])
    for name, values in (("d", m), ("pair", order), ("other", others[j])):
        best[name][at][new] = values[new]


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nearest partner of each cluster within a pair of blocks; every pair's cost is computed once, so both ends see the same."""
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    a, b = pdf[pdf["own"] == low], pdf[pdf["own"] == high]
    if a.empty or b.empty:
        return pd.DataFrame({"id": [], "d": [], "pair": [], "other": []})
    x, y = (np.stack(t["c"].to_numpy()) for t in (a, b))
    x, y, n, k = x - x.mean(0), y - x.mean(0), a["n"].to_numpy(float), b["n"].to_numpy(float)
    one, two = ({"id": i, "d": np.full(len(i), np.inf), "pair": np.zeros(len(i), np.int64), "other": np.full(len(i), -1, np.int64)} for i in (a["id"].to_numpy(), b["id"].to_numpy()))
    two = one if low == high else two
    for i in range(0, len(a), WARD_ROWS):
        at, to = slice(i, i + WARD_ROWS), slice(i if low == high else 0, None)
        d = ward_costs(x[at], y[to], n[at], k[to])
        if low == high:
            d[np.tril_indices(len(d), 0, d.shape[1])] = np.inf
        _nearer(one, at, d, two["id"][to])
        _nearer(two, to, d.T, one["id"][at])
    found = pd.concat([pd.DataFrame(t) for t in ([one] if low == high else [one, two])])
    return found[found["d"] < np.inf]


def _ward_round(clusters: DataFrame, count: int, block: int) -> DataFrame:
    """Joins every two clusters that are each other's nearest: into (the id that stays) and its one or two members."""
    dealt = deal_blocks(clusters.select("id", "n", "c"), "id", max(4, block_count(count, block, min(block, WARD_FEW))))
    near = dealt.groupBy("low", "high").applyInPandas(_nearest, "id long, d double, pair long, other long")
    near = near.groupBy("id").agg(F.min(F.struct("d", "pair", "other")).alias("m"))
    pairs = near.groupBy(F.least("id", "m.other").alias("into"), F.greatest("id", "m.other").alias("id")).agg(F.count("*").alias("ends")).where("ends = 2")
    kept = clusters.join(pairs.select("id", "into"), "id", "left")
    return kept.groupBy(F.coalesce("into", "id").alias("into")).agg(F.sort_array(F.collect_list(F.struct("id", "n", "h", "c"))).alias("members"))


def _joined_clusters(step: DataFrame) -> DataFrame:
    """id, n, h and c of the clusters that a round leaves."""
    a, b = F.element_at("members", 1), F.get("members", F.lit(1))
    n, d2 = a["n"] + b["n"], F.aggregate(F.zip_with(a["c"], b["c"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    both = F.struct(n.alias("n"), F.greatest(d2 * a["n"] * b["n"] / n, a["h"], b["h"]).alias("h"), F.zip_with(a["c"], b["c"], lambda p, q: (p * a["n"] + q * b["n"]) / n).alias("c"))
    return step.select(F.col("into").alias("id"), F.when(F.size("members") == 1, F.struct(a["n"].alias("n"), a["h"].alias("h"), a["c"].alias("c"))).otherwise(both).alias("s"), (F.size("members") == 2).alias("new"), F.element_at("members", -1)["id"].alias("gone")).select("id", "s.*", "new", "gone")


@by_system
def ward_frames(positions: DataFrame, k: int = 5, group: int = WARD_GROUP, align_first: bool = True) -> DataFrame:
    """frame and cluster by Ward's linkage of all frames, superposed on the first (align_first) before they are clustered.

    Ward's costs never fall when clusters are joined, so all pairs of clusters that are each other's nearest belong to the
    tree and are joined in one round, over pairs of bounded blocks. Once at most `group` clusters are left, one task links
    them. The k - 1 highest joins of the whole tree are then undone, and labels go down the rounds.
    """
    frames = _packed(positions, align_first)
    kind = frames.schema["frame"].dataType.simpleString()
    clusters = materialize(frames.select(F.col("frame").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("h"), F.col("coords").alias("c")), "frames")
    count, values = clusters.agg(F.count("*"), F.max(F.size("c"))).first()
    if k > count:
        raise ValueError("more clusters than frames")
    fit = max(1, WARD_VALUES // max(1, values or 1))
    rounds, high = [], []
    while count > min(group, fit):
        rounds.append(materialize(_ward_round(clusters.select("id", "n", "h", "c"), count, min(WARD_BLOCK, fit)), "ward"))
        clusters = _joined_clusters(rounds[-1])
        left = rounds[-1].count()
        if left == count:
            raise ValueError("coordinates are missing")
        count = left
        high += [(r["h"], len(rounds), 0, r["id"], r["gone"]) for r in clusters.where("new").orderBy(F.desc("h"), F.desc("id")).limit(k - 1).collect()] if k > 1 else []

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        merges = ward_merges(np.stack(pdf["c"].to_numpy()), pdf["n"].to_numpy(), pdf["h"].to_numpy())
        return pd.DataFrame([(o, ids[i], ids[j], h) for o, (i, j, h) in enumerate(merges)], columns=["o", "id", "gone", "h"])

    last = sorted(clusters.groupBy(F.lit(1).alias("one")).applyInPandas(link, "o long, id long, gone long, h double").collect())
    high = sorted([*high, *((r["h"], len(rounds) + 1, r["o"], r["id"], r["gone"]) for r in last)])
    undone = {m[4] for m in high[len(high) - (k - 1) :]}
    label = {r["id"]: r["id"] for r in clusters.select("id").collect()}
    for r in reversed(last):  # each id goes once, into one that stays longer
        label[r["gone"]] = r["gone"] if r["gone"] in undone else label[r["id"]]
    names = {root: c for c, root in enumerate(sorted({*label.values()} | undone))}
    spark = positions.sparkSession
    labels = spark.createDataFrame([(i, names[root]) for i, root in label.items()], "into long, cluster int")
    own = F.create_map(*(F.lit(v) for i in undone for v in (i, names[i]))) if undone else None
    for done, step in enumerate(reversed(rounds), 1):
        down = step.select("into", F.explode("members.id").alias("id")).join(labels, "into")
        cut = F.when(F.col("id") != F.col("into"), F.element_at(own, F.col("id"))) if undone else F.lit(None).cast("int")
        labels = down.select(F.col("id").alias("into"), F.coalesce(cut, "cluster").cast("int").alias("cluster"))
        labels = materialize(labels, "labels") if done % 4 == 0 else labels  # else a plan has a join for each round
    return labels.select(F.col("into").cast(kind).alias("frame"), "cluster")


def _features(features: list[str] | str) -> Column:
    """The features as one array column."""
    return F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))


def fit_model(rows: DataFrame, features: list[str] | str, label: str, order: str, kind: str = "ridge", alpha: float = 1.0, folds: int = 5, seed: int = 42, working: int = WIDE) -> tuple[PipelineModel, dict[str, float]]:
    """A ridge, forest or svr (radial support vectors) model on standardised features, with training R2 and the mean R2 and RMSE over contiguous folds.

    features: names of columns, or of one array column of numbers. Folds are runs of rows by the integer column `order`, equal but
    for one row. Rows with a missing value don't count. Support vectors are exact over all rows (gamma is one over the
    features times the variance of all their values); working: rows of their working set.
    """
    rows = rows.select(_features(features).alias("f"), label, order)
    rows = reindex(rows.where(F.col("f").isNotNull() & ~F.exists("f", lambda x: x.isNull() | F.isnan(x))).dropna(subset=[label, order]).select("f", F.col(label).cast("double").alias("y"), F.col(order).cast("long").alias("idx")))
    rows = materialize(rows.select(array_to_vector("f").alias("raw"), "y", "new_idx"), "rows")
    n = rows.count()
    if n < 5:
        raise ValueError("at least five rows are needed")
    size, longer = divmod(n, folds)
    edge = longer * (size + 1)
    at = F.col("new_idx")
    rows = rows.withColumn("fold", F.when(at < edge, F.floor(at / (size + 1))).otherwise(F.lit(longer) + F.floor((at - edge) / F.lit(size))))
    if kind == "forest":
        last = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=100, seed=seed)
    elif kind == "svr":
        return _fit_svr(rows, folds, working)
    else:
        last = LinearRegression(featuresCol="x", labelCol="y", regParam=alpha / n, elasticNetParam=0.0, standardization=False)
    pipeline = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True), last])
    model = pipeline.fit(rows)
    return model, _scores(model.transform(rows), [pipeline.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)) for k in range(folds)])


def _scores(trained: DataFrame, held: list[DataFrame]) -> dict[str, float]:
    """Measures of y and prediction, over the rows of training and each fold that was left out."""
    metric = lambda df, name: RegressionEvaluator(labelCol="y", metricName=name).evaluate(df)
    return {"train_r2": metric(trained, "r2"), "cv_r2": float(np.mean([metric(h, "r2") for h in held])), "cv_rmse": float(np.mean([metric(h, "rmse") for h in held]))}


def _fit_svr(rows: DataFrame, folds: int, working: int) -> tuple[PipelineModel, dict[str, float]]:
    """Support vectors of all folds and of all rows, fitted together; rows: raw, y, new_idx and fold."""
    scaler, scales = StandardScaler(inputCol="raw", outputCol="x", withMean=True), []
    for k in range(folds + 1):
        own = rows.where(F.col("fold") != k)
        n, seen = own.count(), scaler.fit(own)
        deviation = seen.std.toArray()
        spread = np.count_nonzero(deviation) * (n - 1) / n
        factor = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        scales.append(Scale(seen.mean.toArray(), factor, float(1 / spread) if spread > 0 else 1.0))
    given = rows.select(F.col("new_idx").cast("long").alias("id"), vector_to_array("raw").alias("raw"), "y", "fold")
    state, offsets = fit_support(given, scales, working=working)
    seen_by = lambda k: state.select("y", "fold", (F.col("f")[k] + offsets[k]).alias("prediction"))
    scores = _scores(seen_by(folds), [seen_by(k).where(F.col("fold") == k) for k in range(folds)])
    support = materialize(state.where(F.col("w")[folds] != 0).select("raw", F.col("w")[folds].alias("weight")), "vectors")
    discard(state)
    return PipelineModel(stages=[SupportVectorModel(support, offsets[folds], scales[folds])]), scores


def predict(model: PipelineModel, rows: DataFrame, features: list[str] | str, name: str = "predicted") -> DataFrame:
    """rows with the model's prediction, null where a feature is missing."""
    given = _features(features)
    known = given.isNotNull() & ~F.exists(given, lambda x: x.isNull())
    filled = rows.withColumn("raw", array_to_vector(F.transform(given, lambda x: F.coalesce(x, F.lit(0.0)))))
    return model.transform(filled).select(*rows.columns, F.when(known, F.col("prediction")).alias(name))


def describe_clusters(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, size, medoid (the frame nearest the mean of its frames) and inertia (squares to that mean) of labelled frames."""
    keys, own = m.keys(positions, labels), m.system_keys(positions, labels)
    rows = positions.select(*keys, "idx", "x", "y", "z").join(labels.select(*keys, "cluster"), keys)
    centre = rows.groupBy(*own, "cluster", "idx").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
    d2 = reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"))
    each = rows.join(centre, [*own, "cluster", "idx"]).groupBy(*own, "cluster", "frame").agg(F.sum(d2).alias("d2"))
    return each.groupBy(*own, "cluster").agg(F.count("*").alias("size"), F.min(F.struct("d2", "frame"))["frame"].alias("medoid"), F.sum("d2").alias("inertia"))


@by_system
def cluster_atoms(system: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """frame, idx and cluster: k-means over the positions of all atoms."""
    rows = system.select("frame", "idx", array_to_vector(F.array(*(F.col(c).cast("double") for c in "xyz"))).alias("v"))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(rows).select("frame", "idx", "cluster")


@by_system
def fit_frames(positions: DataFrame, kind: str = "ridge") -> DataFrame:
    """One row of scores: the distance of the first and the last atom from the coordinates of all atoms."""
    packed = materialize(pack_frames(positions), "packed")
    far = reduce(lambda a, b: a + b, (F.pow(F.element_at("coords", k + 1) - F.element_at("coords", k - 3), F.lit(2.0)) for k in range(3)))
    _, scores = fit_model(packed.select("frame", "coords", F.sqrt(far).alias("y")), "coords", "y", "frame", kind)
    return positions.sparkSession.createDataFrame([tuple(round(v, 6) for v in scores.values())], ", ".join(f"{k} double" for k in scores))


class _Rows:
    """A table whose rows are made when they are asked for."""

    def __init__(self, row: Callable[[int], tuple], which: int):
        self.row, self.which = row, which

    def __getitem__(self, at: tuple[int, int]) -> float:
        return self.row(at[0])[self.which][at[1]]


def align(a: str, b: str, local: bool = False, match: float = 2, mismatch: float = -1, gap_open: float = -0.5, gap_extend: float = -0.1) -> tuple[float, str, str]:
    """Score and aligned strings with affine gaps; ties prefer the diagonal, then a gap in b, then one in a.

    Rows are computed whole: what a gap along a row costs is a running maximum. Of n rows about the root of n are kept, and a stretch between two is made again on the way back. Opening a gap must cost at least as much as extending one.
    """
    if gap_open > gap_extend:
        raise ValueError("opening a gap costs less than extending one")
    n, k = len(a), len(b)
    low, every = -1e18, max(1, math.isqrt(n))
    text, steps = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(k + 1) * gap_extend

    def following(i: int, best: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row i from those of best and up before it."""
        new, above, left = np.full(k + 1, low), np.full(k + 1, low), np.full(k + 1, low)
        above[0] = gap_open + (i - 1) * gap_extend
        new[0] = 0 if local else above[0]
        # a gap that another gap in the same row would open anew costs more, so the greatest opening so far is enough
        above[1:] = np.maximum(best[1:] + gap_open, up[1:] + gap_extend)
        row = np.maximum(best[:-1] + np.where(text == ord(a[i - 1]), match, mismatch), above[1:])
        row = np.maximum(row, 0) if local else row
        new[1:] = row
        left[1:] = np.maximum.accumulate(new[:-1] - steps[:-1]) + (gap_open - gap_extend) + steps[1:]
        new[1:] = np.maximum(row, left[1:])
        return new, above, left

    first, side = np.zeros(k + 1), np.full(k + 1, low)
    side[1:] = gap_open + np.arange(k) * gap_extend
    if not local:
        first[1:] = side[1:]
    row, kept = (first, np.full(k + 1, low), side), []
    top, place = -1.0, (n, k)
    for i in range(n + 1):
        row = following(i, *row[:2]) if i else row
        if i % every == 0:
            kept.append(row)
        if local and (most := (near := row[0].round(9)).max()) > top:
            top, place = most, (i, int(near.argmax()))
    held: dict[int, tuple] = {}

    def at_row(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """best, up and left of a row; those of its stretch are made again from the row that was kept."""
        if i not in held:
            start = i // every * every
            above = held.get(i + 1)
            held.clear()
            held[start] = kept[start // every]
            for r in range(start + 1, i + 1):
                held[r] = following(r, *held[r - 1][:2])
            if above is not None:
                held[i + 1] = above
        return held[i]

    i, j = place
    best, up, left = _Rows(at_row, 0), _Rows(at_row, 1), _Rows(at_row, 2)
    score, x, y, at = float(best[i, j]), [], [], "best"
    while i or j:
        if at == "best":
            if local and best[i, j] <= 0:
                break
            if i and j and np.isclose(best[i, j], best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)):
                i, j = i - 1, j - 1
                x.append(a[i])
                y.append(b[j])
                continue
            at = "up" if i and np.isclose(best[i, j], up[i, j]) else "left"
        if at == "up":
            at = "best" if np.isclose(up[i, j], best[i - 1, j] + gap_open) else "up"
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            at = "best" if np.isclose(left[i, j], best[i, j - 1] + gap_open) else "left"
            j -= 1
            x.append("-")
            y.append(b[j])
    return score, "".join(reversed(x)), "".join(reversed(y))


def identity_similarity(x: str, y: str) -> tuple[float, float]:
    """Shares of identical and of similar columns among those without a gap."""
    pairs = [(p, q) for p, q in zip(x, y, strict=False) if p != "-" and q != "-"]
    same = sum(p == q for p, q in pairs)
    alike = same + sum(p != q and ((p + q).upper() in SIMILAR or (q + p).upper() in SIMILAR) for p, q in pairs)
    return (same / len(pairs), alike / len(pairs)) if pairs else (0.0, 0.0)


def align_pairs(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", local: bool = False) -> DataFrame:
    """pairs with score, aligned_a, aligned_b, identity and similarity."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [align(p or "", q or "", local) for p, q in zip(pdf[a], pdf[b], strict=True)]
            alike = [identity_similarity(x, y) for _, x, y in found]
            yield pdf.assign(score=[f[0] for f in found], aligned_a=[f[1] for f in found], aligned_b=[f[2] for f in found], identity=[s[0] for s in alike], similarity=[s[1] for s in alike])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{kinds}, score double, aligned_a string, aligned_b string, identity double, similarity double")


def align_chains(sequences: DataFrame) -> DataFrame:
    """All pairs of a structure's chains."""
    keys = m.keys(sequences)
    a = sequences.select(*keys, F.col("chain_id").alias("chain_a"), F.col("sequence").alias("seq_a"))
    b = sequences.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("chain_id").alias("chain_b"), F.col("sequence").alias("seq_b"))
    on = reduce(lambda c, k: c & (F.col(k) == F.col(f"_{k}")), keys, F.col("chain_a") < F.col("chain_b"))
    return align_pairs(a.join(b, on)).select(*keys, "chain_a", "chain_b", "score", "identity", "similarity")
