"""Support vector regression with a radial kernel, over rows of any number.

The dual's optimum is found by decomposition. Each round takes from all rows those whose slopes disagree most, a bounded
number, solves the dual in their weights alone in a task (itself in rounds over smaller sets), and adds what their change means to
the values of all rows in one pass. It ends where no two slopes of any two rows disagree, so no row is left out, and nothing that
grows with the rows meets in one task. All folds are fitted in the same passes. Rows travel in blocks, a row of the state each;
what passes the driver is the weights that changed in a round, and of each block a few slopes, which tell how many of its rows to take.
The points whose weights changed are written to the shared folder and read from there (so it must be of a scheme that pyarrow.fs knows).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs, parquet
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.store import discard, materialize

#: Rows of a block of support vectors and numbers in their features, rows and columns of a kernel's tile.
WORKING, VALUES, BLOCK = 2000, 4_000_000, 1024
#: Rows of a working set, of the sets that it is solved in, and of a block of the state; slopes that are known of a block; solutions in a round, and steps in each for each row.
WIDE, INNER, PACK, SKETCH, TURNS, STEPS = 40_000, 1000, 4096, 128, 400, 20
#: Half squared norms (scaled by the kernel) up to which single precision gives a kernel to five digits.
NEAR = 64.0


class Scale(NamedTuple):
    """How one fit sees raw features."""

    mean: np.ndarray
    factor: np.ndarray
    gamma: float

    def of(self, raw: np.ndarray) -> np.ndarray:
        return (raw - self.mean) * self.factor


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma d2) of all pairs of rows."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0))


def placed(raw: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Rows so that their kernel is exp(a b' - |a|^2 / 2 - |b|^2 / 2), and their half squared norms."""
    z = scale.of(raw) * np.sqrt(2 * scale.gamma)
    half = (z * z).sum(1) / 2
    return (z.astype("f4"), half.astype("f4")) if not len(z) or half.max() < NEAR else (z, half)


def pulled(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """What weights at b (as placed) add to the value of each of a, a tile of the kernel at a time."""
    out, weights = np.zeros(len(a[0])), weights.astype(np.result_type(a[0], b[0]))
    for i in range(0, len(out), BLOCK):
        for j in range(0, len(weights), BLOCK):
            tile = a[0][i : i + BLOCK] @ b[0][j : j + BLOCK].T
            tile -= a[1][i : i + BLOCK, None]
            tile -= b[1][j : j + BLOCK]
            out[i : i + BLOCK] += np.exp(np.minimum(tile, 0, out=tile), out=tile) @ weights[j : j + BLOCK]
    return out


def weighted(raw: np.ndarray, points: np.ndarray, weights: np.ndarray, scale: Scale) -> np.ndarray:
    """What weights at points add to the value of each row."""
    return pulled(placed(raw, scale), placed(points, scale), weights)


def slopes(w: np.ndarray, gain: np.ndarray, c: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """What a weight gains by rising, and loses by falling; infinite at its bound."""
    rise = np.where(w < c, gain - np.where(w >= 0, epsilon, -epsilon), -np.inf)
    return rise, np.where(w > -c, gain - np.where(w > 0, epsilon, -epsilon), np.inf)


def support_weights(kernel: np.ndarray, y: np.ndarray, c: float, epsilon: float, tolerance: float = 1e-4, w: np.ndarray | None = None, f: np.ndarray | None = None, steps: int | None = None) -> tuple[np.ndarray, float]:
    """Weights in [-c, c] that keep the sum of w (else zero), and the offset, at the optimum of the dual or after so many steps.

    A step moves weight from one point to another, the two whose slopes disagree most. Slopes are one-sided: beyond zero a
    weight costs epsilon more, or less on its way back. It ends where no two slopes disagree by more than the tolerance.
    w and f: weights to start from and the values at the points, in which points outside may have a part.
    """
    w, f = (np.zeros(len(y)) if v is None else v.copy() for v in (w, f))
    diagonal = np.diag(kernel)
    for _ in range(1000 * len(y) + 100_000 if steps is None else steps):
        rise, fall = slopes(w, y - f, c, epsilon)
        i, j = int(rise.argmax()), int(fall.argmin())
        gap = rise[i] - fall[j]
        if gap <= tolerance:
            break
        step = gap / max(diagonal[i] + diagonal[j] - 2 * kernel[i, j], 1e-12)
        # a step ends at a bound, or at zero where a slope changes
        step = min(step, (c if w[i] >= 0 else 0.0) - w[i], w[j] - (-c if w[j] <= 0 else 0.0))
        w[i] += step
        w[j] -= step
        f += step * (kernel[i] - kernel[j])
    rise, fall = slopes(w, y - f, c, epsilon)
    return w, float((rise.max() + fall.min()) / 2) if np.isfinite([rise.max(), fall.min()]).all() else float((y - f).mean())


_STATE = "ids binary, raw binary, y binary, fold binary, w binary, f binary, slopes binary"
_ROWS = "id bigint, raw array<double>, y double, fold int, w array<double>, f array<double>"
_CHOSEN = "fit int, gap double, ids binary, raw binary, y binary, w binary, f binary"
_CHANGE = "fit int, ids binary, w binary, change binary"


class _Block(NamedTuple):
    """Rows of the state; w and f have a column for each fit."""

    ids: np.ndarray
    raw: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    w: np.ndarray
    f: np.ndarray

    @classmethod
    def read(cls, row: tuple) -> _Block:
        ids, raw, y, fold, w, f = (np.frombuffer(v, t) for v, t in zip(row[:6], ("i8", "f8", "f8", "i8", "f8", "f8"), strict=True))
        return cls(ids, raw.reshape(len(ids), -1), y, fold, w.reshape(len(ids), -1), f.reshape(len(ids), -1))

    def sides(self, fit: int, c: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """What each row gains by rising and by falling, minus infinity where it can't or is left out."""
        rise, fall = slopes(self.w[:, fit], self.y - self.f[:, fit], c, epsilon)
        out = self.fold == fit
        return np.where(out, -np.inf, rise), np.where(out, -np.inf, -fall)

    def written(self, c: float, epsilon: float) -> tuple:
        """The row of the state, with the fits' slopes: for each fit and side SKETCH pairs of a value, in falling order, and how many rows it stands for."""
        known = np.zeros((self.w.shape[1], 2, SKETCH, 2))
        for k in range(len(known)):
            for side, value in enumerate(self.sides(k, c, epsilon)):
                value = -np.sort(-value[np.isfinite(value)])
                edges = np.unique(np.linspace(0, len(value), min(len(value), SKETCH) + 1).astype(int))
                known[k, side, : len(edges) - 1, 0], known[k, side, : len(edges) - 1, 1] = value[edges[:-1]], np.diff(edges)
        return *(np.ascontiguousarray(v).tobytes() for v in self), known.tobytes()


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _begun(batches: Iterator[pd.DataFrame], fits: int, c: float, epsilon: float) -> Iterator[pd.DataFrame]:
    """Rows in blocks, with weights and values of zero."""
    for pdf in batches:
        for k in range(0, len(pdf), PACK):
            own = pdf.iloc[k : k + PACK]
            zeros = np.zeros((len(own), fits))
            yield _frame([_Block(own["id"].to_numpy(), np.stack(own["raw"]), own["y"].to_numpy(), own["fold"].to_numpy().astype("i8"), zeros, zeros).written(c, epsilon)], _STATE)


def _quotas(known: pd.DataFrame, fits: int, count: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Of each fit the gap and the offset, and of each block, by its first id, how many rows of each fit and side to take; none of a fit that has ended."""
    known = known.sort_values("first")
    values = np.stack([np.frombuffer(v, "f8").reshape(fits, 2, SKETCH, 2) for v in known["slopes"]])
    value = np.where(values[..., 1] > 0, values[..., 0], -np.inf)
    rise, fall = value[:, :, 0].max((0, 2)), -value[:, :, 1].max((0, 2))
    take = np.zeros((len(known), fits, 2), int)
    for k in range(fits):
        for side in (0, 1) if rise[k] - fall[k] > tolerance else ():
            order = np.argsort(-value[:, k, side].ravel(), kind="stable")
            rows = values[:, k, side, :, 1].ravel()[order].astype(int)
            rows = np.clip(count - (rows.cumsum() - rows), 0, rows)
            np.add.at(take[:, k, side], order // SKETCH, rows)
    return rise - fall, (rise + fall) / 2, dict(zip(known["first"], take))


def _chosen(batches: Iterator[pd.DataFrame], quotas: dict[int, np.ndarray], gaps: np.ndarray, c: float, epsilon: float) -> Iterator[pd.DataFrame]:
    """The rows to take of each block, a row a fit."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            block = _Block.read(row)
            for k, take in enumerate(quotas[int(block.ids[0])]):
                at = np.unique(np.concatenate([np.lexsort((block.ids, -v))[:n] for v, n in zip(block.sides(k, c, epsilon), take, strict=True)]))
                if len(at):
                    yield _frame([(k, gaps[k], *(np.ascontiguousarray(v).tobytes() for v in (block.ids[at], block.raw[at], block.y[at], block.w[at, k], block.f[at, k])))], _CHOSEN)


def _solved(pdf: pd.DataFrame, scales: list[Scale], c: float, epsilon: float, tolerance: float) -> pd.DataFrame:
    """New weights of one fit's working set, in rounds over those of its rows whose slopes disagree most."""
    fit, gap = int(pdf["fit"].iloc[0]), pdf["gap"].iloc[0]
    ids, y, w, f = (np.concatenate([np.frombuffer(v, t) for v in pdf[name]]) for name, t in (("ids", "i8"), ("y", "f8"), ("w", "f8"), ("f", "f8")))
    order = ids.argsort()
    raw = np.concatenate([np.frombuffer(v, "f8") for v in pdf["raw"]]).reshape(len(ids), -1)[order]
    ids, y, w, f = (v[order] for v in (ids, y, w, f))
    points, new, gain = placed(raw, scales[fit]), w.copy(), y - f
    least, z = max(tolerance / 2, 0.3 * gap), scales[fit].of(raw)
    for _ in range(TURNS):
        rise, fall = slopes(new, gain, c, epsilon)
        own = rise.max() - fall.min()
        if own <= least:
            break
        at = np.unique(np.concatenate([np.argsort(-v, kind="stable")[: INNER // 2] for v in (rise, -fall)]))
        x = z[at]
        part, _ = support_weights(radial(x, x, scales[fit].gamma), gain[at], c, epsilon, max(least / 2, 0.1 * own), new[at], np.zeros(len(at)), STEPS * len(at))
        moved = np.flatnonzero(part != new[at])
        gain -= pulled(points, tuple(v[at[moved]] for v in points), (part - new[at])[moved])
        new[at] = part
    moved = new != w
    return _frame([(fit, ids[moved].tobytes(), new[moved].tobytes(), (new - w)[moved].tobytes())], _CHANGE)


def _points(batches: Iterator[pd.DataFrame], ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """Ids and raw features of those rows of a block that have one of the ids."""
    for pdf in batches:
        for block in map(_Block.read, pdf.itertuples(index=False)):
            at = np.isin(block.ids, ids)
            if at.any():
                yield pd.DataFrame({"ids": [block.ids[at].tobytes()], "raw": [block.raw[at].tobytes()]})


def _written(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and raw features of the points in a written table, a block at a time."""
    files, root = fs.FileSystem.from_uri(path)
    for info in files.get_file_info(fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            for ids, raw in zip(*(column.to_pylist() for column in parquet.read_table(info.path, filesystem=files, columns=["ids", "raw"]).columns), strict=True):
                ids = np.frombuffer(ids, "i8")
                yield ids, np.frombuffer(raw, "f8").reshape(len(ids), -1)


def _moved(batches: Iterator[pd.DataFrame], path: str, shared: object, scales: list[Scale], c: float, epsilon: float) -> Iterator[pd.DataFrame]:
    """Rows after changes; path: the points that changed; shared: of each open fit the ids of its own in order, their new weights and their change."""
    for pdf in batches:
        blocks = [_Block.read(row) for row in pdf.itertuples(index=False)]
        blocks = [b._replace(w=b.w.copy(), f=b.f.copy()) for b in blocks]
        for ids, raw in _written(path):
            for k, own, _, change in shared.value:
                at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
                found = own[at] == ids
                points = placed(raw[found], scales[k])
                for block in blocks if found.any() else ():
                    block.f[:, k] += pulled(placed(block.raw, scales[k]), points, change[at[found]])
        for block in blocks:
            for k, own, new, _ in shared.value:
                at = np.minimum(np.searchsorted(own, block.ids), len(own) - 1)
                block.w[:, k] = np.where(own[at] == block.ids, new[at], block.w[:, k])
            yield _frame([block.written(c, epsilon)], _STATE)


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for block in map(_Block.read, pdf.itertuples(index=False)):
            yield pd.DataFrame({"id": block.ids, "raw": list(block.raw), "y": block.y, "fold": block.fold, "w": list(block.w), "f": list(block.f)})


def fit_support(rows: DataFrame, scales: list[Scale], c: float = 1.0, epsilon: float = 0.1, tolerance: float = 1e-3, working: int = WIDE) -> tuple[DataFrame, list[float]]:
    """rows (id, raw, y, fold) with w and f, the weight and value in each fit, and the fits' offsets; a prediction is f and the offset.

    Fit k leaves fold k out; a fit with no fold of its number takes all rows. working: rows of a working set, less if features are many.
    """
    fits, width, context = len(scales), max(1, len(scales[0].mean)), rows.sparkSession.sparkContext
    count = max(1, min(working, VALUES // width) // 2)
    law = {"c": c, "epsilon": epsilon}
    dealt = rows.select("id", "raw", "y", F.col("fold").cast("int").alias("fold")).repartition(2 * context.defaultParallelism, "id")
    state = materialize(dealt.mapInPandas(partial(_begun, fits=fits, **law), _STATE), "support")
    while True:
        first = F.udf(lambda ids: int(np.frombuffer(ids[:8], "i8")[0]), "bigint")
        gaps, offsets, quotas = _quotas(state.select(first("ids").alias("first"), "slopes").toPandas(), fits, count, tolerance)
        if not (gaps > tolerance).any():
            ended = materialize(state.mapInPandas(_ended, _ROWS), "supported")
            discard(state)
            return ended, [float(v) if np.isfinite(v) else 0.0 for v in offsets]
        chosen = state.mapInPandas(partial(_chosen, quotas=quotas, gaps=gaps, **law), _CHOSEN).repartition(8 * fits, "fit")
        solved = chosen.groupBy("fit").applyInPandas(lambda pdf: _solved(pdf, scales, c, epsilon, tolerance), _CHANGE).toPandas()
        changes = [(int(r.fit), *(np.frombuffer(v, t) for v, t in ((r.ids, "i8"), (r.w, "f8"), (r.change, "f8")))) for r in solved.itertuples()]
        changes = [r for r in changes if len(r[1])]
        points = materialize(state.mapInPandas(partial(_points, ids=np.unique(np.concatenate([r[1] for r in changes]))), "ids binary, raw binary"), "points")
        shared = context.broadcast(changes)
        moved = materialize(state.mapInPandas(partial(_moved, path=points.written_at, shared=shared, scales=scales, **law), _STATE), "support")
        shared.destroy()
        discard(state, points)
        state = moved


class SupportVectorModel(Model):
    """Adds `prediction` to rows with the vector raw.

    support: a written table of raw and weight. A block of it at a time is sent to the rows, and predictions are written between blocks.
    """

    def __init__(self, support: DataFrame, offset: float, scale: Scale):
        super().__init__()
        self.support, self.offset, self.scale = support, offset, scale

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, rows = max(1, min(WORKING, VALUES // max(1, len(self.scale.mean)))), self.support.toLocalIterator()
        out, blocks = dataset.withColumn("prediction", F.lit(self.offset)), 0
        while block := list(islice(rows, size)):
            out = materialize(out, "predictions") if blocks else out
            out = out.withColumn("prediction", F.col("prediction") + self._part(block)(vector_to_array("raw")))
            blocks += 1
        return out

    def _part(self, block: list):
        points, weights, scale = np.array([r["raw"] for r in block]), np.array([r["weight"] for r in block]), self.scale

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(weighted(np.stack(x), points, weights, scale) if len(x) else np.zeros(0))

        return score
