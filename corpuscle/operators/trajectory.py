"""RMSD, RMSF, superposition and frame matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.geometry import once
from corpuscle.sources.lines import running
from corpuscle.sources.store import materialize

AXES = "xyz"


def _to_reference(positions: DataFrame, ref_frame: int) -> DataFrame:
    """Every position beside that of the same atom in its system's reference frame; one frame is what is broadcast or shuffled."""
    own = m.system_keys(positions)
    ref = positions.where(F.col("frame") == ref_frame).select(*own, "idx", *(F.col(c).alias(f"r{c}") for c in AXES))
    return positions.join(ref, [*own, "idx"])


def rmsd_to_frame(positions: DataFrame, ref_frame: int = 0) -> DataFrame:
    """frame and RMSD to the reference frame, without superposition."""
    d = sum((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in AXES)
    return _to_reference(positions, ref_frame).groupBy(*m.keys(positions)).agg(F.sqrt(F.sum(d) / F.count("*")).alias("rmsd"))


def rmsf(positions: DataFrame) -> DataFrame:
    """idx and RMSF over all frames: one pass of partial variances."""
    return positions.groupBy(*m.system_keys(positions), "idx").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def rmsf_per_residue(system: DataFrame) -> DataFrame:
    """residue_id and the mean RMSF of its atoms; rows without residue don't count."""
    own = m.system_keys(system)
    each = system.where("residue_id is not null").groupBy(*own, "residue_id", "idx").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("r"))
    return each.groupBy(*own, "residue_id").agg(F.avg("r").alias("rmsf"))


def _sums(p: str, q: str) -> list[Column]:
    """What superposition needs of paired points: counts, sums, squares and products."""
    one = [F.count("*").alias("n"), *(F.sum(f"{s}{c}").alias(f"s_{s}{c}") for s in (p, q) for c in AXES)]
    squares = [F.sum(sum(F.col(f"{s}{c}") * F.col(f"{s}{c}") for c in AXES)).alias(f"g_{s or 'm'}") for s in (p, q)]
    return one + squares + [F.sum(F.col(f"{p}{a}") * F.col(f"{q}{b}")).alias(f"h_{a}{b}") for a in AXES for b in AXES]


def closed_rmsd(p: str, q: str) -> Column:
    """The least RMSD over rotations, from _sums(p, q), without a decomposition.

    The singular values of the 3 x 3 covariance are the roots of the eigenvalues of its square, which the trigonometric formula gives.
    """
    n = F.col("n")
    g = sum(F.col(f"g_{s or 'm'}") - sum(F.col(f"s_{s}{c}") * F.col(f"s_{s}{c}") for c in AXES) / n for s in (p, q))
    h = {(a, b): F.col(f"h_{a}{b}") - F.col(f"s_{p}{a}") * F.col(f"s_{q}{b}") / n for a in AXES for b in AXES}
    pairs = [(a, b) for a in AXES for b in AXES]
    root = lambda e: F.sqrt(F.greatest(e, F.lit(0.0)))

    def squared(s: Column) -> Column:
        h = {ab: s["".join(ab)] for ab in pairs}
        det = h["x", "x"] * (h["y", "y"] * h["z", "z"] - h["y", "z"] * h["z", "y"]) - h["x", "y"] * (h["y", "x"] * h["z", "z"] - h["y", "z"] * h["z", "x"]) + h["x", "z"] * (h["y", "x"] * h["z", "y"] - h["y", "y"] * h["z", "x"])
        k = {(a, b): sum(h[c, a] * h[c, b] for c in AXES) for a, b in pairs if a <= b}
        return F.struct(*(v.alias("".join(ab)) for ab, v in k.items()), ((k["x", "x"] + k["y", "y"] + k["z", "z"]) / 3).alias("q"), F.when(det < 0, -1.0).otherwise(1.0).alias("sign"))

    def shifted(s: Column) -> Column:
        x, y, z, off = s["xx"] - s["q"], s["yy"] - s["q"], s["zz"] - s["q"], s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]
        det = x * (y * z - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * z - s["yz"] * s["xz"]) + s["xz"] * (s["xy"] * s["yz"] - y * s["xz"])
        return F.struct(F.sqrt((x * x + y * y + z * z + 2 * off) / 6).alias("p"), det.alias("det"), s["q"].alias("q"), s["sign"].alias("sign"))

    def eigenvalues(s: Column) -> Column:
        ratio = F.when(s["p"] > 0, s["det"] / (s["p"] * s["p"] * s["p"]) / 2).otherwise(F.lit(1.0))
        phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) / 3
        return F.struct((s["q"] + 2 * s["p"] * F.cos(phi)).alias("e1"), (s["q"] + 2 * s["p"] * F.cos(phi + F.lit(2 * np.pi / 3))).alias("e3"), s["q"].alias("q"), s["sign"].alias("sign"))

    total = lambda s: root(s["e1"]) + root(3 * s["q"] - s["e1"] - s["e3"]) + s["sign"] * root(s["e3"])
    values = once(once(once(F.struct(*(h[ab].alias("".join(ab)) for ab in pairs)), squared), shifted), eigenvalues)
    return once(values, lambda s: F.sqrt(F.greatest((g - 2 * total(s)) / n, F.lit(0.0))))


def kabsch_rmsd_to_frame(positions: DataFrame, ref_frame: int = 0) -> DataFrame:
    """frame and RMSD to the reference frame after superposition, all in built-in aggregates."""
    return _to_reference(positions, ref_frame).groupBy(*m.keys(positions)).agg(*_sums("", "r")).select(*m.keys(positions), closed_rmsd("", "r").alias("rmsd"))


#: Coordinates of a block of frames at most, and frames of a tile of a matrix.
BLOCK_VALUES, MATRIX_ROWS, MATRIX_COLUMNS = 2_000_000, 128, 1024


def _overlaps(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The sum of singular values, the least signed, of the covariance of each of a with each of b (centred), by the closed form of closed_rmsd().

    Pairs that it would give too few digits are decomposed: flat or alike ones, and those of two values that are nearly one.
    """
    h = [[a[:, :, c] @ b[:, :, d].T for d in range(3)] for c in range(3)]
    det = h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1]) - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0]) + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0])
    k = {(c, d): h[0][c] * h[0][d] + h[1][c] * h[1][d] + h[2][c] * h[2][d] for c in range(3) for d in range(c, 3)}
    q = (k[0, 0] + k[1, 1] + k[2, 2]) / 3
    x, y, z, xy, xz, yz = k[0, 0] - q, k[1, 1] - q, k[2, 2] - q, k[0, 1], k[0, 2], k[1, 2]
    p = np.sqrt((x * x + y * y + z * z + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (x * (y * z - yz * yz) - xy * (xy * z - yz * xz) + xz * (xy * yz - y * xz)) / (2 * p * p * p)
        phi = np.arccos(np.clip(ratio, -1.0, 1.0)) / 3
        most, least = q + 2 * p * np.cos(phi), q + 2 * p * np.cos(phi + 2 * np.pi / 3)
        both = np.sqrt(most) + np.sqrt(np.maximum(3 * q - most - least, 0.0)) + np.copysign(np.sqrt(np.maximum(least, 0.0)), det)
        sure = (np.abs(ratio) < 1 - 1e-8) & (least > 1e-8 * most) & (squares - 2 * both > 1e-6 * squares)
    i, j = np.nonzero(~sure)
    for at in range(0, len(i), 10_000):
        r, c = i[at : at + 10_000], j[at : at + 10_000]
        own = np.stack([np.stack([h[u][v][r, c] for v in range(3)], -1) for u in range(3)], -2)
        values = np.linalg.svd(own, compute_uv=False) if np.isfinite(own).all() else np.stack([np.linalg.svd(o, compute_uv=False) if np.isfinite(o).all() else np.full(3, np.nan) for o in own])
        values[..., 2] *= np.where(np.linalg.det(own) < 0, -1.0, 1.0)
        both[r, c] = values.sum(-1)
    return both


def block_rmsd(a: np.ndarray, b: np.ndarray, align: bool) -> np.ndarray:
    """RMSD of each of a (frames, atoms, 3) to each of b."""
    if align:
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    squares = (a * a).sum((1, 2))[:, None] + (b * b).sum((1, 2))[None]
    if align:
        both = _overlaps(a, b, squares)
    else:
        both = a.reshape(len(a), -1) @ b.reshape(len(b), -1).T
    return np.sqrt(np.maximum(squares - 2 * both, 0.0) / a.shape[1])


def _kinds(df: DataFrame, names: list[str]) -> str:
    """The named columns as the start of a schema."""
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def one_size(packed: DataFrame) -> tuple[int, int]:
    """The most frames of a system and the most values of a frame; frames of a system that differ in their number of atoms are an error."""
    each = packed.groupBy(*m.system_keys(packed)).agg(F.count("*").alias("n"), F.min(F.size("coords")).alias("least"), F.max(F.size("coords")).alias("most"))
    n, most, mixed = each.agg(F.max("n"), F.max("most"), F.count(F.when(F.col("least") != F.col("most"), 1))).first()
    if mixed:
        raise ValueError("frames differ in their number of atoms")
    return n or 0, most or 0


def rmsd_matrix(positions: DataFrame, align: bool = True, block: int | None = None, digits: int | None = None) -> DataFrame:
    """i, j, rmsd of all frame pairs i < j of a system, which is what the operator asks for.

    Frames are dealt to blocks of bounded size, and each pair of blocks is one group whose rows leave tile by tile, so a frame is shuffled once a
    block, of which there are a dozen or as few as its bound allows, and no task holds its result. Frames of different atom counts are an error.
    digits: values are rounded to so many, half up, in the arrays; Spark's round() costs more than the distances.
    """
    packed, keys = pack_frames(positions), m.system_keys(positions)
    n, most = one_size(packed)
    dealt = deal_blocks(packed, "frame", block_count(n, block or max(1, BLOCK_VALUES // max(1, most))))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high, own, frame = (table[c].to_numpy() for c in ("low", "high", "own", "frame"))
        same = low[0] == high[0]
        xyz = table["coords"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1, 3)
        (a, p), (b, q) = ((xyz[t], frame[t]) for t in (own == low[0], own == high[0]))
        for r in range(0, len(a), MATRIX_ROWS):
            for c in range(0, len(b), MATRIX_COLUMNS):
                i, j = p[r : r + MATRIX_ROWS, None], q[None, c : c + MATRIX_COLUMNS]
                keep = i < j if same else i != j
                if not (count := int(keep.sum())):
                    continue
                found = block_rmsd(a[r : r + MATRIX_ROWS], b[c : c + MATRIX_COLUMNS], align)
                found = found if digits is None else np.floor(found * 10.0**digits + 0.5) / 10.0**digits
                first = [table[k].slice(0, 1).combine_chunks().take(pa.array(np.zeros(count, np.int64))) for k in keys]
                yield pa.RecordBatch.from_arrays([*first, *map(pa.array, (np.minimum(i, j)[keep], np.maximum(i, j)[keep], found[keep]))], names=[*keys, "i", "j", "rmsd"])

    kind = packed.schema["frame"].dataType.simpleString()
    return dealt.groupBy(*keys, "low", "high").applyInArrow(pair, f"{_kinds(packed, keys)}i {kind}, j {kind}, rmsd double")


def rotation(mobile: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and t with mobile @ R.T + t nearest to reference; det R = 1."""
    cm, cr = mobile.mean(0), reference.mean(0)
    u, _, vt = np.linalg.svd((mobile - cm).T @ (reference - cr))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    return r, cr - r @ cm


def superimpose_trajectory(positions: DataFrame, ref_frame: int = 0, fit_on: DataFrame | None = None) -> DataFrame:
    """positions with every frame rotated and moved onto the reference frame; fit_on: the atoms (idx) that are fitted."""
    paired = _to_reference(positions, ref_frame)
    keys, own = m.keys(positions), [*m.system_keys(positions, *([fit_on] if fit_on is not None else [])), "idx"]
    paired = paired.join(fit_on.select(*own).withColumn("fit", F.lit(True)), own, "left") if fit_on is not None else paired.withColumn("fit", F.lit(True))

    names = ("x", "y", "z", "rx", "ry", "rz")
    one = F.struct("idx", *(F.col(c).cast("double").alias(c) for c in names), F.col("fit").isNotNull().cast("double").alias("fit"))
    packed = paired.groupBy(*keys).agg(F.collect_list(one).alias("p")).select(*keys, *(F.col("p")[c].alias(c) for c in ("idx", *names, "fit")))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["idx"].value_lengths().to_numpy(zero_copy_only=False)
            start, flat = np.cumsum(size) - size, {c: batch[c].flatten() for c in ("idx", *names, "fit")}
            values = np.stack([flat[c].to_numpy(zero_copy_only=False) for c in (*names, "fit")], axis=-1)
            for n in np.unique(size):
                alike = np.flatnonzero(size == n)
                for k in range(0, len(alike), step := max(1, BLOCK_VALUES // (7 * int(n)))):
                    rows = alike[k : k + step]
                    at = start[rows][:, None] + np.arange(n)
                    part = values[at]
                    moved = superposed(part[..., :3], part[..., 3:6], part[..., 6] > 0).reshape(-1, 3)
                    own = batch.select(keys).take(pa.array(np.repeat(rows, n)))
                    yield pa.RecordBatch.from_arrays([*own.columns, flat["idx"].take(pa.array(at.ravel())), *map(pa.array, moved.T)], names=[*keys, "idx", *AXES])

    return packed.mapInArrow(move, f"{_kinds(positions, [*keys, 'idx'])}x double, y double, z double")


def superposed(mobile: np.ndarray, reference: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Each of mobile (frames, atoms, 3) as rotation() moves it, by the atoms of fit (frames, atoms)."""
    with np.errstate(invalid="ignore"):
        n = fit.sum(1)[:, None]
        cm, cr = (np.where(fit[..., None], c, 0.0).sum(1) / n for c in (mobile, reference))
    a, b = (np.where(fit[..., None], c - m[:, None], 0.0) for c, m in ((mobile, cm), (reference, cr)))
    u, _, vt = np.linalg.svd(np.einsum("ika,ikb->iab", a, b))
    u[..., 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    return (mobile - cm[:, None]) @ (u @ vt) + cr[:, None]


def divergent_pairs(matrix: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """The `top` most different pairs of frames of a matrix, and the mean over all pairs that differ, of each system."""
    own, mean = m.system_keys(matrix), F.avg("rmsd").alias("mean")
    if not own:
        return matrix.orderBy(F.desc("rmsd"), "i", "j").limit(top), matrix.where("rmsd > 0").agg(mean)
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("rmsd"), "i", "j"))  # Spark keeps `top` rows a task before it shuffles
    return matrix.withColumn("_place", place).where(F.col("_place") <= top).drop("_place"), matrix.where("rmsd > 0").groupBy(*own).agg(mean)


def divergent_frames(positions: DataFrame, top: int = 10, align: bool = False, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """divergent_pairs() of the matrix of all frames, without a row for a pair: each pair of blocks gives its `top` pairs and its sum.

    Equal frames are one row with their number and their least ids, so they cost no more than one and their distance is zero.
    The pairs that count are measured again by differences, so that ties are exact.
    """
    packed, own = pack_frames(positions), m.system_keys(positions)
    kind = packed.schema["frame"].dataType.simpleString()
    alike = Window.partitionBy(*own, "coords")
    ranked = packed.withColumn("n", F.count("*").over(alike)).withColumn("place", F.row_number().over(alike.orderBy("frame"))).where(F.col("place") <= top + 1)
    classes = ranked.groupBy(*own, "coords").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("frame")).alias("ids"))
    classes = materialize(classes, "frames")
    n, most = one_size(classes)
    dealt = deal_blocks(classes.withColumn("first", F.col("ids")[0]), "first", block_count(n, block or max(1, BLOCK_VALUES // max(1, most))))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        a, b = pdf[pdf["own"] == low], pdf[pdf["own"] == high]
        count, total, best = (0, 0.0, []) if a.empty or b.empty else block_divergence(a, b, low == high, top, align)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in own}, "pairs": [count], "total": [total], "best": [[{"rmsd": r, "i": i, "j": j} for r, i, j in best]]})

    found = dealt.groupBy(*own, "low", "high").applyInPandas(pair, f"{_kinds(packed, own)}pairs bigint, total double, best array<struct<rmsd: double, i: {kind}, j: {kind}>>")
    each = found.select(*own, F.inline("best")).select(*own, "i", "j", "rmsd")
    sums = (found.groupBy(*own) if own else found).agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    sums = sums.where("pairs > 0") if own else sums
    return divergent_pairs(each, top)[0], sums.select(*own, F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("mean"))


def block_count(n: int, most: int, few: int = 1024) -> int:
    """Blocks for n rows: of `most` rows at the most, and a dozen where they have `few` rows then, so that pairs of blocks are enough tasks."""
    return max(1, -(-n // most), min(12, -(-n // few)))


def deal_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """rows with their block (own) for each pair of blocks (low, high) that it is one of."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *rows.columns)


#: Frames of a tile of distances, either way: a tile stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 256, 256


def block_divergence(a: pd.DataFrame, b: pd.DataFrame, same: bool, top: int, align: bool) -> tuple[int, float, list[tuple]]:
    """Number and sum of the RMSDs above zero between the frames of a and of b (same: each pair once), and the `top` largest (rmsd, i, j).

    Rows are classes of equal frames: coords, n and ids in order.
    """
    x, y = (np.stack(t["coords"].to_numpy()) for t in (a, b))
    ids, weights = (a["ids"].to_numpy(), b["ids"].to_numpy()), (a["n"].to_numpy(float), b["n"].to_numpy(float))
    atoms, best, cut = x.shape[1] // 3, [], -np.inf
    centre = x.mean(0)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    p, q = x - centre, y - centre
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    scale = pp[np.isfinite(pp)].max(initial=0.0) + qq[np.isfinite(qq)].max(initial=0.0)
    count, total = 0.0, 0.0

    def offer(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Takes pairs of classes, whose members make up to `top` pairs each, into the best."""
        nonlocal best, cut
        first = [np.array([ids[0][k][0] for k in i]), np.array([ids[1][k][0] for k in j])]
        key = np.where(np.isnan(r), -np.inf, -r)
        order = np.lexsort((np.maximum(*first), np.minimum(*first), key))[:top]
        members = [(key[o], (min(f, g), max(f, g)), r[o]) for o in order for f in ids[0][i[o]] for g in ids[1][j[o]]]
        best = sorted([*best, *members], key=lambda t: t[:2])[:top]
        cut = -best[-1][0] if len(best) == top else -np.inf

    if same:  # members of one class are equal
        several = sorted((tuple(v[:2]) for v in ids[0] if len(v) > 1))[:top]
        chosen = {v[0] for v in several}
        best = sorted((0.0, (f, g), 0.0) for v in ids[0] if v[0] in chosen for k, f in enumerate(v) for g in v[k + 1 :])[:top]
    for i in range(0, len(p), TILE_ROWS):
        for j in range(i // TILE_COLUMNS * TILE_COLUMNS if same else 0, len(q), TILE_COLUMNS):
            at, to = slice(i, i + TILE_ROWS), slice(j, j + TILE_COLUMNS)
            if align:
                d = block_rmsd(x[at].reshape(-1, atoms, 3), y[to].reshape(-1, atoms, 3), True) ** 2 * atoms
            else:
                d = p[at] @ q[to].T
                d *= -2.0
                d += pp[at][:, None]
                d += qq[to]
                np.maximum(d, 0.0, out=d)
            inner = same and j < i + TILE_ROWS  # else all of its pairs count
            keep = (np.arange(i, i + d.shape[0])[:, None] < np.arange(j, j + d.shape[1])) if inner else None
            if top and (keep is None or keep.any()):
                known = d if keep is None else np.where(keep, d, -1.0)
                if not known.max() < np.square(cut) * atoms - 1e-11 * scale if np.isfinite(cut) else True:
                    known = np.where(np.isnan(known), np.inf, known).ravel()
                    least = max(0.0, np.square(cut) * atoms if np.isfinite(cut) else cut, np.partition(known, -top)[-top] if known.size > top else 0.0)
                    u, v = np.divmod(np.flatnonzero((known >= least - 1e-11 * scale) & (known >= 0)), d.shape[1])
                    if len(u):
                        u, v = u + i, v + j
                        exact = np.sqrt(d[u - i, v - j] / atoms) if align else np.sqrt(np.cumsum(((x[u] - y[v]) ** 2).reshape(-1, atoms, 3) @ np.ones(3), axis=1)[:, -1] / atoms)
                        offer(exact, u, v)
            d /= atoms
            np.sqrt(d, out=d)
            w, z = weights[0][at], weights[1][to]
            if keep is not None or align:
                keep = ~(d <= 0) if keep is None else keep & ~(d <= 0) if align else keep
                count, d = count + w @ keep.astype(float) @ z, np.where(keep, d, 0.0)
            else:
                count += w.sum() * z.sum()
            total += w @ d @ z
    return int(count), float(total), [(float(r), *(int(v) for v in pair)) for _, pair, r in best]


def subsample(positions: DataFrame, most: int) -> DataFrame:
    """Every (n div most)-th of a system's n frames by their places, the first `most` of those."""
    own, keys = m.system_keys(positions), m.keys(positions)
    frames = running(positions.select(*keys).distinct().withColumn("_bucket", F.floor(F.col("frame") / 65536)).withColumn("_all", F.lit(0)), [*own, "_all"], "_bucket", "frame", F.lit(1), "_place")
    n = frames.groupBy(*own).agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.lit(most))).alias("_step"))
    kept = m.beside(frames, n).where((F.col("_place") - 1) % F.col("_step") == 0).where((F.col("_place") - 1) / F.col("_step") < most)
    return positions.join(kept.select(*keys), keys, "left_semi")


def pack_frames(positions: DataFrame) -> DataFrame:
    """frame and the coordinates of all its atoms in order of idx, for frame-wise linear algebra."""
    keys = m.keys(positions)
    rows = positions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("p"))
    return rows.select(*keys, F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("coords"))


def superimpose_packed(frames: DataFrame) -> DataFrame:
    """frames, as pack_frames gives them, each superposed on its system's frame of least number; atoms are paired in order of idx.

    One system's reference is broadcast; with several, each frame is joined with its own.
    """
    one_size(frames)
    keys, own, shared = m.keys(frames), m.system_keys(frames), None
    if own:
        frames = frames.join(frames.groupBy(*own).agg(F.min_by("coords", "frame").alias("ref")), own)
    else:
        ref = frames.agg(F.min_by("coords", "frame")).first()[0]
        shared = frames.sparkSession.sparkContext.broadcast(np.reshape(ref or [], (-1, 3)))

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for _, same in pdf.groupby(own, sort=False, dropna=False) if own else [(None, pdf)]:
                to = shared.value if shared else np.reshape(same["ref"].iloc[0], (-1, 3))
                mean = to.mean(0) if len(to) else np.zeros(3)
                for k in range(0, len(same), step := max(1, BLOCK_VALUES // max(1, to.size))):
                    part = same.iloc[k : k + step]
                    xyz = np.stack(part["coords"].to_numpy()).reshape(len(part), -1, 3)
                    xyz = xyz - xyz.mean(1, keepdims=True)
                    u, _, vt = np.linalg.svd(np.einsum("ika,kb->iab", xyz, to - mean))
                    u[..., 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
                    yield part[keys].assign(coords=list((xyz @ (u @ vt) + mean).reshape(len(part), -1)))

    return frames.mapInPandas(move, f"{_kinds(frames, keys)}coords array<double>")


def unpack_frames(frames: DataFrame) -> DataFrame:
    third = F.transform(F.sequence(F.lit(0), F.expr("size(coords) div 3 - 1")), lambda k: F.struct(k.cast("long").alias("idx"), *(F.element_at("coords", (k * 3 + n + 1).cast("int")).alias(c) for n, c in enumerate(AXES))))
    return frames.select(*m.keys(frames), F.inline(third))


def iter_frames(positions: DataFrame) -> Iterator[pd.DataFrame]:
    """Frames in order of system and number, one at a time on the driver (playback)."""
    for row in pack_frames(positions).orderBy(*m.keys(positions)).toLocalIterator():
        yield pd.DataFrame(np.reshape(row["coords"], (-1, 3)), columns=list(AXES))
