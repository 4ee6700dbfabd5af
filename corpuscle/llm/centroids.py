"""Clusters around centroids by delta Lloyd, in integers.

Assignments (with their vectors) are a table that each round writes anew; sums and counts of the clusters are kept from
round to round. A round compares a vector whose centroid stayed with the centroids that changed alone, since what hasn't
moved can't win against what hasn't either, and a vector whose own centroid moved with all of them. Only vectors that
change hands are summed then, with a sign: out of the old cluster, into the new one. If no centroid changes, all further
rounds would leave everything as it is, so none is made.

What passes the driver is the centroids and one row of sums for each cluster; a task gives that much too. Nothing is
grouped by cluster but those rows, so a cluster of any size is no hot key. Each round's table is made of the one before
it alone, which is deleted once its successor and the sums are there.

Vectors with another number of components, or with one that is null, NaN or infinite, take no part; a null vector neither.
Of equal distances the centroid of the smaller number wins. Repeated rows are vectors of their own; a null id stays null, and its
hash is that of the seed alone; of equal hashes the smaller vector comes first. Fewer vectors than centroids: each is one.
An empty table gives an empty one. Other columns are not read. A component beyond LIMIT / scale is an error, since squared distances must fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import discard, materialize, narrow

CLUSTERS, ROUNDS, SEED, SCALE, SIZE = 16, 3, 1, 64, 64
#: Largest integer of a component: 64 squares of differences are below 2 ** 63.
LIMIT = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long, before int"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors that take part."""
    rows = narrow(vectors, vec_id=id_col, e=vector_col).select(F.col("vec_id").cast("long"), F.col("e").cast("array<double>").alias("e"))
    sound = rows.where((F.size("e") == size) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform("e", lambda x: F.when(F.abs(x) <= LIMIT / scale, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int")))
    return sound.select("vec_id", scaled.alias("v"))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, exact; one centre after another, so that no more than the rows' size is held."""
    out = np.empty((len(x), len(centres)), np.int64)
    for k, c in enumerate(centres):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def compare(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centres: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the changed centroids moved; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = squares(x[lost], centres)
        owner[lost] = d.argmin(1)  # the first of equal ones
        distance[lost] = d.min(1)
    others = np.flatnonzero(changed)
    stay = np.flatnonzero(~lost)
    if len(others) and len(stay):
        d = squares(x[stay], centres[others])
        best, least = others[d.argmin(1)], d.min(1)
        wins = (least < distance[stay]) | ((least == distance[stay]) & (best < owner[stay]))
        owner[stay[wins]], distance[stay[wins]] = best[wins], least[wins]
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, size)


def assign(state: DataFrame, centres: np.ndarray, changed: np.ndarray) -> DataFrame:
    """state after a comparison; before: the cluster that a vector came from."""
    size = centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("cluster").to_numpy()
            owner, distance = compare(_matrix(batch.column("v"), size), before, batch.column("distance").to_numpy(), centres, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], names=["vec_id", "v", "cluster", "distance", "before"])

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(work, STATE)


def transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, list[list[int]]]:
    """Signed counts and sums of each cluster over the vectors that changed hands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            for name, sign in (("cluster", 1), ("before", -1)):
                c = batch.column(name).to_numpy()
                for j in np.unique(c[c >= 0]):
                    counts[j] += sign * int((c == j).sum())
                    sums[j] += sign * x[c == j].sum(0)
        used = np.flatnonzero(counts.astype(bool) | sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    moved = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(work, "cluster int, n long, sums array<long>")
    rows = moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums")).collect()
    counts, sums = np.zeros(k, np.int64), [[0] * size for _ in range(k)]
    for r in rows:
        counts[r["cluster"]], sums[r["cluster"]] = r["n"], list(r["sums"])
    return counts, sums


def first_centres(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, v, cluster, distance and before of every vector that takes part, and the final centroids."""
    whole = whole_vectors(vectors, id_col, vector_col, size, scale)
    centres = first_centres(whole, k, seed)
    state = whole.select("*", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    if not centres:
        return state.withColumn("before", F.lit(-1)), centres
    counts, sums, changed, old = np.zeros(len(centres), np.int64), [[0] * size for _ in centres], np.ones(len(centres), bool), []
    for left in range(rounds, -1, -1):
        state = materialize(assign(state, np.array(centres, np.int64), changed), "clusters")
        if left:
            n, moved = transfers(state, len(centres), size)
            counts += n
            sums = [[a + b for a, b in zip(s, m, strict=True)] for s, m in zip(sums, moved, strict=True)]
            new = [[s // int(n) for s in row] if n else c for row, n, c in zip(sums, counts, centres, strict=True)]
            changed = np.array([a != b for a, b in zip(new, centres, strict=True)])
            centres = new
        discard(*old)
        old = [state]
        if not changed.any():
            break
    return state, centres


def cluster_report(vectors: DataFrame, **options: object) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the cluster's centroid, of each vector."""
    state, centres = delta_lloyd(vectors, **options)
    spark = state.sparkSession
    spread = dict(state.groupBy("cluster").agg(F.sum("distance")).collect()) if centres else {}
    rows = [(c, spread[c], sum(spread.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c in sorted(spread)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
