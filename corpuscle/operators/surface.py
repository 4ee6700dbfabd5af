"""Solvent-accessible surface, patches, pKa and water density."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.operators.spatial import cell_join


#: Distances from sphere points to neighbours that are computed at once.
CHUNK = 1_000_000


def _areas(batches: Iterator[pa.RecordBatch], sphere: np.ndarray, kept: int) -> Iterator[pa.RecordBatch]:
    """In: the `kept` columns (keys, idx, residue_id), x, y, z, r, near (x, y, z, r of each neighbour, flat). Out: those kept, and area."""
    for batch in batches:
        x, y, z, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(kept, kept + 4))
        n = pc.fill_null(pc.list_value_length(batch.column(kept + 4)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        near = batch.column(kept + 4).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        free, ends = np.full(batch.num_rows, len(sphere)), np.cumsum(n)
        step = max(1, CHUNK // len(sphere))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, (ends[at] - n[at]) + step, "right")))
            own = np.repeat(np.arange(at, until), n[at:until])
            if len(own):
                other = near[ends[at] - n[at] : ends[until - 1]]
                dx, dy, dz = ((v[own][:, None] + r[own][:, None] * sphere[:, k]) - other[:, k : k + 1] for k, v in enumerate((x, y, z)))
                covered = np.sqrt(dx * dx + dy * dy + dz * dz) < other[:, 3:]
                some = np.flatnonzero(n[at:until]) + at
                free[some] = len(sphere) - np.logical_or.reduceat(covered, (ends - n)[some] - (ends[at] - n[at])).sum(1)
            at = until
        area = free / float(len(sphere)) * (4 * math.pi) * r * r
        yield pa.record_batch([*batch.columns[:kept], pa.array(area)], names=[*batch.schema.names[:kept], "area"])


def sasa(system: DataFrame, probe: float = m.PROBE, points: int = m.SPHERE_POINTS) -> DataFrame:
    """frame, idx, residue_id and area by sphere points that lie in no neighbour's extended sphere.

    Cells are as wide as the greatest radius that occurs asks for. Neighbours come from a cell join and are gathered for
    each atom (their number is bounded by packing); no row is made for a point.
    """
    keys = m.keys(system)
    own = system.select(*keys, "idx", "residue_id", *(F.col(c).cast("double").alias(c) for c in "xyz"), (m.lookup(m.SURFACE_RADIUS, F.col("element"), m.DEFAULT_RADIUS) + F.lit(probe)).cast("double").alias("r"))
    largest = own.agg(F.max("r")).first()[0] or probe
    pairs = cell_join(own.select(*keys, "idx", "x", "y", "z", "r"), own.select(*keys, "idx", "x", "y", "z", "r"), 2 * largest, condition=F.col("l_idx") != F.col("r_idx"))
    pairs = pairs.where((F.sqrt("d2") > 1e-6) & (F.sqrt("d2") < F.col("l_r") + F.col("r_r")))
    around = pairs.groupBy(*keys, F.col("l_idx").alias("idx")).agg(F.flatten(F.collect_list(F.array(*(F.col(f"r_{c}") for c in "xyzr")))).alias("near"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    rows = own.join(m.large(around), [*keys, "idx"], "left").select(*keys, "idx", "residue_id", "x", "y", "z", "r", "near")
    return rows.mapInArrow(partial(_areas, sphere=np.array(m.sphere(points)), kept=len(keys) + 2), ", ".join(f"{c} {kinds[c]}" for c in (*keys, "idx", "residue_id")) + ", area double")


def sasa_per_residue(areas: DataFrame) -> DataFrame:
    return areas.where("residue_id is not null").groupBy(*m.keys(areas), "residue_id").agg(F.sum("area").alias("area"))


def surface_patches(system: DataFrame, areas: DataFrame, threshold: float = 5.0) -> DataFrame:
    """frame, residue_id and class of the residues with at least threshold of surface."""
    keys = m.keys(system, areas)
    names = system.where("residue_id is not null and resname is not null and resname <> ''").groupBy(*keys, "residue_id").agg(F.upper(F.min_by("resname", "idx")).alias("resname"))
    kind = F.lit("other")
    for name, residues in reversed((("hydrophobic", m.HYDROPHOBIC), ("positive", m.POSITIVE), ("negative", m.NEGATIVE), ("polar", m.POLAR))):
        kind = F.when(m.among(F.col("resname"), residues), name).otherwise(kind)
    exposed = sasa_per_residue(areas).where(F.col("area") >= threshold)
    return exposed.join(m.large(names), [*keys, "residue_id"], "left").select(*keys, "residue_id", kind.alias("kind"))


def estimate_pka(system: DataFrame, areas: DataFrame, buried: float = 10.0) -> DataFrame:
    """chain_id, residue_id, resname, pka and whether the residue is buried, of the ionisable residues of each frame, in the order of chain and residue."""
    keys = m.keys(system, areas)
    own = system.where(m.among(F.col("resname"), tuple(m.MODEL_PKA))).groupBy(*keys, F.coalesce("chain_id", F.lit("")).alias("chain_id"), "residue_id").agg(F.upper(F.min_by("resname", "idx")).alias("resname"))
    shift = F.when(m.among(F.col("resname"), ("ASP", "GLU", "CYS", "TYR")), 1.5).otherwise(-1.5)
    out = own.join(sasa_per_residue(areas), [*keys, "residue_id"], "left").withColumn("buried", F.coalesce(F.col("area") < buried, F.lit(False)))
    pka = m.lookup(m.MODEL_PKA, F.col("resname")) + F.when(F.col("buried"), shift).otherwise(0.0)
    return out.select(*keys, "chain_id", "residue_id", "resname", F.round(pka, 2).alias("pka"), "buried").orderBy(*keys, "chain_id", F.coalesce("residue_id", F.lit(0)))


def protonation(pkas: DataFrame, ph: float = 7.4) -> DataFrame:
    state = F.when(F.col("pka") > ph + 1.5, "protonated").when(F.col("pka") < ph - 1.5, "deprotonated").otherwise("mixed")
    return pkas.withColumn("state", state)


def water_density(system: DataFrame, spacing: float = 0.5, most: int = 100) -> DataFrame:
    """vx, vy, vz, density (waters a frame) of the occupied voxels of a system, and their lower corners x, y, z.

    A system's grid is one row (its origin and spacing); empty voxels are never made.
    """
    own = m.system_keys(system)
    waters = system.where(m.among(F.col("resname"), m.DENSITY_WATERS) & m.among(F.col("name"), m.DENSITY_OXYGENS))
    lo, hi = [F.min(c) - 1.0 for c in "xyz"], [F.max(c) + 1.0 for c in "xyz"]
    span = F.greatest(*(h - low for h, low in zip(hi, lo, strict=True)))
    grid = waters.groupBy(*own).agg(*(low.alias(f"o{c}") for low, c in zip(lo, "xyz", strict=True)), F.when(F.ceil(span / spacing) + 1 > most, span / (most - 1)).otherwise(spacing).alias("step"))
    frames = system.select(*own, "frame").distinct().groupBy(*own).agg(F.count("*").alias("frames"))
    placed = m.beside(waters, grid).select(*own, "ox", "oy", "oz", "step", *(F.floor((F.col(c) - F.col(f"o{c}")) / F.col("step")).alias(f"v{c}") for c in "xyz"))
    counted = placed.groupBy(*own, "vx", "vy", "vz").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("ox", "oy", "oz", "step")))
    return m.beside(counted, frames).select(*own, "vx", "vy", "vz", (F.col("n") / F.col("frames")).alias("density"), *((F.col(f"o{c}") + F.col(f"v{c}") * F.col("step")).alias(c) for c in "xyz"))


def hydration_sites(density: DataFrame, contour: float = 2.0) -> DataFrame:
    """Voxels denser than mean + contour * sigma of the occupied ones."""
    level = density.groupBy(*m.system_keys(density)).agg((F.avg("density") + contour * F.stddev_pop("density")).alias("level"))
    return m.beside(density, level).where("density > level").drop("level")
