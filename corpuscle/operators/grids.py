"""Pocket grids, pharmacophores and connected components."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.operators.spatial import cell_join
from corpuscle.sources.store import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and root (least id of its component); nodes: id, edges: a, b; ids of any type with an order, structs too.

    Labels pass along edges and then jump to the label of the label, so long chains shorten by half in a step. Edges and each step are written, so that no step makes the edges again.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        near = both.join(m.large(labels.select(F.col("id").alias("b"), "root")), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        met = labels.join(m.large(near), "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("root").alias("up"))
        step = materialize(met.join(m.large(jump), "new", "left").select("id", F.least("new", F.coalesce("up", "new")).alias("new"), "root"), "labels")
        if not step.where("new <> root").limit(1).count():
            return step.select("id", F.col("new").alias("root"))
        labels = step.select("id", F.col("new").alias("root"))


#: Grid points an axis of a block: blocks that no atom reaches are never made.
GRID_BLOCK = 16


def pocket_points(system: DataFrame, spacing: float = 1.0, probe: float = 1.4, reach: float = 5.0) -> DataFrame:
    """Grid points (gx, gy, gz, x, y, z) in no atom's extended sphere that enough atoms surround, in each frame.

    The grid is as fine as `spacing` however wide a frame is. Blocks of it that atoms reach are made from the atoms, so its size grows with these
    and not with the frame's box; points in an extended sphere go at the first atom that has them, and only the others are counted for.
    """
    keys = m.keys(system)
    atoms = system.select(*keys, "x", "y", "z", m.lookup(m.CONTACT_RADIUS, F.col("element"), m.DEFAULT_RADIUS).alias("r"))
    pad, widest = probe + 2.0, max(*m.CONTACT_RADIUS.values(), m.DEFAULT_RADIUS)
    box = atoms.groupBy(*keys).agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz"))
    box = box.select(*keys, *((F.col(f"lo{c}") - pad).alias(f"lo{c}") for c in "xyz"), *(F.ceil((F.col(f"hi{c}") + pad - (F.col(f"lo{c}") - pad)) / spacing).alias(f"n{c}") for c in "xyz"))
    wide, far = spacing * GRID_BLOCK, widest + reach + spacing  # a step more than an atom reaches
    blocks = atoms.select(*keys, *(F.floor(F.col(c) / wide).alias(f"c{c}") for c in "xyz")).distinct()  # few, so that the box of one frame meets few rows
    blocks = blocks.join(m.large(box), keys) if keys else blocks.crossJoin(F.broadcast(box))
    for c in "xyz":
        first, last = (F.floor((F.col(f"c{c}") * wide + side - F.col(f"lo{c}")) / wide) for side in (-far, wide + far))
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.floor(F.col(f"n{c}") / GRID_BLOCK))
        blocks = blocks.withColumn(f"b{c}", F.explode(F.when(first <= last, F.sequence(first, last))))
    grid = blocks.select(*keys, *(f"{k}{c}" for k in ("lo", "n", "b") for c in "xyz")).distinct()
    for c in "xyz":
        start = F.col(f"b{c}") * GRID_BLOCK
        grid = grid.withColumn(f"g{c}", F.explode(F.sequence(start, F.least(start + GRID_BLOCK - 1, F.col(f"n{c}")))))
    at = ("gx", "gy", "gz", *"xyz")
    grid = grid.select(*keys, *(F.col(f"g{c}").cast("int").alias(f"g{c}") for c in "xyz"), *((F.col(f"lo{c}") + F.col(f"g{c}") * F.lit(float(spacing))).alias(c) for c in "xyz"))
    d = F.sqrt(sum(((F.col(f"l_{c}") - F.col(f"r_{c}")) * (F.col(f"l_{c}") - F.col(f"r_{c}")) for c in "yz"), (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x"))))
    empty = cell_join(grid, atoms, widest + probe, how="left_anti", condition=d < F.col("r_r") + probe)
    near = cell_join(empty, atoms, widest + reach, condition=d < F.col("r_r") + reach)
    counted = near.groupBy(*keys, *(F.col(f"l_{c}").alias(c) for c in at)).agg(F.count("*").alias("around"))
    return counted.where(F.col("around") >= max(3, math.floor(reach / spacing))).select(*keys, *at)


#: Grid points an axis of a block whose points are linked in one task, and steps that a link is shorter than.
LINK_BLOCK, LINK_STEPS = 32, 3


def linked(at: np.ndarray, xyz: np.ndarray, limit: float) -> np.ndarray:
    """For each point of a block (rows of `at` in order, positions `xyz`) the first that links of a squared length below limit lead to."""
    low, wide = at.min(0), np.ptp(at, axis=0) + 2 * LINK_STEPS + 1
    place = ((at - low) * [wide[1] * wide[2], wide[2], 1]).sum(1)
    dense = np.full(int(wide.prod()), -1, np.int32)
    dense[place] = np.arange(len(at))
    steps = np.arange(-LINK_STEPS, LINK_STEPS + 1)
    i, j = [], []
    for off in (np.array(o) for o in np.ndindex(*(len(steps),) * 3)):
        off = off - LINK_STEPS
        if tuple(off) <= (0, 0, 0) or (off * off).sum() > LINK_STEPS * LINK_STEPS:
            continue
        # the room beside a block keeps a step from leading to another line, but for steps back from its start
        inside = ((at - low + off) >= 0).all(1)
        other = np.where(inside, dense[np.where(inside, place + (off * [wide[1] * wide[2], wide[2], 1]).sum(), 0)], -1)
        own = np.flatnonzero(other >= 0)
        other = other[own]
        d = xyz[own] - xyz[other]
        near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] < limit
        i.append(own[near])
        j.append(other[near])
    i, j, first = np.concatenate(i), np.concatenate(j), np.arange(len(at))
    while len(i):
        a, b = first[i], first[j]
        np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
        while (first[first] != first).any():
            first = first[first]
        open_ = first[i] != first[j]
        i, j = i[open_], j[open_]
    return first


def grid_components(points: DataFrame, spacing: float) -> tuple[DataFrame, DataFrame]:
    """Components of grid points (gx, gy, gz, x, y, z) by links shorter than LINK_STEPS steps: parts of them (part: their first point; n, and sums of x, y, z)
    and the root of each part, the first point of its component.

    Points are linked within blocks of the grid, in arrays; a point near a block's lower side is also in the block before it, and what ties parts
    together is that they share points. So only parts pass through components(), and not points and their links.
    """
    keys, kinds = m.keys(points), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name in m.KEYS)
    copies = points
    for c in "xyz":
        copies = copies.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(f"g{c}") - LINK_STEPS) / LINK_BLOCK), F.floor(F.col(f"g{c}") / LINK_BLOCK))))
    limit = (LINK_STEPS * spacing) ** 2

    def link(table: pa.Table) -> pa.Table:
        at, xyz = (np.stack([table[c].to_numpy() for c in names], -1) for names in (("gx", "gy", "gz"), tuple("xyz")))
        order = np.lexsort(at.T[::-1])
        at, xyz = at[order].astype(np.int64), xyz[order]
        block = np.array([table[f"b{c}"][0].as_py() for c in "xyz"])
        first = linked(at, xyz, limit)
        own = (at // LINK_BLOCK == block).all(1)
        # a point is in one block alone if it is its own and no lower side is near
        shared = ~own | (at % LINK_BLOCK < LINK_STEPS).any(1)
        sums, n = np.zeros((len(at), 3)), np.bincount(first[own], minlength=len(at))
        np.add.at(sums, first[own], xyz[own])
        rows = np.flatnonzero((first == np.arange(len(at))) | shared)
        root = rows == first[rows]
        point = pa.StructArray.from_arrays([pa.array(at[rows, k].astype(np.int32)) for k in range(3)], names=["gx", "gy", "gz"])
        part = pa.StructArray.from_arrays([pa.array(at[first[rows], k].astype(np.int32)) for k in range(3)], names=["gx", "gy", "gz"])
        values = [pa.array(np.where(root, n[rows], 0)), *(pa.array(np.where(root, sums[rows, k], 0.0)) for k in range(3))]
        return pa.table([*(table[k].slice(0, 1).take(pa.array(np.zeros(len(rows), np.int64))) for k in keys), point, part, pa.array(shared[rows]), *values], names=[*keys, "point", "part", "shared", "n", "x", "y", "z"])

    place = "struct<gx: int, gy: int, gz: int>"
    found = copies.groupBy(*keys, "bx", "by", "bz").applyInArrow(link, f"{kinds}{', ' if keys else ''}point {place}, part {place}, shared boolean, n bigint, x double, y double, z double")
    found = materialize(found, "linked")
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    parts = found.groupBy(*keys, "part").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "z")))
    ties = found.where("shared").groupBy(*keys, "point").agg(F.collect_set("part").alias("all")).where(F.size("all") > 1)
    ties = ties.select(*keys, F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    roots = components(parts.select(node("part").alias("id")), ties.select(node("a").alias("a"), node("b").alias("b")))
    return parts, roots.select(*(f"id.{k}" for k in keys), F.col("id.id").alias("part"), F.col("root.id").alias("root"))


def binding_sites(system: DataFrame, spacing: float = 1.0, least: float = 100.0, most: int | None = None) -> DataFrame:
    """frame, rank, centre, volume, score and number of lining atoms of the pockets of each frame, the best first; `most`: of so many alone."""
    keys = m.keys(system)
    parts, roots = grid_components(pocket_points(system, spacing), spacing)
    pockets = parts.join(m.large(roots), [*keys, "part"]).groupBy(*keys, "root").agg((F.sum("n") * F.lit(float(spacing) ** 3)).alias("volume"), *((F.sum(c) / F.sum("n")).alias(c) for c in "xyz")).where(F.col("volume") >= least)
    atoms = system.select(*keys, F.upper("element").alias("e"), "x", "y", "z")
    lining = cell_join(pockets.select(*keys, "root", "volume", "x", "y", "z"), atoms, 10.0, how="left", strict=True)
    scored = lining.groupBy(*keys, F.col("l_root").alias("root"), F.col("l_volume").alias("volume"), *(F.col(f"l_{c}").alias(c) for c in "xyz")).agg(F.count("r_x").alias("lining"), F.count(F.when(F.col("r_e") == "C", 1)).alias("carbon"))
    scored = scored.withColumn("score", F.col("volume") * 0.01 + F.col("carbon") / F.greatest("lining", F.lit(1)) * 10.0)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "root")))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select(*keys, "rank", "x", "y", "z", "volume", "score", "lining")


def pharmacophore(system: DataFrame) -> DataFrame:
    """kind, key (atom or residue), centre and number of atoms of donors, acceptors, charges and aromatic residues in each frame."""
    e, empty, keys = F.upper("element"), F.lit(""), m.keys(system)
    single = lambda kind, elements: system.where(e.isin(*elements)).select(*keys, F.lit(kind).alias("kind"), F.col("idx").cast("string").alias("key"), "x", "y", "z", F.lit(1).cast("long").alias("n"))
    key = F.concat_ws(":", F.coalesce("chain_id", empty), F.col("residue_id").cast("string"))

    def grouped(kind: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, key.alias("key")).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n")).select(*keys, F.lit(kind).alias("kind"), "key", "x", "y", "z", "n")

    name = F.col("resname")
    parts = [
        single("donor", ("N", "S")),
        single("acceptor", ("N", "O", "S", "F")),
        grouped("positive", system.where(m.among(name, m.POSITIVE))),
        grouped("negative", system.where(m.among(name, m.NEGATIVE))),
        grouped("aromatic", system.where(m.among(name, m.AROMATIC[:-1]) & e.isin("C", "N"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def pharmacophore_json(features: DataFrame, digits: int = 4) -> DataFrame:
    """frame and one JSON text of its features (as pharmacophore gives them): n_features, and of each its type, centre, key and atoms."""
    number = f"decimal(18,{digits})"
    one = F.struct(F.col("kind").alias("type"), "key", F.array(*(F.round(c, digits).cast(number) for c in "xyz")).alias("center"), F.col("n").cast("bigint").alias("n_atoms"))
    return features.groupBy(*m.keys(features)).agg(F.to_json(F.struct(F.count("*").alias("n_features"), F.array_sort(F.collect_list(one)).alias("features"))).alias("json"))


def hydrophobic_regions(system: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """frame, root, centre, radius and size of the connected regions of carbon and sulphur atoms of each frame."""
    keys = m.keys(system)
    own = system.where(F.upper("element").isin("C", "S")).select(*keys, "idx", "x", "y", "z")
    node = lambda c: F.struct(*keys, F.col(c).alias("idx"))
    edges = cell_join(own, own, cutoff, condition=F.col("l_idx") < F.col("r_idx"), strict=True).select(node("l_idx").alias("a"), node("r_idx").alias("b"))
    roots = components(own.select(node("idx").alias("id")), edges).select(*(f"id.{k}" for k in keys), "id.idx", F.col("root.idx").alias("root"))
    n = F.count("*")
    return own.join(m.large(roots), [*keys, "idx"]).groupBy(*keys, "root").agg(*(F.avg(c).alias(c) for c in "xyz"), F.greatest(F.lit(1.5), n * 0.3).alias("radius"), n.alias("n"))
