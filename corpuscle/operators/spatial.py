"""Distance joins by grid cells.

Cells are twice as wide as the cutoff, so what lies within it of a point is in eight cells at most. The right side is copied to these and meets the
left side in an equi-join on (keys, cell), keys being those of system and frame that both sides have; the exact distance is a condition of
the join. A pair meets in exactly one cell, so nothing is removed afterwards, and no pair beyond adjacent cells is made. The join always
shuffles: copies made by explode() are no part of the planner's estimate of a size, which would have it broadcast tables that the driver can't hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import model as m


#: By how much more than the cutoff a point is copied, for what rounding may do to a distance.
SLACK = 1 + 1e-9


def _cell(axis: str, cutoff: float, off: float = 0.0) -> Column:
    """The cell of a point, or of one that lies `off` cutoffs farther."""
    return F.floor((F.col(axis) + F.lit(off * cutoff) if off else F.col(axis)) / F.lit(2.0 * cutoff * SLACK))


#: Points of the left side from which a cell is hot (and at least one in SHARE of all, so there are no more hot cells than that), and points of a part of it.
HOT_CELL, SHARE, PART = 4096, 10_000, 1024
DEAL = "spark.corpuscle.dealHotCells"


def hot_cells(cells: DataFrame, on: list[str]) -> DataFrame:
    """The hot cells of points with the columns `on`, at most SHARE of them, and the parts that each is dealt to."""
    counts = cells.groupBy(*on).agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") / F.lit(SHARE)).alias("_least"))
    large = counts.where(F.col("n") >= HOT_CELL).crossJoin(F.broadcast(total))  # of one row
    return large.where(F.col("n") >= F.col("_least")).select(*on, F.ceil(F.col("n") / PART).cast("int").alias("_parts"))


def cell_join(left: DataFrame, right: DataFrame, cutoff: float, keys: Sequence[str] | None = None, how: str = "inner", condition: Column | None = None, strict: bool = False, deal: bool | None = None) -> DataFrame:
    """Pairs of left and right within cutoff (inclusive, or strictly).

    Columns of left are named l_<name>, of right r_<name>; keys keep theirs, and d2 is the squared distance (inner).
    deal: the cells of left are counted first, and the points of a hot one, as models filled with zeros have, are dealt to parts
    that each meet its neighbours, so that no task has them all. It costs an aggregation and changes no result; where it isn't given, the
    session's setting spark.corpuscle.dealHotCells tells (false if unset), so that all operators can be told at once.
    """
    keys = m.keys(left, right) if keys is None else list(keys)
    own = [c for c in left.columns if c not in keys]
    other = [c for c in right.columns if c not in keys]
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in own), *(_cell(c, cutoff).alias(f"_c{c}") for c in "xyz"))
    b = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"r_{c}") for c in other), *(F.sequence(_cell(c, cutoff, -SLACK), _cell(c, cutoff, SLACK)).alias(f"_s{c}") for c in "xyz"))
    for c in "xyz":
        b = b.withColumn(f"_n{c}", F.explode(f"_s{c}")).drop(f"_s{c}")
    parts = []
    if deal if deal is not None else left.sparkSession.conf.get(DEAL, "false") == "true":
        at = [f"_c{c}" for c in "xyz"]
        hot = hot_cells(a.select(*keys, *at), [*keys, *at])
        a = a.join(F.broadcast(hot), [*keys, *at], "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*(f"l_{c}" for c in own)), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
        near = hot.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(f"_c{c}").alias(f"_n{c}") for c in "xyz"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_deal"))
        b = b.join(F.broadcast(near), [*(f"_k_{k}" for k in keys), *(f"_n{c}" for c in "xyz")], "left").withColumn("_deal", F.coalesce("_deal", F.lit(0)))
        parts = [F.col("_part") == F.col("_deal")]
    dx, dy, dz = (F.col(f"l_{c}") - F.col(f"r_{c}") for c in "xyz")
    d2 = dx * dx + dy * dy + dz * dz
    limit = F.lit(float(cutoff) * float(cutoff))
    on = d2 < limit if strict else d2 <= limit
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    for c in "xyz":
        on = on & (F.col(f"_c{c}") == F.col(f"_n{c}"))
    for p in parts:
        on = on & p
    if condition is not None:
        on = on & condition
    out = a.join(m.large(b), on, how)
    if how in ("left_semi", "left_anti"):
        return out.select(*keys, *(F.col(f"l_{c}").alias(c) for c in own))
    return out.select(*keys, *(f"l_{c}" for c in own), *(f"r_{c}" for c in other), d2.alias("d2"))


def bonds_within(system: DataFrame, cutoff: float) -> DataFrame:
    """frame, i, j of atoms within cutoff, i < j."""
    keys = m.keys(system)
    own = system.select(*keys, "idx", "x", "y", "z")
    return cell_join(own, own, cutoff, condition=F.col("l_idx") < F.col("r_idx")).select(*keys, F.col("l_idx").alias("i"), F.col("r_idx").alias("j"))


def covalent_bonds(system: DataFrame, tolerance: float = 0.45, longest: float = 3.0, shortest: float = 0.4) -> DataFrame:
    """frame, i, j with shortest < d < min(sum of covalent radii + tolerance, longest)."""
    keys = m.keys(system)
    own = system.select(*keys, "idx", "x", "y", "z", m.lookup(m.COVALENT_RADIUS, F.col("element"), m.DEFAULT_COVALENT).alias("r"))
    pairs = cell_join(own, own, longest, condition=F.col("l_idx") < F.col("r_idx"), strict=True)
    most = F.least(F.col("l_r") + F.col("r_r") + F.lit(tolerance), F.lit(longest))
    return pairs.where((F.sqrt("d2") > shortest) & (F.sqrt("d2") < most)).select(*keys, F.col("l_idx").alias("i"), F.col("r_idx").alias("j"))


def bonds_between(bonds: DataFrame, selected: DataFrame) -> DataFrame:
    """Bonds with both ends in selected (a column idx)."""
    keys = m.keys(bonds, selected)
    a, b = selected.select(*keys, F.col("idx").alias("i")), selected.select(*keys, F.col("idx").alias("j"))
    return bonds.join(m.large(a), [*keys, "i"], "left_semi").join(m.large(b), [*keys, "j"], "left_semi").select(*bonds.columns)


def missing_bonds(pairs: DataFrame, bonds: DataFrame) -> DataFrame:
    """Rows of pairs (i, j) that no bond joins, in either direction."""
    keys = m.keys(pairs, bonds)
    known = bonds.select(*(F.col(k).alias(f"_{k}") for k in keys), F.least("i", "j").alias("_i"), F.greatest("i", "j").alias("_j"))
    on = (F.least("i", "j") == F.col("_i")) & (F.greatest("i", "j") == F.col("_j"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return pairs.join(m.large(known), on, "left_anti")


def nearest_atom(system: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """idx and distance of the atom nearest to a point in each frame, the lowest index of several."""
    d2 = sum((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip("xyz", (x, y, z), strict=True))
    keys = m.keys(system)
    best = system.select(*keys, F.struct(d2.alias("d2"), F.col("idx").alias("idx")).alias("n")).groupBy(*keys).agg(F.min("n").alias("n"))
    return best.select(*keys, F.col("n.idx").alias("idx"), F.sqrt("n.d2").alias("d"))


def picked_atom(system: DataFrame, bonds: DataFrame, x: float, y: float, z: float, most: int = 8) -> DataFrame:
    """The atom nearest to a point in each frame, its distance and the first `most` atoms that bonds (frame, i, j) join it with."""
    near = nearest_atom(system, x, y, z)
    keys = m.keys(bonds, near)
    ends = bonds.select(*keys, F.col("i").alias("idx"), F.col("j").alias("other")).unionByName(bonds.select(*keys, F.col("j").alias("idx"), F.col("i").alias("other")))
    held = ends.join(m.large(near.select(*keys, "idx")), [*keys, "idx"]).groupBy(*keys, "idx").agg(F.slice(F.array_sort(F.collect_set("other")), 1, most).alias("bonded"))
    return near.join(held, [*keys, "idx"], "left").select(*m.keys(near), "idx", "d", F.coalesce("bonded", F.array().cast("array<bigint>")).alias("bonded"))


def line_array(bonds: DataFrame) -> DataFrame:
    """Bonds as cells of a line mesh: the number of points, then the two ends."""
    return bonds.select(*m.system_keys(bonds), F.array(F.lit(2).cast("bigint"), F.col("i").cast("bigint"), F.col("j").cast("bigint")).alias("cell"))


def line_pairs(cells: DataFrame) -> DataFrame:
    """i and j of the cells of a line mesh."""
    return cells.select(*m.system_keys(cells), F.col("cell")[1].alias("i"), F.col("cell")[2].alias("j"))


def effective_colors(atoms: DataFrame, base: tuple[Column, Column, Column], selected: Column, highlight: tuple[float, float, float] = (1.0, 0.85, 0.2)) -> DataFrame:
    """idx and colour: selected atoms are highlighted and all others dimmed to a fifth; all keep theirs where none is selected."""
    keys = m.system_keys(atoms)
    own = atoms.select(*keys, "idx", F.coalesce(selected, F.lit(False)).alias("_s"), *(c.alias(n) for c, n in zip(base, "rgb", strict=True)))
    rows = m.beside(own, atoms.groupBy(*keys).agg(F.coalesce(F.max(selected), F.lit(False)).alias("_any")))
    return rows.select(*keys, "idx", *(F.when(~F.col("_any"), F.col(n)).when(F.col("_s"), F.lit(h)).otherwise(F.col(n) * 0.2).alias(n) for n, h in zip("rgb", highlight, strict=True)))
