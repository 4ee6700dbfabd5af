"""Interactions between two groups of atoms, all as cell joins.

Input: a system with boolean columns in_a and in_b. Each detector returns the keys (system, frame), i, j and distance (and what it adds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.geometry import angle, point
from corpuscle.operators.spatial import cell_join

KINDS = ("hbonds", "salt_bridges", "clashes", "hydrophobic", "halogen", "pi")


def _atoms(system: DataFrame, *more: Column) -> DataFrame:
    return system.select(*m.keys(system), "idx", "x", "y", "z", "in_a", "in_b", *more)


def _across() -> Column:
    return (F.col("l_in_a") & F.col("r_in_b")) | (F.col("l_in_b") & F.col("r_in_a"))


def _pair(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select(*m.keys(pairs), F.col("l_idx").alias("i"), F.col("r_idx").alias("j"), F.sqrt("d2").alias("distance"), *more)


def hbonds(system: DataFrame) -> DataFrame:
    """Donor i, acceptor j, angle D-H...A at the nearest hydrogen, null without one. The hydrogen is found once a donor, not once a pair."""
    element, keys = F.upper("element"), m.keys(system)
    donors = _atoms(system.where(element.isin("N", "O", "S")))
    acceptors = _atoms(system.where(element.isin("N", "O", "S", "F")))
    hydrogens = system.where(element == "H").select(*keys, "idx", "x", "y", "z")
    near = cell_join(donors.select(*keys, "idx", "x", "y", "z"), hydrogens, m.HYDROGEN_DISTANCE, strict=True)
    near = near.groupBy(*keys, F.col("l_idx").alias("l_idx")).agg(F.min(F.struct("d2", F.col("r_idx").alias("h"), F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col("r_z").alias("z"))).alias("n"))
    pairs = cell_join(donors, acceptors, m.HBOND_DISTANCE, condition=_across() & (F.col("l_idx") != F.col("r_idx"))).join(m.large(near), [*keys, "l_idx"], "left")
    bend = F.when(F.col("n").isNotNull(), angle(point("l_"), point(struct="n"), point("r_")))
    found = pairs.withColumn("angle", bend).where(F.col("angle").isNull() | (F.col("angle") >= m.HBOND_ANGLE))
    return _pair(found, F.col("n.h").alias("h"), F.col("angle"))


def salt_bridges(system: DataFrame) -> DataFrame:
    plus, minus = system.where(m.among(F.col("resname"), m.POSITIVE)), system.where(m.among(F.col("resname"), m.NEGATIVE))
    return _pair(cell_join(_atoms(plus), _atoms(minus), m.SALT_BRIDGE, condition=_across()))


def clashes(system: DataFrame) -> DataFrame:
    """i in A, j in B, no hydrogen, nearer than the radii less the allowed overlap."""
    own = _atoms(system, F.upper("element").alias("e"), m.lookup(m.CONTACT_RADIUS, F.col("element"), m.DEFAULT_RADIUS).alias("r")).where("e is null or e <> 'H'").drop("e")
    most = 2 * max(m.CONTACT_RADIUS.values()) - m.VDW_OVERLAP
    pairs = cell_join(own.where("in_a"), own.where("in_b"), most, condition=F.col("l_idx") != F.col("r_idx"))
    limit = F.col("l_r") + F.col("r_r") - F.lit(m.VDW_OVERLAP)
    return _pair(pairs.where(F.sqrt("d2") < limit), (limit - F.sqrt("d2")).alias("overlap"))


def hydrophobic(system: DataFrame, cutoff: float = m.HYDROPHOBIC_CONTACT) -> DataFrame:
    """Carbon and sulphur contacts of A and B; where the groups overlap an atom meets itself too."""
    own = _atoms(system.where(F.upper("element").isin("C", "S")))
    return _pair(cell_join(own.where("in_a"), own.where("in_b"), cutoff))


def halogen_bonds(system: DataFrame) -> DataFrame:
    """Halogen i bound to carbon c (the first within reach), acceptor j; exactly one of both is in A, the other in B or not in A."""
    element, keys = F.upper("element"), m.keys(system)
    halogens = _atoms(system.where(element.isin("F", "CL", "BR", "I")))
    carbons = system.where(element == "C").select(*keys, "idx", "x", "y", "z")
    bound = cell_join(halogens, carbons, m.HALOGEN_CARBON, condition=F.col("l_idx") != F.col("r_idx"), strict=True).groupBy(*keys, "l_idx").agg(F.min("r_idx").alias("c"))
    acceptors = _atoms(system.where(element.isin("N", "O", "S")))
    one = (F.col("l_in_a") | F.col("l_in_b")) & (F.col("r_in_a") | F.col("r_in_b")) & (F.col("l_in_a") != F.col("r_in_a"))
    pairs = cell_join(halogens, acceptors, m.HALOGEN_BOND, condition=one)
    return _pair(pairs.join(m.large(bound), [*keys, "l_idx"]), F.col("c"))


def rings(system: DataFrame) -> DataFrame:
    """frame, residue_id, group flags and centroid of aromatic residues with five or six carbon and nitrogen atoms."""
    atoms = system.where(m.among(F.col("resname"), m.AROMATIC) & F.upper("element").isin("C", "N") & F.col("residue_id").isNotNull())
    sides = [atoms.where(side).withColumn("in_a", F.lit(side == "in_a")).withColumn("in_b", F.lit(side == "in_b")) for side in ("in_a", "in_b")]
    grouped = reduce(DataFrame.unionByName, sides).groupBy(*m.keys(system), "residue_id", "in_a", "in_b")
    return grouped.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz")).where("n between 5 and 6").withColumnRenamed("residue_id", "idx").drop("n")


def pi_stacks(system: DataFrame) -> DataFrame:
    """Residues i in A and j in B whose rings' centroids are near."""
    own = rings(system)
    return _pair(cell_join(own.where("in_a"), own.where("in_b"), m.PI_STACK))


def contacts(system: DataFrame) -> DataFrame:
    """frame, i, j, distance and for each kind but pi whether the pair is one: a single cell join for all kinds."""
    e, keys = F.upper("element"), m.keys(system)
    yes = lambda c, n: F.coalesce(c, F.lit(False)).alias(n)
    flags = [
        yes(e.isin("N", "O", "S"), "donor"), yes(e.isin("N", "O", "S", "F"), "acceptor"), yes(m.among(F.col("resname"), m.POSITIVE), "plus"), yes(m.among(F.col("resname"), m.NEGATIVE), "minus"),
        (F.col("element").isNull() | (e != "H")).alias("heavy"), yes(e.isin("C", "S"), "oily"), yes(e.isin("F", "CL", "BR", "I"), "halogen"),
    ]
    atoms = _atoms(system, *flags, m.lookup(m.CONTACT_RADIUS, F.col("element"), m.DEFAULT_RADIUS).alias("r"))
    places = lambda test: system.where(test).select(*keys, "idx", "x", "y", "z")
    near = cell_join(places(e.isin("N", "O", "S")), places(e == "H"), m.HYDROGEN_DISTANCE, strict=True)
    near = near.groupBy(*keys, F.col("l_idx").alias("idx")).agg(F.min(F.struct("d2", F.col("r_idx").alias("h"), *(F.col(f"r_{c}").alias(c) for c in "xyz"))).alias("n"))
    bound = cell_join(places(e.isin("F", "CL", "BR", "I")), places(e == "C"), m.HALOGEN_CARBON, condition=F.col("l_idx") != F.col("r_idx"), strict=True)
    bound = bound.select(*keys, F.col("l_idx").alias("idx"), F.lit(True).alias("bound")).distinct()
    left = atoms.join(m.large(near), [*keys, "idx"], "left").join(m.large(bound), [*keys, "idx"], "left")
    reach = max(m.HBOND_DISTANCE, m.SALT_BRIDGE, m.HYDROPHOBIC_CONTACT, m.HALOGEN_BOND, 2 * max(m.CONTACT_RADIUS.values()) - m.VDW_OVERLAP)
    pairs = cell_join(left, atoms, reach, condition=_across())  # which every kind asks for
    two, a_b = F.col("l_idx") != F.col("r_idx"), F.col("l_in_a") & F.col("r_in_b")
    within = lambda c: F.col("d2") <= c * c
    bend = F.when(F.col("l_n").isNotNull(), angle(point("l_"), point(struct="l_n"), point("r_")))
    found = {
        "hbonds": F.col("l_donor") & F.col("r_acceptor") & two & within(m.HBOND_DISTANCE) & F.coalesce(bend >= m.HBOND_ANGLE, F.lit(True)),
        "salt_bridges": F.col("l_plus") & F.col("r_minus") & within(m.SALT_BRIDGE),
        "clashes": a_b & two & F.col("l_heavy") & F.col("r_heavy") & (F.sqrt("d2") < F.col("l_r") + F.col("r_r") - F.lit(m.VDW_OVERLAP)),
        "hydrophobic": a_b & F.col("l_oily") & F.col("r_oily") & within(m.HYDROPHOBIC_CONTACT),
        "halogen": F.col("l_halogen") & F.coalesce("l_bound", F.lit(False)) & F.col("r_donor") & (F.col("l_in_a") != F.col("r_in_a")) & within(m.HALOGEN_BOND),
    }
    return _pair(pairs, *(c.alias(k) for k, c in found.items()))


def all_interactions(system: DataFrame) -> DataFrame:
    """kind, frame, i, j and distance of every interaction."""
    kinds = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in KINDS[:-1])), lambda k: k.isNotNull())
    keys = m.keys(system)
    near = contacts(system).select(F.explode(kinds).alias("kind"), *keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance")
    return near.unionByName(pi_stacks(system).select(F.lit("pi").alias("kind"), *keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance"))


def interaction_counts(system: DataFrame) -> DataFrame:
    """frame, the count of each kind and their total; frames without any have zeros."""
    count, keys = lambda c: F.count(F.when(c, 1)), m.keys(system)
    near = contacts(system).groupBy(*keys).agg(*(count(F.col(k)).alias(k) for k in KINDS[:-1]))
    pi = pi_stacks(system).groupBy(*keys).agg(F.count("*").alias("pi"))
    each = system.select(*keys).distinct().join(near, keys, "left").join(pi, keys, "left").na.fill(0)
    return each.withColumn("total", reduce(lambda a, b: a + b, map(F.col, KINDS)))


def interaction_summary(system: DataFrame) -> DataFrame:
    """The number of each kind in a system, over all its frames."""
    return all_interactions(system).groupBy(*m.system_keys(system), "kind").agg(F.count("*").alias("n"))
