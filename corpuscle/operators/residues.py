"""Residue-level windows, sequences, structure checks and coarse beads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.geometry import point, torsion


def _chain(default: str = ""):
    return F.coalesce(F.col("chain_id"), F.lit(default))


def list_residues(atoms: DataFrame) -> DataFrame:
    """chain_id, residue_id, resname of the first atom and number of atoms, in the order of the first two, in each system and frame."""
    keys = m.keys(atoms)
    first = F.coalesce(F.min_by("resname", "idx"), F.lit("UNK"))
    return atoms.groupBy(*keys, _chain().alias("chain_id"), F.coalesce("residue_id", F.lit(0)).alias("residue_id")).agg(first.alias("resname"), F.count("*").alias("n_atoms")).orderBy(*keys, "chain_id", "residue_id")


def renumber(atoms: DataFrame, start: int = 1) -> DataFrame:
    """idx and new residue_id in order of first appearance.

    Residues are numbered by ranges of their first atom, so no task orders them all.
    """
    keys = m.keys(atoms)
    rows = atoms.select(*keys, "idx", _chain().alias("chain_id"), "residue_id")
    first = rows.groupBy(*keys, F.col("chain_id").alias("c"), F.col("residue_id").alias("r")).agg(F.min("idx").alias("first"))
    new = reindex(first.withColumnRenamed("first", "idx")).select(*(F.col(k).alias(f"_{k}") for k in keys), "c", "r", (F.col("new_idx") + start).alias("new_id"))
    same = (F.col("chain_id") == F.col("c")) & F.col("residue_id").eqNullSafe(F.col("r"))
    return rows.join(new, reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, same)).select(*keys, "idx", "new_id")


def reindex(atoms: DataFrame) -> DataFrame:
    """atoms with new_idx, gapless from 0 in order of idx in each system and frame: counts of ranges of idx, then a window in each."""
    width, keys = 1 << 16, m.keys(atoms)
    rows = atoms.withColumn("_range", F.floor(F.col("idx") / width))
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_range", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("idx")) - 1
    return rows.withColumn("_own", own).join(before, [*keys, "_range"]).withColumn("new_idx", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def residue_gaps(atoms: DataFrame) -> DataFrame:
    """chain_id, after and before of jumps in residue numbers."""
    keys = m.keys(atoms)
    rows = atoms.where("residue_id is not null").select(*keys, _chain().alias("chain_id"), "residue_id").distinct()
    before = F.lag("residue_id").over(Window.partitionBy(*keys, "chain_id").orderBy("residue_id"))
    return rows.withColumn("prev_id", before).where("residue_id - prev_id > 1").select(*keys, "chain_id", "prev_id", "residue_id")


def ramachandran(system: DataFrame) -> DataFrame:
    """frame, residue_id, phi and psi; null at a missing side, no row without either."""
    named = system.where(F.trim("name").isin("N", "CA", "C") & F.col("residue_id").isNotNull())
    at = lambda name: F.max_by(F.struct("x", "y", "z"), F.when(F.trim("name") == name, F.col("idx"))).alias(name)
    keys = m.keys(system)
    rows = named.groupBy(*keys, "residue_id").agg(at("N"), at("CA"), at("C"))
    w = Window.partitionBy(*keys).orderBy("residue_id")
    rows = rows.withColumn("before", F.lag("C").over(w)).withColumn("after", F.lead("N").over(w))
    whole = F.col("N").isNotNull() & F.col("CA").isNotNull() & F.col("C").isNotNull()
    p = {c: point(struct=c) for c in ("before", "N", "CA", "C", "after")}
    phi = F.when(whole & F.col("before").isNotNull(), torsion(p["before"], p["N"], p["CA"], p["C"]))
    psi = F.when(whole & F.col("after").isNotNull(), torsion(p["N"], p["CA"], p["C"], p["after"]))
    return rows.select(*keys, "residue_id", phi.alias("phi"), psi.alias("psi")).where("phi is not null or psi is not null")


def extract_sequence(atoms: DataFrame) -> DataFrame:
    """chain_id (null: A) and its one-letter sequence by residue number."""
    own = atoms.where(F.upper(F.trim("name")).isin("CA", "C1'", "C1*") & F.col("resname").isNotNull() & F.col("residue_id").isNotNull())
    keys = m.keys(atoms)
    first = own.groupBy(*keys, _chain("A").alias("chain_id"), "residue_id").agg(F.min_by("resname", "idx").alias("resname"))
    letter = m.lookup(m.SEQUENCE_LETTER, F.substring(F.trim("resname"), 1, 3), "X")
    letters = first.groupBy(*keys, "chain_id").agg(F.sort_array(F.collect_list(F.struct("residue_id", letter.alias("l")))).alias("s"))
    return letters.select(*keys, "chain_id", F.array_join(F.transform("s", lambda x: x["l"]), "").alias("sequence"))


def _residues(atoms: DataFrame) -> DataFrame:
    names = F.collect_set(F.upper(F.trim(F.coalesce("name", F.lit("")))))
    rows = atoms.groupBy(*m.keys(atoms), _chain().alias("chain_id"), "residue_id").agg(F.upper(F.coalesce(F.min_by("resname", "idx"), F.lit(""))).alias("resname"), names.alias("names"), F.count("*").alias("n"))
    return rows.withColumn("water", m.among(F.col("resname"), m.WATERS)).withColumn("amino", m.among(F.col("resname"), m.AMINO_ACIDS + m.AMINO_VARIANTS))


def structure_issues(system: DataFrame) -> DataFrame:
    """issue, chain_id, residue_id and detail of each finding in each system and frame.

    Bad coordinates are an atom and one of its 19 followers that nearly coincide; all atoms are looked at.
    """
    rows, keys = _residues(system), m.keys(system)
    parts = [
        rows.where(~F.col("water") & ~F.col("amino") & ~m.among(F.col("resname"), m.NUCLEOTIDES) & (F.col("resname") != "")).select(*keys, F.lit("NON_STANDARD_RESIDUE").alias("issue"), "chain_id", "residue_id", F.col("resname").alias("detail")),
    ]
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, m.BACKBONE)), "names"))
    parts.append(rows.where("amino").select(*keys, F.lit("MISSING_BACKBONE").alias("issue"), "chain_id", "residue_id", F.array_join(lacking, ",").alias("detail")).where("detail <> ''"))
    parts.append(residue_gaps(system).select(*keys, F.lit("MISSING_LOOP").alias("issue"), "chain_id", "prev_id", F.col("residue_id").cast("string").alias("detail")))
    near = system.select(*keys, "idx", "x", "y", "z", "chain_id", "residue_id")
    far = near.select(*keys, F.col("idx").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    d2 = sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz")
    follower = near.withColumn("j", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 19))).join(far, [*keys, "j"]).where(F.sqrt(d2) < 0.5)
    parts.append(follower.select(*keys, F.lit("BAD_COORDINATES").alias("issue"), _chain().alias("chain_id"), "residue_id", F.concat_ws("-", "idx", "j").alias("detail")))
    hydrogens = system.groupBy(*keys).agg(F.count(F.when(F.upper("element") == "H", 1)).alias("n")).where("n = 0")
    parts.append(hydrogens.select(*keys, F.lit("NO_HYDROGENS").alias("issue"), F.lit("").alias("chain_id"), F.lit(None).cast("int").alias("residue_id"), F.lit("").alias("detail")))
    return reduce(DataFrame.union, [p.select(*keys, "issue", "chain_id", F.col(p.columns[-2]).cast("int").alias("residue_id"), p.columns[-1]) for p in parts])


def structure_counts(system: DataFrame) -> DataFrame:
    """One row a system and frame: atoms, residues, chains, waters, residues with missing backbone, and gaps."""
    keys = m.keys(system)
    lacking = F.size(F.array_except(F.array(*map(F.lit, m.BACKBONE)), "names")) > 0
    own = _residues(system).groupBy(*keys).agg(F.sum("n").alias("n_atoms"), F.count("*").alias("n_residues"), F.countDistinct("chain_id").alias("n_chains"), F.count(F.when(F.col("water"), 1)).alias("n_waters"), F.count(F.when(F.col("amino") & lacking, 1)).alias("missing_backbone"))
    gaps = residue_gaps(system).groupBy(*keys).agg(F.count("*").alias("missing_loops"))
    return own.join(gaps, keys, "left").na.fill(0, ["missing_loops"]) if keys else own.crossJoin(gaps)  # one row each


def ion_estimate(atoms: DataFrame, n_waters: int, concentration: float = 0.15) -> DataFrame:
    """One row a system and frame: net charge, sodium and chloride counts."""
    keys = m.keys(atoms)
    charge = F.when(m.among(F.col("resname"), ("ARG", "LYS", "HIS", "HSD", "HSE")), 1).when(m.among(F.col("resname"), m.NEGATIVE), -1).otherwise(0)
    first = atoms.groupBy(*keys, _chain().alias("chain_id"), "residue_id").agg(F.min_by("resname", "idx").alias("resname"))
    salt = int(concentration * 6.02214e-4 * 30 * n_waters)
    net = first.groupBy(*keys).agg(F.coalesce(F.sum(charge), F.lit(0)).cast("long").alias("net_charge"))
    return net.select(*keys, "net_charge", (F.greatest(-F.col("net_charge"), F.lit(0)) + salt).cast("long").alias("n_na"), (F.greatest(F.col("net_charge"), F.lit(0)) + salt).cast("long").alias("n_cl"))


# Beads of each residue after the backbone bead: type and atoms, in order.
_HIS = (("TC4", "CB CG"), ("TN6d", "ND1 CE1"), ("TN5a", "NE2 CD2"))
SIDE_BEADS = {
    "ALA": (("SC1", "CB"),),
    "GLY": (),
    "VAL": (("SC2", "CB CG1 CG2"),),
    "LEU": (("SC2", "CB CG CD1 CD2"),),
    "ILE": (("SC2", "CB CG1 CG2 CD1"),),
    "PHE": (("SC4", "CB CG"), ("SC4", "CD1 CE1"), ("SC4", "CD2 CE2 CZ")),
    "TRP": (("SC4", "CB CG CD1"), ("SC4", "CD2 CE2 NE1"), ("SC4", "CE3 CZ3 CH2"), ("SC4", "CZ2")),
    "MET": (("C5", "CB CG SD CE"),),
    "SER": (("P5", "CB OG"),),
    "THR": (("P5", "CB OG1 CG2"),),
    "CYS": (("C5", "CB SG"),),
    "TYR": (("SC4", "CB CG"), ("SC4", "CD1 CE1"), ("P5", "CD2 CE2 CZ OH")),
    "ASN": (("P5", "CB CG OD1 ND2"),),
    "GLN": (("P5", "CB CG CD OE1 NE2"),),
    "ASP": (("Qa", "CB CG OD1 OD2"),),
    "GLU": (("Qa", "CB CG CD OE1 OE2"),),
    "LYS": (("C3", "CB CG CD"), ("Qd", "CE NZ")),
    "ARG": (("N5", "CB CG CD"), ("Qd", "NE CZ NH1 NH2")),
    "HIS": _HIS,
    "PRO": (("C3", "CB CG CD"),),
} | dict.fromkeys(("HSD", "HSE", "HSP", "HIE", "HID", "HIP"), _HIS)


def bead_table() -> list[tuple[str, int, str, str, tuple[str, ...]]]:
    """resname, order, bead, type and atom names."""
    out = []
    for res, side in SIDE_BEADS.items():
        out.append((res, 0, "BB", "N4" if res == "PRO" else "P2", m.BACKBONE))
        out += [(res, k + 1, f"SC{k + 1}", kind, tuple(names.split())) for k, (kind, names) in enumerate(side)]
    return out


def cg_beads(system: DataFrame) -> DataFrame:
    """frame, chain_id, residue_id, bead_order, bead, bead_type and centroid; the bead table is an array literal by residue.

    Unknown residues have one bead at CA, else at their first atom.
    """
    beads = {}
    for res, order, bead, kind, names in bead_table():
        beads.setdefault(res, []).append(F.struct(F.lit(order).alias("o"), F.lit(bead).alias("b"), F.lit(kind).alias("t"), F.array(*map(F.lit, names)).alias("n")))
    table = F.create_map(*(x for res, b in beads.items() for x in (F.lit(res), F.array(*b))))
    none = F.array(F.struct(F.lit(0).alias("o"), F.lit("BB").alias("b"), F.lit("P2").alias("t"), F.array().cast("array<string>").alias("n")))
    keys = m.keys(system)
    key = [*keys, "chain_id", "residue_id"]
    rows = system.select(*keys, _chain().alias("chain_id"), "residue_id", "idx", F.upper(F.coalesce("resname", F.lit(""))).alias("resname"), F.upper(F.trim("name")).alias("name"), "x", "y", "z")
    known = rows.withColumn("bead", F.explode(F.coalesce(F.element_at(table, F.col("resname")), none)))
    inside = F.array_contains("bead.n", F.col("name"))
    mean = [F.avg(F.when(inside, F.col(c))).alias(f"m{c}") for c in "xyz"]
    first = F.min(F.struct((F.col("name") != "CA").alias("k"), F.col("idx").alias("i"), "x", "y", "z")).alias("first")
    out = known.groupBy(*key, F.col("bead.o").alias("bead_order"), F.col("bead.b").alias("bead"), F.col("bead.t").alias("bead_type")).agg(*mean, first)
    return out.select(*key, "bead_order", "bead", "bead_type", *(F.coalesce(f"m{c}", F.col(f"first.{c}")).alias(c) for c in "xyz"))


def docking_box(system: DataFrame, selected, padding: float = 5.0, empty: float = 20.0) -> DataFrame:
    """frame, centre and size around the selected atoms; around all of them, with edges of `empty`, if none is."""
    own = lambda c: F.when(selected, F.col(c))
    n = F.count(F.when(selected, 1))
    centre = [F.coalesce(F.avg(own(c)), F.avg(c)).alias(f"c{c}") for c in "xyz"]
    size = [F.when(n > 0, F.max(own(c)) - F.min(own(c)) + 2 * padding).otherwise(F.lit(empty)).alias(f"s{c}") for c in "xyz"]
    return system.groupBy(*m.keys(system)).agg(*centre, *size)


def legend(atoms: DataFrame) -> DataFrame:
    """label and the first atom that has it, in each system."""
    label = F.coalesce(F.when(F.col("element") != "", F.upper("element")), F.concat(F.lit("TYPE "), F.coalesce("type_id", F.lit(0)).cast("string")))
    return atoms.groupBy(*m.system_keys(atoms), label.alias("label")).agg(F.min("idx").alias("first_idx"))
