"""Structure editing: filters, mutation, caps, water boxes and scans. Each returns a new table of atoms with coordinates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.geometry import cross, minus, norm, once, point
from corpuscle.operators.interactions import clashes, hbonds, hydrophobic
from corpuscle.operators.spatial import cell_join
from corpuscle.sources.lines import running
from corpuscle.sources.store import materialize


class MutationError(ValueError):
    """No such residue or target."""


def remove_waters(atoms: DataFrame) -> DataFrame:
    return atoms.where(~m.among(F.col("resname"), m.WATERS))


def remove_hetatm(atoms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Standard residues, nucleotides, waters and those in keep stay; atoms without a residue name go."""
    return atoms.where(m.among(F.col("resname"), m.AMINO_ACIDS + m.AMINO_VARIANTS + m.NUCLEOTIDES + m.WATERS + tuple(k.upper() for k in keep)))


def residue_atoms(atoms: DataFrame, residue_id: int, chain_id: str | None = None) -> DataFrame:
    own = F.col("residue_id") == residue_id
    return atoms.where(own if chain_id is None else own & (F.col("chain_id") == chain_id))


def residue_name(text: str) -> str:
    """A three-letter name from a one-letter code, a name, or the start of one."""
    text = text.strip().upper()
    by_letter = {v: k for k, v in m.ONE_LETTER.items()}
    if text in by_letter:
        return by_letter[text]
    if text in m.ONE_LETTER:
        return text
    found = [n for n in m.ONE_LETTER if len(text) > 1 and n.startswith(text)]
    if not found:
        raise MutationError(f"unknown residue name {text!r}")
    return found[0]


def _unit(p: tuple[Column, ...]) -> tuple[Column, ...]:
    size = norm(p)
    return tuple(c / size for c in p)


def _named(p: tuple[Column, ...]) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(p, "xyz", strict=True)))


def place_cbeta(n: Column, ca: Column, c: Column) -> Column:
    """The beta carbon (structs x, y, z), 1.52 from CA along 0.58 of the outward bisector and 0.82 of the normal."""
    at = lambda s: tuple(s[k] for k in "xyz")
    arms = F.struct(_named(_unit(minus(at(n), at(ca)))).alias("u"), _named(_unit(minus(at(c), at(ca)))).alias("v"))

    def ways(s: Column) -> Column:
        u, v = at(s["u"]), at(s["v"])
        out = tuple(-(a + b) for a, b in zip(u, v, strict=True))
        return F.struct(_named(out).alias("out"), _named(cross(u, v)).alias("up"))

    def mixed(s: Column) -> Column:
        return _named(tuple(0.58 * a + 0.82 * b for a, b in zip(_unit(at(s["out"])), _unit(at(s["up"])), strict=True)))

    def placed(way: Column) -> Column:
        return _named(tuple(a + 1.52 * b for a, b in zip(at(ca), _unit(at(way)), strict=True)))

    return once(once(once(arms, ways), mixed), placed)


def mutate(system: DataFrame, which: Column, target: str) -> DataFrame:
    """The residues that `which` selects become target: backbone (and for ALA a beta carbon) only; positions are kept.

    Works on every frame and residue at once. An added beta carbon has no idx.
    """
    target = residue_name(target)
    name = F.upper(F.trim("name"))
    change = F.coalesce(which, F.lit(False)) & (F.upper(F.coalesce("resname", F.lit(""))) != target)
    kept = ("N", "CA", "C", "O", "OXT") + (("CB",) if target == "ALA" else ())
    stay = system.where(~change)
    cut = system.where(change & name.isin(*kept)).withColumn("resname", F.lit(target))
    if target != "ALA":
        return stay.unionByName(cut)
    keys = [*m.keys(system), *(c for c in ("scan_residue", "chain_id", "residue_id") if c in system.columns)]
    at = lambda a: F.min_by(F.struct("x", "y", "z"), F.when(name == a, F.col("idx"))).alias(a)
    bare = cut.groupBy(*keys).agg(at("N"), at("CA"), at("C"), F.count(F.when(name == "CB", 1)).alias("cb"), *(F.first(c).alias(c) for c in system.columns if c not in (*keys, "idx", "x", "y", "z", "name", "element", "type_id", "resname"))).where("cb = 0 and CA is not null")
    whole = F.col("N").isNotNull() & F.col("C").isNotNull()
    plain = (1.21, -0.89, 1.19)
    bare = bare.withColumn("beta", F.when(whole, place_cbeta(F.col("N"), F.col("CA"), F.col("C"))))
    placed = [F.coalesce(F.col("beta")[c], F.col("CA")[c] + p).alias(c) for c, p in zip("xyz", plain, strict=True)]
    fixed = {"idx": F.lit(None).cast("long"), "name": F.lit("CB"), "element": F.lit("C"), "type_id": F.lit(6), "resname": F.lit(target)}
    added = bare.select(*placed, *(fixed.get(c, F.col(c)).alias(c) for c in system.columns if c not in "xyz"))
    return reduce(DataFrame.unionByName, [stay, cut, added.select(*system.columns)])


def mutate_residue(system: DataFrame, residue_id: int, target: str, chain_id: str | None = None) -> DataFrame:
    which = F.col("residue_id") == residue_id
    which = which if chain_id is None else which & (F.col("chain_id") == chain_id)
    if not system.where(which).limit(1).count():
        raise MutationError(f"no residue {residue_id}")
    return mutate(system, which, target)


def apply_mutations(system: DataFrame, mutations: list[tuple[int, str]]) -> DataFrame:
    return reduce(lambda s, mt: mutate_residue(s, *mt), mutations, system)


def cap_termini(system: DataFrame) -> DataFrame:
    """chain_id, residue_id, resname, name and position of the caps of each chain: 1.33 beyond its first N and last C."""
    own = system.where(F.col("residue_id").isNotNull() & F.col("chain_id").isNotNull())
    keys = m.keys(system)
    ends = own.groupBy(*keys, "chain_id").agg(F.min("residue_id").alias("first"), F.max("residue_id").alias("last"))
    rows = own.join(ends, [*keys, "chain_id"])
    name = F.trim("name")
    at = lambda a, end: F.min_by(F.struct("x", "y", "z"), F.when((name == a) & (F.col("residue_id") == F.col(end)), F.col("idx"))).alias(f"{a}_{end}")
    rows = rows.groupBy(*keys, "chain_id", "first", "last").agg(at("N", "first"), at("CA", "first"), at("CA", "last"), at("C", "last"))

    def cap(of: str, away: str, rid: Column, resname: str, atom: str) -> DataFrame:
        a, b = point(struct=of), point(struct=away)
        way = _unit(minus(a, b))
        return rows.where(F.col(of).isNotNull() & F.col(away).isNotNull()).select(*keys, "chain_id", rid.cast("int").alias("residue_id"), F.lit(resname).alias("resname"), F.lit(atom).alias("name"), *((p + 1.33 * w).alias(c) for p, w, c in zip(a, way, "xyz", strict=True)))

    return cap("N_first", "CA_first", F.col("first") - 1, "ACE", "CH3").unionByName(cap("C_last", "CA_last", F.col("last") + 1, "NME", "N"))


# Oxygen and hydrogens of a water molecule.
WATER_MODELS = {"tip3p": ((0.0, 0.0, 0.0), (0.957, 0.0, 0.0), (-0.239, 0.927, 0.0)), "spc": ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (-0.333, 0.943, 0.0))}
WATER_SPACING, WATER_CLEARANCE = 3.1, 2.4


def _water_lines(system: DataFrame, buffer: float) -> DataFrame:
    """The grid of each frame as a row a line (ix, iy): nz sites along z from `z0`, at x and y, of which those of the numbers `taken` are too near to a heavy atom.

    An atom reaches two sites an axis at most, so atoms go to these and no site is made before the lines are.
    """
    keys = m.keys(system)
    box = system.groupBy(*keys).agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz"))
    n = lambda c: F.greatest(F.lit(1), F.floor((F.col(f"hi{c}") + buffer - (F.col(f"lo{c}") - buffer)) / WATER_SPACING).cast("int"))
    box = box.select(*keys, *((F.col(f"lo{c}") - buffer).alias(f"o{c}") for c in "xyz"), *(n(c).alias(f"n{c}") for c in "xyz"))
    site = lambda c, i: F.col(f"o{c}") + (i + 0.5) * WATER_SPACING
    near = system.where("element is null or upper(element) <> 'H'").select(*(F.col(k).alias(f"_{k}") for k in keys), "x", "y", "z")
    near = near.join(box, [F.col(f"_{k}") == F.col(k) for k in keys]) if keys else near.crossJoin(F.broadcast(box))
    reach = WATER_CLEARANCE + 0.1  # more than the clearance by what rounding may do
    for c in "xyz":
        first, last = (F.greatest(F.lit(0), F.ceil((F.col(c) - reach - F.col(f"o{c}")) / WATER_SPACING - 0.5)), F.least(F.col(f"n{c}") - 1, F.floor((F.col(c) + reach - F.col(f"o{c}")) / WATER_SPACING - 0.5)))
        near = near.withColumn(f"i{c}", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
    dx, dy, dz = (site(c, F.col(f"i{c}")) - F.col(c) for c in "xyz")
    near = near.where(dx * dx + dy * dy + dz * dz < WATER_CLEARANCE * WATER_CLEARANCE)
    taken = near.groupBy(*keys, "ix", "iy").agg(F.collect_set("iz").alias("taken"))
    lines = box
    for c in "xy":
        lines = lines.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)))
        lines = lines.repartition(*keys, "ix") if c == "x" else lines
    lines = lines.select(*keys, "ix", "iy", *(site(c, F.col(f"i{c}")).alias(c) for c in "xy"), F.col("oz").alias("z0"), "nz")
    return lines.join(m.large(taken), [*keys, "ix", "iy"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))


def _free() -> Column:
    """The free sites of a line, in order."""
    return F.array_except(F.sequence(F.lit(0), F.col("nz") - 1), "taken")


def water_sites(system: DataFrame, buffer: float = 10.0) -> DataFrame:
    """ix, iy, iz and oxygen position of the grid waters of each frame that no heavy atom is too near to.

    A frame's grid is dealt to the tasks by its planes, so one frame's is made by many; sites are made last and not shuffled.
    """
    sites = _water_lines(system, buffer).withColumn("iz", F.explode(_free()))
    return sites.select(*m.keys(system), "ix", "iy", "iz", "x", "y", (F.col("z0") + (F.col("iz") + 0.5) * WATER_SPACING).alias("z"))


def water_box(system: DataFrame, buffer: float = 10.0, water: str = "tip3p", most: int | None = None) -> DataFrame:
    """frame, residue_id, name and position of the atoms of a frame's waters, in grid order; `most`: of the first so many alone."""
    keys = m.keys(system)
    lines = _water_lines(system, buffer).withColumn("_free", F.col("nz") - F.size("taken"))
    lines = running(lines, keys, "ix", "iy", F.col("_free"), "_until")
    lines = lines if most is None else lines.where(F.col("_until") - F.col("_free") < most)
    sites = lines.select(*keys, "x", "y", "z0", (F.col("_until") - F.col("_free") + 1).alias("_first"), F.posexplode(_free()).alias("_at", "iz"))
    sites = sites.withColumn("residue_id", F.col("_first") + F.col("_at")).withColumn("z", F.col("z0") + (F.col("iz") + 0.5) * WATER_SPACING)
    sites = sites if most is None else sites.where(F.col("residue_id") <= most)
    shape = WATER_MODELS.get("spc" if water == "spce" else water, WATER_MODELS["tip3p"])
    atoms = F.array(*(F.struct(F.lit(n).alias("name"), *(F.lit(v).alias(f"d{c}") for c, v in zip("xyz", d, strict=True))) for n, d in zip(("OW", "HW1", "HW2"), shape, strict=True)))
    return sites.select(*keys, F.col("residue_id").cast("int").alias("residue_id"), "x", "y", "z", F.inline(atoms)).select(*keys, "residue_id", F.lit("HOH").alias("resname"), F.lit("W").alias("chain_id"), "name", *((F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"))


def _places(system: DataFrame) -> DataFrame:
    """system with place: the number of each atom in its frame by rising idx, from 0."""
    rows = running(system.withColumn("_bucket", F.floor(F.col("idx") / 65536)), m.keys(system), "_bucket", "idx", F.lit(1), "place")
    return rows.withColumn("place", F.col("place") - 1).drop("_bucket")


_ATOM = ("element", "name", "resname", "residue_id", "chain_id", "x", "y", "z")


def solvate(system: DataFrame, buffer: float = 10.0, water: str = "tip3p", most: int | None = None) -> DataFrame:
    """The atoms of the system and of the waters of its box, numbered anew in each frame: the solute's first, then water by water."""
    keys = m.keys(system)
    solute = _places(system).select(*keys, F.col("place").alias("idx"), *_ATOM)
    n = system.groupBy(*keys).agg(F.count("*").alias("_n"))
    order = F.when(F.col("name") == "OW", 0).when(F.col("name") == "HW1", 1).otherwise(2)
    waters = water_box(system, buffer, water, most).join(n, keys)
    waters = waters.select(*keys, (F.col("_n") + 3 * (F.col("residue_id") - 1) + order).cast("bigint").alias("idx"), F.substring("name", 1, 1).alias("element"), *_ATOM[1:])
    return solute.unionByName(waters.withColumn("residue_id", F.col("residue_id").cast(solute.schema["residue_id"].dataType)))


def capped_structure(system: DataFrame) -> DataFrame:
    """The atoms with their chains' caps, numbered anew in each frame: ACE caps first, the last chain's before the others', then
    the atoms as they were, then NME caps in order of the chains (that of their first atoms)."""
    keys = m.keys(system)
    chains = system.where("residue_id is not null and chain_id is not null").groupBy(*keys, "chain_id").agg(F.min("idx").alias("first"))
    caps = cap_termini(system).join(chains, [*keys, "chain_id"])
    rank = F.row_number().over(Window.partitionBy(*keys, "resname").orderBy("first")) - 1  # as many as a frame has chains
    front = F.count(F.when(F.col("resname") == "ACE", 1)).over(Window.partitionBy(*keys))
    caps = caps.select(*keys, "chain_id", "residue_id", "resname", "name", "x", "y", "z", rank.alias("rank"), front.alias("front"))
    n = system.groupBy(*keys).agg(F.count("*").alias("n"))
    at = F.when(F.col("resname") == "ACE", F.col("front") - 1 - F.col("rank")).otherwise(F.col("front") + F.col("n") + F.col("rank"))
    added = caps.join(n, keys).select(*keys, at.cast("bigint").alias("idx"), F.when(F.col("resname") == "ACE", "C").otherwise("N").alias("element"), *_ATOM[1:])
    fronts = caps.groupBy(*keys).agg(F.max("front").alias("front"))
    own = _places(system).join(fronts, keys, "left").select(*keys, (F.col("place") + F.coalesce("front", F.lit(0))).cast("bigint").alias("idx"), *_ATOM)
    return own.unionByName(added.withColumn("residue_id", F.col("residue_id").cast(own.schema["residue_id"].dataType)))


#: An atom farther than this from a residue has no interaction that the residue's change to ALA can alter: the beta carbon lies
#: within 1.93 of CA, contacts reach 4.0, and a donor's hydrogen is within 1.2 of it.
SCAN_REACH = 8.0


def alanine_scan(system: DataFrame) -> DataFrame:
    """frame, residue_id and the loss of hydrogen bonds, contacts and clashes when it becomes ALA, and the score.

    A variant is the neighbourhood of one residue, once as it is and once changed; what lies farther off is the same in both, so
    the work grows with the residues and their surroundings, not with residues times atoms.
    """
    scanned = system.where("in_a and residue_id is not null")
    keys = m.keys(system)
    own = scanned.select(*keys, F.col("residue_id").alias("scan_residue"), "x", "y", "z")
    near = cell_join(own, system.select(*keys, "idx", "x", "y", "z"), SCAN_REACH).select(*keys, F.col("l_scan_residue").alias("scan_residue"), F.col("r_idx").alias("idx")).distinct()
    before = system.join(m.large(near), [*keys, "idx"]).select("scan_residue", *system.columns)
    before = materialize(before, "scan")
    after = mutate(before, (F.col("residue_id") == F.col("scan_residue")) & F.col("in_a"), "ALA").select(*before.columns)
    every = before.withColumn("new", F.lit(False)).unionByName(after.withColumn("new", F.lit(True)))
    # frame, residue and side are what keeps variants apart in the joins
    every = every.withColumn("frame", F.struct(F.col("frame").alias("f"), F.col("scan_residue").alias("v"), F.col("new").alias("new"))).withColumn("idx", F.coalesce("idx", F.lit(-1)))
    every = materialize(every, "variants")
    counts = reduce(DataFrame.unionByName, [f(every).select(*keys, F.lit(k).alias("kind")) for k, f in (("hb", hbonds), ("cl", clashes), ("hy", hydrophobic))])
    lost = lambda k: F.sum(F.when(F.col("kind") == k, F.when(F.col("frame.new"), -1).otherwise(1)).otherwise(0)).alias(k)
    wide = counts.groupBy(*m.system_keys(system), F.col("frame.f").alias("frame"), F.col("frame.v").alias("residue_id")).agg(*(lost(k) for k in ("hb", "cl", "hy")))
    first = scanned.groupBy(*keys, "residue_id").agg(F.upper(F.min_by("resname", "idx")).alias("resname"))
    rows = first.join(wide, [*keys, "residue_id"], "left")
    skip = F.col("resname").isin("ALA", "GLY")
    d = {k: F.when(skip, F.lit(0)).otherwise(F.coalesce(k, F.lit(0))) for k in ("hb", "cl", "hy")}
    return rows.select(*keys, "residue_id", "resname", d["hb"].alias("d_hbonds"), d["hy"].alias("d_hydrophobic"), d["cl"].alias("d_clashes"), (2 * d["hb"] + d["hy"] - 0.5 * d["cl"]).cast("double").alias("score"))
