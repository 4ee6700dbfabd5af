"""Molecules as bond graphs: names, fragments, fingerprints, descriptors, torsion trees and common substructures.

Input: a row a molecule with mol (and path, where several files are read), name, atoms (idx, element, charge, x, y, z) and bonds (i, j, order), as
datasource.read_molecules() gives them. A molecule is one row, so what concerns its own graph is a small helper over Arrow
batches, without a shuffle; what compares or counts over molecules (pairs, fingerprints, similarities, clusters) is joins and grouping.

Hydrogens are counted, not kept as atoms: those of the bond table and those that valences ask for. Molecules without atoms
keep their row with an empty name, no bits and counts of zero; a bond to an atom that isn't there is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle import model as m
from corpuscle.functions.geometry import once
from corpuscle.sources.sinks import AUTODOCK
from corpuscle.sources.store import discard, materialize

# Valences, the least that holds an atom's bonds counts; masses and outer electrons.
VALENCES = {"B": (3,), "C": (4,), "N": (3,), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "CL": (1,), "BR": (1,), "I": (1,), "SI": (4,), "SE": (2, 4, 6)}
MASS = {"H": 1.008, "B": 10.811, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "SI": 28.086, "P": 30.974, "S": 32.067, "CL": 35.453, "SE": 78.96, "BR": 79.904, "I": 126.904}
OUTER = {"H": 1, "B": 3, "C": 4, "N": 5, "O": 6, "F": 7, "SI": 4, "P": 5, "S": 6, "CL": 7, "SE": 6, "BR": 7, "I": 7}
#: Atoms whose valence falls with a positive charge; that of all others rises.
ELECTRON_POOR = ("C", "SI")
#: How bonds are written by their order; 10 more: in a ring.
MARKS = {1: "", 2: "=", 3: "#", 4: ":", 11: "@", 12: "=@", 13: "#@", 14: ":@"}
HEAVY = "array<struct<idx: int, element: string, charge: int, hydrogens: int, ring: boolean, x: double, y: double, z: double>>"
BOND = "array<struct<i: int, j: int, order: int, ring: boolean>>"

Bonds = list[tuple[int, int, int]]


def mol_keys(molecules: DataFrame) -> list[str]:
    return [*m.system_keys(molecules), "mol"]


def neighbours(n: int, bonds: Bonds) -> list[list[tuple[int, int]]]:
    """(other end, bond) of each atom."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (i, j, _) in enumerate(bonds):
        out[i].append((j, k))
        out[j].append((i, k))
    return out


def ring_bonds(n: int, bonds: Bonds) -> set[int]:
    """Bonds that lie on a cycle: a walk finds for each atom how far back its subtree reaches, and bonds that nothing spans are bridges."""
    near, order, low, bridges = neighbours(n, bonds), [-1] * n, [0] * n, set()
    count = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = count
        count, stack = count + 1, [(root, -1, iter(near[root]))]
        while stack:
            at, came, rest = stack[-1]
            for to, k in rest:
                if k == came:
                    continue
                if order[to] < 0:
                    order[to] = low[to] = count
                    count += 1
                    stack.append((to, k, iter(near[to])))
                    break
                low[at] = min(low[at], order[to])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[at])
                    if low[at] > order[up]:
                        bridges.add(came)
    return set(range(len(bonds))) - bridges


def side(n: int, bonds: Bonds, cut: set[int], start: int) -> list[int]:
    """Atoms that are reached from start without the bonds of cut, in order."""
    near, seen, todo = neighbours(n, bonds), {start}, [start]
    while todo:
        for to, k in near[todo.pop()]:
            if k not in cut and to not in seen:
                seen.add(to)
                todo.append(to)
    return sorted(seen)


def _refined(ranks: list[int], near: list[list[tuple[int, int]]], bonds: Bonds) -> list[int]:
    """Ranks split by those of the neighbours until nothing changes."""
    while True:
        keys = [(r, sorted((bonds[k][2], ranks[to]) for to, k in near[a])) for a, r in enumerate(ranks)]
        place = {key: p for p, key in enumerate(sorted({(r, tuple(x)) for r, x in keys}))}
        new = [place[r, tuple(x)] for r, x in keys]
        if len(place) == len(set(ranks)):
            return new
        ranks = new


def _written(ranks: list[int], labels: list[str], near: list[list[tuple[int, int]]], bonds: Bonds) -> str:
    """Depth first from the least rank, branches by rank; a bond that closes a ring is numbered at both ends."""
    seen: set[int] = set()
    closing: dict[int, int] = {}

    def walk(at: int, came: int) -> list[str]:
        seen.add(at)
        rings, branches = [], []
        for to, k in sorted((t for t in near[at] if t[1] != came), key=lambda t: (ranks[t[0]], t[1])):
            if k in closing:
                rings.append(f"{MARKS[bonds[k][2]]}%{closing[k]}")
            elif to in seen:
                closing[k] = len(closing) + 1
                rings.append(f"{MARKS[bonds[k][2]]}%{closing[k]}")
            else:
                branches.append([MARKS[bonds[k][2]], *walk(to, k)])
        out = [labels[at], *rings]
        for part in branches[:-1]:
            out += ["(", *part, ")"]
        return out + (branches[-1] if branches else [])

    parts = []
    for a in sorted(range(len(ranks)), key=ranks.__getitem__):
        if a not in seen:
            parts.append("".join(walk(a, -1)))
    return ".".join(sorted(parts))


def canonical_name(labels: list[str], bonds: Bonds) -> str:
    """One name for all orders of the atoms: the least of those that the ways to break ties of refined ranks give.

    Tied atoms with the same neighbours may change places, so one of them stands for all.
    """
    n = len(labels)
    near = neighbours(n, bonds)
    start = {x: p for p, x in enumerate(sorted({(lab, len(near[a])) for a, lab in enumerate(labels)}))}
    best: str | None = None
    todo = [_refined([start[lab, len(near[a])] for a, lab in enumerate(labels)], near, bonds)] if n else []
    done: set[tuple[int, ...]] = set()
    while todo:
        ranks = todo.pop()
        if tuple(ranks) in done:
            continue
        done.add(tuple(ranks))
        tied = next((r for r in sorted(set(ranks)) if ranks.count(r) > 1), None)
        if tied is None:
            name = _written(ranks, labels, near, bonds)
            best = name if best is None else min(best, name)
            continue
        members = [a for a in range(n) if ranks[a] == tied]
        twins = {frozenset((to, bonds[k][2]) for to, k in near[a]): a for a in reversed(members)}
        for a in twins.values():
            todo.append(_refined([2 * r + (b != a and r == tied) for b, r in enumerate(ranks)], near, bonds))
    return best or ""


def aromatic_bonds(elements: list[str], bonds: Bonds, cyclic: set[int]) -> set[int]:
    """Bonds of six-membered rings whose atoms are carbon or nitrogen with one double bond in a ring each, however these are drawn."""
    n = len(elements)
    double = [sum(k in cyclic and bonds[k][2] == 2 for _, k in x) for x in neighbours(n, bonds)]
    fit = [e in ("C", "N") and d == 1 for e, d in zip(elements, double, strict=True)]
    near = [[(to, k) for to, k in x if k in cyclic and fit[to]] if fit[a] else [] for a, x in enumerate(neighbours(n, bonds))]
    found: set[int] = set()
    for a in range(n):
        paths = [([a], [])]
        for _ in range(5):
            paths = [([*p, to], [*ks, k]) for p, ks in paths for to, k in near[p[-1]] if to > a and to not in p]
        for p, ks in paths:
            found.update(*([*ks, k] for to, k in near[p[-1]] if to == a))
    return found | {k for k, b in enumerate(bonds) if b[2] == 4}


def _label(element: str, charge: int, hydrogens: int) -> str:
    sign = f"{'+' if charge > 0 else '-'}{abs(charge)}" if charge else ""
    return f"[{element.capitalize()}{f'H{hydrogens}' if hydrogens else ''}{sign}]"


def _graphs(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], Bonds, set[int], set[int]]]:
    """Atoms, bonds (aromatic ones of order 4), bonds on cycles and aromatic ones of each molecule of a batch of heavy()."""
    for atoms, given in zip(batch.column("atoms").to_pylist(), batch.column("bonds").to_pylist(), strict=True):
        bonds = [(b["i"], b["j"], b["order"]) for b in given]
        cyclic = {k for k, b in enumerate(given) if b["ring"]}
        flat = aromatic_bonds([a["element"] for a in atoms], bonds, cyclic)
        yield atoms, [(i, j, 4 if k in flat else o) for k, (i, j, o) in enumerate(bonds)], cyclic, flat


def _per_molecule(molecules: DataFrame, work: Callable[[list[dict], Bonds, set[int], set[int]], list[tuple]], columns: str) -> DataFrame:
    """Rows that work makes of each molecule, with its keys."""
    keys = mol_keys(molecules)
    rows = molecules.select(*keys, "atoms", "bonds")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + f", {columns}"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
        for batch in batches:
            made = [work(*g) for g in _graphs(batch)]
            at = pa.array([k for k, rows in enumerate(made) for _ in rows], pa.int64())
            own = [batch.column(c).take(at) for c in range(len(keys))]
            values = list(zip(*(r for rows in made for r in rows), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, kinds[c.split()[1]]) for v, c in zip(values, columns.split(", "), strict=True))], names=[*keys, *names])

    return rows.mapInArrow(run, schema)


def heavy(molecules: DataFrame) -> DataFrame:
    """molecules with their heavy atoms alone, numbered anew, with hydrogens and whether a bond or atom is in a ring."""
    ids = F.transform(F.filter("atoms", lambda a: a["element"] != "H"), lambda a: a["idx"])
    kept = molecules.select("*", ids.alias("_ids"))
    place = lambda c: (F.array_position("_ids", c) - 1).cast("int")
    inside = F.filter("bonds", lambda b: F.array_contains("_ids", b["i"]) & F.array_contains("_ids", b["j"]))
    kept = kept.withColumn("bonds", F.transform(inside, lambda b: F.struct(place(b["i"]).alias("i"), place(b["j"]).alias("j"), b["order"].alias("order"))))

    def filled(a: Column, k: Column) -> Column:
        used = F.aggregate(F.filter("bonds", lambda b: (b["i"] == k) | (b["j"] == k)), F.lit(0.0), lambda s, b: s + F.when(b["order"] == 4, 1.5).otherwise(b["order"]))
        turn = F.when(a["element"].isin(*ELECTRON_POOR), -F.abs(a["charge"])).when(a["element"] == "B", -a["charge"]).otherwise(a["charge"])
        valences = F.create_map(*(x for e, v in VALENCES.items() for x in (F.lit(e), F.array(*map(F.lit, v)))))
        room = F.array_min(F.filter(F.transform(F.coalesce(F.element_at(valences, a["element"]), F.array().cast("array<int>")), lambda v: v + turn - used), lambda v: v >= 0))
        return F.coalesce(F.floor(room), F.lit(0)).cast("int")

    atoms = F.transform(F.filter("atoms", lambda a: a["element"] != "H"), lambda a, k: F.struct(k.cast("int").alias("idx"), a["element"].alias("element"), a["charge"].alias("charge"), filled(a, k).alias("hydrogens"), *(a[c].alias(c) for c in "xyz")))
    rows = kept.withColumn("atoms", atoms).drop("_ids")

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, bonds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cyclic = ring_bonds(n, [(b["i"], b["j"], b["order"]) for b in bonds])
                out.append([k in cyclic for k in range(len(bonds))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.bool_())), *batch.columns[2:]], names=["_ring", *batch.schema.names[2:]])

    given = rows.select(F.size("atoms").alias("_n"), F.col("bonds").alias("_b"), *rows.columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = given.mapInArrow(rings, f"_ring array<boolean>, {kinds}")
    bonds = F.transform("bonds", lambda b, k: F.struct(b["i"].alias("i"), b["j"].alias("j"), b["order"].alias("order"), F.get("_ring", k).alias("ring")))
    marked = marked.withColumn("bonds", bonds.cast(BOND)).drop("_ring")
    on_ring = lambda a: F.exists("bonds", lambda b: b["ring"] & ((b["i"] == a["idx"]) | (b["j"] == a["idx"])))
    whole = F.transform("atoms", lambda a: F.struct(*(a[c].alias(c) for c in ("idx", "element", "charge", "hydrogens")), on_ring(a).alias("ring"), *(a[c].alias(c) for c in "xyz")))
    return marked.withColumn("atoms", whole.cast(HEAVY))


def names(molecules: DataFrame) -> DataFrame:
    """The canonical name of each molecule of heavy(): atoms in brackets, ring closures as %n, aromatic bonds as colons."""

    def work(atoms, bonds, cyclic, flat):
        return [(_named(tuple(_label(a["element"], a["charge"], a["hydrogens"]) for a in atoms), tuple(bonds))[0],)]

    return _per_molecule(molecules, work, "smiles string")


def fragments(molecules: DataFrame) -> DataFrame:
    """mol, heavy, core, rgroup and group_heavy, as matched_pairs() takes them: both ways round of each cut of one bond.

    Cut are single bonds that are in no ring, at a carbon without multiple bonds to other elements. * stands where the bond was.
    """

    def work(atoms, bonds, cyclic, flat):
        out, n = [], len(atoms)
        bound = {x for i, j, o in bonds if o in (2, 3) for x, y in ((i, j), (j, i)) if atoms[x]["element"] == "C" and atoms[y]["element"] != "C"}
        open_carbon = [a["element"] == "C" and k not in bound for k, a in enumerate(atoms)]
        for cut, (i, j, o) in enumerate(bonds):
            if o != 1 or cut in cyclic or not (open_carbon[i] or open_carbon[j]):
                continue
            parts = []
            for start in (i, j):
                kept = side(n, bonds, {cut}, start)
                place = {a: k for k, a in enumerate(kept)}
                labels = [_label(atoms[a]["element"], atoms[a]["charge"], atoms[a]["hydrogens"]) + "*" * (a == start) for a in kept]
                own = [(place[x], place[y], w) for k, (x, y, w) in enumerate(bonds) if k != cut and x in place and y in place]
                parts.append((_named(tuple(labels), tuple(own))[0], len(kept)))
            (a, na), (b, nb) = parts
            out += [(n, a, b, nb), (n, b, a, na)]
        return sorted(set(out))

    return _per_molecule(molecules, work, "heavy int, core string, rgroup string, group_heavy int")


def fingerprints(molecules: DataFrame, radius: int = 2, bits: int = 2048) -> DataFrame:
    """The bits of each molecule of heavy(), sorted: hashes of every atom's surroundings up to radius bonds away.

    Messages pass along bonds within a row: an atom's next hash is that of its own and its neighbours' with their bonds' orders.
    """
    keys = mol_keys(molecules)
    touching = lambda k: F.filter("bonds", lambda b: (b["i"] == k) | (b["j"] == k))
    atom = lambda a: F.md5(F.concat_ws(",", a["element"], a["charge"].cast("string"), a["hydrogens"].cast("string"), a["ring"].cast("int").cast("string"), F.size(touching(a["idx"])).cast("string")))

    def grown(h: Column) -> Column:
        near = lambda k: F.transform(touching(k), lambda b: F.concat(b["order"].cast("string"), F.get(h, F.when(b["i"] == k, b["j"]).otherwise(b["i"]))))
        return F.transform(h, lambda own, k: F.md5(F.concat(own, F.array_join(F.array_sort(near(k)), ""))))

    def found(h: Column, left: int) -> Column:
        """The hashes h and those of the steps after them."""
        return F.concat(h, once(grown(h), lambda g: found(g, left - 1))) if left else h

    hashes = once(F.transform("atoms", atom), lambda h: found(h, radius))
    bit = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(bits)).cast("int")
    return molecules.select(*keys, F.coalesce(F.array_sort(F.array_distinct(F.transform(hashes, bit))), F.array().cast("array<int>")).alias("bits"))


#: Molecules of one kind that travel and meet others as one row.
KIND_PART = 1000


def tanimoto(prints: DataFrame, wanted: DataFrame, least: float = 0.0) -> DataFrame:
    """Similarity of each fingerprint of wanted to each of prints that shares a bit with it, if it is at least `least`; wanted may be prints itself.

    Molecules of equal bits are one kind. Kinds meet in a join on their bits, if their sizes allow the similarity, and shared bits are
    counted; then similar kinds become pairs of molecules: rows of up to KIND_PART molecules of either kind meet, dealt to all tasks, and pairs are made last.
    """
    keys = mol_keys(prints)
    bits = prints.select("bits").union(wanted.select("bits")).distinct()
    kinds = materialize(bits.select(F.monotonically_increasing_id().alias("kind"), "bits"), "kinds")
    a, b = (kinds.join(m.large(t.select("bits").distinct()), "bits", "left_semi").select(F.col("kind").alias(f"kind_{s}"), F.size("bits").alias(f"n_{s}"), F.explode("bits").alias("bit")) for t, s in ((wanted, "a"), (prints, "b")))
    able = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (least * (1 - 1e-12))
    both = a.join(m.large(b), "bit").where(able).groupBy("kind_a", "kind_b").agg(F.count("*").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    near = both.select("kind_a", "kind_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= least)

    def dealt(t: DataFrame, side: str) -> DataFrame:
        """The molecules of each kind as rows of many, numbered in their kind."""
        rows = t.join(m.large(kinds), "bits").select(F.col("kind").alias(f"kind_{side}"), F.struct(*keys).alias("mol"))
        parts = rows.groupBy(f"kind_{side}").agg(F.ceil(F.count("*") / KIND_PART).alias("parts"))
        rows = rows.join(m.large(parts), f"kind_{side}").withColumn("part", F.pmod(F.xxhash64("mol"), "parts"))
        return rows.groupBy(f"kind_{side}", "part").agg(F.collect_list("mol").alias(f"mols_{side}")).drop("part")

    own, other = (materialize(dealt(t, side), "dealt") for t, side in ((wanted, "a"), (prints, "b")))
    pairs = own.join(m.large(near), "kind_a").join(m.large(other), "kind_b").select("similarity", "mols_a", "mols_b")
    pairs = pairs.repartition(F.xxhash64("mols_a", "mols_b")).select("similarity", F.explode("mols_a").alias("a"), "mols_b").select("similarity", "a", F.explode("mols_b").alias("b"))
    return pairs.select(*(F.col(f"{s}.{k}").alias(f"{k}_{s}") for s in "ab" for k in keys), "similarity")


def cluster_fingerprints(prints: DataFrame, k: int = 5, bits: int = 2048, seed: int = 42) -> DataFrame:
    """The cluster of each molecule by k-means over its bits; fewer molecules than clusters are a cluster each, in their order."""
    keys = mol_keys(prints)
    if prints.limit(k).count() < k:
        few = [tuple(r) for r in prints.select(*keys).orderBy(*keys).collect()]  # fewer than k rows
        return prints.sparkSession.createDataFrame([(*r, c) for c, r in enumerate(few)], ", ".join(f"{c} {prints.schema[c].dataType.simpleString()}" for c in keys) + ", cluster int")
    dense = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.array_contains("bits", b).cast("double"))
    rows = prints.select(*keys, array_to_vector(dense).alias("v"))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(rows).select(*keys, "cluster")


def descriptors(molecules: DataFrame) -> DataFrame:
    """The countable descriptors of each molecule of heavy(); null for those that need a toolkit's parameters.

    A rotatable bond is a single bond outside rings between atoms that each have another neighbour.
    """
    keys = mol_keys(molecules)

    def work(atoms, bonds, cyclic, flat):
        near = neighbours(len(atoms), bonds)
        return [(sum(o == 1 and k not in cyclic and len(near[i]) > 1 and len(near[j]) > 1 for k, (i, j, o) in enumerate(bonds)), len({x for k in flat for x in bonds[k][:2]}))]

    total = lambda table: F.aggregate("atoms", F.lit(0.0), lambda s, a: s + F.coalesce(F.element_at(F.create_map(*(x for e, v in table.items() for x in (F.lit(e), F.lit(float(v))))), a["element"]), F.lit(0.0)) + a["hydrogens"] * float(table["H"]))
    count = lambda test: F.size(F.filter("atoms", test))
    single = lambda a: F.forall(F.filter("bonds", lambda b: (b["i"] == a["idx"]) | (b["j"] == a["idx"])), lambda b: b["order"] == 1)
    carbon = count(lambda a: a["element"] == "C")
    charge = F.aggregate("atoms", F.lit(0), lambda s, a: s + a["charge"])
    parts = _per_molecule(molecules, lambda atoms, bonds, cyclic, flat: [(len({side(len(atoms), bonds, set(), a)[0] for a in range(len(atoms))}),)], "parts int")
    own = molecules.select(
        *keys,
        total(MASS).alias("MolWt"),
        F.size("atoms").alias("HeavyAtomCount"),
        count(lambda a: (a["element"] == "N") & (a["hydrogens"] > 0) | a["element"].isin("O", "S") & (a["hydrogens"] == 1) & (a["charge"] == 0)).alias("NumHDonors"),
        count(lambda a: ~a["element"].isin("C")).alias("NumHeteroatoms"),
        F.when(carbon > 0, count(lambda a: (a["element"] == "C") & single(a)) / carbon).otherwise(0.0).alias("FractionCSP3"),
        (total(OUTER).cast("int") - charge).alias("NumValenceElectrons"),
        (F.size("bonds") - F.size("atoms")).alias("_excess"),
        *(F.lit(None).cast("double").alias(c) for c in ("MolLogP", "TPSA", "MaxPartialCharge", "MinPartialCharge")),
    )
    return own.join(_per_molecule(molecules, work, "NumRotatableBonds int, NumAromaticAtoms int"), keys).join(parts, keys).withColumn("RingCount", F.col("_excess") + F.col("parts")).drop("_excess", "parts")


def torsion_lines(molecules: DataFrame) -> DataFrame:
    """n and line of the PDBQT of each molecule of heavy(): the rigid part with most atoms is the root, and each rotatable bond a branch.

    Types and charges are those of pdbqt_lines(). TORSDOF is the number of branches.
    """

    def work(atoms, bonds, cyclic, flat):
        n, near = len(atoms), neighbours(len(atoms), bonds)
        turn = {k for k, (i, j, o) in enumerate(bonds) if o == 1 and k not in cyclic and len(near[i]) > 1 and len(near[j]) > 1}
        lines, serial = [f"REMARK  {len(turn)} active torsions"], {}
        parts = {tuple(side(n, bonds, turn, a)) for a in range(n)}

        def put(part: list[int]) -> None:
            for a in part:
                serial[a] = len(serial) + 1
                x, y, z = (atoms[a][c] for c in "xyz")
                name = atoms[a]["element"].capitalize()
                lines.append(f"ATOM  {serial[a] % 100000:5d}  {name:<3s} LIG     1    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00    +0.000 {AUTODOCK.get(atoms[a]['element'], 'C'):<2s}")

        def branch(a: int, to: int, k: int) -> None:
            start = len(lines)
            part = side(n, bonds, turn, to)
            lines.append("")
            put(part)
            lines[start] = f"BRANCH {serial[a]:3d} {serial[to]:3d}"
            grow(part, k)
            lines.append(f"ENDBRANCH {serial[a]:3d} {serial[to]:3d}")

        def grow(part: list[int], came: int) -> None:
            for a in part:
                for to, k in sorted(near[a]):
                    if k in turn and k != came:
                        branch(a, to, k)

        if parts:
            lines.append("ROOT")
            root = list(min(parts, key=lambda p: (-len(p), p)))
            put(root)
            lines.append("ENDROOT")
            grow(root, -1)
        lines.append(f"TORSDOF {len(turn)}")
        return list(enumerate(lines))

    return _per_molecule(molecules, work, "n int, line string")


@lru_cache(1 << 16)
def _named(labels: tuple[str, ...], bonds: tuple[tuple[int, int, int], ...]) -> tuple[str, bool]:
    """The name of a graph, and whether its ring bonds are in whole rings; molecules share most of their parts."""
    closed = ring_bonds(len(labels), list(bonds))
    return canonical_name(list(labels), list(bonds)), all(k in closed for k, b in enumerate(bonds) if b[2] > 10)


def _subgraph(labels: list[str], bonds: Bonds, chosen: list[int]) -> tuple[str, bool]:
    """As _named(), of the atoms and bonds of a chosen set of bonds."""
    place = {a: k for k, a in enumerate(sorted({x for k in chosen for x in bonds[k][:2]}))}
    return _named(tuple(labels[a] for a in place), tuple((place[i], place[j], o) for i, j, o in (bonds[k] for k in chosen)))


def common_substructure(molecules: DataFrame, whole_rings: bool = True) -> DataFrame:
    """The largest connected set of bonds that all molecules of heavy() have: smarts, n_atoms, n_bonds, n_molecules, and of each molecule its keys
    and atom_map (the atoms of one place where it has it, the least). No row if they share no bond.

    Atoms match by element, bonds by order and by whether they are in a ring; whole_rings: a ring is shared as a whole or not at all.
    Sets grow bond by bond: a level's sets are those of the level before and a neighbouring bond, each once, named alike in all
    molecules, and only names that every molecule has grow on. A part of a shared set is shared, so none is missed; of equally
    large ones the least name counts. Molecules with the same elements and bonds in the same order are one graph, grown once.
    The sets of a molecule are many where much of it is shared, so this is for molecules, not polymers.
    """
    keys = mol_keys(molecules)
    graph = F.struct(F.transform("atoms", lambda a: a["element"]).alias("labels"), "bonds").alias("graph")
    own = materialize(molecules.select(*keys, graph), "graphs")
    n = own.count()
    if n < 2:
        raise ValueError("a common substructure needs two molecules at least")
    kinds = materialize(own.select("graph").distinct().select(F.monotonically_increasing_id().alias("_m"), "graph"), "kinds")
    graph = kinds.select("_m", F.transform("graph.labels", lambda e: F.struct(e.alias("element"))).alias("atoms"), "graph.bonds")
    different = kinds.count()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mol, sets, (atoms, bonds, cyclic, _) in zip(batch.column("_m").to_pylist(), batch.column("sets").to_pylist(), _graphs(batch), strict=True):
                labels = [f"[{a['element'].capitalize()}]" for a in atoms]
                bonds = [(i, j, o + 10 * (k in cyclic)) for k, (i, j, o) in enumerate(bonds)]
                near = neighbours(len(atoms), bonds)
                new = {(k,) for k in range(len(bonds))} if sets is None else {tuple(sorted((*s, k))) for s in sets for b in s for x in bonds[b][:2] for _, k in near[x] if k not in s}
                rows += [(mol, list(s), *_subgraph(labels, bonds, list(s)), sorted({x for k in s for x in bonds[k][:2]})) for s in new]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_m", "bond_set", "name", "whole", "atom_set"])

    best, held = None, graph.withColumn("sets", F.lit(None).cast("array<array<int>>"))
    while True:
        level = materialize(held.mapInArrow(grow, "_m bigint, bond_set array<int>, name string, whole boolean, atom_set array<int>"), "level")
        names = level.groupBy("name", "whole").agg(F.countDistinct("_m").alias("n")).where(F.col("n") == different)
        shared = materialize(level.join(names.select("name"), "name"), "shared")
        discard(level)
        if shared.isEmpty():
            break
        good = shared.where("whole") if whole_rings else shared
        if (first := good.agg(F.min("name")).first()[0]) is not None:
            best = good.where(F.col("name") == first).groupBy("_m").agg(F.min(F.struct("atom_set", "bond_set")).alias("s")), first
        held = graph.join(m.large(shared.groupBy("_m").agg(F.collect_list("bond_set").alias("sets"))), "_m")
    if best is None:
        return own.limit(0).select(F.lit("").alias("smarts"), *(F.lit(0).alias(c) for c in ("n_atoms", "n_bonds")), F.lit(0).cast("bigint").alias("n_molecules"), *keys, F.array().cast("array<int>").alias("atom_map"))
    places, name = best
    found = own.join(m.large(kinds), "graph").join(m.large(places), "_m")
    return found.select(F.lit(name).alias("smarts"), F.size("s.atom_set").alias("n_atoms"), F.size("s.bond_set").alias("n_bonds"), F.lit(n).cast("bigint").alias("n_molecules"), *keys, F.col("s.atom_set").alias("atom_map"))
