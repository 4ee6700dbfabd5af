"""Bond graphs against brute force: names over all orders of atoms, rings, cuts, fingerprints and torsion trees."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

from corpuscle.operators import bondgraph as g
from corpuscle.operators import molecules as mm
from corpuscle.sources import datasource

SCHEMA = "path string, mol bigint, name string, atoms array<struct<idx: int, element: string, charge: int, x: double, y: double, z: double>>, bonds array<struct<i: int, j: int, order: int>>"


def row(mol, elements, bonds, charges=None, path="f"):
    return (path, mol, f"m{mol}", [(k, e, (charges or {}).get(k, 0), float(k), 0.5 * k, -float(k)) for k, e in enumerate(elements)], [tuple(b) for b in bonds])


BENZENE = [(k, (k + 1) % 6, 1 + k % 2) for k in range(6)]


def same_graph(a, b):
    (la, ba), (lb, bb) = a, b
    if sorted(la) != sorted(lb) or len(ba) != len(bb):
        return False
    want = {(min(i, j), max(i, j)): o for i, j, o in bb}
    return any(all(la[p[k]] == lb[k] for k in range(len(la))) and all(want.get((min(q[i], q[j]), max(q[i], q[j]))) == o for i, j, o in ba) for p in itertools.permutations(range(len(la))) for q in [{v: k for k, v in enumerate(p)}])


def random_graph(rng, n):
    bonds = [(rng.randrange(k), k, rng.choice([1, 1, 2])) for k in range(1, n)]
    for _ in range(rng.randint(0, 3) if n > 1 else 0):
        i, j = sorted(rng.sample(range(n), 2))
        if (i, j) not in {b[:2] for b in bonds}:
            bonds.append((i, j, 1))
    return [rng.choice("CCN") for _ in range(n)], bonds


def shuffled(rng, labels, bonds):
    p = list(range(len(labels)))
    rng.shuffle(p)
    new = [None] * len(labels)
    for k, v in enumerate(p):
        new[v] = labels[k]
    out = [(p[i], p[j], o) if rng.random() < 0.5 else (p[j], p[i], o) for i, j, o in bonds]
    rng.shuffle(out)
    return new, out


def test_names_tell_graphs_apart_and_nothing_else():
    rng = random.Random(6)
    graphs = [random_graph(rng, rng.randint(1, 6)) for _ in range(60)]
    named = [g.canonical_name(*x) for x in graphs]
    for x, name in zip(graphs, named):
        assert all(g.canonical_name(*shuffled(rng, *x)) == name for _ in range(6))
    for (a, na), (b, nb) in itertools.combinations(zip(graphs, named), 2):
        assert (na == nb) == same_graph(a, b)


def test_names_of_regular_graphs():
    """Graphs that refinement alone can't order: a cube, a prism, two triangles, and atoms with twins."""
    rng = random.Random(1)
    cube = [(a, a ^ 1 << k, 1) for a in range(8) for k in range(3) if a < a ^ 1 << k]
    prism = [(k, (k + 1) % 4, 1) for k in range(4)] + [(4 + k, 4 + (k + 1) % 4, 1) for k in range(4)] + [(k, 4 + (k + 1) % 4, 1) for k in range(4)]
    ladder = [(k, (k + 1) % 8, 1) for k in range(8)] + [(k, k + 4, 1) for k in range(4)]
    two = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)]
    star = [(0, k, 1) for k in range(1, 5)] + [(k, 1 + 3 * k + d, 1) for k in range(1, 5) for d in (1, 2, 3)]
    for n, bonds in ((8, cube), (8, ladder), (6, two), (6, BENZENE), (17, star)):
        name = g.canonical_name(["C"] * n, bonds)
        assert all(g.canonical_name(*shuffled(rng, ["C"] * n, bonds)) == name for _ in range(10))
    assert g.canonical_name(["C"] * 8, cube) == g.canonical_name(["C"] * 8, prism) != g.canonical_name(["C"] * 8, ladder)


def test_ring_bonds_are_those_whose_ends_stay_joined():
    rng = random.Random(2)
    for _ in range(200):
        labels, bonds = random_graph(rng, rng.randint(1, 12))
        bonds = [b for b in bonds if rng.random() < 0.9]
        assert g.ring_bonds(len(labels), bonds) == {k for k, (i, j, _) in enumerate(bonds) if j in g.side(len(labels), bonds, {k}, i)}


def test_aromatic_rings_however_they_are_drawn(spark):
    other = [(i, j, 3 - o) for i, j, o in BENZENE]
    naphthalene = [(0, 1, 2), (1, 2, 1), (2, 3, 2), (3, 4, 1), (4, 5, 2), (5, 0, 1), (4, 6, 1), (6, 7, 2), (7, 8, 1), (8, 9, 2), (9, 5, 1)]
    turned = [(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 2), (4, 5, 1), (5, 0, 2), (4, 6, 1), (6, 7, 2), (7, 8, 1), (8, 9, 2), (9, 5, 1)]
    cases = [(["C"] * 6 + ["C", "O"], BENZENE + [(0, 6, 1), (1, 7, 1)]), (["C"] * 6 + ["C", "O"], other + [(0, 6, 1), (1, 7, 1)]), (["C"] * 10, naphthalene), (["C"] * 10, turned), (["C"] * 6, [(0, 1, 2), *[(k, (k + 1) % 6, 1) for k in range(1, 6)]])]
    rows = [row(k, *c) for k, c in enumerate(cases)]
    heavy = g.heavy(spark.createDataFrame(rows, SCHEMA))
    found = {r["mol"]: r["smiles"] for r in g.names(heavy).collect()}
    assert found[0] == found[1] and found[2] == found[3] and ":" not in found[4] and ":" in found[0]
    assert {r["mol"]: (r["NumAromaticAtoms"], r["RingCount"]) for r in g.descriptors(heavy).collect()} == {0: (6, 1), 1: (6, 1), 2: (10, 2), 3: (10, 2), 4: (0, 1)}


# acetic acid with hydrogens, ethanol, an ammonium ion, butane, toluene, chlorobenzene, and nothing
CASES = [
    (["C", "C", "O", "O", "H", "H", "H", "H"], [(0, 1, 1), (1, 2, 2), (1, 3, 1), (0, 4, 1), (0, 5, 1), (0, 6, 1), (3, 7, 1)], None),
    (["O", "C", "C"], [(0, 1, 1), (1, 2, 1)], None),
    (["N", "C"], [(0, 1, 1)], {0: 1}),
    (["C"] * 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)], None),
    (["C"] * 7, BENZENE + [(0, 6, 1)], None),
    (["C"] * 6 + ["CL"], BENZENE + [(3, 6, 1)], None),
    ([], [], None),
]


@pytest.fixture(scope="module")
def heavy(spark):
    return g.heavy(spark.createDataFrame([row(k, *c) for k, c in enumerate(CASES)] + [row(1, *CASES[3], path="other")], SCHEMA)).cache()


def test_hydrogens_and_descriptors(heavy):
    atoms = {r["mol"]: [(a["element"], a["hydrogens"]) for a in r["atoms"]] for r in heavy.where("path = 'f'").collect()}
    assert atoms[0] == [("C", 3), ("C", 0), ("O", 0), ("O", 1)] and atoms[1] == [("O", 1), ("C", 2), ("C", 3)] and atoms[2] == [("N", 3), ("C", 3)] and atoms[4][0] == ("C", 0) and atoms[6] == []
    found = {r["mol"]: r for r in g.descriptors(heavy).where("path = 'f'").collect()}
    assert found[0]["MolWt"] == pytest.approx(60.052, abs=0.01) and found[1]["MolWt"] == pytest.approx(46.069, abs=0.01) and found[4]["MolWt"] == pytest.approx(92.141, abs=0.01)
    assert [found[k]["NumHDonors"] for k in range(7)] == [1, 1, 1, 0, 0, 0, 0] and [found[k]["NumValenceElectrons"] for k in range(7)] == [24, 20, 14, 26, 36, 36, 0]
    assert [found[k]["NumRotatableBonds"] for k in range(7)] == [0, 0, 0, 1, 0, 0, 0] and [found[k]["RingCount"] for k in range(7)] == [0, 0, 0, 0, 1, 1, 0]
    assert found[0]["FractionCSP3"] == 0.5 and found[6]["FractionCSP3"] == 0 and found[4]["TPSA"] is None and found[5]["NumHeteroatoms"] == 1


def test_cuts_feed_matched_pairs(heavy):
    rows = g.fragments(heavy.where("path = 'f'")).drop("path")
    cuts = Counter(r["mol"] for r in rows.collect())
    assert cuts == {0: 2, 1: 4, 2: 2, 3: 3, 4: 2, 5: 2}  # butane's ends are cut alike, and its halves are the same
    pairs = mm.matched_pairs(rows).collect()
    assert {(r["mol_a"], r["mol_b"], r["group_a"], r["group_b"]) for r in pairs if r["mol_b"] - r["mol_a"] == 1 and r["mol_a"] == 4} == {(4, 5, "[CH3]*", "[Cl]*")}


def test_fingerprints_equal_brute_force(heavy):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for r in heavy.join(g.fingerprints(heavy), ["path", "mol"]).collect():
        near = {a["idx"]: [(b["order"], b["j"] if b["i"] == a["idx"] else b["i"]) for b in r["bonds"] if a["idx"] in (b["i"], b["j"])] for a in r["atoms"]}
        now = {a["idx"]: md5(f"{a['element']},{a['charge']},{a['hydrogens']},{int(a['ring'])},{len(near[a['idx']])}") for a in r["atoms"]}
        seen = set(now.values())
        for _ in range(2):
            now = {k: md5(h + "".join(sorted(f"{o}{now[x]}" for o, x in near[k]))) for k, h in now.items()}
            seen |= set(now.values())
        assert r["bits"] == sorted({int(h[:8], 16) % 2048 for h in seen})
    prints = g.fingerprints(heavy)
    similar = {(r["mol_a"], r["path_b"], r["mol_b"]): r["similarity"] for r in g.tanimoto(prints, prints.where("path = 'f' and mol in (3, 4)")).collect()}
    bits = {(r["path"], r["mol"]): set(r["bits"]) for r in prints.collect()}
    assert similar == {(a, *b): pytest.approx(len(bits["f", a] & v) / len(bits["f", a] | v)) for a in (3, 4) for b, v in bits.items() if bits["f", a] & v}
    labels = {(r["path"], r["mol"]): r["cluster"] for r in g.cluster_fingerprints(prints, 3).collect()}
    assert len(set(labels.values())) == 3 and labels["f", 3] == labels["other", 1]
    assert [r["cluster"] for r in g.cluster_fingerprints(prints.where("mol < 2"), 5).orderBy("path", "mol").collect()] == [0, 1, 2]


def test_torsion_trees(spark):
    """Biphenyl with a propyl chain: every atom once, branches nested, and each branch joins a bond's ends."""
    bonds = BENZENE + [(i + 6, j + 6, o) for i, j, o in BENZENE] + [(0, 6, 1), (9, 12, 1), (12, 13, 1), (13, 14, 1)]
    heavy = g.heavy(spark.createDataFrame([row(0, ["C"] * 15, bonds), row(1, [], []), row(2, ["O"], [])], SCHEMA))
    lines = {m: [r["line"] for r in g.torsion_lines(heavy).where(f"mol = {m}").orderBy("n").collect()] for m in range(3)}
    place, stack, branches = {}, [], []
    for line in lines[0]:
        if line.startswith("ATOM"):
            place[int(line[6:11])] = round(float(line[30:38]))
            assert float(line[38:46]) == place[int(line[6:11])] / 2
        elif line.startswith("BRANCH"):
            stack.append(line.split()[1:])
            branches.append(line.split()[1:])
        elif line.startswith("ENDBRANCH"):
            assert stack.pop() == line.split()[1:]
    assert not stack and sorted(place.values()) == list(range(15)) and lines[0][-1] == "TORSDOF 3"
    assert {frozenset(place[int(x)] for x in b) for b in branches} == {frozenset(x) for x in ((0, 6), (9, 12), (12, 13))}
    assert lines[1] == ["REMARK  0 active torsions", "TORSDOF 0"] and lines[2][1:] == ["ROOT", lines[2][2], "ENDROOT", "TORSDOF 0"]


def test_molecules_of_a_file(spark, tmp_path):
    text = "one\n\n\n  2  1  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.0000    0.0000    0.0000 O   0  0\n  1  2  1\nM  END\n$$$$\n"
    (tmp_path / "a.sdf").write_text(text * 3)
    assert {(r["mol"], r["smiles"]) for r in g.names(g.heavy(datasource.read_molecules(spark, f"{tmp_path}/a.sdf", 100))).collect()} == {(k, "[CH3][OH1]") for k in range(3)}


def brute_common(graphs, whole_rings):
    """The greatest number of bonds of a connected part of the first graph that every other one has, by all sets of bonds and all maps."""

    def marked(labels, bonds):
        cyclic = g.ring_bonds(len(labels), bonds)
        return labels, [(i, j, (o, k in cyclic)) for k, (i, j, o) in enumerate(bonds)]

    def connected(part):
        seen, todo = set(part[0][:2]), True
        while todo:
            new = {x for i, j, _ in part for x in (i, j) if i in seen or j in seen}
            todo, seen = new - seen, seen | new
        return all(i in seen for i, _, _ in part)

    def held(labels, part, other):
        names, bonds = other
        edges = {frozenset((i, j)): o for i, j, o in bonds}
        atoms = sorted({x for i, j, _ in part for x in (i, j)})
        return any(all(labels[a] == names[q[a]] for a in atoms) and all(edges.get(frozenset((q[i], q[j]))) == o for i, j, o in part) for p in itertools.permutations(range(len(names)), len(atoms)) for q in [dict(zip(atoms, p))])

    (labels, bonds), *others = [marked(*x) for x in graphs]
    for size in range(len(bonds), 0, -1):
        for part in itertools.combinations(bonds, size):
            own = g.ring_bonds(len(labels), [(i, j, 1) for i, j, _ in part])
            if connected(part) and (not whole_rings or all(k in own for k, b in enumerate(part) if b[2][1])) and all(held(labels, part, o) for o in others):
                return size
    return 0


def test_common_substructures_equal_brute_force(spark):
    rng = random.Random(9)
    for case in range(4):
        graphs = [random_graph(rng, rng.randint(3, 6)) for _ in range(3)]
        graphs = [(labels, [(i, j, 1 if rng.random() < 0.7 else o) for i, j, o in bonds]) for labels, bonds in graphs]
        heavy = g.heavy(spark.createDataFrame([row(k, *x) for k, x in enumerate(graphs)], SCHEMA).coalesce(1))
        for whole in (True, False):
            found = g.common_substructure(heavy, whole).collect()
            want = brute_common(graphs, whole)
            assert {r["n_bonds"] for r in found} == ({want} if want else set()) and len(found) == (3 if want else 0)
            for r in found:
                assert r["n_molecules"] == 3 and len(r["atom_map"]) == r["n_atoms"] == r["smarts"].count("[")
    with pytest.raises(ValueError, match="two molecules"):
        g.common_substructure(heavy.limit(1))


def test_rings_are_shared_as_a_whole(spark):
    """Toluene and chlorobenzene share the ring, and cyclohexane with a chain nothing of it."""
    heavy = g.heavy(spark.createDataFrame([row(0, *CASES[4]), row(1, *CASES[5]), row(2, ["C"] * 6 + ["N"], [(i, j, 3 - o) for i, j, o in BENZENE] + [(2, 6, 1)])], SCHEMA))
    assert {(r["n_atoms"], r["n_bonds"], tuple(r["atom_map"])) for r in g.common_substructure(heavy).collect()} == {(6, 6, (0, 1, 2, 3, 4, 5))}
    ring = [(k, (k + 1) % 6, 1) for k in range(6)]
    other = g.heavy(spark.createDataFrame([row(0, ["C"] * 8, ring + [(0, 6, 1), (6, 7, 1)]), row(1, ["C"] * 5, [(k, k + 1, 1) for k in range(4)])], SCHEMA))
    assert {r["n_bonds"] for r in g.common_substructure(other).collect()} == {2}


def test_similarities_are_of_all_molecules(spark):
    """Every molecule is a query: each meets itself, and as many as meet it."""
    import tempfile

    from corpuscle.plans import files

    with tempfile.TemporaryDirectory() as d:
        spark.range(1, 31).withColumnRenamed("id", "p_partkey").write.parquet(f"{d}/part.parquet")
        rows = {(r["mol_a"], r["mol_b"]): r["similarity"] for r in files.QUERIES["fingerprint_similarity"](spark, d).collect()}
    assert {a for a, _ in rows} == set(range(1, 31)) and all(rows[k, k] == 1 for k in range(1, 31))
    assert all(rows[b, a] == s for (a, b), s in rows.items()) and len(rows) > 30


def test_equal_graphs_grow_once(spark, monkeypatch):
    seen, keep = [], g.materialize
    monkeypatch.setattr(g, "materialize", lambda df, name: (out := keep(df, name), seen.append((name, out.count())))[0])
    heavy = g.heavy(spark.createDataFrame([row(k, *CASES[4 + k % 2]) for k in range(40)], SCHEMA))
    found = g.common_substructure(heavy).collect()
    assert len(found) == 40 and {(r["n_molecules"], tuple(r["atom_map"])) for r in found} == {(40, (0, 1, 2, 3, 4, 5))}
    assert dict(seen[:2]) == {"graphs": 40, "kinds": 2} and max(k for name, k in seen if name == "level") < 100
