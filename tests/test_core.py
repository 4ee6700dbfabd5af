"""Operators on small systems with values worked out by hand, and every registered query against its SQL."""

import glob
import importlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import geometry as g
from corpuscle.functions.plugins import PluginApi, run_plugin
from corpuscle.functions.selection import SelectionError, compile_selection, index_range
from corpuscle.operators import edit, grids, interactions, kernels, learn, molecules, residues, spatial, surface, trajectory
from corpuscle.sources import formats, simulation, sinks

SCHEMA = "frame int, idx long, type_id int, element string, x double, y double, z double, residue_id int, chain_id string, name string, resname string, in_a boolean, in_b boolean"


def system(spark, rows):
    """rows: element, position, residue, name, residue name, chain, side."""
    return spark.createDataFrame([(0, k, 0, e, *map(float, p), r, ch, n, res, side == "A", side == "B") for k, (e, p, r, n, res, ch, side) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def sel3(spark):
    rows = [(0, 1, "C", 1, 2, 3, "CA", 1, "A"), (1, 2, "N", 4, 5, 6, "CB", 1, "A"), (2, 1, "C", 7, 8, 9, "CA", 2, "B"), (3, None, None, 0, 0, 0, None, None, None)]
    return spark.createDataFrame([(k, t, e, float(x), float(y), float(z), n, r, c, n) for k, t, e, x, y, z, n, r, c in rows], "idx long, type_id int, element string, x double, y double, z double, name string, residue_id int, chain_id string, resname string")


@pytest.mark.parametrize(("text", "want"), [("type == 1", {0, 2}), ("element == C", {0, 2}), ("z > 5", {1, 2}), ("name == 'CA'", {0, 2}), ("chain_id == B", {2}), ("type == 1 AND z > 5", {2}), ("type == 2 OR z > 8", {1, 2}), ("NOT element == C", {1, 3}), ("z > 1 AND z < 7 AND NOT (type = 2)", {0}), ("resid == -1", {3}), ("NOT NOT type != 1", {1, 3})])
def test_selections(sel3, text, want):
    assert {r["idx"] for r in sel3.where(compile_selection(text)).collect()} == want


@pytest.mark.parametrize("text", ["@@@ invalid", "foobar == 1", "type == ", "(type == 1", "element > C", "named none", "type == 1 z", "x == C", ""])
def test_bad_selections(text):
    with pytest.raises(SelectionError):
        compile_selection(text)


def test_index_range_and_plugins(sel3):
    assert {r["idx"] for r in sel3.where(index_range("0-1, 3")).collect()} == {0, 1, 3}
    with pytest.raises(SelectionError):
        index_range("1-x")
    api = PluginApi(sel3.withColumn("frame", F.lit(0)))
    assert run_plugin(lambda a: a.n_atoms() * 10 + a.n_frames(), api) == 41
    assert run_plugin(lambda a: 1 / 0, api) is None and "ZeroDivisionError" in api.messages[0]
    assert api.system.where(api.selection("@@")).count() == 0


def test_geometry(spark):
    rows = spark.range(1)
    lit = lambda *p: tuple(F.lit(float(v)) for v in p)
    value = lambda c: rows.select(c).first()[0]
    assert value(g.distance(lit(15, 93, 35), lit(12, 92, 37))) == pytest.approx(math.sqrt(14))
    assert value(g.angle(lit(15, 93, 35), lit(12, 92, 37), lit(9, 93, 37))) == pytest.approx(math.degrees(math.acos(-8 / math.sqrt(140))))
    assert value(g.angle(lit(0, 0, 0), lit(0, 0, 0), lit(1, 0, 0))) == 0
    for last, want in (((1, 1, 0), 0), ((1, 0, 1), -90)):
        assert value(g.torsion(lit(0, 1, 0), lit(0, 0, 0), lit(1, 0, 0), lit(*last))) == pytest.approx(want)
    assert abs(value(g.torsion(lit(0, 1, 0), lit(0, 0, 0), lit(1, 0, 0), lit(1, -1, 0)))) == pytest.approx(180)


def test_superposition(spark):
    r = np.random.default_rng(3)
    a = r.uniform(-5, 5, (15, 3))
    b = a @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + 3
    table = spark.createDataFrame([(f, k, *map(float, p)) for f, m in ((0, a), (1, b)) for k, p in enumerate(m)], "frame int, idx long, x double, y double, z double")
    closed = {x["frame"]: x["rmsd"] for x in trajectory.kabsch_rmsd_to_frame(table).collect()}
    assert closed[1] == pytest.approx(0, abs=1e-5)
    moved = trajectory.superimpose_trajectory(table).where("frame = 1").orderBy("idx").toPandas()
    assert np.allclose(moved[["x", "y", "z"]], a)
    raw = {x["frame"]: x["rmsd"] for x in trajectory.rmsd_to_frame(table).collect()}
    assert raw[0] == 0 and raw[1] == pytest.approx(math.sqrt(((a - b) ** 2).sum() / 15))


def test_cell_join_equals_brute_force(spark):
    r = np.random.default_rng(1)
    p = r.uniform(-6, 6, (120, 3))
    table = system(spark, [("C", q, 1, "C", "ALA", "A", "A") for q in p])
    found = {(x["i"], x["j"]) for x in spatial.bonds_within(table, 2.5).collect()}
    assert found == {(i, j) for i in range(120) for j in range(i + 1, 120) if ((p[i] - p[j]) ** 2).sum() <= 6.25}


def test_interactions(spark):
    hb = system(spark, [("N", (0, 0, 0), 1, "N", "GLY", "A", "A"), ("H", (1, 0, 0), 1, "H", "GLY", "A", "A"), ("O", (3, 0, 0), 2, "O", "ALA", "A", "B")])
    rows = {(x["i"], x["j"]): x["angle"] for x in interactions.hbonds(hb).collect()}
    assert rows[0, 2] == pytest.approx(180) and rows[2, 0] is None and len(rows) == 2
    cl = system(spark, [("C", (0, 0, 0), 1, "C", "ALA", "A", "A"), ("C", (1, 0, 0), 2, "C", "ALA", "A", "B")])
    assert interactions.clashes(cl).first()["overlap"] == pytest.approx(2.0)
    sb = system(spark, [("N", (0, 0, 0), 1, "N", "ARG", "A", "A"), ("O", (3.5, 0, 0), 2, "O", "ASP", "A", "B")])
    assert interactions.salt_bridges(sb).count() == 1 and interactions.hbonds(sb).count() == 2
    far = system(spark, [("C", (0, 0, 0), 1, "C", "ALA", "A", "A"), ("C", (20, 0, 0), 2, "C", "ALA", "A", "B")])
    assert interactions.interaction_counts(far).first()["total"] == 0


def test_surface(spark):
    one = system(spark, [("C", (0, 0, 0), 1, "C", "ALA", "A", "A")])
    assert surface.sasa(one).first()["area"] == pytest.approx(4 * math.pi * 3.1**2)
    octet = system(spark, [("C", p, 1, "C", "ALA", "A", "A") for p in ((0, 0, 0), (2, 0, 0), (-2, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 2), (0, 0, -2))])
    area = {x["idx"]: x["area"] for x in surface.sasa(octet).collect()}
    assert area[0] == 0 and all(45.8 < area[k] < 48.7 for k in range(1, 7))


AG9 = [(e, p, r, n, res, "A", "A") for e, p, r, n, res in (("N", (0, 0, 0), 1, "N", "ALA"), ("C", (1.5, 0, 0), 1, "CA", "ALA"), ("C", (2, 1.2, 0), 1, "C", "ALA"), ("O", (3.2, 1.2, 0), 1, "O", "ALA"), ("C", (1.5, -1.2, 0), 1, "CB", "ALA"), ("N", (3.5, 0, 0), 2, "N", "GLY"), ("C", (5, 0, 0), 2, "CA", "GLY"), ("C", (5.5, 1.2, 0), 2, "C", "GLY"), ("O", (6.7, 1.2, 0), 2, "O", "GLY"))]


def test_residues_and_edits(spark):
    ag = system(spark, AG9)
    assert [(r["residue_id"], r["resname"], r["n_atoms"]) for r in residues.list_residues(ag).collect()] == [(1, "ALA", 5), (2, "GLY", 4)]
    assert residues.extract_sequence(ag).first()["sequence"] == "AG"
    rama = {r["residue_id"]: (r["phi"], r["psi"]) for r in residues.ramachandran(ag).collect()}
    assert rama[1][0] is None and rama[1][1] is not None and rama[2][0] is not None and rama[2][1] is None
    beads = residues.cg_beads(ag).orderBy("residue_id", "bead_order").collect()
    assert [(b["bead"], round(b["x"], 3), round(b["y"], 3)) for b in beads] == [("BB", 1.675, 0.6), ("SC1", 1.5, -1.2), ("BB", 5.175, 0.6)]
    assert edit.mutate_residue(ag, 1, "GLY").count() == 8
    assert edit.mutate_residue(ag, 2, "A").where("name = 'CB'").count() == 2 and edit.mutate_residue(ag, 2, "A").count() == 10
    assert edit.mutate_residue(ag, 1, "ALA").count() == 9
    with pytest.raises(edit.MutationError):
        edit.mutate_residue(ag, 99, "ALA")
    assert edit.cap_termini(ag).count() == 2
    assert residues.ion_estimate(ag, 1000).first()["n_na"] == 2
    assert [r["new_idx"] for r in residues.reindex(ag.where("idx > 3")).orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    assert {r["new_id"] for r in residues.renumber(ag, 7).collect()} == {7, 8}
    assert grids.hydrophobic_regions(ag).first()["n"] == 5


def test_components_of_a_chain(spark):
    nodes = spark.range(40).select("id")
    edges = spark.range(39).where("id <> 19").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in grids.components(nodes, edges).collect()} == {0, 20}


def test_learning():
    r = np.random.default_rng(0)
    x = np.r_[r.normal(0, 0.05, (5, 6)), r.normal(10, 0.05, (5, 6))]
    labels = learn.ward_labels(x, 2)
    assert len(set(labels[:5])) == len(set(labels[5:])) == 1 and labels[0] != labels[9]
    assert learn.align("ACGT", "ACGT")[1:] == ("ACGT", "ACGT") and learn.align("ACGT", "AGT")[2] == "A-GT"
    assert learn.align("xxACGTyy", "ACGT", local=True) == (8.0, "ACGT", "ACGT") and learn.align("", "")[0] == 0
    assert learn.identity_similarity("DK-A", "ERAA") == (pytest.approx(1 / 3), 1.0)


def test_frame_matrix_by_blocks(spark):
    r = np.random.default_rng(5)
    p = r.normal(0, 2, (11, 6, 3))
    table = spark.createDataFrame([(f, k, *map(float, p[f, k])) for f in range(11) for k in range(6)], "frame int, idx long, x double, y double, z double")

    def aligned(a, b):
        rot, t = trajectory.rotation(a, b)
        return math.sqrt(((a @ rot.T + t - b) ** 2).sum() / 6)

    for align, want in ((False, lambda a, b: math.sqrt(((a - b) ** 2).sum() / 6)), (True, aligned)):
        for block in (None, 1, 3):
            rows = {(x["i"], x["j"]): x["rmsd"] for x in trajectory.rmsd_matrix(table, align, block).collect()}
            assert set(rows) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
            assert all(v == pytest.approx(want(p[i], p[j])) for (i, j), v in rows.items())
    assert trajectory.rmsd_matrix(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="differ"):
        trajectory.rmsd_matrix(table.where("frame > 0 or idx > 0"))


def test_alanine_scan_equals_mutating_one_by_one(spark):
    r = np.random.default_rng(8)
    rows = []
    for res in range(1, 7):
        centre = r.uniform(-6, 6, 3)
        for n, e in zip("N CA C O CB H SD".split(), "N C C O C H S".split(), strict=True):
            rows.append((e, centre + r.uniform(-1.5, 1.5, 3), res, n, ("ARG", "PHE", "ALA", "MET", "ASP", "GLY")[res - 1], "A", "A" if res % 2 else "B"))
    rows = [x for x in rows if not (x[2] == 1 and x[3] == "CB")]  # one that gets a new beta carbon
    table = system(spark, rows)
    table = table.unionByName(table.withColumn("frame", F.lit(1)).withColumn("x", F.col("x") * 0.8)).cache()
    count = lambda t, f: {k: t.where(F.col("frame") == k).transform(f).count() for k in (0, 1)}
    kinds = (interactions.hbonds, interactions.hydrophobic, interactions.clashes)
    before = [count(table, f) for f in kinds]
    got = {(x["frame"], x["residue_id"]): (x["d_hbonds"], x["d_hydrophobic"], x["d_clashes"]) for x in edit.alanine_scan(table).collect()}
    assert set(got) == {(f, k) for f in (0, 1) for k in (1, 3, 5)} and got[0, 3] == (0, 0, 0)
    for k in (1, 5):
        changed = edit.mutate_residue(table, k, "ALA").withColumn("idx", F.coalesce("idx", F.lit(-1))).cache()
        after = [count(changed, f) for f in kinds]
        assert all(got[f, k] == tuple(b[f] - a[f] for a, b in zip(after, before, strict=True)) for f in (0, 1))


def test_binding_sites_equal_brute_force(spark):
    ring = [(4 * math.cos(t), 4 * math.sin(t), z) for z in (0, 4) for t in np.arange(6) * math.pi / 3]
    p = np.array(ring)
    table = system(spark, [("C", q, 1, "C", "ALA", "A", "A") for q in ring])
    lo, hi = p.min(0) - 3.4, p.max(0) + 3.4
    grid = np.array([lo + g for g in np.ndindex(*(math.ceil(w) + 1 for w in hi - lo))])
    d = np.sqrt(((grid[:, None] - p[None]) ** 2).sum(2)) - 1.7
    points = grid[(d < 1.4).sum(1).__eq__(0) & ((d < 5).sum(1) >= 5)]
    root = list(range(len(points)))
    for i in range(len(points)):
        for j in np.flatnonzero(((points[i + 1 :] - points[i]) ** 2).sum(1) < 9) + i + 1:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    want = sorted((float(root.count(k)), int((((points[np.array(root) == k].mean(0) - p) ** 2).sum(1) < 100).sum())) for k in set(root) if root.count(k) >= 20)
    two = table.unionByName(table.withColumn("frame", F.lit(1)))
    for frame in (0, 1):
        rows = grids.binding_sites(two, least=20.0).where(F.col("frame") == frame).collect()
        assert want and sorted((r["volume"], r["lining"]) for r in rows) == want and sorted(r["rank"] for r in rows) == list(range(1, len(want) + 1))


def test_models_and_whole_clusters(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (23, 2))
    rows = spark.createDataFrame([(k, float(a), float(b), float(3 * a - b)) for k, (a, b) in enumerate(x)] + [(99, None, 1.0, 1.0)], "n int, a double, b double, y double")
    model, scores = learn.fit_model(rows, ["a", "b"], "y", "n", alpha=1e-9)
    assert scores["train_r2"] == pytest.approx(1) and scores["cv_rmse"] == pytest.approx(0, abs=1e-6)
    predicted = {p["n"]: p["predicted"] for p in learn.predict(model, rows, ["a", "b"]).collect()}
    assert predicted[99] is None and all(predicted[k] == pytest.approx(3 * a - b, abs=1e-5) for k, (a, b) in enumerate(x))
    assert learn.fit_model(rows, ["a", "b"], "y", "n", "forest")[1]["train_r2"] > 0.5
    with pytest.raises(ValueError, match="five"):
        learn.fit_model(rows.limit(4), ["a", "b"], "y", "n")
    frames = spark.createDataFrame([(f, k, float(f % 2 * 50 + k), 0.0, f / 100) for f in range(20) for k in range(3)], "frame int, idx long, x double, y double, z double")
    labels = {p["frame"]: p["cluster"] for p in learn.ward_frames(frames, 2, 6).collect()}
    assert len(labels) == 20


def test_molecules(spark):
    rows = [(1, 10, "c", "x", 2), (2, 12, "c", "y", 3), (3, 10, "c", "x", 2), (4, 9, "c", "z", 9), (1, 10, "b", "p", 1), (2, 12, "b", "q", 1), (5, 10, None, "x", 1)]
    found = molecules.matched_pairs(spark.createDataFrame(rows, "mol int, heavy int, core string, rgroup string, group_heavy int"))
    assert {(r["mol_a"], r["mol_b"], r["core"], r["group_a"], r["group_b"]) for r in found.collect()} == {(1, 2, "b", "p", "q"), (2, 3, "c", "y", "x"), (1, 4, "c", "x", "z"), (2, 4, "c", "y", "z"), (3, 4, "c", "x", "z")}
    shapes = [(1, 1, 5.0, [0.0] * 6), (1, 2, 6.0, [0.1] * 6), (1, 3, 7.0, [3.0] * 6), (1, 4, 30.0, [9.0] * 6), (1, 5, None, [20.0] * 6), (2, 1, 1.0, [0.0] * 6), (2, 2, 1.0, [0.0] * 6), (3, 1, 1.0, [])]
    found = molecules.diverse_conformers(spark.createDataFrame(shapes, "mol int, conformer int, energy double, coords array<double>"))
    assert {(r["mol"], r["conformer"], r["rank"]) for r in found.collect()} == {(1, 5, 1), (1, 1, 2), (1, 3, 3), (2, 1, 1)}


def test_formats(spark, tmp_path):
    xyz = '2\nLattice="10 0 0 0 12 0 0 0 15"\nO 0 0 0\nH 1 0 0\n2\nStep: 100 x\nO 0 0 1\nH 1 0 1\n'
    (tmp_path / "a.xyz").write_text(xyz)
    data = formats.load(spark, str(tmp_path / "a.xyz"))
    assert data.positions.count() == 4 and data.atoms.count() == 2 and tuple(data.box.first())[1:] == (10, 12, 15)
    assert [s for s, _ in formats.parse_xyz(xyz).frames] == [0, 100] and formats.parse_xyz(xyz, True).box == (10, 0, 0)
    for bad, words in (("2\n\nO 0 0 0\nH a 0 0\n", "Bad coordinate"), ("", "No frames"), ("1\n\nO 0 0 0\n2\n\nO 0 0 0\nO 0 0 0\n", "atom count")):
        with pytest.raises(formats.FormatError, match=words):
            formats.parse_xyz(bad)
    with pytest.raises(formats.FormatError, match="Unsupported file format"):
        formats.detect("x.foo")
    ag = system(spark, AG9)
    lines = [r["line"] for r in sinks.pdb_lines(ag).orderBy("idx").collect()]
    back = formats.parse_pdb("\n".join(lines))
    assert [a["name"] for a in back.atoms] == [r[3] for r in AG9] and np.allclose(back.frames[0][1], [r[1] for r in AG9])
    dump = "".join(f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type x y z\n1 1 0 0 {t}\n2 1 1 1 1\n" for t in (0, 1))
    (tmp_path / "t.lammpstrj").write_text(dump)
    data = formats.load(spark, str(tmp_path / "t.lammpstrj"))
    assert {(r["frame"], r["timestep"]) for r in data.positions.collect()} == {(0, 0), (1, 1)} and data.atoms.count() == 2
    lammps = formats.parse_lammps_data("x\n\n3 atoms\n0 10 xlo xhi\n0 10 ylo yhi\n0 10 zlo zhi\n\nAtoms # bond\n\n0 1 0 0 0 0\n1 1 1 1 0 0\n2 1 2 2 0 0\n\nBonds\n\n1 1 0 1\n2 1 2 1\n")
    assert lammps.bonds == [(0, 1), (1, 2)] and [a["type_id"] for a in lammps.atoms] == [0, 1, 2] and lammps.box == (10, 10, 10)
    gro = formats.parse_gro("t\n1\n    1SOL     OW    1   1.200   0.000   0.500\n   5.0 5.0 5.0\n")
    assert gro.frames[0][1] == [(12.0, 0.0, 5.0)] and gro.box == (50, 50, 50) and gro.atoms[0]["resname"] == "SOL"
    cif = formats.parse_mmcif("data_x\n_cell.length_a 50\n_cell.length_b 50\n_cell.length_c 50\nloop_\n_atom_site.id\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n1 N N ALA A 1 1.0 2.0 3.0\n2 C CA ALA A 1 2.0 2.0 3.0\n#\n")
    assert len(cif.atoms) == 2 and cif.box == (50, 50, 50) and cif.atoms[0]["chain_id"] == "A"
    sdf = formats.parse_sdf("m\n\n\n  2  1  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 C   0\n    1.0000    0.0000    0.0000 O   0\n  1  2  1  0\nM  END\n$$$$\n")
    assert sdf.bonds == [(0, 1)] and sdf.atoms[1]["element"] == "O"
    assert sinks.csv_rows(ag).first()["x"] == "0.0000"


def test_simulation_inputs(spark):
    bare = system(spark, [("C", (0, 0, 0), 1, "CA", "ALA", "A", "A"), ("N", (10, 20, 30), 1, "N", "ALA", "A", "A"), (None, (5, 5, 5), 1, "X", "ALA", "A", "A")])
    files = simulation.gromacs_inputs(bare, "CHARMM36", "spce", "NVT", n_prod=7)
    assert set(files) == {"em.mdp", "nvt.mdp", "npt.mdp", "md.mdp", "README.txt"}
    read = {n: dict(line.split(" = ", 1) for line in t.splitlines() if " = " in line) for n, t in files.items()}
    assert read["md.mdp"]["nsteps"] == "7" and read["md.mdp"]["pcoupl"] == "no" and "tau_p" not in read["md.mdp"]
    assert read["npt.mdp"]["pcoupl"] == "Parrinello-Rahman" and read["npt.mdp"]["define"] == "-DPOSRES" and read["nvt.mdp"]["nsteps"] == "100000"
    assert "-box 3.000 4.000 5.000" in files["README.txt"] and "-ff charmm36-jul2021 -water spce" in files["README.txt"] and simulation.HYDROGEN_WARNING in files["README.txt"]
    assert "-box 1.000 2.000 3.000" in simulation.gromacs_inputs(bare, box=(10, 20, 30))["README.txt"]
    assert "-box 2.000 2.000 2.000" in simulation.gromacs_inputs(bare.limit(0))["README.txt"]
    files = simulation.amber_inputs(bare.withColumn("element", F.lit("h")), "FF19SB", "tip4p")
    assert "source leaprc.protein.ff19SB\nsource leaprc.water.tip4pew" in files["tleap.in"] and "TIP4PEWBOX" in files["tleap.in"]
    assert simulation.HYDROGEN_WARNING not in files["README.txt"] and "-c min.rst -r heat.rst -x heat.nc" in files["README.txt"]
    assert "restraint_wt = 10.0," in files["heat.in"] and "nstlim = 5000000," in files["prod.in"] and "ntr = 0," in files["equil.in"]
    assert "ff14SB" in simulation.amber_inputs(bare, "none", "none")["tleap.in"]


@pytest.mark.parametrize("n", [1, 5, 80])
def test_support_weights_are_optimal(n):
    """Primal and dual agree, which only the optimum does."""
    r = np.random.default_rng(n)
    x = np.repeat(r.normal(size=(n, 3)), 2, axis=0)  # with repeated rows
    y = np.sin(2 * x[:, 0]) + x[:, 1] + r.normal(size=2 * n) / 5
    k = kernels.radial(x, x, 1 / 3)
    w, b = kernels.support_weights(k, y, 1.0, 0.1)
    assert abs(w.sum()) < 1e-9 and abs(w).max() <= 1
    loss = w @ k @ w / 2 + np.maximum(abs(y - k @ w - b) - 0.1, 0).sum()
    assert loss - (y @ w - w @ k @ w / 2 - 0.1 * abs(w).sum()) == pytest.approx(0, abs=2e-4 * n + 1e-4)


def test_support_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 2))
    rows = spark.createDataFrame([(k, float(a), float(b), float(np.sin(a) + b)) for k, (a, b) in enumerate(x)] + [(999, None, 0.0, 0.0)], "n int, a double, b double, y double")
    model, scores = learn.fit_model(rows, ["a", "b"], "y", "n", "svr")
    assert scores["train_r2"] > 0.95 and scores["cv_r2"] > 0.9
    predicted = {p["n"]: p["predicted"] for p in learn.predict(model, rows, ["a", "b"]).collect()}
    assert predicted[999] is None and np.mean([abs(predicted[k] - np.sin(a) - b) for k, (a, b) in enumerate(x)]) < 0.2


def test_queries_equal_their_sql(spark):
    entry, data = importlib.import_module("__spark_entry__"), "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    sql = entry.oracle_sql()
    assert entry.entry(spark).count() > 0
    for name, query in entry.queries().items():
        if name not in sql:
            continue
        rows = query(spark, data)
        found = con.execute(sql[name])
        columns = [d[0] for d in found.description]
        assert sorted(rows.columns) == sorted(columns), name
        key = lambda r: [repr(v) for v in r]
        assert sorted((list(r) for r in rows.select(*columns).collect()), key=key) == sorted((list(r) for r in found.fetchall()), key=key), name


def test_ward_links_every_frame(spark):
    def greedy(x, k):
        own = [[i] for i in range(len(x))]
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        while len(own) > k:
            i, j = min(((i, j) for i in range(len(own)) for j in range(i + 1, len(own))), key=lambda p: cost(own[p[0]], own[p[1]]))
            own[i] += own.pop(j)
        return {frozenset(c) for c in own}

    r = np.random.default_rng(4)
    x = r.normal(0, 1, (60, 9))
    x[40:], x[[7, 33]] = x[40:] / 50 + 3, x[[7, 33]] / 9 + 40  # a dense group, and a far pair in odd frames only
    table = lambda x: spark.createDataFrame([(f, k, *map(float, c)) for f, row in enumerate(x) for k, c in enumerate(row.reshape(-1, 3))], "frame int, idx long, x double, y double, z double")

    def got(x, k, group):
        found = {}
        for p in learn.ward_frames(table(x), k, group, align_first=False).collect():
            found.setdefault(p["cluster"], set()).add(p["frame"])
        assert sorted(found) == list(range(k))
        return {frozenset(c) for c in found.values()}

    for k, group in ((3, 30), (6, 4096)):
        assert got(x, k, group) == greedy(x, k)
    assert {len(c) for c in got(np.r_[np.zeros((40, 9)), np.ones((9, 9))], 2, 30)} == {40, 9}  # equal frames


def test_clusters_of_superposed_frames(spark):
    r = np.random.default_rng(6)
    shapes, rows = r.normal(0, 3, (2, 7, 3)), []
    for f in range(24):
        q, _ = np.linalg.qr(r.normal(0, 1, (3, 3)))
        q *= np.sign(np.linalg.det(q))
        xyz = (shapes[f // 3 % 2] + r.normal(0, 0.01, (7, 3))) @ q + r.normal(0, 50, 3)  # tumbles and drifts
        rows += [(f + 2, k, *map(float, c)) for k, c in enumerate(xyz)]
    table = spark.createDataFrame(rows, "frame int, idx long, x double, y double, z double").cache()
    packed = trajectory.superimpose_packed(trajectory.pack_frames(table)).collect()
    want = {p["frame"]: p["coords"] for p in trajectory.pack_frames(trajectory.superimpose_trajectory(table, 2)).collect()}
    assert len(packed) == 24 and all(np.allclose(p["coords"], want[p["frame"]], atol=1e-8) for p in packed)
    for found in (learn.cluster_frames(table, 2), learn.ward_frames(table, 2)):
        labels = {p["frame"]: p["cluster"] for p in found.collect()}
        assert len(labels) == 24 and all((labels[f + 2] == labels[2]) == (f // 3 % 2 == 0) for f in range(24))
