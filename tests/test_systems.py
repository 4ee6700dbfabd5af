"""Systems that are loaded together: every operator gives for each what it gives for it alone."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import edit, grids, interactions, learn, residues, spatial, surface, trajectory
from corpuscle.sources import formats, sinks

SCHEMA = "path string, frame int, idx bigint, type_id int, element string, x double, y double, z double, residue_id int, chain_id string, name string, resname string"
NAMES = [("N", "N"), ("CA", "C"), ("C", "C"), ("O", "O"), ("CB", "C"), ("H", "H"), ("CL1", "CL")]
RESIDUES = ("ARG", "ASP", "PHE", "ALA", "HOH", "GLY")


def rows(path, seed, n_residues, frames=(0, 1, 4)):
    rng, out = random.Random(seed), []
    for f in frames:
        idx = 0
        for r in range(n_residues):
            res = RESIDUES[(r + seed) % len(RESIDUES)]
            for name, e in ([("OW", "O"), ("HW1", "H"), ("HW2", "H")] if res == "HOH" else NAMES):
                out.append((path, f, idx, idx % 5, e, *(round(rng.uniform(0, 7), 3) for _ in "xyz"), r + 1 + (r > 3), "AB"[r > 2], name, res))
                idx += 1
    return out


@pytest.fixture(scope="module")
def systems(spark):
    both = {"a": rows("a", 1, 6), "b": rows("b", 2, 5, (0, 1, 2, 7))}
    df = spark.createDataFrame([r for p in both.values() for r in p], SCHEMA).coalesce(2).cache()
    return df, {p: spark.createDataFrame([r[1:] for r in own], SCHEMA.partition(", ")[2]).coalesce(1).cache() for p, own in both.items()}


def grouped(s):
    return s.withColumn("in_a", F.col("residue_id") <= 3).withColumn("in_b", F.col("residue_id") > 3)


def bonds(s):
    return spatial.covalent_bonds(s)


OPERATORS = {
    "bonds_within": lambda s: spatial.bonds_within(s, 2.0),
    "covalent_bonds": bonds,
    "bonds_between": lambda s: spatial.bonds_between(spatial.bonds_within(s, 2.0), s.where("element = 'C'")),
    "missing_bonds": lambda s: spatial.missing_bonds(spatial.bonds_within(s, 2.5), bonds(s)),
    "picked_atom": lambda s: spatial.picked_atom(s, spatial.bonds_within(s, 2.0), 3.0, 3.0, 3.0),
    "effective_colors": lambda s: spatial.effective_colors(s.where("frame = 0"), (F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.col("x") > 6.9),
    "all_interactions": lambda s: interactions.all_interactions(grouped(s)),
    "hbonds": lambda s: interactions.hbonds(grouped(s)),
    "halogen": lambda s: interactions.halogen_bonds(grouped(s)),
    "interaction_counts": lambda s: interactions.interaction_counts(grouped(s)),
    "interaction_summary": lambda s: interactions.interaction_summary(grouped(s)),
    "rmsd": trajectory.rmsd_to_frame,
    "kabsch": lambda s: trajectory.kabsch_rmsd_to_frame(s, 1),
    "rmsf": trajectory.rmsf,
    "rmsf_residue": trajectory.rmsf_per_residue,
    "matrix": trajectory.rmsd_matrix,
    "divergent": lambda s: trajectory.divergent_pairs(trajectory.rmsd_matrix(s, align=False), 2)[0],
    "divergent_mean": lambda s: trajectory.divergent_pairs(trajectory.rmsd_matrix(s, align=False), 2)[1],
    "superimpose": lambda s: trajectory.superimpose_trajectory(s, 0, s.where("element = 'C'")),
    "superimpose_packed": lambda s: trajectory.unpack_frames(trajectory.superimpose_packed(trajectory.pack_frames(s))),
    "subsample": lambda s: trajectory.subsample(s, 2).select(*[c for c in ("path",) if c in s.columns], "frame", "idx"),
    "list_residues": residues.list_residues,
    "renumber": lambda s: residues.renumber(s, 3),
    "reindex": lambda s: residues.reindex(edit.remove_waters(s)),
    "gaps": residues.residue_gaps,
    "ramachandran": residues.ramachandran,
    "sequence": residues.extract_sequence,
    "align_chains": lambda s: learn.align_chains(residues.extract_sequence(s)),
    "issues": residues.structure_issues,
    "counts": residues.structure_counts,
    "ions": lambda s: residues.ion_estimate(s, 1000),
    "beads": residues.cg_beads,
    "box": lambda s: residues.docking_box(s, F.col("resname") == "PHE"),
    "legend": residues.legend,
    "mutate": lambda s: edit.mutate_residue(s, 1, "ALA"),
    "caps": edit.cap_termini,
    "capped": edit.capped_structure,
    "solvate": lambda s: edit.solvate(s, 2.0, most=40),
    "alanine": lambda s: edit.alanine_scan(grouped(s)),
    "sites": lambda s: grids.binding_sites(s.where("frame < 2"), 2.0, 10.0),
    "pharmacophore": grids.pharmacophore,
    "regions": lambda s: grids.hydrophobic_regions(s, 1.5),
    "patches": lambda s: surface.surface_patches(s, surface.sasa(s)),
    "pka": lambda s: surface.estimate_pka(s, surface.sasa(s)),
    "density": lambda s: surface.hydration_sites(surface.water_density(s, 1.0), 0.1),
    "clusters": lambda s: learn.describe_clusters(s, s.select(*[c for c in ("path",) if c in s.columns], "frame", (F.col("frame") % 2).alias("cluster")).distinct()),
    "ward": lambda s: learn.ward_frames(s.select(*[c for c in ("path",) if c in s.columns], "frame", "idx", "x", "y", "z"), 2),
    "pdb_lines": sinks.pdb_lines,
    "xyz_frames": sinks.xyz_frames,
}


def listed(df):
    names = sorted(df.columns)
    fixed = lambda v: f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    return sorted(tuple(fixed(r[c]) for c in names) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_together_as_alone(systems, name):
    df, alone = systems
    found = OPERATORS[name](df)
    assert "path" in found.columns
    found = found.toPandas()
    for path, own in alone.items():
        want = OPERATORS[name](own)
        names = sorted(want.columns)
        fixed = lambda v: "None" if v is None or v != v else f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
        got = sorted(tuple(fixed(v) for v in r) for r in found[found["path"] == path][names].itertuples(index=False))
        assert got == sorted(tuple(fixed(v) for v in r) for r in want.toPandas()[names].itertuples(index=False))


def test_two_files_are_not_mixed(spark, tmp_path):
    for f, far in (("a", 3.0), ("b", 9.0)):
        (tmp_path / f"{f}.xyz").write_text("".join(f"2\n{k}\nN 0 0 0\nO {far} 0 {k}\n" for k in range(3)))
    two = formats.load(spark, f"{tmp_path}/*.xyz")
    near = spatial.bonds_within(two.system(), 3.5).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["frame"], r["i"], r["j"]) for r in near) == [("a.xyz", 0, 0, 1), ("a.xyz", 1, 0, 1)]
    assert {(r["path"].rsplit("/", 1)[1], r["frame"]) for r in trajectory.pack_frames(two.positions).where("size(coords) = 6").collect()} == {(f"{f}.xyz", k) for f in "ab" for k in range(3)}


def test_topologies_meet_their_trajectories(spark, tmp_path):
    for f, e in (("one", "C"), ("two", "N")):
        (tmp_path / f"{f}.pdb").write_text(f"ATOM      1 {e:^4} ALA A   1       0.000   0.000   0.000  1.00  0.00           {e}\n")
        (tmp_path / f"{f}.xyz").write_text("1\n0\nX 1 2 3\n1\n1\nX 4 5 6\n")
    rows = formats.load(spark, f"{tmp_path}/*.pdb").with_trajectory(formats.load(spark, f"{tmp_path}/*.xyz")).system().collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["frame"], r["element"]) for r in rows) == [("one.xyz", 0, "C"), ("one.xyz", 1, "C"), ("two.xyz", 0, "N"), ("two.xyz", 1, "N")]


def test_pdb_columns_hold_large_numbers(spark, tmp_path):
    n = 100_001
    atoms = spark.range(n).select(F.lit(0).alias("frame"), F.col("id").alias("idx"), F.lit("C").alias("element"), (F.col("id") / 1000.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("id") / 8 + 1).cast("int").alias("residue_id"), F.when(F.col("id") < 99_999, "A").otherwise("B").alias("chain_id"), F.lit("CA").alias("name"), F.lit("TIP3").alias("resname"))
    text = {r["idx"]: r["line"] for r in sinks.pdb_lines(atoms).collect()}
    last, first = text[n - 2].split("\n")[-1], text[n - 2].split("\n")[0]
    assert {len(line) for t in text.values() for line in t.split("\n") if line.startswith("ATOM")} == {78}
    assert last[:30] == "ATOM      0  CA  TIP3B2500    " and first == "TER   99999      TIP3A2500" and text[8 * 9998][22:26] == "9999" and text[8 * 9999][22:26] == "   0"
    sinks.write_pdb(atoms, f"{tmp_path}/out.pdb")
    assert spark.read.text(f"{tmp_path}/out.pdb").where("value = 'END'").count() == 1
    back = formats.load(spark, f"{tmp_path}/out.pdb")
    assert back.positions.groupBy("path").count().agg(F.sum("count")).first()[0] == n and back.atoms.where("resname = 'TIP3'").count() == n
