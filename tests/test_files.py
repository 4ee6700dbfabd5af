"""Readers of text trajectories: files cut into many splits, odd frames and rows, against the whole-file parsers."""

import random

import pytest

from corpuscle.sources import formats

DUMP = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS pp pp pp\n0 {b}\n0 10\n0 10\nITEM: ATOMS id type x y z\n{rows}\n"


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def places(data):
    return sorted((r["path"].rsplit("/", 1)[1], r["frame"], r["timestep"], r["idx"], r["x"], r["y"], r["z"]) for r in data.positions.collect())


def atoms(data, *names):
    return sorted((r["path"].rsplit("/", 1)[1], r["idx"], *(r[n] for n in names)) for r in data.atoms.collect())


def parsed(folder, parser):
    return {p.name: parser(p.read_text()) for p in folder.iterdir()}


def same(data, want, *names):
    assert places(data) == sorted((f, k, t, i, *map(float, p)) for f, s in want.items() for k, (t, points) in enumerate(s.frames) for i, p in enumerate(points))
    assert atoms(data, *names) == sorted((f, a["idx"], *(a.get(n) for n in names)) for f, s in want.items() for a in s.atoms)
    assert {r["path"].rsplit("/", 1)[1]: (r["lx"], r["ly"], r["lz"]) for r in data.box.collect()} == {f: tuple(map(float, s.box)) for f, s in want.items() if s.box}


def test_xyz_in_many_splits(spark, tmp_path, small_splits):
    r = random.Random(1)
    for f in range(3):
        n, text = 5 + f, ""
        for k in range(40):
            comment = ["", str(7 * k), f"Step: {k * 10}", f'Lattice="{k + 1} 0 0 0 12 0 0 0 15" x'][k % 4]
            text += f"{n}\n{comment}\n" + "".join(f"{r.choice(['O', 'C1', 'cl'])}  {r.random():.4f}\t{r.random():.4f} {r.random():.4f} extra\n" for _ in range(n))
        (tmp_path / f"{f}.xyz").write_text(text + "\n" * f)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    same(formats.load(spark, f"{tmp_path}/*.xyz", split=400), parsed(tmp_path, formats.parse_xyz), "id", "element", "type_id")


@pytest.mark.parametrize("text, words", [("2\n\nO 0 0 0\nH a 0 0\n", "Bad coordinate"), ("2\n\nO 0 0 0\nH 0 0\n", "Bad coordinate"), ("\n\n", "No frames"), ("1\n\nO 0 0 0\n2\n\nO 0 0 0\nO 0 0 0\n", "atom count"), ("2\n\nO 0 0 0\n", "cut short"), ("x\n", "no atom count")])
def test_bad_xyz(spark, tmp_path, text, words):
    (tmp_path / "a.xyz").write_text(text)
    with pytest.raises(formats.FormatError, match=words):
        formats.load(spark, f"{tmp_path}/a.xyz")


def pdb_record(k, name, x, alt=" ", element="  "):
    return f"ATOM  {k:5d} {name:<4s}{alt}ALA A{k // 4 + 1:4d}    {x:8.3f}{x / 2:8.3f}{-x:8.3f}  1.00  0.00          {element}\n"


def test_pdb_in_many_splits(spark, tmp_path, small_splits):
    r = random.Random(2)
    for f in range(2):
        text = "HEADER\nCRYST1   50.000   40.000   30.000  90.00  90.00  90.00\n"
        for k in range(12):
            n = 9 + (k % 3 - 1) * (k > 0)  # models of fewer and of more atoms than the first
            text += f"MODEL     {k + 1:4d}\n" + "".join(pdb_record(a, r.choice([" CA", " CB", "2HB", "CL1", " N"]), r.random() * 9, r.choice(" AB1"), r.choice(["  ", " C"])) for a in range(n)) + "TER\nENDMDL\n"
        (tmp_path / f"{f}.pdb").write_text(text + "END\n")
    (tmp_path / "one.pdb").write_text(pdb_record(0, " CA", 1.5) + pdb_record(1, " N", 2.5))
    same(formats.load(spark, f"{tmp_path}/*.pdb", split=400), parsed(tmp_path, formats.parse_pdb), "element", "type_id", "name", "resname", "chain_id", "residue_id")
    (tmp_path / "none.pdb").write_text("HEADER\n")
    with pytest.raises(formats.FormatError, match="no ATOM"):
        formats.load(spark, f"{tmp_path}/none.pdb")


def test_dump_frames_rows_and_boxes(spark, tmp_path, small_splits):
    rows = lambda t: "\n".join(f"{a + 1} {a % 3 + 1} {t}.{a} {a} 0" for a in (3, 1, 0, 2))
    text = "".join(DUMP.format(t=t, n=4, b=10 + k, rows=rows(k)) for k, t in enumerate([0, 100, 200, 200, 100] * 12))  # a restart repeats timesteps
    (tmp_path / "a.lammpstrj").write_text(text)
    data = formats.load(spark, f"{tmp_path}/a.lammpstrj", split=300)
    assert sorted({(r["frame"], r["timestep"]) for r in data.positions.collect()}) == [(k, t) for k, t in enumerate([0, 100, 200, 200, 100] * 12)]
    assert {(r["frame"], r["idx"], r["x"]) for r in data.positions.collect()} == {(k, i, float(f"{k}.{a}")) for k in range(60) for i, a in enumerate((3, 1, 0, 2))}
    assert atoms(data, "id", "type_id") == [("a.lammpstrj", i, a, a % 3 + 1) for i, a in enumerate((3, 1, 0, 2))]
    assert tuple(data.box.first())[1:] == (69.0, 10.0, 10.0)  # of the last frame


def test_dump_rows_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "b.lammpstrj").write_text(DUMP.format(t=5, n=4, b=10, rows="1 1 1 1 1\n2 1 x 1 1\n3 1 2\n4 2 4 4 4"))
    data = formats.load(spark, f"{tmp_path}/b.lammpstrj")
    assert [(i, *p) for _, _, _, i, *p in places(data)] == [(0, 1, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 4, 4, 4)]
    assert [(i, k) for _, i, k in atoms(data, "id")] == [(0, 0), (3, 3)]


def test_which_lammps_file(spark, tmp_path):
    assert formats.is_data_file(["# x", "", "3 atoms"]) and formats.is_data_file(["LAMMPS Description"]) and not formats.is_data_file(["ITEM: TIMESTEP", "3 atoms"]) and not formats.is_data_file(["hello"])
    (tmp_path / "c.lammps").write_text("x\n\n1 atoms\n\nAtoms # atomic\n\n1 1 5 6 7\n")
    assert [tuple(p) for *_, p in ((r["idx"], (r["x"], r["y"], r["z"])) for r in formats.load(spark, f"{tmp_path}/c.lammps").positions.collect())] == [(5.0, 6.0, 7.0)]


def test_mmcif_keeps_the_first_row_of_an_id():
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    cif = formats.parse_mmcif(head + "1 N N ALA A 1 1 2 3\n2 C CA ALA A 1 2 2 3\n1 N N ALA A 1 9 9 9\n")
    assert [a["id"] for a in cif.atoms] == [1, 2] and cif.frames[0][1] == [(1, 2, 3), (2, 2, 3)]
