"""Files read in many ranges against the parsers of whole files, and packed frames against an encoder of the format."""

import random
import struct

import numpy as np
import pytest
from test_binary import XYZ, dcd, netcdf, trr

from corpuscle.sources import binary, binary_sinks, datasource, formats, ranges, xtc


class Bits:
    """The stream as the format has it: numbers of whole bytes from the lowest on, then the rest, each from its highest bit."""

    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""

    def triple(self, values, sizes, n):
        number = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        while n >= 8:
            self.put(number & 255, 8)
            number, n = number >> 8, n - 8
        self.put(number, n)

    def bytes(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def packed_frame(whole, small, plan, precision=1000.0, wide=False):
    """An XTC frame of integers whole, by a plan of (atoms in the run, change of the range index), each run's first atom swapped with the whole one."""
    low, high = whole.min(0), whole.max(0)
    sizes = [int(x) for x in high - low + 1]
    apart = max(sizes) > 0xFFFFFF
    bits, at, run_now, index = Bits(), 0, 0, small
    for run, change in plan:
        atoms = whole[at : at + 1 + run]
        head = atoms[1] if run else atoms[0]
        if apart:
            for v, s in zip(head - low, sizes, strict=True):
                bits.put(int(v), s.bit_length())
        else:
            bits.triple([int(v) for v in head - low], sizes, (sizes[0] * sizes[1] * sizes[2]).bit_length())
        if run != run_now or change:
            bits.put(1, 1)
            bits.put(3 * run + change + 1, 5)
            run_now = run
        else:
            bits.put(0, 1)
        before, size = head, xtc.RANGES[index]
        for k in range(run):
            own = atoms[0] if k == 0 else atoms[k + 1]
            bits.triple([int(v) for v in own - before + size // 2], [size] * 3, index)
            before = own
        at, index = at + 1 + run, index + change
    body = bits.bytes()
    head = struct.pack(">3if9fi", xtc.WIDE if wide else xtc.NARROW, len(whole), 7, 0.5, *(5.0, 0, 0, 0, 6.0, 0, 0, 0, 7.0), len(whole))
    return head + struct.pack(">f7i", precision, *map(int, low), *map(int, high), small) + struct.pack(">q" if wide else ">i", len(body)) + body + b"\0" * (-len(body) % 4)


def packed_case(seed, spread=3000, small=20, wide=False):
    """Atoms whose runs stay within the range index that holds then."""
    rng = random.Random(seed)
    plan, index, atoms = [], small, []
    while len(atoms) < 60:
        run = rng.choice([0, 0, 1, 2, 3, 8])
        change = rng.choice([0, 0, 1, -1]) if 12 < index < 30 else 0
        half = xtc.RANGES[index] // 2
        step = lambda half=half: np.array([rng.randint(-half, half - 1) for _ in "xyz"])
        head = np.array([rng.randint(-spread, spread) for _ in "xyz"])
        group, last = [head], head
        for k in range(run):
            last = last + step()
            group = [last, head] if k == 0 else [*group, last]
        atoms += group
        plan.append((run, change))
        index += change
    return np.array(atoms), packed_frame(np.array(atoms), small, plan, wide=wide)


@pytest.mark.parametrize("seed,spread,small,wide", [(1, 3000, 20, False), (2, 40, 13, False), (3, 9_000_000, 25, True), (4, 8_000_000, 60, False), (5, 200_000, 40, False), (6, 3, 9, False)])
def test_packed_frames(seed, spread, small, wide):
    whole, frame = packed_case(seed, spread, small, wide)
    assert np.array_equal(np.rint(xtc.points(frame) * 100).astype(np.int64), whole)


def test_packed_files_in_ranges(spark, tmp_path):
    """Frames of several sizes, one of few atoms' kind, and a last one that is cut short."""
    cases = [packed_case(s) for s in range(5)]
    n = min(len(w) for w, _ in cases)
    assert n > 9
    (tmp_path / "a.xtc").write_bytes(b"".join(f for _, f in cases) + cases[0][1][:-8])
    data = formats.load(spark, f"{tmp_path}/a.xtc", split=1)
    assert data.positions.rdd.getNumPartitions() == 5
    found = {(r["frame"], r["idx"]): (r["x"], r["y"], r["z"]) for r in data.positions.collect()}
    assert found == {(k, i): tuple(p) for k, (w, f) in enumerate(cases) for i, p in enumerate(xtc.points(f).tolist())}
    assert tuple(data.box.first())[1:] == (50.0, 60.0, 70.0)
    few = [np.array([[1.0, -2.0, 3.25], [0.5, 0.25, -8.0]])] * 2
    (tmp_path / "b.xtc").write_bytes(binary_sinks.xtc_bytes(few))
    got = formats.load(spark, f"{tmp_path}/b.xtc").positions.where("frame = 1").orderBy("idx").select("x", "y", "z").collect()
    assert np.allclose(np.array(got), few[0], atol=1e-5)
    (tmp_path / "c.xtc").write_bytes(b"\0" * 100)
    with pytest.raises(Exception, match="no XTC frame"):
        formats.load(spark, f"{tmp_path}/c.xtc").positions.collect()


@pytest.mark.parametrize("name,data,parser", [("a.dcd", dcd(), binary.parse_dcd), ("b.dcd", dcd(">", False), binary.parse_dcd), ("a.trr", trr(), binary.parse_trr), ("b.trr", trr(8, False), binary.parse_trr), ("a.nc", netcdf(), binary.parse_netcdf), ("b.nc", netcdf(2, -1), binary.parse_netcdf)])
def test_binary_ranges_equal_whole_files(tmp_path, name, data, parser):
    (tmp_path / name).write_bytes(data + b"\0" * 7)
    want, kind = parser(data), ranges.BINARY["." + name.split(".")[1]]
    with ranges.open_file(f"file://{tmp_path}/{name}") as f:
        size = f.size() - 7
        for step in (1, 100, 1 << 20):
            parts, n, box = kind.plan(f, size, name, step)
            assert n == len(want.atoms) and box == want.box
            assert [p.first for p in parts] == [0, *(p.beyond for p in parts[:-1])] and (len(parts) > 1) == (step < 1000)
            got = [(k, xyz) for p in parts for k, _, _, xyz in kind.points(f, size, p, lambda k: k != 1)]
            assert [k for k, _ in got] == [k for k in range(len(want.frames)) if k != 1]
            assert all(np.array_equal(xyz, want.frames[k][1]) for k, xyz in got)


def test_fixed_atoms(tmp_path):
    """Only the first frame has all atoms; each range reads it for those that don't move."""
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    head = record(struct.pack("<4s9if10i", b"CORD", 3, 0, 1, 0, 0, 0, 0, 0, 3, 1.0, *[0] * 9, 24)) + record(struct.pack("<i", 0)) + record(struct.pack("<i", 5)) + record(struct.pack("<2i", 2, 4))
    axes = lambda f: b"".join(record(f[:, k].astype("<f4").tobytes()) for k in range(3))
    data = head + axes(XYZ[0]) + axes(XYZ[1][[1, 3]]) + axes(XYZ[2][[1, 3]])
    (tmp_path / "f.dcd").write_bytes(data)
    want = binary.parse_dcd(data)
    with ranges.open_file(str(tmp_path / "f.dcd")) as f:
        parts, _, _ = ranges.BINARY[".dcd"].plan(f, len(data), "f", 1)
        got = [xyz for p in parts for _, _, _, xyz in ranges.BINARY[".dcd"].points(f, len(data), p, lambda k: True)]
    assert len(got) == 3 and all(np.array_equal(a, b) for a, (_, b) in zip(got, want.frames, strict=True))


MOL = "{name}\n\n\n{n:3d}{b:3d}  0  0  0  0            999 V2000\n{atoms}{bonds}{more}M  END\n$$$$\n"


def molecule(name, elements, bonds, more=""):
    atoms = "".join(f"{k:10.4f}{k * 2:10.4f}{0:10.4f} {e:<3} 0  0\n" for k, e in enumerate(elements))
    return MOL.format(name=name, n=len(elements), b=len(bonds), atoms=atoms, bonds="".join(f"{i + 1:3d}{j + 1:3d}{o:3d}\n" for i, j, o in bonds), more=more)


def test_sdf_records_are_split(spark, tmp_path):
    records = [molecule(f"m{k}", ["C", "N", "O"][: 2 + k % 2], [(0, 1, 1)] + ([(1, 2, 2)] if k % 2 else []), "M  CHG  1   2   1\n" if k == 3 else "") for k in range(20)]
    (tmp_path / "a.sdf").write_text("".join(records))
    for split in (1 << 20, 90):
        data = formats.load(spark, f"{tmp_path}/a.sdf", split=split)
        assert {(r["frame"], r["idx"]): (r["x"], r["y"]) for r in data.positions.collect()} == {(f, i): (float(i), 2.0 * i) for f in range(10) for i in range(2)}
        assert [tuple(r)[1:] for r in data.bonds.collect()] == [(0, 1)]
        found = datasource.read_molecules(spark, f"{tmp_path}/a.sdf", split).orderBy("mol").collect()
        assert [(r["mol"], r["name"], len(r["atoms"]), len(r["bonds"])) for r in found] == [(k, f"m{k}", 2 + k % 2, 1 + k % 2) for k in range(20)]
        assert [a["charge"] for a in found[3]["atoms"]] == [0, 1, 0] and found[1]["bonds"][1]["order"] == 2


def test_frames_that_are_asked_for(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("".join(f"2\n{k}\nC 0 0 {k}\nO 1 1 {k}\n" for k in range(50)))
    (tmp_path / "a.dcd").write_bytes(binary_sinks.dcd_bytes([XYZ[0] + k for k in range(50)]))
    for name in ("a.xyz", "a.dcd"):
        every, some = (formats.load(spark, f"{tmp_path}/{name}", split=128, frames=f).positions for f in (None, (7, 9)))
        assert {r["frame"] for r in some.select("frame").distinct().collect()} == {7, 8} and every.select("frame").distinct().count() == 50
        assert some.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 4
        assert every.where("frame = 3").join(every, ["path", "idx"]).count() == 50 * every.where("frame = 3").count()


def test_errors_may_wait(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1\n0\nC 0 0 0\n1\n1\nC 0 x 0\n")
    late = formats.load(spark, f"{tmp_path}/a.xyz", check=False)
    assert late.atoms.count() == 1
    with pytest.raises(Exception, match="Bad coordinate"):
        late.positions.collect()


def test_names_and_patterns(tmp_path):
    for f in ("a.xyz", "b.xyz", "_c.xyz", "part=1/d.xyz", "sub/e.xyz"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    names = lambda p: [u.rsplit("/", 1)[1] for u, _ in ranges.list_files(p)]
    assert names(f"{tmp_path}") == ["a.xyz", "b.xyz", "d.xyz"] and names(f"file:{tmp_path}/[b-z].xyz") == ["b.xyz"]
    assert names(f"{tmp_path}/{{a,b}}.xyz") == ["a.xyz", "b.xyz"] and names(f"{tmp_path}/part=*") == ["d.xyz"] and names(f"{tmp_path}/a.xyz") == ["a.xyz"]
    with pytest.raises(FileNotFoundError):
        ranges.list_files(f"{tmp_path}/none.xyz")


def test_mol2_text(spark, tmp_path):
    """Two molecules, of which the first counts, with the sections and columns of the format as it is written elsewhere."""
    text = "# made by hand\n@<TRIPOS>MOLECULE\nethanol\n 3 2 1 0 0\nSMALL\nUSER_CHARGES\n\n@<TRIPOS>ATOM\n      1 C1         -0.0010    1.0300    2.5000 C.3     1  LIG        -0.1040\n      2 C2          1.5000    0.0000    0.0000 C.3     1  LIG         0.1450\n      3 O1          2.1000    1.2000   -0.7000 O.3     2  lig2       -0.6830\n@<TRIPOS>BOND\n     1     2     1    1\n     2     3     2    1\n@<TRIPOS>MOLECULE\nother\n 1 0\n@<TRIPOS>ATOM\n 1 N 0 0 0 N.3\n"
    (tmp_path / "a.mol2").write_text(text)
    data = formats.load(spark, f"{tmp_path}/a.mol2")
    atoms = data.atoms.orderBy("idx").collect()
    assert [(r["name"], r["element"], r["residue_id"], r["resname"], r["charge"]) for r in atoms] == [("C1", "C", 1, "LIG", -0.104), ("C2", "C", 1, "LIG", 0.145), ("O1", "O", 2, "LIG2", -0.683)]
    assert [tuple(r)[1:] for r in data.bonds.orderBy("i").collect()] == [(0, 1), (1, 2)] and data.positions.where("idx = 0").first()["z"] == 2.5
