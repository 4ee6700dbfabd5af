"""Binary trajectories, held against files that the tests write byte by byte."""

import struct
from functools import partial

import numpy as np
import pytest

from corpuscle.sources import binary, formats

XYZ = np.random.default_rng(4).uniform(-20, 20, (3, 5, 3)).astype(np.float32)


def dcd(order="<", cell=True, free=None):
    rec = lambda b: struct.pack(f"{order}i", len(b)) + b + struct.pack(f"{order}i", len(b))
    control = [0] * 20
    control[0], control[8], control[10] = 3, 5 - len(free) if free else 0, int(cell)
    out = rec(b"CORD" + struct.pack(f"{order}20i", *control)) + rec(struct.pack(f"{order}i", 1) + b"t" * 80) + rec(struct.pack(f"{order}i", 5))
    out += rec(struct.pack(f"{order}{len(free)}i", *(k + 1 for k in free))) if free else b""
    for f, points in enumerate(XYZ):
        out += rec(struct.pack(f"{order}6d", 10, 90, 11, 90, 90, 12)) if cell else b""
        rows = points if f == 0 or not free else points[free]
        out += b"".join(rec(rows[:, k].astype(f"{order}f4").tobytes()) for k in range(3))
    return out


def trr(real=4, velocities=True):
    out = b""
    for step, points in enumerate(XYZ):
        body = points.astype(f">f{real}") / 10
        v = 15 * real if velocities else 0
        out += struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", 0, 0, 9 * real, 0, 0, 0, 0, 15 * real, v, 0, 5, step, 0)
        out += np.array([step, 0], f">f{real}").tobytes() + (np.eye(3) * [1, 2, 3]).astype(f">f{real}").tobytes() + body.astype(f">f{real}").tobytes() + b"\1" * v
    return out


def netcdf(version=1, records=3):
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">2i", 10, 4) + b"".join(name(n) + struct.pack(">i", k) for n, k in (("frame", 0), ("atom", 5), ("spatial", 3), ("cell", 3)))
    note = struct.pack(">2i", 12, 1) + name("title") + struct.pack(">2i", 2, 5) + b"hello\0\0\0"
    wide = ">q" if version == 2 else ">i"

    def variables(base):
        return struct.pack(">2i", 11, 2) + name("coordinates") + struct.pack(">4i", 3, 0, 1, 2) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 5, 60) + struct.pack(wide, base) + name("cell_lengths") + struct.pack(">3i", 2, 0, 3) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 6, 24) + struct.pack(wide, base + 60)

    head = b"CDF" + bytes([version]) + struct.pack(">i", records) + dims + note
    data = b"".join(p.astype(">f4").tobytes() + np.array([7, 8, 9], ">f8").tobytes() for p in XYZ)
    return head + variables(len(head) + len(variables(0))) + data


@pytest.mark.parametrize("data", [dcd(), dcd(">", False), trr(), trr(8, False), netcdf(), netcdf(2, -1)], ids=["dcd", "dcd big", "trr", "trr double", "cdf1", "cdf2"])
def test_frames_come_back(data):
    parser = binary.parse_dcd if data[4:8] == b"CORD" else binary.parse_netcdf if data[:3] == b"CDF" else binary.parse_trr
    found = parser(data)
    assert [k for k, _ in found.frames] == [0, 1, 2] and len(found.atoms) == 5
    assert np.allclose(np.stack([x for _, x in found.frames]), XYZ, atol=1e-5)
    assert np.allclose(np.stack([x for _, x in parser(data[:-30]).frames]), XYZ[:2], atol=1e-5)  # cut short
    assert found.box in ((10, 11, 12), (10, 20, 30), (7, 8, 9), None)


def test_fixed_atoms_and_errors():
    found = binary.parse_dcd(dcd(free=[1, 3]))
    want = np.stack([XYZ[0]] * 3)
    want[:, [1, 3]] = XYZ[:, [1, 3]]
    assert np.allclose(np.stack([x for _, x in found.frames]), want)
    for parser in (binary.parse_dcd, binary.parse_trr, binary.parse_netcdf):
        for bad in (b"", b"nothing at all here"):
            with pytest.raises(formats.FormatError):
                parser(bad)


def test_amber_text():
    column = lambda v, w, d, n: "\n".join("".join(f"{x:{w}.{d}f}" for x in v[k : k + n]) for k in range(0, len(v), n))
    rst = "title\n    5  1.0\n" + column(XYZ[0].ravel(), 12, 7, 6) + "\n"
    box = "".join(f"{x:12.7f}" for x in (30, 31, 32, 90, 90, 90)) + "\n"
    for text, want in ((rst, None), (rst + box, (30, 31, 32)), (rst + column(XYZ[1].ravel(), 12, 7, 6) + "\n" + box, (30, 31, 32)), (rst + column(XYZ[1].ravel(), 12, 7, 6) + "\n", None)):
        found = binary.parse_restart(text.encode())
        assert np.allclose(found.frames[0][1], XYZ[0], atol=1e-6) and found.box == want
    for extra, want in (("", None), ("  30.000  31.000  32.000\n", (30, 31, 32))):
        text = "title\n" + "".join(column(p.ravel(), 8, 3, 10) + "\n" + extra for p in XYZ)
        found = binary.parse_mdcrd(text.encode(), 5)
        assert np.allclose(np.stack([x for _, x in found.frames]), XYZ, atol=1e-3) and found.box == want
    with pytest.raises(formats.FormatError, match="Bad coordinate"):
        binary.parse_mdcrd(b"title\n   x.000   1.000   2.000\n", 1)


def test_load_with_topology(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(2):
        (tmp_path / "t" / f"{k}.dcd").write_bytes(dcd())
    two = formats.load(spark, f"{tmp_path}/t/*.dcd", binary.parse_dcd)
    assert two.positions.count() == 30 and two.box.count() == 2
    (tmp_path / "p.xyz").write_text("5\n0\n" + "".join(f"C {k} 0 0\n" for k in range(5)))
    (tmp_path / "m.mdcrd").write_text("t\n" + "".join(f"{x:8.3f}" for x in XYZ[0].ravel()[:10]) + "\n" + "".join(f"{x:8.3f}" for x in XYZ[0].ravel()[10:]) + "\n")
    top = formats.load(spark, f"{tmp_path}/p.xyz")
    for name, parser, n in (("t/0.dcd", None, 15), ("m.mdcrd", partial(binary.parse_mdcrd, n_atoms=5), 5)):
        rows = top.with_trajectory(formats.load(spark, f"{tmp_path}/{name}", parser)).system()
        assert rows.where("element = 'C'").count() == n
    with pytest.raises(formats.FormatError, match="Unsupported"):
        formats.detect("a.xtc")
