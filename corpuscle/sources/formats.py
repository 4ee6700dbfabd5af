"""Structure and trajectory files as DataFrames.

Trajectories of any length and SDF files are split and read lazily by corpuscle.sources.datasource. For all other formats a
parser turns one file into atoms, frames, bonds and a box on the executors, so a folder of files is read in parallel. What is
parsed is written once, and all tables come from there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.model import ATOMIC_NUMBER
from corpuscle.sources.store import materialize

ATOM_FIELDS = ("idx", "id", "type_id", "element", "charge", "mass", "residue_id", "chain_id", "name", "resname")
ATOM_TYPES = dict(zip(ATOM_FIELDS, ("bigint", "bigint", "int", "string", "double", "double", "int", "string", "string", "string"), strict=True))
BOND_SCHEMA = "path string, i bigint, j bigint"


class FormatError(ValueError):
    """The file isn't what its name or content says."""


@dataclass
class Structure:
    atoms: list[dict] = field(default_factory=list)
    frames: list[tuple[int, list[tuple[float, float, float]]]] = field(default_factory=list)
    bonds: list[tuple[int, int]] = field(default_factory=list)
    box: tuple[float, float, float] | None = None

    def add(self, **values: object) -> None:
        self.atoms.append({"idx": len(self.atoms), "id": len(self.atoms)} | values)


def _number(element: str | None) -> int:
    return ATOMIC_NUMBER.get((element or "").upper(), 0)


def element_of(name: str) -> str:
    """The element that an atom name stands for: without leading digits, two letters if they name one, else the first."""
    bare = name.strip().lstrip("0123456789").upper()
    if not bare:
        return "C"
    # names of protein atoms such as CA and CD start with carbon, not calcium or cadmium
    if len(bare) >= 2 and bare[:2] in ATOMIC_NUMBER and bare[:2] not in ("CA", "NA"):
        return bare[:2]
    return bare[0] if bare[0] in ATOMIC_NUMBER else "C"


def parse_xyz(text: str, compat_lattice: bool = False) -> Structure:
    """Blocks of count, comment and rows; the lattice diagonal is the box (compat_lattice: its first row)."""
    lines, out, at = text.splitlines(), Structure(), 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        try:
            n = int(lines[at])
        except ValueError:
            raise FormatError(f"no atom count: {lines[at]!r}") from None
        if out.frames and n != len(out.atoms):
            raise FormatError("the atom count changes")
        comment, rows = lines[at + 1] if at + 1 < len(lines) else "", lines[at + 2 : at + 2 + n]
        points = []
        for row in rows:
            parts = row.split()
            try:
                points.append(tuple(float(v) for v in parts[1:4]))
            except ValueError:
                raise FormatError(f"Bad coordinate: {row!r}") from None
            if not out.frames:
                e = re.sub(r"\d+$", "", parts[0])
                out.add(element=e.upper(), type_id=_number(e))
        if len(points) < n:
            raise FormatError("the last frame is cut short")
        step = re.fullmatch(r"\s*(\d+)\s*", comment) or re.search(r"(?:step|time|frame|i)\s*[=:]\s*(\d+)", comment, re.I)
        if (cell := re.search(r'Lattice="([^"]*)"', comment)) and len(v := cell[1].split()) == 9:
            out.box = tuple(float(v[k]) for k in ((0, 3, 6) if compat_lattice else (0, 4, 8)))
        out.frames.append((int(step[1]) if step else len(out.frames), points))
        at += 2 + n
    if not out.frames:
        raise FormatError("No frames")
    return out


def pdb_resname(line: str) -> str | None:
    """The residue name of a record: three columns, and the one before the chain where names of four letters are written."""
    return line[17:21].strip().upper() or None


def parse_pdb(text: str) -> Structure:
    """ATOM and HETATM records in fixed columns; each MODEL is a frame, filled with zeros or cut to the atoms of the first."""
    out, points = Structure(), []

    def close() -> None:
        if points:
            n = len(out.atoms)
            out.frames.append((len(out.frames), (points + [(0.0, 0.0, 0.0)] * n)[:n]))
            points.clear()

    for line in text.splitlines():
        kind = line[:6].strip()
        if kind in ("ATOM", "HETATM"):
            if line[16:17] not in (" ", "", "A", "1"):
                continue  # another place of the same atom
            points.append(tuple(float(line[a : a + 8]) for a in (30, 38, 46)))
            if not out.frames:
                name = line[12:16].strip()
                e = (line[76:78].strip() or element_of(name)).upper()
                number = line[22:26].strip()
                out.add(element=e, type_id=_number(e), name=name, resname=pdb_resname(line), chain_id=line[21:22].strip() or None, residue_id=int(number) if number else None)
        elif kind in ("MODEL", "ENDMDL"):
            close()
        elif kind == "CRYST1":
            out.box = tuple(float(line[a : a + 9]) for a in (6, 15, 24))
    close()
    if not out.frames:
        raise FormatError("no ATOM records")
    return out


def parse_gro(text: str) -> Structure:
    """One frame in nanometres, returned in Angstrom. Residue numbers beyond 99999 are told by the title, as gro_frames() writes it."""
    lines, out = text.splitlines(), Structure()
    n = int(lines[1])
    points, lack, at = [], 0, {}
    if note := re.search(r"^system, add to residues:((?: \d+:-?\d+)+)$", lines[0]):
        at = {int(k): int(v) for k, v in (p.split(":") for p in note[1].split())}
    for k, row in enumerate(lines[2 : 2 + n]):
        lack = at.get(k, lack)
        name = row[10:15].strip()
        e = element_of(name)
        out.add(residue_id=int(row[:5]) + lack, resname=row[5:10].strip().upper() or None, name=name, element=e, type_id=_number(e))
        points.append(tuple(10 * float(row[a : a + 8]) for a in (20, 28, 36)))
    sides = [10 * float(v) for v in lines[2 + n].split()[:3]] if len(lines) > 2 + n else []
    out.box = tuple(sides) if len(sides) == 3 and all(s > 0 for s in sides) else None
    out.frames.append((0, points))
    return out


def parse_lammps_data(text: str) -> Structure:
    """Sections Atoms (styles atomic, charge, bond, molecular, full) and Bonds; ids start at the first one's 0 or 1."""
    out, section, rows, style = Structure(), None, {"Atoms": [], "Bonds": [], "Masses": []}, None
    bounds: dict[str, float] = {}
    for raw in text.splitlines()[1:]:
        line, _, comment = raw.partition("#")
        parts = line.split()
        if not parts:
            continue
        if m := re.fullmatch(r"(\S+) (\S+) ([xyz])lo [xyz]hi", " ".join(parts)):
            bounds[m[3]] = float(m[2]) - float(m[1])
        elif parts[0][0].isalpha():
            section, style = parts[0], comment.strip() or style if parts[0] == "Atoms" else style
        elif section in rows:
            rows[section].append(parts)
    if not rows["Atoms"]:
        raise FormatError("no atoms")
    shape = {"atomic": (None, 1, None, 2), "charge": (None, 1, 2, 3), "bond": (1, 2, None, 3), "molecular": (1, 2, None, 3), "full": (1, 2, 3, 4)}
    mol, kind, charge, first = shape.get(style or "", shape["full" if len(rows["Atoms"][0]) >= 7 else "bond" if len(rows["Atoms"][0]) == 6 else "atomic"])
    offset = 0 if int(rows["Atoms"][0][0]) == 0 else 1
    mass = {int(r[0]): float(r[1]) for r in rows["Masses"]}
    points, at = [], {}
    for r in rows["Atoms"]:
        try:
            p = tuple(float(v) for v in r[first : first + 3])
            ident, number = int(r[0]) - offset, int(r[kind])
        except (ValueError, IndexError):
            continue
        at[ident] = len(out.atoms)
        out.add(id=ident, type_id=number - offset, mass=mass.get(number), charge=float(r[charge]) if charge else None, residue_id=int(r[mol]) if mol else None)
        points.append(p)
    out.frames.append((0, points))
    pairs = [sorted((int(r[2]) - offset, int(r[3]) - offset)) for r in rows["Bonds"]]
    out.bonds = [(at[a], at[b]) for a, b in pairs if a in at and b in at]
    out.box = tuple(bounds[c] for c in "xyz") if len(bounds) == 3 else None
    return out


def parse_lammps_frame(text: str, with_atoms: bool = True) -> Structure:
    """One frame of a dump, after its ITEM: TIMESTEP; coordinates are x, else xu, else xs as they stand.

    Atoms are numbered by their rows. A row that can't be read keeps its place, at the origin, but is no atom.
    """
    out, lines = Structure(), text.splitlines()
    step = int(lines[1] if not lines[0].strip() else lines[0])
    start = next((k for k, x in enumerate(lines) if x.startswith("ITEM: ATOMS")), None)
    if start is None:
        raise FormatError("a frame without atoms")
    if (b := next((k for k, x in enumerate(lines) if x.startswith("ITEM: BOX BOUNDS")), None)) is not None:
        out.box = tuple(float(p[1]) - float(p[0]) for p in (lines[b + k].split() for k in (1, 2, 3)))
    names = lines[start].split()[2:]
    try:
        xyz = [next(names.index(c + s) for s in ("", "u", "s") if c + s in names) for c in "xyz"]
    except StopIteration:
        raise FormatError("a frame without coordinates") from None
    points = []
    for row in lines[start + 1 :]:
        parts = row.split()
        if not parts:
            continue
        try:
            if len(parts) < len(names):
                raise ValueError(row)
            point = tuple(float(parts[k]) for k in xyz)
            if with_atoms:
                value = dict(zip(names, parts, strict=False))
                out.add(idx=len(points), id=int(value["id"]) - 1 if "id" in value else len(points), type_id=int(value["type"]) if "type" in value else None, residue_id=int(value["mol"]) if "mol" in value else None)
            points.append(point)
        except ValueError:
            points.append((0.0, 0.0, 0.0))
    out.frames.append((step, points))
    return out


def parse_mmcif(text: str) -> Structure:
    """The first block's _atom_site loop, first alternative places, first row of each id; models are frames."""
    out, lines = Structure(), text.splitlines()
    cell = {m[1]: float(m[2]) for m in re.finditer(r"^_cell\.length_([abc])\s+([\d.]+)", text, re.M)}
    out.box = tuple(cell[c] for c in "abc") if len(cell) == 3 else None
    start = next((k for k, x in enumerate(lines) if x.strip().startswith("_atom_site.")), None)
    if start is None:
        raise FormatError("no _atom_site loop")
    names = []
    while lines[start].strip().startswith("_atom_site."):
        names.append(lines[start].strip().split(".", 1)[1])
        start += 1
    models: dict[str, list] = {}
    seen: set[tuple[str, int]] = set()
    for row in lines[start:]:
        if row.startswith(("#", "loop_", "_", "data_")) or not row.strip():
            break
        v = dict(zip(names, (a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", row)), strict=False))
        get = lambda k, v=v: None if v.get(k) in (None, ".", "?", "") else v[k]
        if v.get("label_alt_id", ".") not in ("", ".", "A", "?"):
            continue
        number = v.get("pdbx_PDB_model_num", "1")
        if (number, int(v["id"])) in seen:
            continue
        seen.add((number, int(v["id"])))
        model = models.setdefault(number, [])
        if len(models) == 1:
            e = (get("type_symbol") or "").upper()
            out.add(id=int(v["id"]), element=e or None, type_id=_number(e), name=get("label_atom_id"), resname=(get("label_comp_id") or "").upper() or None, chain_id=get("label_asym_id"), residue_id=int(get("label_seq_id") or 0))
        model.append(tuple(float(v[f"Cartn_{c}"]) for c in "xyz"))
    out.frames = [(k, p) for k, p in enumerate(models.values()) if len(p) == len(out.atoms)]
    if not out.frames:
        raise FormatError("no atoms")
    return out


def parse_sdf(text: str) -> Structure:
    """V2000 records as frames, where their atom counts agree; bonds of the first."""
    out = Structure()
    for record in text.split("$$$$"):
        lines = record.lstrip("\r\n").splitlines() if out.frames else record.splitlines()
        counts = next((k for k, x in enumerate(lines[:6]) if "V2000" in x), None)
        if counts is None:
            continue
        n, bonds = int(lines[counts][:3]), int(lines[counts][3:6])
        rows = [x.split() for x in lines[counts + 1 : counts + 1 + n]]
        if out.frames and n != len(out.atoms):
            continue
        if not out.frames:
            for r in rows:
                out.add(element=r[3].upper(), type_id=_number(r[3]))
            out.bonds = [tuple(sorted((int(x[:3]) - 1, int(x[3:6]) - 1))) for x in lines[counts + 1 + n : counts + 1 + n + bonds]]
        out.frames.append((len(out.frames), [tuple(float(v) for v in r[:3]) for r in rows]))
    if not out.frames:
        raise FormatError("no V2000 record")
    return out


def sdf_counts(record: str) -> tuple[int, int, int] | None:
    """The counts line's place in a V2000 record, and its numbers of atoms and bonds."""
    rows = record.splitlines()[:7]
    at = next((k for k, x in enumerate(rows) if "V2000" in x), None)
    return None if at is None else (at, int(rows[at][:3]), int(rows[at][3:6]))


def sdf_molecule(record: str) -> tuple[str, list[dict], list[dict]] | None:
    """Name, atoms (idx, element, charge, x, y, z) and bonds (i, j, order) of a V2000 record; None for another version."""
    if (counts := sdf_counts(record)) is None:
        return None
    at, n, bonds = counts
    rows = record.splitlines()
    atoms = []
    for k, row in enumerate(rows[at + 1 : at + 1 + n]):
        p = row.split()
        atoms.append({"idx": k, "element": p[3].upper(), "charge": {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}.get(int(p[5]), 0) if len(p) > 5 and p[5].isdigit() else 0, "x": float(p[0]), "y": float(p[1]), "z": float(p[2])})
    found = [{"i": int(x[:3]) - 1, "j": int(x[3:6]) - 1, "order": int(x[6:9])} for x in rows[at + 1 + n : at + 1 + n + bonds]]
    for row in rows[at + 1 + n + bonds :]:
        if row.startswith("M  CHG"):
            p = list(map(int, row[6:].split()))
            for a, c in zip(p[1::2], p[2::2], strict=False):
                atoms[a - 1]["charge"] = c
    return rows[0].strip() if at else "", atoms, found


def parse_mol2(text: str) -> Structure:
    """Sections ATOM and BOND of the first molecule."""
    out, section, points = Structure(), "", []
    for line in text.splitlines():
        if line.startswith("@<TRIPOS>"):
            if line.strip() == "@<TRIPOS>MOLECULE" and points:
                break
            section = line.strip()[9:]
        elif section == "ATOM" and len(p := line.split()) >= 6:
            e = p[5].split(".")[0].upper()
            out.add(element=e, type_id=_number(e), name=p[1], residue_id=int(p[6]) if len(p) > 6 else None, resname=p[7].upper() if len(p) > 7 else None, charge=float(p[8]) if len(p) > 8 else None)
            points.append(tuple(float(v) for v in p[2:5]))
        elif section == "BOND" and len(p := line.split()) >= 4:
            out.bonds.append(tuple(sorted((int(p[1]) - 1, int(p[2]) - 1))))
    if not points:
        raise FormatError("no atoms")
    out.frames.append((0, points))
    return out


PARSERS: dict[str, Callable[[str], Structure]] = {
    ".xyz": parse_xyz, ".pdb": parse_pdb, ".gro": parse_gro, ".cif": parse_mmcif, ".mmcif": parse_mmcif, ".sdf": parse_sdf, ".mol": parse_sdf, ".mol2": parse_mol2,
    ".data": parse_lammps_data, ".lammps": parse_lammps_data, ".lammpstrj": parse_lammps_frame, ".traj": parse_lammps_frame,
}
#: Formats whose parsers take bytes, by the name of the parser in corpuscle.sources.binary.
BINARY = {".dcd": "parse_dcd", ".trr": "parse_trr", ".nc": "parse_netcdf", ".ncdf": "parse_netcdf", ".rst7": "parse_restart", ".rst": "parse_restart", ".restrt": "parse_restart"}
#: Formats that aren't read without more: with a parser that knows the atom count.
UNREAD = {".mdcrd": "pass parser=partial(parse_mdcrd, n_atoms=...)", ".crd": "pass parser=partial(parse_mdcrd, n_atoms=...)"}


def suffix_of(path: str) -> str:
    found = re.search(r"\.[^./]+$", path.lower())
    return found[0] if found else ""


def detect(path: str) -> Callable:
    suffix = suffix_of(path)
    if suffix in BINARY:
        from corpuscle.sources import binary

        return getattr(binary, BINARY[suffix])
    if suffix not in PARSERS:
        raise FormatError(f"Unsupported file format: {path}" + (f" ({UNREAD[suffix]})" if suffix in UNREAD else ""))
    return PARSERS[suffix]


def takes_bytes(parser: Callable) -> bool:
    return getattr(parser, "func", parser).__module__ == "corpuscle.sources.binary"


@dataclass
class Dataset:
    """The tables of one or more files, keyed by path."""

    atoms: DataFrame
    positions: DataFrame
    bonds: DataFrame
    box: DataFrame

    def system(self) -> DataFrame:
        return self.positions.join(self.atoms, ["path", "idx"])

    def with_trajectory(self, other: Dataset) -> Dataset:
        """Atoms and bonds of this topology, frames and box of other; they join by ordinal.

        One topology serves all trajectories of other; of several, each serves the trajectories of its name without folder and ending.
        The result's systems are the trajectories, whose frames keep their numbers.
        """
        stem = lambda c: F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r"\.[^.]*$", "")
        names = self.atoms.select("path").distinct()
        one = names.limit(2).count() < 2
        runs = other.atoms.select("path").distinct()
        if one:
            pairs = names.select(F.col("path").alias("_top")).crossJoin(F.broadcast(runs))  # of one row
        else:
            pairs = names.select(F.col("path").alias("_top"), stem("path").alias("_stem")).join(runs.withColumn("_stem", stem("path")), "_stem").drop("_stem")
        served = lambda df: df.withColumnRenamed("path", "_top").join(pairs, "_top").drop("_top")
        box = other.box.withColumn("_k", F.lit(0)).unionByName(served(self.box).withColumn("_k", F.lit(1)))
        box = box.groupBy("path").agg(*(F.min_by(c, "_k").alias(c) for c in ("lx", "ly", "lz")))
        return Dataset(served(self.atoms).select("path", *ATOM_FIELDS), other.positions, served(self.bonds).select("path", "i", "j"), box)


_BOND = pa.struct([("i", pa.int64()), ("j", pa.int64())])
_KINDS = {"idx": pa.int64(), "id": pa.int64(), "type_id": pa.int32(), "element": pa.string(), "charge": pa.float64(), "mass": pa.float64(), "residue_id": pa.int32(), "chain_id": pa.string(), "name": pa.string(), "resname": pa.string()}
_PARSED = pa.schema([("path", pa.string()), ("frame", pa.int32()), ("timestep", pa.int64()), ("coords", pa.list_(pa.float64())), ("atoms", pa.list_(pa.struct(list(_KINDS.items())))), ("bonds", pa.list_(_BOND)), ("box", pa.list_(pa.float64()))])


def _parse(batches: Iterator[pa.RecordBatch], parser: Callable) -> Iterator[pa.RecordBatch]:
    """A row for each frame; the file's atoms and bonds stand in that of the first."""
    for batch in batches:
        for path, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = parser(value)
            for k, (step, points) in enumerate(s.frames):
                head = k == 0
                atoms = [{f: a.get(f) for f in ATOM_FIELDS} for a in s.atoms] if head else None
                bonds = [{"i": i, "j": j} for i, j in s.bonds] if head else None
                row = [path, k, step, np.asarray(points, float).ravel(), atoms, bonds, s.box if head else None]
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _PARSED, strict=True)], schema=_PARSED)


def is_data_file(head: list[str]) -> bool:
    """Whether the first lines are those of a LAMMPS data file and not of a dump."""
    for line in (x.strip().lower() for x in head):
        if line.startswith("item:"):
            return False
        if "lammps description" in line or re.search(r"\b(atoms|bonds|atom types|bond types)$", line):
            return True
    return False


def load(spark: SparkSession, path: str, parser: Callable[[str], Structure] | None = None, suffix: str | None = None, split: int = 64 << 20, frames: tuple[int, int] | None = None, check: bool = True) -> Dataset:
    """Reads a file, a folder or a pattern of files of one format, which its ending tells, or else suffix.

    Trajectories, PDB and SDF files are read in ranges of `split` bytes by corpuscle.sources.datasource, lazily; frames (the first, and one beyond
    the last) leaves the ranges of others unread, and check=False puts off the errors of text until it is read. A parser, and the other formats,
    take whole files, which are parsed once; that is written, and all tables come from there.
    """
    ending = (suffix or suffix_of(path)).lower()
    if parser is None:
        from corpuscle.sources import datasource, ranges

        if ending in (".data", ".lammps", ".lammpstrj", ".traj"):
            ending = ".data" if is_data_file([r["value"] for r in spark.read.text(path).limit(20).collect()]) else ".lammpstrj"
        if ending in ranges.TEXT or ending in ranges.BINARY:
            return datasource.read_files(spark, path, ending, split, frames, check)
    parser = parser or detect(ending)
    if takes_bytes(parser):
        files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("value"))
    else:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    kinds = ", ".join(f"{f}: {ATOM_TYPES[f]}" for f in ATOM_FIELDS)
    schema = f"path string, frame int, timestep bigint, coords array<double>, atoms array<struct<{kinds}>>, bonds array<struct<i: bigint, j: bigint>>, box array<double>"
    parsed = materialize(files.mapInArrow(partial(_parse, parser=parser), schema), "parsed")
    point = F.expr("transform(sequence(0, size(coords) div 3 - 1), k -> struct(cast(k as bigint) as idx, coords[3 * k] as x, coords[3 * k + 1] as y, coords[3 * k + 2] as z))")
    positions = parsed.where(F.size("coords") > 0).select("path", "frame", "timestep", F.inline(point))
    atoms = parsed.select("path", F.inline("atoms"))
    bonds = parsed.select("path", F.inline("bonds"))
    box = parsed.where("box is not null").groupBy("path").agg(F.max_by("box", "frame").alias("box")).select("path", *(F.col("box")[k].alias(c) for k, c in enumerate(("lx", "ly", "lz"))))
    return Dataset(atoms, positions, bonds, box)
