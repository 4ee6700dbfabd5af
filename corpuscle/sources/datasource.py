"""The data source `particles`: structure and trajectory files read in byte ranges, lazily.

    spark.dataSource.register(ParticleSource)
    spark.read.format("particles").option("frames", "100:200").load("run/*.dcd")

A partition is a range of a file (option splitBytes). Binary trajectories are planned from their headers. Text is planned from
marks, a few numbers for each range that mark_ranges() gathers in one distributed pass; without marks a text file is one
partition. Ranges without any of the frames that are asked for aren't read. Nothing of the files is written anywhere.

Frames are asked for by the option and not by pushed filters: Spark 4.1 keeps the filters that a Python data source once
accepted with the relation, so another query over the same DataFrame would lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuscle.sources import formats, ranges
from corpuscle.sources.formats import FormatError
from corpuscle.sources.store import materialize

SPLIT = 64 << 20
#: Ranges of a table's files from which on they grow with the input, up to SPLIT, and not in number: each costs planning and a task.
MOST = 512
ATOM_COLUMNS = ", ".join(f"{c} {k}" for c, k in formats.ATOM_TYPES.items())
SCHEMAS = {
    "positions": "path string, frame int, timestep bigint, idx bigint, x double, y double, z double",
    "atoms": f"path string, {ATOM_COLUMNS}",
    "bonds": "path string, i bigint, j bigint",
    "box": "path string, lx double, ly double, lz double",
    "molecules": "path string, mol bigint, name string, atoms array<struct<idx: int, element: string, charge: int, x: double, y: double, z: double>>, bonds array<struct<i: int, j: int, order: int>>",
    "marks": "path string, begin bigint, end bigint, size bigint, summary string",
    "errors": "error string",
}
_ARROW = {
    "positions": pa.schema([("path", pa.string()), ("frame", pa.int32()), ("timestep", pa.int64()), ("idx", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]),
    "atoms": pa.schema([("path", pa.string()), *formats._KINDS.items()]),
    "bonds": pa.schema([("path", pa.string()), ("i", pa.int64()), ("j", pa.int64())]),
    "box": pa.schema([("path", pa.string()), ("lx", pa.float64()), ("ly", pa.float64()), ("lz", pa.float64())]),
    "molecules": pa.schema([("path", pa.string()), ("mol", pa.int64()), ("name", pa.string()), ("atoms", pa.list_(pa.struct([("idx", pa.int32()), ("element", pa.string()), ("charge", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))), ("bonds", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("order", pa.int32())])))]),
    "marks": pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("size", pa.int64()), ("summary", pa.string())]),
    "errors": pa.schema([("error", pa.string())]),
}


class Part(InputPartition):
    def __init__(self, part: ranges.Range, size: int, box: tuple | None = None, n: int | None = None):
        self.part, self.size, self.box, self.n = part, size, box, n


def _several(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """rows in lists, each ended by the row with which its sizes reach a batch's, so that small frames and molecules share one."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= ranges.ROWS:
            yield held
            held, n = [], 0
    if held:
        yield held


class ParticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path = options.get("table", "positions"), options["path"]
        self.suffix = options.get("suffix") or formats.suffix_of(self.path)
        self.step, self.marks = int(options.get("splitbytes", SPLIT)), options.get("marks")
        low, _, beyond = options.get("frames", "").partition(":")
        self.frames = int(low or 0), int(beyond) if beyond else 1 << 62
        if self.suffix not in ranges.TEXT and self.suffix not in ranges.BINARY:
            raise FormatError(f"Unsupported file format: {self.path}")

    def _keep(self) -> Callable[[int], bool]:
        low, beyond = self.frames
        return lambda frame: low <= frame < beyond

    def _step(self, files: list[tuple[str, int]]) -> int:
        """Bytes of a range: splitBytes, or more where that would make too many tasks."""
        return max(self.step, min(SPLIT, -(-sum(size for _, size in files) // MOST)))

    def partitions(self) -> list[Part]:
        if self.suffix in ranges.BINARY:
            out, files = [], list(ranges.list_files(self.path))
            for path, size in files:
                with ranges.open_file(path) as f:
                    parts, n, box = ranges.BINARY[self.suffix].plan(f, size, path, self._step(files))
                out += [Part(p, size, box, n) for p in (parts if self.table == "positions" else parts[:1])]
        elif self.table == "marks":
            # an empty file has a range too
            files = list(ranges.list_files(self.path))
            step = self._step(files)
            out = [Part(ranges.Range(path, b, min(size, b + step), 0, 0), size) for path, size in files for b in range(0, max(1, size), step)]
        else:
            out = self._text_parts()
        if self.table == "positions":
            out = [p for p in out if p.part.first < self.frames[1] and p.part.beyond > self.frames[0]]
        elif self.table in ("atoms", "bonds"):
            out = [p for p in out if p.part.first == 0 and (p.part.beyond > 0 or self.suffix in ranges.BINARY)]
        elif self.table == "box":
            out = [p for p in out if p.box and p.part.begin == 0 or self.suffix in ranges.BINARY]
        return out or [Part(ranges.Range("", 0, 0, 0, 0), -1)]

    def _text_parts(self) -> list[Part]:
        kind = ranges.TEXT[self.suffix]
        if self.marks:
            files, at = pafs.FileSystem.from_uri(ranges.local(self.marks))
            rows = pads.dataset(at, filesystem=files, format="parquet").to_table().to_pylist()
        else:
            rows = []
            for path, size in ranges.list_files(self.path):
                with ranges.open_file(path) as f:
                    rows.append({"path": path, "begin": 0, "end": size, "size": size, "summary": json.dumps(kind.summary(f, size, 0, max(1, size)))})
        by_path: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["path"], r["begin"])):
            by_path.setdefault(r["path"], []).append(r)
        out = []
        for path, own in by_path.items():
            parts, box = kind.fold(path, [(r["begin"], r["end"], json.loads(r["summary"])) for r in own])
            box = (tuple(box) if len(box) == 3 else tuple(box[k] for k in (0, 4, 8))) if box else None
            out += [Part(p, own[0]["size"], box) for p in parts]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        part, size = partition.part, partition.size
        if size < 0:
            return
        schema, path = _ARROW[self.table], part.path
        batch = lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema)
        if self.table == "box":
            if partition.box:
                yield batch([dict(zip(("path", "lx", "ly", "lz"), (path, *partition.box), strict=True))])
            return
        if self.suffix in ranges.BINARY and self.table == "atoms":
            for k in range(0, partition.n, ranges.ROWS):
                yield batch([{"path": path, "idx": i, "id": i} for i in range(k, min(partition.n, k + ranges.ROWS))])
            return
        kind = ranges.TEXT.get(self.suffix) or ranges.BINARY[self.suffix]
        with ranges.open_file(path) as file:
            if self.table == "marks":
                yield batch([{"path": path, "begin": part.begin, "end": part.end, "size": size, "summary": json.dumps(kind.summary(file, size, part.begin, max(part.end, 1)))}])
            elif self.table == "errors":
                try:
                    for _ in kind.points(file, size, part, lambda k: True):
                        pass
                except FormatError as e:
                    yield batch([{"error": str(e)}])
            elif self.table == "positions":
                for frames in _several(kind.points(file, size, part, self._keep()), lambda p: len(p[2])):
                    yield self._points(path, frames)
            elif self.table == "atoms":
                rows = []
                for a in kind.atoms(file, size, part):
                    rows.append({"path": path} | {c: a.get(c) for c in formats.ATOM_FIELDS})
                    if len(rows) == ranges.ROWS:
                        yield batch(rows)
                        rows = []
                yield batch(rows)
            elif self.table == "bonds":
                yield batch([{"path": path, "i": i, "j": j} for i, j in kind.bonds(file, size, part)])
            elif self.table == "molecules":
                for rows in _several(kind.molecules(file, size, part), lambda r: 1 + len(r[2])):
                    yield batch([{"path": path, "mol": mol, "name": name, "atoms": atoms, "bonds": bonds} for mol, name, atoms, bonds in rows])

    @staticmethod
    def _points(path: str, frames: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(f[2]) for f in frames]
        number, step = (np.repeat(np.array([f[k] for f in frames], kind), sizes) for k, kind in ((0, np.int32), (1, np.int64)))
        idx, xyz = (np.concatenate([f[k] for f in frames]) for k in (2, 3))
        columns = [pa.array([path] * sum(sizes), pa.string()), pa.array(number), pa.array(step), pa.array(idx), *(pa.array(np.ascontiguousarray(xyz[:, k], float)) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW["positions"])


class ParticleSource(DataSource):
    """Options: path; table (positions, atoms, bonds, box or molecules); suffix, where the path doesn't tell the format; splitBytes; marks; frames, as first:beyond."""

    @classmethod
    def name(cls) -> str:
        return "particles"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "positions")]

    def reader(self, schema) -> ParticleReader:
        return ParticleReader({k.lower(): v for k, v in self.options.items()})


def _read(spark: SparkSession, table: str, path: str, suffix: str, split: int, marks: str | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    spark.dataSource.register(ParticleSource)
    reader = spark.read.format("particles").option("table", table).option("suffix", suffix).option("splitBytes", split)
    for name, value in (("marks", marks), ("frames", frames and f"{frames[0]}:{frames[1]}")):
        reader = reader.option(name, value) if value else reader
    return reader.load(path)


def mark_ranges(spark: SparkSession, path: str, suffix: str, split: int = SPLIT) -> str:
    """Where the marks of text files are written: a row of a few numbers for each range."""
    return materialize(_read(spark, "marks", path, suffix, split), "marks").written_at


def read_files(spark: SparkSession, path: str, suffix: str, split: int = SPLIT, frames: tuple[int, int] | None = None, check: bool = True) -> formats.Dataset:
    """The tables of the files. frames: the first that is read, and one beyond the last. check: text is parsed once before, so that what can't be read is an error here and not when a table is used."""
    try:
        marks = mark_ranges(spark, path, suffix, split) if suffix in ranges.TEXT else None
        tables = {t: _read(spark, t, path, suffix, split, marks, frames) for t in ("atoms", "positions", "box")}
        tables["bonds"] = _read(spark, "bonds", path, suffix, split, marks) if suffix in (".sdf", ".mol") else spark.createDataFrame([], formats.BOND_SCHEMA)
        if marks and check and (bad := _read(spark, "errors", path, suffix, split, marks).first()) is not None:
            raise FormatError(bad["error"])
        if marks and suffix == ".pdb" and tables["atoms"].isEmpty():
            raise FormatError("no ATOM records")
    except PySparkException as e:
        text = str(e)
        if "FormatError: " in text:
            raise FormatError(text.split("FormatError: ", 1)[1].split("\n", 1)[0]) from None
        raise
    return formats.Dataset(**tables)


def read_molecules(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, mol (its place in the file), name, atoms and bonds of every V2000 record of SDF files."""
    return _read(spark, "molecules", path, ".sdf", split, mark_ranges(spark, path, ".sdf", split))
