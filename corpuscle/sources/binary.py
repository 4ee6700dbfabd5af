"""Binary and restart trajectories: DCD, TRR, NetCDF-3 (trajectory and restart) and the ASCII forms of AMBER.

Each parser turns the bytes of one file into frames in Angstrom; atoms have numbers only, since these files name none, so they
are joined with a topology by Dataset.with_trajectory(). Time steps are the frames' ordinals. A file is the unit of work and
must be below Spark's 2 GB for one value; a folder of them is read in parallel.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from corpuscle.sources.formats import FormatError, Structure


def _structure(frames: list[np.ndarray], box: tuple[float, float, float] | None = None) -> Structure:
    if not frames or not len(frames[0]):
        raise FormatError("No frames")
    out = Structure(frames=list(enumerate(frames)), box=box if box and all(box) else None)
    for _ in range(len(frames[0])):
        out.add()
    return out


def parse_dcd(data: bytes) -> Structure:
    """Fortran records in either byte order: header, titles, atom count, then per frame a cell (if any) and x, y and z.

    With fixed atoms only the first frame has all of them; a frame that is cut short ends the file.
    """
    for order in "<>":
        if len(data) >= 8 and struct.unpack_from(f"{order}i4s", data) == (84, b"CORD"):
            break
    else:
        raise FormatError("no DCD header")
    at = 0

    def record() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from(f"{order}i", data, at)
        if size < 0 or at + size + 8 > len(data):
            return None
        body = data[at + 4 : at + 4 + size]
        at += size + 8
        return body

    header = struct.unpack(f"{order}20i", record()[4:84])
    record()
    count = record()
    if count is None:
        raise FormatError("the DCD header is cut short")
    (n,), fixed, has_cell, has_fourth = struct.unpack(f"{order}i", count[:4]), header[8], header[10], header[11] == 1
    free = np.frombuffer(record() or b"", f"{order}i4") - 1 if fixed else None
    frames, box = [], None
    while True:
        cell = record() if has_cell else b""
        axes = [record() for _ in range(4 if has_fourth else 3)]
        if cell is None or None in axes:
            break
        if has_cell and box is None:
            a, _, b, _, _, c = struct.unpack(f"{order}6d", cell[:48])
            box = a, b, c
        points = np.stack([np.frombuffer(x, f"{order}f4") for x in axes[:3]], 1).astype(float)
        if free is not None and frames:
            points, moved = frames[0].copy(), points
            points[free] = moved
        if len(points) != n:
            raise FormatError("a frame has another number of atoms than the header says")
        frames.append(points)
    return _structure(frames, box)


def parse_trr(data: bytes) -> Structure:
    """Big-endian frames of a magic number, sizes, box, positions and what else there is; frames without positions are passed over."""
    at, frames, box = 0, [], None
    while at + 4 <= len(data):
        magic, _, size = struct.unpack_from(">3i", data, at)
        if magic != 1993:
            raise FormatError("no TRR frame")
        at += 12 + -(-size // 4) * 4
        *sizes, n, _, _ = struct.unpack_from(">13i", data, at)
        at += 52
        box_size, x_size = sizes[2], sizes[7]
        real = _real(sizes, n)
        at += 2 * real
        start, end = at + sum(sizes[:7]), at + sum(sizes)
        if end > len(data):
            break
        if x_size:
            frames.append(np.frombuffer(data, f">f{real}", 3 * n, start).astype(float).reshape(n, 3) * 10)
        if box_size and box is None:
            cell = np.frombuffer(data, f">f{real}", 9, at + sizes[0] + sizes[1]) * 10.0
            box = tuple(float(cell[k]) for k in (0, 4, 8))
        at = end
    return _structure(frames, box)


def dcd_header(file, size: int) -> dict:
    """Byte order, atoms n, free atoms (None: all), whether frames have a cell and a fourth axis, where they start, and the bytes of the first and of each other."""
    for order in "<>":
        if size >= 92 and struct.unpack(f"{order}i4s", file.read_at(8, 0)) == (84, b"CORD"):
            break
    else:
        raise FormatError("no DCD header")
    at, bodies = 0, []

    def record() -> bytes:
        nonlocal at
        if at + 4 > size:
            raise FormatError("the DCD header is cut short")
        (n,) = struct.unpack(f"{order}i", file.read_at(4, at))
        if n < 0 or at + n + 8 > size:
            raise FormatError("the DCD header is cut short")
        body = bytes(file.read_at(n, at + 4))
        at += n + 8
        return body

    bodies = [record() for _ in range(3)]
    head = struct.unpack(f"{order}20i", bodies[0][4:84])
    (n,), fixed, cell, fourth = struct.unpack(f"{order}i", bodies[2][:4]), head[8], bool(head[10]), head[11] == 1
    free = np.frombuffer(record(), f"{order}i4") - 1 if fixed else None
    bytes_of = lambda k: (56 if cell else 0) + (4 if fourth else 3) * (4 * k + 8)
    return {"order": order, "n": n, "free": free, "cell": cell, "fourth": fourth, "start": at, "wide": bytes_of(n), "width": bytes_of(n - fixed)}


def dcd_frame(file, header: dict, at: int, first: bool) -> np.ndarray:
    """Positions of the frame at a place: of all atoms in the first, else of the free ones."""
    n = header["n"] if first or header["free"] is None else len(header["free"])
    data, order = bytes(file.read_at(header["wide" if first else "width"], at)), header["order"]
    skip, out = 56 if header["cell"] else 0, []
    for k in range(3):
        begin = skip + k * (4 * n + 8)
        if struct.unpack_from(f"{order}i", data, begin) != (4 * n,) or struct.unpack_from(f"{order}i", data, begin + 4 + 4 * n) != (4 * n,):
            raise FormatError("a frame has another number of atoms than the header says")
        out.append(np.frombuffer(data, f"{order}f4", n, begin + 4))
    return np.stack(out, 1).astype(float)


def trr_header(file, size: int, at: int) -> dict | None:
    """Atoms, box, end and whether there are positions of the frame at a place; None where no whole frame is left."""
    if at + 12 > size:
        return None
    magic, _, text = struct.unpack(">3i", file.read_at(12, at))
    if magic != 1993:
        raise FormatError("no TRR frame")
    head = at + 12 + -(-text // 4) * 4
    if head + 52 > size:
        return None
    *sizes, n, _, _ = struct.unpack(">13i", file.read_at(52, head))
    real = _real(sizes, n)
    start = head + 52 + 2 * real
    end = start + sum(sizes)
    if end > size:
        return None
    box = None
    if sizes[2]:
        cell = np.frombuffer(file.read_at(9 * real, start + sizes[0] + sizes[1]), f">f{real}") * 10.0
        box = tuple(float(cell[k]) for k in (0, 4, 8))
    return {"n": n, "end": end, "box": box, "has_points": bool(sizes[7])}


def _real(sizes: list[int], n: int) -> int:
    """Bytes of a number in a TRR frame."""
    some = sizes[7] or sizes[8] or sizes[9]
    real = some // (3 * n) if n and some else sizes[2] // 9
    if real not in (4, 8):
        raise FormatError("numbers of a TRR frame are neither single nor double")
    return real


def trr_points(frame: bytes) -> np.ndarray:
    (text,) = struct.unpack_from(">i", frame, 8)
    at = 12 + -(-text // 4) * 4
    *sizes, n, _, _ = struct.unpack_from(">13i", frame, at)
    real = _real(sizes, n)
    return np.frombuffer(frame, f">f{real}", 3 * n, at + 52 + 2 * real + sum(sizes[:7])).astype(float).reshape(n, 3) * 10


@dataclass
class Variable:
    kind: str
    shape: tuple[int, ...]
    is_record: bool
    size: int
    begin: int


# NetCDF-3 types by code.
_KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class NetCdf:
    """Variables of a classic or 64-bit-offset NetCDF-3 file."""

    def __init__(self, data: bytes, size: int | None = None):
        """data: the file, or its head where size tells how long it is."""
        size = len(data) if size is None else size
        if data[:3] != b"CDF" or data[3:4] not in (b"\x01", b"\x02"):
            raise FormatError("no NetCDF-3 file")
        self.data, self.at, self.size, wide = data, 4, size, data[3] == 2
        self.records = self._int()
        dims = [(self._name(), self._int()) for _ in range(self._list())]
        self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._list()):
            name = self._name()
            ids = [self._int() for _ in range(self._int())]
            self._attributes()
            kind, size = _KINDS[self._int()], self._int()
            (begin,) = struct.unpack_from(">q" if wide else ">i", data, self.at)
            self.at += 8 if wide else 4
            is_record = bool(ids) and dims[ids[0]][1] == 0
            self.variables[name] = Variable(kind, tuple(dims[i][1] for i in ids[is_record:]), is_record, size, begin)
        recorded = [v for v in self.variables.values() if v.is_record]
        # a single record variable isn't padded
        self.stride = np.dtype(recorded[0].kind).itemsize * int(np.prod(recorded[0].shape)) if len(recorded) == 1 else sum(v.size for v in recorded)
        if recorded and self.records < 0:
            self.records = (self.size - min(v.begin for v in recorded)) // self.stride

    def _int(self) -> int:
        (value,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return value

    def _name(self) -> str:
        n = self._int()
        text = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def _list(self) -> int:
        _, n = self._int(), self._int()
        return n

    def _attributes(self) -> None:
        for _ in range(self._list()):
            self._name()
            size = np.dtype(_KINDS[self._int()]).itemsize * self._int()
            self.at += -(-size // 4) * 4

    def places(self, name: str) -> list[int]:
        """Where the records of a variable begin, or its one value; records that are cut short are left out."""
        v = self.variables[name]
        width = int(np.prod(v.shape)) * np.dtype(v.kind).itemsize
        starts = [v.begin + k * self.stride for k in range(self.records)] if v.is_record else [v.begin]
        return [s for s in starts if s + width <= self.size]

    def read(self, name: str) -> list[np.ndarray]:
        """The records of a variable, or its one value; records that are cut short are left out."""
        v = self.variables[name]
        return [np.frombuffer(self.data, v.kind, int(np.prod(v.shape)), s).reshape(v.shape) for s in self.places(name)]


def parse_netcdf(data: bytes) -> Structure:
    """The variable coordinates, a frame a record (a restart has one), and cell_lengths of the first."""
    file = NetCdf(data)
    if "coordinates" not in file.variables:
        raise FormatError("no variable coordinates")
    cells = file.read("cell_lengths") if "cell_lengths" in file.variables else []
    return _structure([x.astype(float) for x in file.read("coordinates")], tuple(map(float, cells[0])) if cells else None)


def _fields(line: str, width: int) -> list[float]:
    line = line.rstrip()
    try:
        return [float(line[k : k + width]) for k in range(0, len(line), width)]
    except ValueError:
        raise FormatError(f"Bad coordinate: {line!r}") from None


def parse_restart(data: bytes) -> Structure:
    """An AMBER restart: NetCDF, or text of title, atom count, coordinates in columns of 12, then velocities and box if there are any."""
    if data[:3] == b"CDF":
        return parse_netcdf(data)
    lines = data.decode("utf-8", "replace").splitlines()
    try:
        n = int(lines[1].split()[0])
    except (IndexError, ValueError):
        raise FormatError("no atom count") from None
    values = [_fields(x, 12) for x in lines[2:] if x.strip()]
    rows = -(-n // 2)
    flat = [v for row in values[:rows] for v in row]
    if len(flat) < 3 * n:
        raise FormatError("No frames")
    rest = values[rows:]
    box = tuple(rest[-1][:3]) if len(rest) in (1, rows + 1) and len(rest[-1]) >= 3 and not (len(rest) == rows) else None
    return _structure([np.array(flat[: 3 * n]).reshape(n, 3)], box)


def parse_mdcrd(data: bytes, n_atoms: int, has_box: bool | None = None) -> Structure:
    """An AMBER text trajectory in columns of 8; it doesn't say how many atoms there are, so the topology's count is needed.

    has_box None: there are box lines if the line after the first frame has three numbers, where that tells them apart.
    """
    lines = data.decode("utf-8", "replace").splitlines()[1:]
    rows, frames, box, at = -(-3 * n_atoms // 10), [], None, 0
    if has_box is None:
        has_box = n_atoms > 1 and len(lines) > rows and len(_fields(lines[rows], 8)) == 3
    while at + rows <= len(lines):
        flat = [v for x in lines[at : at + rows] for v in _fields(x, 8)]
        if len(flat) != 3 * n_atoms:
            break
        frames.append(np.array(flat).reshape(n_atoms, 3))
        at += rows
        if has_box and at < len(lines):
            box = box or tuple(_fields(lines[at], 8)[:3])
            at += 1
    return _structure(frames, box)
