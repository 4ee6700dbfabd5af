"""Byte ranges of structure and trajectory files: how each format is split, and what a range holds.

A range of a text file has the lines, or the frames, that begin in it. What a range needs to know of those before it (its first line's number,
frame, record or atom) is a sum over summaries of a few numbers each, which one distributed pass over the text gives; no text is
written. Binary formats tell the sizes of their frames, so their ranges are planned from headers.
"""

from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

from corpuscle.sources import binary, formats, xtc
from corpuscle.sources.formats import FormatError

CHUNK = 1 << 20
ROWS = 65536

#: frame, timestep, idx of the points, and their coordinates.
Points = tuple[int, int, np.ndarray, np.ndarray]


def local(path: str) -> str:
    """file:/x as Spark writes it, as a URI that pyarrow reads."""
    return re.sub(r"^file:/(?!//)", "file:///", path)


def open_file(path: str):
    files, at = pafs.FileSystem.from_uri(local(path))
    return files.open_input_file(at)


def _glob(pattern: str) -> str:
    out = []
    for part in re.findall(r"\*|\?|\[[^]]*\]|\{[^}]*\}|[^*?[{]+|.", pattern):
        if part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part[0] == "{" and part[-1] == "}":
            out.append("(" + "|".join(map(re.escape, part[1:-1].split(","))) + ")")
        else:
            out.append(part if part[0] == "[" and part[-1] == "]" else re.escape(part))
    return "".join(out)


def list_files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of all files in a folder, or of those that a pattern of either matches; names that begin with _ or . don't count."""
    uri = local(path)
    uri = uri if "://" in uri else f"file://{os.path.abspath(uri)}"
    wild = re.search(r"[*?\[{]", uri)
    stem = uri[: uri.rindex("/", 0, wild.start())] if wild else uri
    files, base = pafs.FileSystem.from_uri(stem)
    before = stem[: len(stem) - len(base)] if stem.endswith(base) else ""  # scheme and host
    info = files.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    want = re.compile(_glob(uri[len(before) :]) + "(/.*)?") if wild else None
    out = []
    for i in files.get_file_info(pafs.FileSelector(base, recursive=True)):
        inside = i.path[len(base) :].strip("/").split("/")
        if i.type != pafs.FileType.File or any(x[0] in "_." for x in inside):
            continue
        if want.fullmatch(i.path) if want else all("=" in x for x in inside[:-1]):  # folders of partitions are the folder's own
            out.append((before + i.path, i.size))
    return sorted(out)


def lines(file, size: int, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of all lines that begin at or after start."""
    at, rest = max(0, start - 1), b""
    file.seek(at)
    skip = start > 0
    while at < size or rest:
        chunk = file.read(CHUNK)
        if not chunk:
            if rest and not skip:
                yield at - len(rest), rest.rstrip(b"\r")
            return
        begin, parts = at - len(rest), (rest + chunk).split(b"\n")
        at += len(chunk)
        rest = parts.pop()
        for line in parts:
            if skip:
                skip = False
            else:
                yield begin, line.rstrip(b"\r")
            begin += len(line) + 1


@dataclass
class Range:
    """Part of a file: its bytes, the number of the first frame that it may hold, one beyond the last, and what its reader has to know."""

    path: str
    begin: int
    end: int
    first: int
    beyond: int
    state: dict = field(default_factory=dict)


class Text:
    """A text format. summary() is of one range; fold() turns a file's summaries, in order, into ranges and the box."""

    def summary(self, file, size: int, begin: int, end: int) -> dict:
        raise NotImplementedError

    def fold(self, path: str, parts: list[tuple[int, int, dict]]) -> tuple[list[Range], tuple | None]:
        raise NotImplementedError

    def points(self, file, size: int, part: Range, keep) -> Iterator[Points]:
        raise NotImplementedError

    def atoms(self, file, size: int, part: Range) -> Iterator[dict]:
        """Atoms that begin in a range that holds a part of the first frame."""
        raise NotImplementedError

    def bonds(self, file, size: int, part: Range) -> Iterator[tuple[int, int]]:
        return iter(())


def _gathered(frame: int, step: int, first: int, xyz: list) -> Points:
    return frame, step, np.arange(first, first + len(xyz), dtype=np.int64), np.array(xyz, float).reshape(-1, 3)


class Xyz(Text):
    """Frames of as many lines each: a count, a comment and rows. A frame belongs to the range where it begins."""

    CELL = re.compile(rb'Lattice="([^"]*)"')
    STEP = re.compile(r"(?:step|time|frame|i)\s*[=:]\s*(\d+)", re.I)

    def summary(self, file, size, begin, end):
        n, last, cell, head = 0, -1, None, None
        for at, line in lines(file, size, begin):
            if at >= end:
                break
            if at == 0:
                head = line.decode("utf-8", "replace").strip()
            if line.strip():
                last = n
                if (found := self.CELL.search(line)) and len(v := found[1].split()) == 9:
                    cell = [float(x) for x in v]
            n += 1
        return {"lines": n, "last": last, "cell": cell, "head": head}

    def fold(self, path, parts):
        head, at, last, starts, cell = parts[0][2]["head"], 0, -1, [], None
        for _, _, s in parts:
            starts.append(at)
            last = at + s["last"] if s["last"] >= 0 else last
            cell = s["cell"] or cell
            at += s["lines"]
        if last < 0:
            raise FormatError("No frames")
        if not re.fullmatch(r"\+?\d+", head or ""):
            raise FormatError(f"no atom count: {head!r}")
        n = int(head)
        short = (last + 1) % (n + 2) != 0
        frames = (last + 1) // (n + 2) + short
        starts.append(at)
        up = lambda k: -(-k // (n + 2))
        state = {"n": n, "short": short, "frames": frames}
        return [Range(path, b, e, min(up(starts[k]), frames), min(up(starts[k + 1]), frames), state | {"line": starts[k]}) for k, (b, e, _) in enumerate(parts)], cell

    def _frames(self, file, size, part, keep) -> Iterator[tuple[int, str, list[bytes]]]:
        width, number, rows = part.state["n"] + 2, part.state["line"], []
        for _, line in lines(file, size, part.begin):
            frame, row = divmod(number, width)
            number += 1
            if frame >= part.beyond:
                return
            if frame < part.first or not keep(frame):
                continue
            if row == 0:
                if not re.fullmatch(rb"\s*\d+\s*", line) or int(line) != width - 2:
                    raise FormatError(f"the atom count changes: {line.decode('utf-8', 'replace')!r}")
                rows = []
            rows.append(line)
            if len(rows) == width:
                yield frame, rows[1].decode("utf-8", "replace"), rows[2:]
                rows = []
        if rows:
            raise FormatError("the last frame is cut short")

    @staticmethod
    def _xyz(row: bytes) -> tuple:
        try:
            _, x, y, z = row.split(None, 4)[:4]
            return float(x), float(y), float(z)
        except ValueError:
            raise FormatError(f"Bad coordinate: {row.decode('utf-8', 'replace')!r}") from None

    def points(self, file, size, part, keep):
        for frame, comment, rows in self._frames(file, size, part, keep):
            step = re.fullmatch(r"\s*(\d+)\s*", comment) or self.STEP.search(comment)
            for k in range(0, max(1, len(rows)), ROWS):
                yield _gathered(frame, int(step[1]) if step else frame, k, [self._xyz(r) for r in rows[k : k + ROWS]])

    def atoms(self, file, size, part):
        for _, _, rows in self._frames(file, size, part, lambda f: f == 0):
            for k, r in enumerate(rows):
                symbol = re.sub(r"\d+$", "", r.split(None, 1)[0].decode("utf-8", "replace") if r.strip() else "").upper()
                yield {"idx": k, "id": k, "element": symbol, "type_id": formats.ATOMIC_NUMBER.get(symbol, 0)}


class Pdb(Text):
    """Records in fixed columns; a model, or a file without models, may span ranges. Models are filled with zeros or cut to the first one's atoms."""

    def _records(self, file, size, begin, end) -> Iterator[tuple[str, bytes]]:
        for at, line in lines(file, size, begin):
            if at >= end:
                return
            kind = line[:6].strip()
            if kind in (b"ATOM", b"HETATM"):
                if line[16:17] in (b" ", b"", b"A", b"1"):  # else another place of the same atom
                    yield "atom", line
            elif kind in (b"MODEL", b"ENDMDL"):
                yield "mark", line
            elif kind == b"CRYST1":
                yield "cell", line

    def summary(self, file, size, begin, end):
        before, marks, whole, first, now, cell = 0, 0, 0, None, 0, None
        for kind, line in self._records(file, size, begin, end):
            if kind == "atom":
                now += 1
            elif kind == "cell":
                cell = [float(line[a : a + 9]) if re.fullmatch(rb"\s*[-+\d.eE]+\s*", line[a : a + 9]) else None for a in (6, 15, 24)]
            else:
                if not marks:
                    before = now
                elif now:
                    whole, first = whole + 1, first or now
                marks, now = marks + 1, 0
        return {"before": before if marks else now, "marks": marks, "whole": whole, "first": first, "after": now, "cell": cell}

    def fold(self, path, parts):
        frame, held, most, states, cell = 0, 0, None, [], None
        for _, _, s in parts:
            states.append((frame, held))
            cell = s["cell"] or cell
            held += s["before"]
            if s["marks"]:
                if held:
                    most, frame = most or held, frame + 1
                most = most or s["first"]
                frame, held = frame + s["whole"], s["after"]
        if held:
            most, frame = most or held, frame + 1
        states.append((frame, 0))
        out = []
        for k, (b, e, _) in enumerate(parts):
            # the range after may begin within a model that this one holds a part of
            beyond = states[k + 1][0] + (states[k + 1][1] > 0)
            out.append(Range(path, b, e, states[k][0], beyond, {"idx": states[k][1], "most": most or 0, "last": k == len(parts) - 1}))
        return out, cell

    def points(self, file, size, part, keep):
        frame, idx, most, xyz, first = part.first, part.state["idx"], part.state["most"], [], part.state["idx"]

        def close(idx: int) -> Iterator[Points]:
            if keep(frame):
                if xyz:
                    yield _gathered(frame, frame, first, xyz)
                if idx < most:
                    yield _gathered(frame, frame, idx, [(0.0, 0.0, 0.0)] * (most - idx))

        for kind, line in self._records(file, size, part.begin, part.end):
            if kind == "atom":
                if idx < most and keep(frame):
                    try:
                        xyz.append(tuple(float(line[a : a + 8]) for a in (30, 38, 46)))
                    except ValueError:
                        raise FormatError(f"Bad coordinate: {line.decode('utf-8', 'replace')!r}") from None
                    if len(xyz) == ROWS:
                        yield _gathered(frame, frame, first, xyz)
                        xyz, first = [], idx + 1
                idx += 1
            elif kind == "mark" and idx:
                yield from close(idx)
                frame, idx, xyz, first = frame + 1, 0, [], 0
        if part.state["last"] and idx:
            yield from close(idx)
        elif xyz and keep(frame):
            yield _gathered(frame, frame, first, xyz)

    def atoms(self, file, size, part):
        frame, idx = part.first, part.state["idx"]
        for kind, line in self._records(file, size, part.begin, part.end):
            if frame:
                return
            if kind == "mark":
                frame += idx > 0
            elif kind == "atom":
                text = line.decode("utf-8", "replace")
                name = text[12:16].strip()
                element = (text[76:78].strip() or formats.element_of(name)).upper()
                number = text[22:26].strip()
                yield {"idx": idx, "id": idx, "element": element, "type_id": formats.ATOMIC_NUMBER.get(element, 0), "name": name, "resname": formats.pdb_resname(text), "chain_id": text[21:22].strip() or None, "residue_id": int(number) if re.fullmatch(r"[-+]?\d+", number) else None}
                idx += 1


class Dump(Text):
    """Frames of a LAMMPS dump, each in the range where its ITEM: TIMESTEP begins; they are numbered by their places."""

    MARK, BOUNDS = b"ITEM: TIMESTEP", b"ITEM: BOX BOUNDS"

    def summary(self, file, size, begin, end):
        n, box, left, sides = 0, None, 0, []
        for at, line in lines(file, size, begin):
            own = at < end
            if line.startswith(self.MARK):
                if not own:
                    break
                n += 1
            elif n and line.startswith(self.BOUNDS):
                left, sides = 3, []
            elif left:
                p = line.split()
                sides.append(float(p[1]) - float(p[0]))
                left -= 1
                box = box if left else sides
            if not own and (not n or not left and box and line.startswith(b"ITEM: ATOMS")):
                break
        return {"frames": n, "box": box}

    def fold(self, path, parts):
        out, frame, box = [], 0, None
        for b, e, s in parts:
            out.append(Range(path, b, e, frame, frame + s["frames"]))
            frame, box = frame + s["frames"], s["box"] or box
        return out, box

    def _frames(self, file, size, part, keep) -> Iterator[tuple[int, str]]:
        frame, text = part.first - 1, None
        for at, line in lines(file, size, part.begin):
            if line.startswith(self.MARK):
                if text is not None and keep(frame):
                    yield frame, "\n".join(text)
                if at >= part.end:
                    return
                frame, text = frame + 1, []
            elif text is not None and keep(frame):
                text.append(line.decode("utf-8", "replace"))
            elif at >= part.end and text is None:
                return
        if text is not None and keep(frame):
            yield frame, "\n".join(text)

    def points(self, file, size, part, keep):
        for frame, text in self._frames(file, size, part, keep):
            step, xyz = formats.parse_lammps_frame(text, with_atoms=False).frames[0]
            yield _gathered(frame, step, 0, xyz)

    def atoms(self, file, size, part):
        for _, text in self._frames(file, size, part, lambda f: f == 0):
            yield from formats.parse_lammps_frame(text).atoms


class Sdf(Text):
    """V2000 records, each in the range where it begins. Records with as many atoms as the first are frames; molecules() gives them all."""

    def _texts(self, file, size, begin, end) -> Iterator[str]:
        """Records that begin in the range: at the file's start, or after a line of four dollar signs that begins there."""
        text = [] if begin == 0 else None
        for at, line in lines(file, size, begin):
            if text is not None:
                text.append(line)
            if line.startswith(b"$$$$"):
                if text is not None:
                    yield b"\n".join(text[:-1]).decode("utf-8", "replace")
                if at >= end:
                    return
                text = []
            elif at >= end and text is None:
                return
        if text and any(x.strip() for x in text):
            yield b"\n".join(text).decode("utf-8", "replace")

    def summary(self, file, size, begin, end):
        sizes, first, n = Counter(), None, 0
        for text in self._texts(file, size, begin, end):
            n += 1
            if (counts := formats.sdf_counts(text)) is not None:
                sizes[str(counts[1])] += 1
                first = counts[1] if first is None else first
        return {"sizes": dict(sizes), "first": first, "records": n}

    def fold(self, path, parts):
        n = next((s["first"] for _, _, s in parts if s["first"] is not None), None)
        if n is None:
            raise FormatError("no V2000 record")
        out, frame, record = [], 0, 0
        for b, e, s in parts:
            more = s["sizes"].get(str(n), 0)
            out.append(Range(path, b, e, frame, frame + more, {"n": n, "record": record}))
            frame, record = frame + more, record + s["records"]
        return out, None

    def _frames(self, file, size, part, keep):
        frame = part.first
        for text in self._texts(file, size, part.begin, part.end):
            counts = formats.sdf_counts(text)
            if counts is not None and counts[1] == part.state["n"]:
                if keep(frame):
                    yield frame, formats.parse_sdf(text)
                frame += 1

    def points(self, file, size, part, keep):
        for frame, s in self._frames(file, size, part, keep):
            yield _gathered(frame, frame, 0, s.frames[0][1])

    def atoms(self, file, size, part):
        for _, s in self._frames(file, size, part, lambda f: f == 0):
            yield from s.atoms

    def bonds(self, file, size, part):
        for _, s in self._frames(file, size, part, lambda f: f == 0):
            yield from s.bonds

    def molecules(self, file, size, part) -> Iterator[tuple[int, str, list, list]]:
        """Record number, name, atoms (element, charge and position) and bonds (i, j, order) of every V2000 record."""
        for k, text in enumerate(self._texts(file, size, part.begin, part.end)):
            if (found := formats.sdf_molecule(text)) is not None:
                yield part.state["record"] + k, *found


class Binary:
    """A binary format: plan() gives ranges of whole frames, n atoms and the box, from headers alone."""

    def plan(self, file, size: int, path: str, step: int) -> tuple[list[Range], int, tuple | None]:
        raise NotImplementedError

    def points(self, file, size: int, part: Range, keep) -> Iterator[Points]:
        raise NotImplementedError


def _dealt(path: str, offsets: list[int], end: int, step: int, **state: object) -> list[Range]:
    """Ranges of about step bytes of the frames that begin at offsets."""
    out, k = [], 0
    while k < len(offsets):
        j = k + 1
        while j < len(offsets) and offsets[j] - offsets[k] < step:
            j += 1
        out.append(Range(path, offsets[k], offsets[j] if j < len(offsets) else end, k, j, dict(state)))
        k = j
    return out


def _even(path: str, start: int, width: int, frames: int, step: int, **state: object) -> list[Range]:
    """Ranges of frames that all have the same width."""
    each = max(1, step // width)
    return [Range(path, start + k * width, start + min(frames, k + each) * width, k, min(frames, k + each), dict(state)) for k in range(0, frames, each)]


class Dcd(Binary):
    """Frames have one size, but for the first where some atoms are fixed: the others hold only the free ones."""

    def plan(self, file, size, path, step):
        h = binary.dcd_header(file, size)
        if size < h["start"] + h["wide"]:
            raise FormatError("No frames")
        frames = 1 + (size - h["start"] - h["wide"]) // h["width"]
        box = None
        if h["cell"]:
            a, _, b, _, _, c = struct.unpack(f"{h['order']}6d", file.read_at(48, h["start"] + 4))
            box = (a, b, c)
        ranges = _even(path, h["start"] + h["wide"] - h["width"], h["width"], frames, step)
        return ranges, h["n"], box if box and all(box) else None

    def points(self, file, size, part, keep):
        h = binary.dcd_header(file, size)
        base = binary.dcd_frame(file, h, h["start"], True) if h["free"] is not None else None
        for k in range(part.first, part.beyond):
            if keep(k):
                at = h["start"] if k == 0 else h["start"] + h["wide"] + (k - 1) * h["width"]
                xyz = binary.dcd_frame(file, h, at, k == 0)
                if base is not None and k:
                    full = base.copy()
                    full[h["free"]] = xyz
                    xyz = full
                yield k, k, np.arange(len(xyz), dtype=np.int64), xyz


class NetCdf(Binary):
    """A record a frame, all of one size; a restart has the one."""

    @staticmethod
    def _head(file, size) -> binary.NetCdf:
        n = 1 << 16
        while True:
            try:
                return binary.NetCdf(bytes(file.read_at(min(n, size), 0)), size)
            except (struct.error, IndexError):
                if n >= size:
                    raise FormatError("the NetCDF header is cut short") from None
                n *= 8

    def plan(self, file, size, path, step):
        head = self._head(file, size)
        if "coordinates" not in head.variables:
            raise FormatError("no variable coordinates")
        places, v = head.places("coordinates"), head.variables["coordinates"]
        if not places:
            raise FormatError("No frames")
        cells = head.places("cell_lengths") if "cell_lengths" in head.variables else []
        box = tuple(map(float, np.frombuffer(file.read_at(np.dtype(head.variables["cell_lengths"].kind).itemsize * 3, cells[0]), head.variables["cell_lengths"].kind))) if cells else None
        return _even(path, places[0], head.stride if v.is_record else size, len(places), step), v.shape[0], box if box and all(box) else None

    def points(self, file, size, part, keep):
        head = self._head(file, size)
        v, places = head.variables["coordinates"], head.places("coordinates")
        width = int(np.prod(v.shape)) * np.dtype(v.kind).itemsize
        for k in range(part.first, part.beyond):
            if keep(k):
                xyz = np.frombuffer(file.read_at(width, places[k]), v.kind).reshape(-1, 3).astype(float)
                yield k, k, np.arange(len(xyz), dtype=np.int64), xyz


class Walked(Binary):
    """Frames of any size, whose headers tell where the next one is: they are walked through, a short read each."""

    def __init__(self, header, decode):
        self.header, self.decode = header, decode

    def plan(self, file, size, path, step):
        offsets, at, n, box, end = [], 0, 0, None, 0
        while (h := self.header(file, size, at)) is not None:
            if h["has_points"]:
                offsets.append(at)
                n, end = n or h["n"], h["end"]
            box = box or h["box"]
            at = h["end"]
        if not offsets:
            raise FormatError("No frames")
        return _dealt(path, offsets, end, step), n, box if box and all(box) else None

    def points(self, file, size, part, keep):
        at, k = part.begin, part.first
        while k < part.beyond:
            h = self.header(file, size, at)
            if h["has_points"]:
                if keep(k):
                    xyz = self.decode(bytes(file.read_at(h["end"] - at, at)))
                    yield k, k, np.arange(len(xyz), dtype=np.int64), xyz
                k += 1
            at = h["end"]


TEXT: dict[str, Text] = {".xyz": Xyz(), ".pdb": Pdb(), ".lammpstrj": Dump(), ".traj": Dump(), ".sdf": Sdf(), ".mol": Sdf()}
BINARY: dict[str, Binary] = {".dcd": Dcd(), ".nc": NetCdf(), ".ncdf": NetCdf(), ".trr": Walked(binary.trr_header, binary.trr_points), ".xtc": Walked(xtc.header, xtc.points)}
