"""Writers of binary trajectories: DCD, TRR, NetCDF-3 and XTC, some frames a file."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.trajectory import pack_frames
from corpuscle.sources.ranges import local


def dcd_bytes(frames: list[np.ndarray]) -> bytes:
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    head = struct.pack("<4s9if10i", b"CORD", len(frames), 0, 1, *[0] * 6, 1.0, *[0] * 9, 24)
    out = [record(head), record(struct.pack("<i", 1) + b"trajectory".ljust(80)), record(struct.pack("<i", len(frames[0])))]
    return b"".join([*out, *(record(f[:, k].astype("<f4").tobytes()) for f in frames for k in range(3))])


def trr_bytes(frames: list[np.ndarray]) -> bytes:
    out = []
    for k, f in enumerate(frames):
        n, name = len(f), b"GMX_trn_file"
        out.append(struct.pack(">3i", 1993, len(name) + 1, len(name)) + name + struct.pack(">13i", *[0] * 7, 12 * n, 0, 0, n, k, 0) + struct.pack(">2f", float(k), 0.0) + (f / 10).astype(">f4").tobytes())
    return b"".join(out)


def netcdf_bytes(frames: list[np.ndarray]) -> bytes:
    n = len(frames[0])
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = b"".join(text(name) + struct.pack(">i", size) for name, size in (("frame", 0), ("atom", n), ("spatial", 3)))
    variable = text("coordinates") + struct.pack(">4i", 3, 0, 1, 2) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 5, 12 * n)
    head = b"CDF\x02" + struct.pack(">i", len(frames)) + struct.pack(">2i", 10, 3) + dims + struct.pack(">2i", 0, 0) + struct.pack(">2i", 11, 1) + variable
    return head + struct.pack(">q", len(head) + 8) + b"".join(f.astype(">f4").tobytes() for f in frames)


def xtc_bytes(frames: list[np.ndarray], precision: float = 1000.0) -> bytes:
    """Whole coordinates without runs, which every reader of the format takes; frames of up to nine atoms aren't packed."""
    out = []
    for k, f in enumerate(frames):
        n = len(f)
        head = struct.pack(">3if9fi", 1995, n, k, float(k), *[0.0] * 9, n)
        if n <= 9:
            out.append(head + (f / 10).astype(">f4").tobytes())
            continue
        whole = np.trunc(f * (precision / 10) + np.where(f < 0, -0.5, 0.5)).astype(np.int64)
        low, high = whole.min(0), whole.max(0)
        sizes = [int(s) for s in high - low + 1]
        if max(sizes) > 0xFFFFFF:
            raise ValueError("coordinates too far apart for the precision")
        width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
        bits, filled = 0, 0
        for x, y, z in (whole - low).tolist():
            number, left = (x * sizes[1] + y) * sizes[2] + z, width
            while left > 0:  # bytes from the lowest on, then the rest of the bits
                take = min(8, left)
                bits, number, left = bits << take | number & 255, number >> 8, left - take
            bits, filled = bits << 1, filled + width + 1  # no run
        size = -(-filled // 8)
        packed = (bits << 8 * size - filled).to_bytes(size, "big")
        out.append(head + struct.pack(">f8i", precision, *map(int, low), *map(int, high), 9, size) + packed + b"\0" * (-size % 4))
    return b"".join(out)


KINDS: dict[str, Callable[[list[np.ndarray]], bytes]] = {".dcd": dcd_bytes, ".trr": trr_bytes, ".nc": netcdf_bytes, ".xtc": xtc_bytes}


def write_binary(positions: DataFrame, path: str, suffix: str, frames: int) -> None:
    """Files of `frames` frames each (a task holds one), part=0/..., part=1/... of path. A file gets its name once its task is committed."""
    write_one = KINDS[suffix]
    packed = pack_frames(positions).select(F.floor(F.col("frame") / frames).cast("bigint").alias("part"), F.col("frame").cast("bigint").alias("frame"), "coords")

    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, c) for b in batches for k, c in zip(b.column("frame").to_pylist(), b.column("coords").to_pylist(), strict=True))
        files, base = pafs.FileSystem.from_uri(local(path))
        folder, name = f"{base}/part={key[0].as_py()}", uuid.uuid4().hex
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            out.write(write_one([np.reshape(c, (-1, 3)) for _, c in rows]))
        yield pa.RecordBatch.from_pydict({"folder": [folder], "name": [name]})

    files, _ = pafs.FileSystem.from_uri(local(path))
    for r in packed.groupBy("part").applyInArrow(write, "folder string, name string").collect():  # names of files
        files.move(f"{r['folder']}/_{r['name']}", f"{r['folder']}/{r['name']}{suffix}")
