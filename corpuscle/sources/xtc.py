"""Packed XTC frames: positions as integers of a given precision, in a bit stream of whole coordinates and runs of small differences.

What a step of the stream holds depends on the steps before it, but only through its width. So one loop finds the bit place and
kind of every group of atoms, and numpy then takes the numbers apart, all of one width at once.
"""

from __future__ import annotations

import struct

import numpy as np

from corpuscle.sources.formats import FormatError

# The ranges of small differences by their index; index 9 is the first that is used.
RANGES = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384,
    20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491,
    6658042, 8388607, 10568983, 13316085, 16777216,
)
FIRST = 9
#: Magic numbers of frames whose byte counts have 32 and 64 bits.
NARROW, WIDE = 1995, 2023
#: Frames of so many atoms or fewer aren't packed.
PLAIN = 9
HEAD = 16 + 36 + 4


def header(file, size: int, at: int) -> dict | None:
    """Atoms, box and end of the frame at a place; None at the end of the file or of what is whole."""
    if at + HEAD > size:
        return None
    data = bytes(file.read_at(min(HEAD + 44, size - at), at))
    magic, n = struct.unpack_from(">2i", data)
    if magic not in (NARROW, WIDE):
        raise FormatError("no XTC frame")
    box = struct.unpack_from(">9f", data, 16)
    if n <= PLAIN:
        end = at + HEAD + 12 * n
    else:
        wide = magic == WIDE
        if len(data) < HEAD + 32 + (8 if wide else 4):
            return None
        (packed,) = struct.unpack_from(">q" if wide else ">i", data, HEAD + 32)
        end = at + HEAD + 32 + (8 if wide else 4) + -(-packed // 4) * 4
    return {"n": n, "end": end, "box": tuple(10.0 * box[k] for k in (0, 4, 8)), "has_points": n > 0} if end <= size else None


def _width(sizes: list[int]) -> int:
    """Bits that the product of sizes takes."""
    product = 1
    for s in sizes:
        product *= s
    return product.bit_length()


def _numbers(data: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of `bits` bits at bit places: whole bytes from the lowest on, then the rest of the bits."""
    if bits == 0:
        return np.zeros(len(places), np.uint64)
    whole, rest = divmod(bits, 8)
    shift = (places & 7).astype(np.uint16)
    at = places >> 3
    out = np.zeros(len(places), np.uint64 if bits <= 64 else object)
    for k in range(whole + (rest > 0)):
        two = data[at + k].astype(np.uint16) << 8 | data[at + k + 1]
        byte = two >> (8 - shift) & 255
        if k == whole:
            byte = byte >> (8 - rest)
        out = out + (byte.astype(np.uint64) << np.uint64(8 * k) if bits <= 64 else np.array([int(b) << 8 * k for b in byte], object))
    return out


def _triples(data: np.ndarray, places: np.ndarray, bits: int, sizes: list[int]) -> np.ndarray:
    """Three integers below sizes, mixed into one number each."""
    number = _numbers(data, places, bits)
    kind = object if number.dtype == object else np.uint64
    y, z = (kind(s) if kind is np.uint64 else s for s in sizes[1:])
    return np.stack([(number // z // y).astype(np.int64), (number // z % y).astype(np.int64), (number % z).astype(np.int64)], 1)


def _large(data: np.ndarray, places: np.ndarray, bits: list[int]) -> np.ndarray:
    """Three integers that follow one another, of so many bits each, the highest first."""
    out, at = [], places
    for b in bits:
        value = np.zeros(len(places), np.int64)
        for k in range(b):
            bit = at + k
            value = value << 1 | (data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
        out.append(value)
        at = at + b
    return np.stack(out, 1)


def points(frame: bytes) -> np.ndarray:
    """Positions in Angstrom of one frame."""
    magic, n = struct.unpack_from(">2i", frame)
    (again,) = struct.unpack_from(">i", frame, 52)
    if again != n:
        raise FormatError("an XTC frame with two atom counts")
    if n <= PLAIN:
        return np.frombuffer(frame, ">f4", 3 * n, HEAD).astype(float).reshape(n, 3) * 10
    precision, *bounds, small = struct.unpack_from(">f7i", frame, HEAD)
    low, sizes = np.array(bounds[:3], np.int64), [b - a + 1 for a, b in zip(bounds[:3], bounds[3:], strict=True)]
    at = HEAD + 32 + (8 if magic == WIDE else 4)
    raw = frame[at:]
    data = np.frombuffer(raw + b"\0" * 16, np.uint8)
    apart = [s.bit_length() for s in sizes] if max(sizes) > 0xFFFFFF else None
    whole = sum(apart) if apart else _width(sizes)
    total = 8 * len(raw)

    def peek(place: int, bits: int) -> int:
        byte = place >> 3
        part = int.from_bytes(raw[byte : byte + 2].ljust(2, b"\0"), "big")
        return part >> (16 - bits - (place & 7)) & (1 << bits) - 1

    places, runs, indexes, flags, place, run, got = [], [], [], [], 0, 0, 0
    while got < n:
        if place + whole > total:
            raise FormatError("an XTC frame is cut short")
        places.append(place)
        place += whole
        change, flag = 0, peek(place, 1)
        if flag:
            code = peek(place + 1, 5)
            change = code % 3 - 1
            run = code // 3
            place += 5
        place += 1
        flags.append(flag)
        runs.append(run)
        indexes.append(small)
        place += run * small
        got += 1 + run
        small += change
        if not FIRST <= small < len(RANGES) and change:
            raise FormatError("an XTC frame with a range that isn't known")
    if got != n or place > total:
        raise FormatError("an XTC frame with other atoms than it says")
    place, run, index = (np.array(x, np.int64) for x in (places, runs, indexes))
    first = np.cumsum(1 + run) - 1 - run
    out = np.empty((n, 3), np.int64)
    heads = (_large(data, place, apart) if apart else _triples(data, place, whole, sizes)) + low
    start = place + whole + 1 + 5 * np.array(flags, np.int64)  # the flag, and a run's code where there is one
    out[first] = heads
    for s in np.unique(index[run > 0]):
        group = np.flatnonzero((run > 0) & (index == s))
        size, half = RANGES[s], RANGES[s] // 2
        for k in range(int(run[group].max())):
            at_k = group[run[group] > k]
            step = _triples(data, start[at_k] + k * s, int(s), [size] * 3) - half
            # a run's first atom stands before the whole one, which the second small difference is not counted from
            if k == 0:
                out[first[at_k] + 1] = out[first[at_k]]
                out[first[at_k]] += step
            elif k == 1:
                out[first[at_k] + 2] = out[first[at_k]] + step
            else:
                out[first[at_k] + k + 1] = out[first[at_k] + k] + step
    return out / precision * 10.0
