"""Token ids as directly addressable codes, written to segments and read back.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id and a bitmap that tells which ids go on;
level k holds the k-th chunk of those that do. A rank directory (ones before every 512th bit) turns a position on one
level into that on the next, so any token or run of tokens is read without decoding a block. Segments of whole documents
are rows of a Parquet table (Spark's commit protocol makes retried and lost tasks harmless, on any store) without page
compression: part and segment number, document ids and token counts, and the payload. tokens_at() gives the tokens at any
positions of the whole store, and read_digests() takes each document's last token by its address too.

Rows come in ascending order of doc_id (null ids first; ties by a hash of the text). A null or empty text has the end id
only; repeated rows are stored as often as they occur; an empty table gives no segments; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm.common import by_bytes, hold_cache, narrow, new_path, no_collection

BLOCK = 512
#: Ids from which a segment is closed, characters that are encoded at once, entries of the cache.
SEGMENT, CHARS, CACHE = 1 << 18, 4_000_000, 1_000_000
MAGIC = b"DAC1"


class Dac:
    """A run of ids as directly addressable codes."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a run of directly addressable codes")
        sizes = np.frombuffer(payload, "<u8", payload[4], 8)
        at, self.levels = 8 + 8 * len(sizes), []
        for n in map(int, sizes):
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at + n)
            at += n + len(bits)
            ones = np.frombuffer(payload, "<u4", n // BLOCK + 1, at)
            at += 4 * len(ones)
            self.levels.append((chunks, bits, ones))

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        if ids.dtype.kind != "u":
            ids = np.asarray(ids, np.uint64)
        ids, sizes, body = np.ascontiguousarray(ids), [], []
        while not sizes or len(ids):
            more = ids > 255
            n = len(ids)
            bits = np.packbits(more, bitorder="little")
            whole = n // BLOCK * BLOCK // 8
            ones = np.r_[0, np.cumsum(np.bitwise_count(bits[:whole]).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))]
            body += [ids.astype(np.uint8).tobytes(), bits.tobytes(), ones.astype("<u4").tobytes()]
            sizes.append(n)
            ids = ids[more] >> ids.dtype.type(8)
        return b"".join([MAGIC, bytes([len(sizes), 0, 0, 0]), np.array(sizes, "<u8").tobytes(), *body])

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: int) -> int:
        """Ones before position at."""
        _, bits, ones = self.levels[level]
        block = at // BLOCK
        rest = np.unpackbits(bits[block * BLOCK // 8 : (at + 7) // 8], bitorder="little")[: at - block * BLOCK]
        return int(ones[block]) + int(rest.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift, level = 0, 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift, level = self._rank(level, i), shift + 8, level + 1

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, end exclusive."""
        out = np.zeros(max(0, b - a), np.uint32 if len(self.levels) <= 4 else np.uint64)
        where = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            if where is None:
                out[:] = chunks[a:b]
            else:
                out[where] |= chunks[a:b].astype(out.dtype) << out.dtype.type(8 * level)
            more = np.flatnonzero(np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a])
            where = more if where is None else where[more]
            a = self._rank(level, a)
            b = a + len(where)
        return out


class WordEncoder:
    """A word-end BPE vocabulary of the tokenizers library over a bounded cache of chunks between white space.

    White space never gets into a token of such a vocabulary, so the library encodes each distinct chunk once, many in one
    text; the tokens that end a word tell the chunks apart again.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.library, self.words = Tokenizer.from_file(path), regex.compile(split)
        ends = [i for t, i in self.library.get_vocab().items() if t.endswith(self.suffix)]
        self.is_end = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.is_end[ends] = True
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.high = re.compile("[^\x00-\u02ff]")
        self.odd = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the library
        #: How an id lies in memory; no vocabulary of words needs more than four bytes.
        self.dtype = np.dtype("<u2" if len(self.is_end) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, chunk: str) -> int:
        """The words that the library cuts a chunk into; plain words need no pattern."""
        if chunk.isalpha() and (chunk.isascii() or not self.high.search(chunk)):
            return 1
        if chunk[-1] in ".,!?" and chunk[:-1].isalpha() and (chunk.isascii() or not self.high.search(chunk)):
            return 2
        return len(self.words.findall(unicodedata.normalize("NFC", chunk).lower()))

    def _learn(self, chunks: list[str]) -> None:
        special = [c for c in chunks if self.special.search(c)]
        self.cache.update(zip(special, self._alone(special), strict=True))
        plain = [c for c in chunks if c not in self.cache] if special else chunks
        for a in range(0, len(plain), 20_000):
            part = plain[a : a + 20_000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            n = np.fromiter(map(self._pieces, part), np.int64, len(part))
            ends = np.r_[0, np.flatnonzero(self.is_end[ids]) + 1]
            if len(ends) - 1 != n.sum() or ends[-1] != len(ids):  # words that this count takes apart otherwise
                self.cache.update(zip(part, self._alone(part), strict=True))
                continue
            cut, data = (self.dtype.itemsize * ends[np.r_[0, np.cumsum(n)]]).tolist(), ids.tobytes()
            self.cache.update((c, data[x:y]) for c, x, y in zip(part, cut, cut[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as bytes of self.dtype."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        odd = [k for k, t in enumerate(texts) if any(c in t for c in self.odd)]
        # small letters first make fewer distinct chunks; from U+0300 on that could change how marks compose
        cut = [(t if not t.isascii() and self.high.search(t) or "<|" in t and self.special.search(t) else t.lower()).split() for t in texts]
        for k in odd:
            cut[k] = []
        self._learn(list(set().union(*cut).difference(self.cache)))
        get = self.cache.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for k, own in zip(odd, self._alone([texts[k] for k in odd]), strict=True):
            out[k] = own
        return out


_ENCODERS: dict[str, WordEncoder] = {}
SEGMENT_SCHEMA = "part int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    hold_cache("store", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    own = _ENCODERS[path]
    end = np.array([end_id], own.dtype).tobytes()
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
    part, segment, first, ids, docs, counts, size = 0, 0, 0, [], [], [], 0

    def close() -> pa.RecordBatch:
        row = [part, segment, first, size, docs, counts, Dac.pack(np.frombuffer(b"".join(ids), own.dtype))]
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        if batch.num_rows:
            part = batch.column(2)[0].as_py()
        names, at = batch.column(0).to_pylist(), 0
        for texts in by_bytes(batch.column(1).to_pylist(), CHARS):
            with no_collection():
                encoded = own.encode(texts)
            for doc, data in zip(names[at : at + len(texts)], encoded, strict=True):
                ids += [data, end]
                docs.append(doc)
                counts.append(len(data) // own.dtype.itemsize + 1)
                size += counts[-1]
                if size >= SEGMENT:
                    yield close()
                    segment, first, ids, docs, counts, size = segment + 1, first + size, [], [], [], 0
            at += len(texts)
    if docs:
        yield close()


def write_store(df: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes whole texts, appends end_id to each, and writes segments in ascending order of id_col.

    One shuffle deals the texts by ranges of the id (and a hash, which splits ranges of equal ids).
    """
    given = narrow(df, doc_id=id_col, text=text_col)
    order = [F.col("doc_id").cast("long"), F.xxhash64("text")]
    dealt = given.repartitionByRange(partitions, *order) if partitions else given.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(partial(_segments, path=vocab_path, end_id=end_id), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    """The segments, with the number of ids before each as start."""
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row for each part, so this single ordered window is as small as the list of files
    before = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # a row for each written part, which the driver's commit listed too
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("first")).alias("start"), *[c for c in rows.columns if c != "first"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            base, docs, counts, payload = (batch.column(c)[k].as_py() for c in range(4))
            codes, ends = Dac(payload), np.r_[0, np.cumsum(np.array(counts, np.int64))]
            ids = memoryview(codes.slice(0, len(codes)).astype("<u4", copy=False)).cast("B")
            if any(codes[b - 1] != int.from_bytes(ids[4 * b - 4 : 4 * b], "little") for b in ends[1:].tolist()):
                raise ValueError("the rank directory and the codes differ")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(base + ends[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of each document, decoded from the store."""
    return read_segments(spark, path).select("start", "doc_ids", "counts", "payload").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: start, payload, positions. Out: position, token."""
    for batch in batches:
        for start, payload, positions in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            codes = Dac(payload)
            yield pa.record_batch([pa.array(positions, pa.int64()), pa.array([codes[p - start] for p in positions], pa.int64())], names=["position", "token"])


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """position and token for each distinct position (column position) that the store has; only segments that hold one are
    read, and none of them is decoded."""
    segments = read_segments(positions.sparkSession, path)
    # positions meet segments by ranges of SEGMENT positions, of which a segment touches as many as it is long, and two
    ranges = segments.select("part", "segment", "start", "n_ids", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n_ids") - 1) / SEGMENT))).alias("range"))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().withColumn("range", F.floor(F.col("position") / SEGMENT))
    held = asked.join(ranges, "range").where("position >= start and position < start + n_ids")
    held = held.groupBy("part", "segment").agg(F.collect_list("position").alias("positions"))  # a segment's ids at most
    return segments.join(held, ["part", "segment"]).select("start", "payload", "positions").mapInArrow(_pick, "position bigint, token bigint")


def store_round_trip(df: DataFrame, vocab_path: str, end_id: int, path: str | None = None) -> DataFrame:
    path = path or new_path(df.sparkSession, "tokens")
    write_store(df, path, vocab_path, end_id)
    return read_digests(df.sparkSession, path)
