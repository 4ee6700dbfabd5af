"""WARC archives with a two-level capture index.

write_archive() writes a record for each page, one gzip member each, to files of the shared folder. Of the pages with equal
payloads of at least `least` bytes that with the largest page_id is a response; the others revisit it and hold no payload. Shorter
payloads are all responses. Which ones revisit is decided on digests alone: payloads are neither grouped nor shuffled for it, unless
the revisits are too many for Spark to broadcast, and then by (page_id, digest), which a page shares with no other.

The index has two levels. Captures are sorted by reversed-host key and page_id over range partitions, and each writes a file
of compressed blocks of BLOCK lines, then a sparse directory (first key, offset and length of each block) and a trailer that tells where that is.
A lookup deals its keys to the files by their first keys (one entry for a file of some 250 000 captures, so that list is small),
and there, in the order of the keys, searches the directory by bisection, reads the block's range and searches in it. What it
finds is sorted by place, and records that lie near each other are read as one range.

Files are named anew by each attempt of a task and count only if a table that Spark committed names them, so failed and repeated tasks do no
harm. They are opened with pyarrow.fs, which must know the scheme of spark.checkpoint.dir.

A null html is the empty payload; a null url has the empty key; a null page_id is the id `null` and the smallest. All rows with a
group's largest page_id are responses if that id is repeated. Repeated rows are captures of their own and come back as often as they were
written. An empty table gives an archive without files. Control characters and spaces in URLs are percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import materialize, narrow, new_path

#: Least bytes of a payload that is revisited; lines of an index block; captures of an index file; bytes of an archive file.
LEAST, BLOCK, PART, FILE = 1000, 1024, 250_000, 256_000_000
#: Bytes between records, and of a range, up to which records are read at once.
GAP, RANGE = 64_000, 8_000_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
TRAILER = "<QQ"
ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^]/?#]*\]|[^/?#:]*)(:[0-9]*)?([^#]*)", re.I)
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def safe_url(url: str | None) -> str:
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def reversed_key(url: str | None) -> str:
    """The host's labels from the last to the first, the port unless it is the scheme's, the path and the query: com,example)/a?b."""
    url = safe_url(url)
    found = ADDRESS.match(url)
    if not found:
        return url
    host, port, rest = found[1].lower(), found[2] or "", found[3] or "/"
    labels = [host] if host.startswith("[") else host.rstrip(".").split(".")[::-1]
    if port in (":", ":443" if url[:6].lower() == "https:" else ":80"):
        port = ""
    return f"{','.join(labels)}{port}){rest if rest[0] == '/' else '/' + rest}"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A record as one gzip member. refers_to: the id of the response that it revisits; such a record has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {safe_url(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(http) + len(payload)}", "", ""]).encode()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"".join([head, http, payload, b"\r\n\r\n"])) + packer.flush()


def parse_record(member: bytes) -> tuple[int | None, str, str, str | None, int, str, bytes | None]:
    """A row of RECORD; ValueError for a damaged record, or a response whose payload isn't what its digest says."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    full, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    named = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    page, kind = named(fields["WARC-Record-ID"]), fields["WARC-Type"]
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload is not what its digest says")
    refers_to = named(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return None if page == "null" else int(page), fields["WARC-Target-URI"], kind, refers_to, full, digest, payload if kind == "response" else None


@dataclass
class Archive:
    """Where an archive is, its captures, and the index files with their first keys, in order."""

    spark: SparkSession
    root: str
    captures: DataFrame
    parts: list[tuple[str, tuple]]


def _open(root: str, name: str) -> tuple[pafs.FileSystem, str]:
    files, base = pafs.FileSystem.from_uri(root)
    return files, f"{base}/{name}"


def _order(key: str, page_id: int | None) -> tuple:
    """As Spark sorts them, null first."""
    return (key, 0 if page_id is None else 1, page_id or 0)


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digests and the response's id of each distinct page that revisits another; pages: with its payload's digests."""
    large = materialize(pages.where(F.col("size") >= least).select("page_id", "size", "sha", "mix"), "payloads")
    same = ["size", "sha", "mix"]
    groups = large.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").drop("n")
    return large.join(groups, same).where("NOT page_id <=> top").distinct().select("page_id", *same, F.coalesce(F.col("top").cast("string"), F.lit("null")).alias("refers_to"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, block: int = BLOCK, part: int = PART, date: str = DATE) -> Archive:
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    rows = narrow(pages, page_id=id_col, url=url_col, payload=payload_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("mix"))
    again = materialize(revisits(rows, least), "revisits")
    a, b = rows.alias("a"), again.alias("b")
    match = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha") == F.col("b.sha")) & (F.col("a.mix") == F.col("b.mix")) & (F.col("a.size") == F.col("b.size"))
    told = a.join(b, match, "left").select("a.page_id", "a.url", F.when(F.col("b.refers_to").isNull(), F.col("a.payload")).alias("payload"), "a.size", "a.sha", "b.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, size, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE:
                        if out is not None:
                            out.close()
                        name, at = f"archive/{uuid.uuid4().hex}.warc.gz", 0
                        files, path = _open(root, name)
                        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = files.open_output_stream(path, compression=None)
                    member = record(page_id, url, payload, size, sha, refers_to, date)
                    out.write(member)
                    rows.append((reversed_key(url), page_id, name, at, len(member), "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield _batch(rows, CAPTURE_ARROW)
        finally:
            if out is not None:
                out.close()

    captures = materialize(told.mapInArrow(write, CAPTURE), "captures")
    return Archive(spark, root, captures, _write_index(captures, root, block, part))


CAPTURE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())])
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(lines: list[tuple]) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("".join("\t".join("" if v is None else str(v) for v in line) + "\n" for line in lines).encode()) + packer.flush()


def _unpack(data: bytes) -> list[tuple]:
    """Lines whose first two fields are a key and a page_id and all further ones numbers or names."""
    rows = [line.split("\t") for line in zlib.decompress(data, 31).decode().split("\n")[:-1]]
    return [(r[0], int(r[1]) if r[1] else None, *r[2:]) for r in rows]


def _write_index(captures: DataFrame, root: str, block: int, part: int) -> list[tuple[str, tuple]]:
    """Writes the index files; their names and first keys in order."""
    spark = captures.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        name = f"index/{uuid.uuid4().hex}.cdx.gz"
        files, path = _open(root, name)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        directory, lines, at = [], [first], 0
        with files.open_output_stream(path, compression=None) as out:

            def close() -> None:
                nonlocal at
                data = _pack(lines)
                out.write(data)
                directory.append((*lines[0][:2], at, len(data)))
                at += len(data)

            for r in rows:
                if len(lines) == block:
                    close()
                    lines = []
                lines.append(r)
            close()
            data = _pack(directory)
            out.write(data)
            out.write(struct.pack(TRAILER, at, len(data)))
        yield _batch([(name, *first[:2])], pa.schema([("file", pa.string()), ("key", pa.string()), ("page_id", pa.int64())]))

    order = ["key", "page_id", "file", "offset"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // part))
    parts = materialize(captures.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "file string, key string, page_id long"), "index-parts").collect()
    return sorted(((r["file"], _order(r["key"], r["page_id"])) for r in parts), key=lambda p: p[1])


class IndexFile:
    """The blocks of one index file, found by bisection of its directory; the last block stays unpacked."""

    def __init__(self, root: str, name: str):
        files, path = _open(root, name)
        self.file = files.open_input_file(path)
        size = self.file.size()
        at, length = struct.unpack(TRAILER, self.file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        self.directory = [(_order(*r[:2]), int(r[2]), int(r[3])) for r in _unpack(self.file.read_at(length, at))]
        self.firsts = [d[0] for d in self.directory]
        self.held, self.reads = (-1, [], []), 0

    def block(self, k: int) -> tuple[list[tuple], list[tuple]]:
        if self.held[0] != k:
            _, at, length = self.directory[k]
            rows = _unpack(self.file.read_at(length, at))
            self.held, self.reads = (k, rows, [_order(*r[:2]) for r in rows]), self.reads + 1
        return self.held[1:]

    def find(self, low: tuple, high: tuple) -> Iterator[tuple]:
        """The captures from low to high, both included."""
        k = max(0, bisect_left(self.firsts, low) - 1)
        while k < len(self.directory) and self.firsts[k] <= high:
            rows, keys = self.block(k)
            yield from rows[bisect_left(keys, low) : bisect_right(keys, high)]
            k += 1


def _bounds(key: str, page_id: int | None, whole: bool) -> tuple[tuple, tuple]:
    return ((key, 0, 0), (key, 2, 0)) if whole else (_order(key, page_id),) * 2


def lookup(archive: Archive, wanted: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """The captures of the URLs of wanted, or with id_col of (URL, page_id), each once however often it is asked for."""
    names, firsts, root = [p[0] for p in archive.parts], [p[1] for p in archive.parts], archive.root
    whole = id_col is None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = reversed_key(url)
                low, high = _bounds(key, page_id, whole)
                rows += [(k, key, page_id) for k in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))]
            yield _batch(rows, pa.schema([("part", pa.int32()), ("key", pa.string()), ("page_id", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = -1, None
        for batch in batches:
            found = []
            for k, key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != held:
                    held, index = k, IndexFile(root, names[k])
                for r in index.find(*_bounds(key, page_id, whole)):
                    found.append((*r[:3], int(r[3]), int(r[4]), r[5]))
                    if len(found) >= 10_000:
                        yield _batch(found, CAPTURE_ARROW)
                        found = []
            yield _batch(found, CAPTURE_ARROW)

    keys = wanted.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.lit(None).cast("long").alias("page_id") if whole else F.col(f"`{id_col}`").cast("long").alias("page_id"))
    dealt = keys.mapInArrow(deal, "part int, key string, page_id long").distinct()
    n = max(1, min(len(names), int(archive.spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "key", "page_id").mapInArrow(search, CAPTURE)


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records at the captures' places. A revisit has no payload; its size and digest are those of the full payload."""
    root = archive.root

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = "", None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(places):
                name, begin, length = places[at]
                end, after = begin + length, at + 1
                while after < len(places) and places[after][0] == name and places[after][1] <= end + GAP and places[after][1] + places[after][2] - begin <= RANGE:
                    end, after = max(end, places[after][1] + places[after][2]), after + 1
                if name != held:
                    files, path = _open(root, name)
                    held, source = name, files.open_input_file(path)
                data = memoryview(source.read_at(end - begin, begin))
                yield _batch([parse_record(data[o - begin : o - begin + n]) for _, o, n in places[at:after]], RECORD_ARROW)
                at = after

    near = F.floor(F.col("offset") / (2 * RANGE))
    n = int(archive.spark.conf.get("spark.sql.shuffle.partitions"))
    return captures.select("file", "offset", "length").repartition(n, "file", near).sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, of a revisit from the response that it names.

    A revisit without a response of that id and digest has null for the payload's bytes and digest.
    """
    facts = materialize(records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"), "records")
    own = facts.where("record_type = 'response'")
    named = own.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).distinct()
    revisit = facts.where("record_type = 'revisit'").withColumnRenamed("payload_digest", "digest").join(named, ["refers_to", "digest"], "left")
    digest = F.when(F.col("bytes").isNotNull(), F.col("digest"))
    columns = lambda size, digest, to: ("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", to.alias("refers_to"))
    named_page = F.when(F.col("refers_to") != "null", F.col("refers_to")).cast("long")
    return own.select(*columns(F.col("payload_bytes"), F.col("payload_digest"), F.lit(None).cast("long"))).unionByName(revisit.select(*columns(F.col("bytes"), digest, named_page)))
