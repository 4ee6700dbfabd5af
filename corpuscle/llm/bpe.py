"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the vocabulary's pattern. Each distinct word that is no token by itself becomes token-position rows; a
recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of minimum rank until
no pair is left. Decoding joins id-position rows with the vocabulary and aggregates the bytes in order.

One step of the query goes through all pairs of a word's minimum rank from the left. That is contracting the leftmost pair again and
again, because pairs of the new token have higher ranks: a token of lower rank over the same bytes would have been built
before, from inside them, and nothing across their ends was contracted so far. (This needs a vocabulary whose tokens encode
to themselves, as merges learnt in the order of their ranks do.) So words of any length take the same query.

Null and empty texts have no tokens and decode to no bytes. Rows are independent, so repeated rows and repeated ids give
repeated results, an empty table an empty one, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuscle.llm.common import CHUNK, by_bytes, hold_cache, narrow, no_collection

#: Rows that one recursive query may pile up, entries of each cache, characters and ids that are handled at once.
MAX_ROWS, CACHE, CHARS, IDS = 6_000_000, 700_000, 3_000_000, 1_000_000

#: One step: in each word the leftmost pair of minimum rank is contracted, then the next one of that rank to its right that
#: doesn't overlap it, and so on to the word's end (hit: such pairs; place: how many overlap in a row before it; take: every second of those).
#: Places (p) are unique over all words; a row knows the place and the id of the next one in its word (np, nid) and the rank of its pair (k).
_STEP = """
with recursive s(step, w, p, np, id, nid, k) as (
  select 0, t.w, t.p, t.np, t.id, t.nid, m.k from tokens t left join merges m on m.l = t.id and m.r = t.nid
  union all
  (with low as (select w, min(k) as k from s where k is not null group by w),
  hit as (select s.p, s.np, s.k, row_number() over (order by s.p) as n, lag(s.np, 1, -1) over (order by s.p) = s.p as linked from s join low using (w, k)),
  run as (select p, np, k, n - max(case when linked then 0 else n end) over (order by p) as place from hit),
  take as (select r.p, r.np, r.k, e.np as nnp, e.nid as nnid from run r join s e on e.p = r.np where place % 2 = 0),
  act as (select p, k, nnp, nnid from take union all select np, -1, 0, 0 from take),
  done as (
    select s.step + 1 as step, s.w, s.p, coalesce(a.nnp, s.np) as np, coalesce(a.k, s.id) as id, coalesce(a.nnid, s.nid) as nid, s.k, a.k is not null as new
    from s join low using (w) left join act a on a.p = s.p where s.step < {steps} and coalesce(a.k, 0) >= 0),
  near as (select d.step, d.w, d.p, d.np, d.id, coalesce(c.k, d.nid) as nid, d.k, d.new or c.k is not null as new from done d left join take c on c.p = d.np)
  select step, w, p, np, id, nid, case when new then m.k else near.k end
  from near left join merges m on m.l = (case when new then id else -1 end) and m.r = nid)
)
select s.w, s.p, s.id, s.k from s join (select w, max(step) as step from s group by w) using (w, step) order by w, p"""


def _with_next(w: np.ndarray, p: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Token-position rows and the next row of the same word, -1 after the last."""
    n = len(w)
    last = np.r_[w[1:] != w[:-1], True][:n]
    after = lambda x: np.where(last, -1, np.r_[x[1:], -1][:n]).astype(np.int32)
    return pa.table({"w": w, "p": p, "np": after(p), "id": ids, "nid": after(ids)})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one rank file in one DuckDB connection of one thread and bounded memory."""

    def __init__(self, path: str, pattern: str):
        self.cache, self.max_rows = CACHE, MAX_ROWS
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir()})
        self.base = np.zeros(256, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.base[token[0]] = rank
        splits = np.array(self._splits(), np.int32).reshape(-1, 3)
        self.db.register("_m", pa.table({c: splits[:, k] for k, c in enumerate("lrk")}))
        self.db.execute("create table merges as select * from _m")
        self.db.unregister("_m")
        self.db.register("_v", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "b": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("create table vocab as select * from _v")
        self.db.unregister("_v")

    def _splits(self) -> list[tuple[int, int, int]]:
        """Every way in which two tokens make a third."""
        get = self.ranks.get
        return [(a, b, k) for token, k in self.ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        tokens = _with_next(np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in words]), np.arange(len(flat), dtype=np.int32), self.base[flat])
        while tokens.num_rows:
            self.db.register("tokens", tokens)
            got = self.db.sql(_STEP.format(steps=max(8, self.max_rows // tokens.num_rows))).to_arrow_table()
            self.db.unregister("tokens")
            w, ids, open_ = got["w"].to_numpy(), got["id"].to_numpy().astype("<u4"), np.unique(got.filter(got["k"].is_valid())["w"].to_numpy())
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            data = ids.tobytes()
            for word, a, b in zip(w[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(w)], strict=True):
                out[word] = data[4 * a : 4 * b]
            rest = np.isin(w, open_)  # steps ran out: go on from there
            tokens = _with_next(w[rest], got["p"].to_numpy()[rest], got["id"].to_numpy()[rest])
        return out

    def _encode_words(self, words: list[str]) -> None:
        part = []
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.words[word] = whole.to_bytes(4, "little")
            else:
                part.append((word, raw))
        while part:
            size, n = 0, 0
            while n < len(part) and (not n or size + len(part[n][1]) <= self.max_rows // 12):
                size, n = size + len(part[n][1]), n + 1
            self.words.update(zip((x for x, _ in part[:n]), self._merge([x for _, x in part[:n]]), strict=True))
            part = part[n:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for cache in (self.chunks, self.words):
            if len(cache) > self.cache:
                cache.clear()
        cut = [CHUNK.findall(t) for t in texts]
        words = {c: self.pattern.findall(c) for c in set(chain.from_iterable(cut)) if c not in self.chunks}
        self._encode_words([w for w in set(chain.from_iterable(words.values())) if w not in self.words])
        get = self.words.__getitem__
        self.chunks.update((c, b"".join(map(get, w))) for c, w in words.items())
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids; an id outside the vocabulary is an error."""
        out, at = [b""] * len(encoded), 0
        while at < len(encoded):
            n, size = at, 0
            while n < len(encoded) and (n == at or size + len(encoded[n]) // 4 <= IDS):
                size, n = size + len(encoded[n]) // 4, n + 1
            ids = np.frombuffer(b"".join(encoded[at:n]), "<u4").astype(np.int32)
            d = np.repeat(np.arange(at, n, dtype=np.int32), [len(x) // 4 for x in encoded[at:n]])
            self.db.register("tokens", pa.table({"d": d, "p": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = self.db.sql("select d, string_agg(b, '' order by p) as s, count(*) as n from tokens join vocab using (id) group by d").to_arrow_table()
            self.db.unregister("tokens")
            if sum(got["n"].to_pylist()) != len(ids):
                raise ValueError("an id is not in the vocabulary")
            for k, s in zip(got["d"].to_pylist(), got["s"].to_pylist(), strict=True):
                out[k] = s.encode("latin-1")
            at = n
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker; its caches are bounded and outlive a task."""
    hold_cache("bpe", _CODECS.clear)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep: int, cache: int = CACHE, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    own.cache, own.max_rows = cache, 2 * chars
    for batch in batches:
        at = 0
        for texts in by_bytes(batch.column(keep).to_pylist(), chars):
            with no_collection():
                encoded = own.encode(texts)
            rows = batch.slice(at, len(texts))
            yield pa.record_batch([*rows.columns[:keep], pa.array(encoded, pa.binary()), pa.array([len(x) // 4 for x in encoded], pa.int64())], names=[*rows.schema.names[:keep], "ids", "n_tokens"])
            at += len(texts)


def encode_texts(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), cache: int = CACHE, chars: int = CHARS) -> DataFrame:
    """The columns keep, then ids (binary: little-endian unsigned 32-bit integers) and n_tokens.

    cache (entries) and chars (handled at once) bound a Python worker's memory, about 600 MB as they are; less costs time only.
    """
    given = narrow(df, **{c: c for c in keep}, **{"_llm_text": text_col})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "ids binary", "n_tokens bigint"])
    return given.mapInArrow(partial(_encode, path=vocab_path, pattern=pattern, keep=len(keep), cache=cache, chars=chars), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep: int) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in batches:
        decoded = own.decode([x or b"" for x in batch.column(keep).to_pylist()])
        yield pa.record_batch([*batch.columns[:keep], pa.array(decoded, pa.binary())], names=[*batch.schema.names[:keep], "decoded"])


def decode_ids(df: DataFrame, vocab_path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then decoded (binary)."""
    given = narrow(df, **{c: c for c in keep}, **{"_llm_ids": ids_col})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "decoded binary"])
    return given.mapInArrow(partial(_decode, path=vocab_path, pattern=pattern, keep=len(keep)), schema)


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in _encode(batches, path, pattern, 1):
        ids = batch.column(1).to_pylist()
        back = codec(path, pattern).decode(ids)
        hexes = [[hashlib.sha256(x).hexdigest() for x in part] for part in (ids, back)]
        yield pa.record_batch([batch.column(0), batch.column(2), *map(pa.array, hexes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids of each whole text and of the bytes that they decode to."""
    given = narrow(df, doc_id=id_col, text=text_col)
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(partial(_digest, path=vocab_path, pattern=pattern), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
