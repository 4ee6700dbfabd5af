"""N-gram Jaccard self-join of whole texts with Bayesian candidate pruning.

Texts are sets of n-grams (five words, lower-cased). Texts with one set are copies: one class from the start. For each set 96
MinHash values make 24 bands of four; sets that agree in a band are candidates (a pair of similarity 0.8 is missed with
probability 3e-6, one of 0.85 with 2e-8). Bands with the same members count once. The members of a band are dealt to blocks, and each pair
of blocks is one group of rows, so a band of any size spreads over many tasks and no pair becomes a row. In a group, a pair is looked
at only in the first band that it shares; its MinHash values are compared 16 at a time, and it is dropped as soon as the
posterior probability (uniform prior) of reaching the threshold falls below the tolerance; all that stay are verified
exactly on their n-grams. A group gives each text its number of links and a root of its links. Classes are
the connected components of all roots, by alternating large-star and small-star steps on tables in the shared folder.

Texts of one to four words are one n-gram, and so is a text of other characters than words have; null, empty and blank texts
are linked to nothing, each its own class. A class is named by its least document id. Repeated rows are copies; null ids
get the class of their text; an empty table gives an empty one; other columns are not read (join) or carried along
(dedupe), whatever their names. Each row is written with a number of its own, by which one row stands for a set of copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.common import by_bytes, discard, hold_cache, join_counted, materialize, narrow, unused

TOKEN = re.compile(r"\w+")
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
#: Members of a band in a block and about their bytes, characters at once, entries of the cache of word hashes, columns of a dense product.
BLOCK, BLOCK_BYTES, CHARS, CACHE, COLUMNS = 512, 8_000_000, 2_000_000, 400_000, 4096
_MIX, _FACTOR = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93

_seeds = np.random.default_rng(20240229)
_A = _seeds.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _seeds.integers(0, 1 << 63, HASHES, np.uint64)
_WORDS: dict[str, int] = {}


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each whole text."""
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    cut = [TOKEN.findall(t.lower()) for t in texts]
    flat = list(chain.from_iterable(cut))
    for w in [w for w in set(flat) if w not in _WORDS]:
        _WORDS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    words = np.fromiter(map(_WORDS.__getitem__, flat), np.uint64, len(flat))
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(_FACTOR) + words[k : k + len(grams)]
        grams = (grams ^ (grams >> np.uint64(32))) * _MIX
    out, at = [], 0
    for c, text in zip(cut, texts, strict=True):
        if len(c) >= n:
            out.append(np.unique(grams[at : at + len(c) - n + 1]))
        else:
            short = " ".join(c) or text.strip()
            out.append(np.array([xxhash.xxh64_intdigest(short.encode("utf-8", "surrogatepass"))] if short else [], np.uint64))
        at += len(c)
    return out


def minhash(grams: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), 1024):
            np.minimum(best, ((grams[a : a + 1024] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(1), out=best)
    return best


def _sign(batches: Iterator[pa.RecordBatch], at: int, names: tuple[str, ...], n: int) -> Iterator[pa.RecordBatch]:
    """Each row with s0, s1 (its set) and sig."""
    hold_cache("ngrams", _WORDS.clear)
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column(at).to_pylist(), CHARS):
            keys, sigs = [], []
            for grams in ngram_sets(texts, n):
                if len(grams):
                    h = xxhash.xxh3_128_intdigest(grams.tobytes())
                    keys.append(((h >> 65), h & (2**63 - 1)))
                    sigs.append(minhash(grams).tobytes())
                else:
                    keys.append((None, None))
                    sigs.append(None)
            rows = batch.slice(done, len(texts))
            yield pa.record_batch([*rows.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sigs, pa.binary())], names=[*rows.schema.names, *names])
            done += len(texts)
    _WORDS.clear()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each n the least matches of n values with which P(similarity >= threshold) is at least tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)) if threshold < 1 else float(m > n)
        out.append(min(m, n))
    return out


def candidate_pairs(sigs: np.ndarray, first: np.ndarray, second: np.ndarray | None, band: int, least: list[int]) -> list[tuple[int, np.ndarray]]:
    """For each row of first the later rows (or rows of second) that share no earlier band and survive the pruning."""
    out = []
    for k, i in enumerate(first.tolist()):
        other = first[k + 1 :] if second is None else second
        if not len(other):
            continue
        same = sigs[other, : band * ROWS] == sigs[i, : band * ROWS]
        if band:
            other = other[~same.reshape(len(other), band, ROWS).all(2).any(1)]
        matches = np.zeros(len(other), np.int64)
        for n in range(0, HASHES, STEP):
            if not len(other):
                break
            matches += (sigs[other, n : n + STEP] == sigs[i, n : n + STEP]).sum(1)
            alive = matches >= least[n + STEP]
            other, matches = other[alive], matches[alive]
        if len(other):
            out.append((i, other))
    return out


def verify(sets: list[np.ndarray | None], pairs: list[tuple[int, np.ndarray]], threshold: float) -> list[tuple[int, np.ndarray]]:
    """The pairs whose exact similarity reaches threshold."""
    size = np.array([0 if s is None else len(s) for s in sets], np.int64)

    def similar(i: int, other: np.ndarray, both: np.ndarray) -> np.ndarray:
        return other[both >= threshold * (size[i] + size[other] - both) - 1e-9]

    if sum(len(o) for _, o in pairs) <= 4 * len(sets):
        return [(i, similar(i, other, np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other.tolist()]))) for i, other in pairs]
    # many pairs of few texts: inner products of rows that tell which n-grams are in a text; those of one text don't count
    used = [k for k, s in enumerate(sets) if s is not None]
    row = np.zeros(len(sets), np.int64)
    row[used] = np.arange(len(used))
    values, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(used)), size[used])
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    rows, column = rows[keep], shared[column[keep]]
    product = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        dense = np.zeros((len(used), COLUMNS), np.float32)
        dense[rows[x:y], column[x:y] - a] = 1
        product += dense @ dense.T
    return [(i, similar(i, other, product[row[i], row[other]].astype(np.int64))) for i, other in pairs]


def _group(rows: list[tuple], n: int, threshold: float, least: list[int]) -> list[tuple[str, str, int]]:
    """Rows of one pair of blocks (band, block 1, block 2, own block, id, sig, text): id, root and links of the linked."""
    rows = list({r[4]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    band, low, high = rows[0][:3]
    sigs = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), HASHES)
    own = np.array([r[3] for r in rows])
    first, second = np.flatnonzero(own == low), None if low == high else np.flatnonzero(own == high)
    pairs = candidate_pairs(sigs, first, second, band, least)
    if not pairs:
        return []
    sets: list[np.ndarray | None] = [None] * len(rows)
    needed = sorted({i for i, _ in pairs} | set(chain.from_iterable(o.tolist() for _, o in pairs)))
    for k, s in zip(needed, ngram_sets([rows[k][6] or "" for k in needed], n), strict=True):
        sets[k] = s
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, other in verify(sets, pairs, threshold):
        links[i] += len(other)
        for j in other.tolist():
            links[j] += 1
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(r[4], rows[find(k)][4], links[k]) for k, r in enumerate(rows) if links[k]]


def _link(batches: Iterator[pa.RecordBatch], n: int, threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """In, sorted by the first four: band, key, block 1, block 2, own block, id, sig, text. Out: id, root, links."""
    hold_cache("ngrams", _WORDS.clear)
    least = least_matches(threshold, tolerance)
    at, rows, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], []]
        out.clear()
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["id", "root", "links"])

    for batch in batches:
        for band, key, low, high, own, name, sig, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (band, key, low, high):
                out += _group(rows, n, threshold, least)
                at, rows = (band, key, low, high), []
            rows.append((band, low, high, own, name, sig, text))
        yield flush()
    out += _group(rows, n, threshold, least)
    _WORDS.clear()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """id and root (the least id of its component) for each id of edges (columns id, root: the two ends).

    A step's table goes when the next one is written.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Links the neighbours of each id, those above it or else it and those below, with the least of them all."""
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
        total = least.agg(F.sum("n")).first()[0] or 0
        low = least.withColumn("m", F.least("a", "m"))
        joined = join_counted(near, low, ["a"], "n", total)
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        out = materialize(out.where("a <> b").distinct(), "edges")
        discard(least, e)
        return out

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(edges.select(F.greatest("id", "root").alias("a"), F.least("id", "root").alias("b")).where("a <> b").distinct(), "edges")
    before, after = None, mark(now)
    while before != after:
        now = star(star(now, True), False)
        before, after = after, mark(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _classes(docs: DataFrame, n: int, threshold: float, tolerance: float) -> tuple[DataFrame, list[str], DataFrame]:
    """The rows of docs with the number of each and its set, and the names of these columns (rid, s0, s1); and for each set
    its class (class_id, keeper: the row that stands for the class), links and copies."""
    names = unused(docs, "rid", "s0", "s1", "sig")
    numbered = docs.withColumn(names[0], F.monotonically_increasing_id())
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in numbered.schema.fields), *(T.StructField(c, t) for c, t in zip(names[1:], (T.LongType(), T.LongType(), T.BinaryType()), strict=True))])
    signed = materialize(numbered.mapInArrow(partial(_sign, at=docs.columns.index("text"), names=tuple(names[1:]), n=n), schema), "signed")
    rows = narrow(signed, doc_id="doc_id", text="text", **dict(zip(("rid", "s0", "s1", "sig"), names, strict=True))).where("s0 is not null")
    name = F.concat(F.lpad(F.hex("s0"), 16, "0"), F.lpad(F.hex("s1"), 16, "0"))
    sets = rows.groupBy("s0", "s1").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("rep"), F.min("sig").alias("sig"), F.max(F.octet_length("text")).alias("size"))
    sets = materialize(sets.select(name.alias("id"), "s0", "s1", "copies", "rep", "sig", "size"), "sets")
    bands = sets.select("s0", "s1", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 4 * ROWS + 1, 4 * ROWS)))).alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor("s0").alias("x"), F.bit_xor("s1").alias("y")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("at.size") / BLOCK_BYTES)).cast("int")
    kept = materialize(full.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key", "size")).alias("at")).select("at.band", "at.key", "n", blocks.alias("blocks")), "bands")
    total = kept.agg(F.sum("n")).first()[0] or 0
    members = join_counted(bands.select("s0", "s1", "band", "key"), kept, ["band", "key"], "n", total)
    members = materialize(members.select(name.alias("id"), "band", "key", "blocks", F.pmod(F.xxhash64("s0", "s1"), "blocks").cast("int").alias("own")), "members")
    needed = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "sig", F.col("rep.rid").alias("rid"))
    loaded = needed.join(rows.select("rid", "text"), "rid").select("id", "sig", "text")
    dealt = members.join(loaded, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "sig", "text")
    dealt = dealt.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")
    linked = materialize(dealt.mapInArrow(partial(_link, n=n, threshold=threshold, tolerance=tolerance), "id string, root string, links bigint"), "links")
    discard(members, kept)
    roots = components(linked)
    links = linked.groupBy("id").agg(F.sum("links").alias("n_links"))
    named = sets.select("id", "s0", "s1", "copies", "rep").join(roots, "id", "left").join(links, "id", "left")
    named = materialize(named.select(F.coalesce("root", "id").alias("root"), "s0", "s1", "copies", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"), F.min("rep").alias("keeper"), F.count("*").alias("n"))
    least = materialize(least, "classes")
    total = least.agg(F.sum("n")).first()[0] or 0
    return signed, names[:3], join_counted(named, least, ["root"], "n", total).select("s0", "s1", "copies", "n_links", "class_id", F.col("keeper.rid").alias("keeper"))


def join_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """For each row doc_id, class_id, n_links (other texts with similarity of at least threshold) and n_copies (rows with its set)."""
    signed, _, classes = _classes(narrow(docs, doc_id="doc_id", text="text"), n, threshold, tolerance)
    classes = materialize(classes, "joined")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    some = join_counted(signed.where("s0 is not null").select("doc_id", "s0", "s1"), classes, ["s0", "s1"], "copies", total)
    none = signed.where("s0 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return some.select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies")).unionByName(none)


def dedupe(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """The rows of docs, with all columns, of which each class keeps the one of least id; null, empty and blank texts stay."""
    signed, (rid, s0, _), classes = _classes(docs, n, threshold, tolerance)
    keepers = classes.select(F.col("keeper").alias(rid)).distinct()
    kept = signed.where(F.col(s0).isNotNull()).join(keepers, rid, "left_semi").unionByName(signed.where(F.col(s0).isNull()))
    return kept.select(*(f"`{c}`" for c in docs.columns))
