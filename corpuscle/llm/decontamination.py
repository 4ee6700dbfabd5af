"""Benchmark decontamination by greedy string tiling.

Texts and items are lower-cased word sequences (a Han or Kana character is a word), words stand as 64-bit hashes. Windows of MIN_TILE words are the
seeds. A bitmap of the items' seeds, of bounded size whatever their number, tells in one pass over the texts which windows
may be shared; what is left of a text are its runs of such windows, which hold all its tiles. Texts with the same runs are
one class from then on, so a passage that many texts share is looked at once. Classes and items are joined on their seeds;
an item's most frequent seeds are left out as long as a covered item must share another one, which loses no pair. A class that
shares seeds with many items goes to many tasks, each with some of the items, and an item is compared with the words alone that lie
in windows it has itself. The bitmap has 2 ** MOST_BITS bits at most; beyond some four million seeds it lets more words through,
which costs time and changes nothing. Running Karp-Rabin then finds the longest matches of unmarked words of each joined pair, marks them, and repeats, so that passages in
another order still count. An item is leaked into a text if its tiles cover at least `coverage` of it.

Neither items nor texts are collected: tables are joined, and broadcast only below BROADCAST rows or bytes, as counted.

Null and empty texts, and items of fewer than MIN_TILE words, match nothing. Repeated rows and items give repeated
results; empty tables give an empty result; other columns are not read (find_leaks) or carried along (drop_leaks),
whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.common import HOT, by_bytes, hold_cache, join_counted, materialize, narrow, unused

#: Hiragana, Katakana and Han, written without spaces.
_ALONE = "぀-ヿ㐀-鿿"
TOKEN, _PLAIN, _SOME = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+"), re.compile(r"\w+"), re.compile(f"[{_ALONE}]")
MIN_TILE, COVERAGE = 5, 0.6
#: Rows, or bytes, of a table up to which it is broadcast; bits of the bitmap for each seed, and at least and most (as powers of two).
BROADCAST_ROWS, BROADCAST_BYTES, BITS_PER_SEED, LEAST_BITS, MOST_BITS = 1_000_000, 32_000_000, 16, 12, 26
#: Items of one class that are tiled in one task.
PART_ITEMS = 500
#: Characters at once, entries of the cache of word hashes.
CHARS, CACHE = 2_000_000, 400_000
BASE = 0x9E3779B97F4A7C15
_PROBES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_WORDS: dict[str, int] = {}


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, none of them 0, and the number of words of each text."""
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    cut = [(_PLAIN if t.isascii() or not _SOME.search(t) else TOKEN).findall(t.lower()) for t in texts]
    flat = list(chain.from_iterable(cut))
    for w in [w for w in set(flat) if w not in _WORDS]:
        _WORDS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
    return np.fromiter(map(_WORDS.__getitem__, flat), np.uint64, len(flat)), np.fromiter(map(len, cut), np.int64, len(cut))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash (mod 2**64) of each window of size ids, equal wherever equal windows stand.

    It is rolled for all windows at once: the hash of a window is built from those of its halves, so doubling takes
    log2(size) steps.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, factor = np.zeros(len(ids) + 1, np.uint64), 0, ids.astype(np.uint64) + np.uint64(1), np.uint64(BASE)
        span = 1  # power holds the hashes of windows of span ids, factor is BASE ** span
        for bit in range(size.bit_length()):
            if size >> bit & 1:
                m = len(ids) - (done + span) + 1
                out = out[:m] * factor + power[done : done + m]
                done += span
            if size >> (bit + 1):
                m = len(ids) - 2 * span + 1
                power = power[:m] * factor + power[span : span + m]
                span, factor = 2 * span, factor * factor
    return out[:n]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Which windows have no marked word."""
    sums = np.r_[0, np.cumsum(marked)]
    return sums[size:] == sums[:-size]


def _matches(item: np.ndarray, text: np.ndarray, used: np.ndarray, seen: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, place in item, place in text) of each free match of at least size words that can't be made longer."""
    places, found = defaultdict(list), []
    own, other = window_hashes(item, size), window_hashes(text, size)
    for i in np.flatnonzero(_free(used, size)).tolist():
        places[int(own[i])].append(i)
    for j in np.flatnonzero(np.isin(other, np.array(list(places), np.uint64)) & _free(seen, size)).tolist():
        for i in places[int(other[j])]:
            if i and j and item[i - 1] == text[j - 1] and not used[i - 1] and not seen[j - 1]:
                continue  # inside a match that starts further left
            most = min(len(item) - i, len(text) - j)
            apart = (item[i : i + most] != text[j : j + most]) | used[i : i + most] | seen[j : j + most]
            n = int(apart.argmax()) if apart.any() else most
            if n >= size:
                found.append((-n, i, j))
    return found


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length): each is the longest match of words that no tile before it holds, of
    equally long ones that of least place in the item, then in the text.

    Search lengths halve. A queued match that a tile took words of goes back as its free parts, each in its new place in
    the order, so whatever leaves the queue whole is the longest there is.
    """
    tiles: list[tuple[int, int, int]] = []
    used, seen = np.zeros(len(item), bool), np.zeros(len(text), bool)
    size = min(len(item), len(text))
    free = len(item)
    while min(free, size) >= min_tile:
        queue = _matches(item, text, used, seen, size)
        heapq.heapify(queue)
        while queue and free >= size:
            n, i, j = heapq.heappop(queue)
            taken = used[i : i - n] | seen[j : j - n]
            if not taken.any():
                used[i : i - n] = seen[j : j - n] = True
                tiles.append((i, j, -n))
                free += n
                continue
            edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, j + a))
        size = max(size // 2, min_tile) if size > min_tile else 0
    return tiles


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of places in a bitmap of 2 ** bits for each probe."""
    with np.errstate(over="ignore"):
        return (hashes * _PROBES[:, None]) >> np.uint64(64 - bits)


def _in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes may be seeds."""
    out = np.ones(len(hashes), bool)
    for at in _probes(hashes, int(len(bitmap) * 64).bit_length() - 1):
        out &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _runs(batches: Iterator[pa.RecordBatch], at: int, name: str, keep: tuple[str, ...], min_tile: int, bitmap) -> Iterator[pa.RecordBatch]:
    """The columns keep and the words of a row's runs of known windows (binary; a 0 between runs), null without one."""
    hold_cache("tiling", _WORDS.clear)
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column(at).to_pylist(), CHARS):
            flat, n = word_hashes(texts)
            ends = np.cumsum(n)
            known = np.zeros(len(flat) + 1, np.int64)
            hashes = window_hashes(flat, min_tile)
            text = np.repeat(np.arange(len(n)), n)
            places = np.flatnonzero(_in_bitmap(hashes, bitmap.value))
            places = places[text[places] == text[places + min_tile - 1]]
            np.add.at(known, places, 1)
            np.add.at(known, places + min_tile, -1)
            known = np.cumsum(known)[:-1] > 0
            out: list[bytes | None] = [None] * len(texts)
            for k in np.unique(text[places]).tolist():
                a, b = int(ends[k] - n[k]), int(ends[k])
                own = known[a:b]
                out[k] = np.where(own, flat[a:b], np.uint64(0))[own | np.r_[False, own[:-1]]].tobytes()
            rows = batch.slice(done, len(texts))
            yield pa.record_batch([*(rows.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, name])
            done += len(texts)


def _items(batches: Iterator[pa.RecordBatch], min_tile: int) -> Iterator[pa.RecordBatch]:
    """In: item_id, text. Out: item_id, words, of items that are long enough."""
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column(1).to_pylist(), CHARS):
            flat, n = word_hashes(texts)
            ends = np.cumsum(n)
            keep = np.flatnonzero(n >= min_tile).tolist()
            yield pa.record_batch([batch.column(0).slice(done, len(texts)).take(pa.array(keep, pa.int64())), pa.array([flat[ends[k] - n[k] : ends[k]].tobytes() for k in keep], pa.binary())], names=["item_id", "words"])
            done += len(texts)
    _WORDS.clear()


def _seeds(batches: Iterator[pa.RecordBatch], min_tile: int) -> Iterator[pa.RecordBatch]:
    """In: key, words. Out: key, words' number, hash and places of each distinct window that lies in a run."""
    for batch in batches:
        own = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)]
        for words in batch.column(1).to_pylist():
            ids = np.frombuffer(words, np.uint64)
            own.append((*np.unique(window_hashes(ids, min_tile)[_free(ids == 0, min_tile)], return_counts=True), len(ids)))
        hashes, places, sizes = (list(x) for x in zip(*own, strict=True))
        n = [len(h) for h in hashes]
        rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)) - 1, n)))
        yield pa.record_batch([rows, pa.array(np.repeat(sizes, n)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places))], names=["key", "n_words", "h", "places"])


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """In: h. Out: the words of the bitmap that these hashes set."""
    for batch in batches:
        at = _probes(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
        word, place = np.unique(at >> np.uint64(6), return_inverse=True)
        value = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(value, place, np.uint64(1) << (at & np.uint64(63)))
        yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])


class Shared:
    """A class's words with its windows in order, so that what an item shares is found without a walk over the text."""

    def __init__(self, text: np.ndarray, min_tile: int):
        self.text, self.min_tile = text, min_tile
        hashes = window_hashes(text, min_tile)
        self.places = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.places]

    def part(self, item: np.ndarray) -> tuple[np.ndarray, int]:
        """The words that lie in windows of the item, a 0 between stretches of them, and how many of the item's words lie in windows of the text.

        All words of a match lie in such windows, and stretches keep their order, so an item's tiles in the part are those in the text.
        """
        own = window_hashes(item, self.min_tile)
        low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        mine = np.flatnonzero(high > low)
        steps = np.arange(self.min_tile)
        known = len(np.unique(mine[:, None] + steps))
        _, first = np.unique(own[mine], return_index=True)
        at = [self.places[low[k] : high[k]] for k in mine[first].tolist()]
        words = np.unique((np.concatenate(at)[:, None] + steps).ravel()) if at else np.zeros(0, np.int64)
        apart = np.flatnonzero(np.diff(words) > 1) + 1
        return np.insert(self.text[words], apart, np.uint64(0)), known


def _tiled(batches: Iterator[pa.RecordBatch], min_tile: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """In, sorted by key, part and form: key, part, form, words; a class's own row (form null) stands before its items. Out: the leaks."""
    shared = None
    for batch in batches:
        out = []
        for key, form, words in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            ids = np.frombuffer(words, np.uint64)
            if form is None:
                shared = Shared(ids, min_tile)
                continue
            text, known = shared.part(ids)
            if known < coverage * len(ids):
                continue
            tiles = tile(ids, text, min_tile)
            size = sum(n for *_, n in tiles)
            if size >= coverage * len(ids):
                out.append((key, form, size / len(ids), size, len(tiles)))
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["key", "form", "coverage", "matched_words", "n_tiles"])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the seeds (column h): at most 2 ** MOST_BITS bits come to the driver, whatever there is."""
    n = max(1, seeds.count())
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_SEED - 1).bit_length()))
    words = seeds.select("h").mapInArrow(partial(_bits, bits=bits), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _join_seeds(classes: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """key and form of each class and item that share a seed. A hot seed's classes are dealt over as many parts as it is hot."""
    if seeds.count() <= limit:
        return classes.select("key", "h").join(F.broadcast(seeds.select("h", "form")), "h").select("key", "form").distinct()
    total = seeds.select("h", "times").distinct().agg(F.sum("times")).first()[0] or 0
    parts = F.floor(F.col("times") * HOT / F.lit(max(total, 1))).cast("int") + 1
    hot = seeds.select("h", parts.alias("parts")).where("parts > 1").distinct()  # at most HOT rows
    left = classes.select("key", "h").join(F.broadcast(hot), "h", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int"))
    right = seeds.select("h", "form", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(right, ["h", "part"]).select("key", "form").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, text_col: str, keep: list[str], min_tile: int, coverage: float, limit: int) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """The columns keep of docs with the class of their runs (null without one) and its name; the leaks of
    each class (key, n rows, form, coverage, matched_words, n_tiles); and the items (item_id, form)."""
    spark = docs.sparkSession
    own = narrow(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialize(own.mapInArrow(partial(_items, min_tile=min_tile), "item_id bigint, words binary").withColumn("form", F.md5("words")), "items")
    forms = materialize(items.groupBy("form").agg(F.first("words").alias("words")), "forms")
    seeds = materialize(forms.select("form", "words").mapInArrow(partial(_seeds, min_tile=min_tile), "form string, n_words bigint, h bigint, places bigint"), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds.select("h").distinct()))

    words, key = unused(docs, "words", "key")
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField(words, T.BinaryType())])
    marked = docs.mapInArrow(partial(_runs, at=docs.columns.index(text_col), name=words, keep=tuple(keep), min_tile=min_tile, bitmap=bitmap), schema)
    marked = materialize(marked.withColumn(key, F.md5(words)), "marked")
    classes = marked.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(words).alias("words"))
    classes = materialize(classes.groupBy("key").agg(F.first("words").alias("words"), F.count("*").alias("n")), "classes")

    shared = classes.select("key", "words").mapInArrow(partial(_seeds, min_tile=min_tile), "key string, n_words bigint, h bigint, places bigint")
    shared = materialize(shared.join(F.broadcast(seeds.select("h").distinct()), "h", "left_semi") if seeds.count() <= limit else shared, "shared")
    times = shared.groupBy("h").agg(F.count("*").alias("times"))
    # tiles on W words have W / min_tile windows or more, so one of the rest is shared too if fewer than these are left out
    spare = F.ceil(F.ceil(F.col("n_words") * coverage) / min_tile) - 1
    before = F.sum("places").over(Window.partitionBy("form").orderBy(F.desc("times"), "h"))
    kept = materialize(seeds.join(times, "h").withColumn("before", before).where(F.col("before") > spare).select("h", "form", "times"), "kept")
    pairs = materialize(_join_seeds(shared, kept, limit), "pairs")

    per = materialize(pairs.groupBy("form").agg(F.count("*").alias("n")), "counts")
    size = forms.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    total = per.agg(F.sum("n")).first()[0] or 0
    joined = pairs.join(F.broadcast(forms), "form") if size <= BROADCAST_BYTES else join_counted(pairs, forms.join(per, "form"), ["form"], "n", total)
    # a class with many items is dealt to parts of about PART_ITEMS, and its words go to each
    deal = pairs.groupBy("key").agg((F.floor((F.count("*") - 1) / PART_ITEMS) + 1).cast("int").alias("parts"))
    own = classes.select("key", "words").join(deal, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("form"), "words")
    items_of = joined.join(deal, "key").select("key", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int").alias("part"), "form", "words")
    rows = own.unionByName(items_of).repartition("key", "part").sortWithinPartitions("key", "part", F.asc_nulls_first("form"))
    found = rows.mapInArrow(partial(_tiled, min_tile=min_tile, coverage=coverage), "key string, form string, coverage double, matched_words bigint, n_tiles bigint")
    return marked, key, materialize(found.join(classes.select("key", "n"), "key"), "leaks"), items.select("item_id", "form")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, coverage, matched_words and n_tiles of each leaked item; clean documents have no row."""
    given = narrow(docs, doc_id="doc_id", text=text_col)
    marked, key, leaks, items = _leaks(given, benchmark, "text", ["doc_id"], min_tile, coverage, limit)
    # as many leaks as one text can hold stand beside each class
    by_class = leaks.groupBy("key", "n").agg(F.collect_list(F.struct("form", "coverage", "matched_words", "n_tiles")).alias("leaks"))
    total = by_class.agg(F.sum("n")).first()[0] or 0
    suspects = marked.where(F.col(key).isNotNull()).select("doc_id", F.col(key).alias("key"))
    found = join_counted(suspects, by_class, ["key"], "n", total).select("doc_id", F.inline("leaks"))
    named = F.broadcast(items) if items.count() <= limit else items
    return found.join(named, "form").select("doc_id", "item_id", "coverage", "matched_words", "n_tiles")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_tile: int = MIN_TILE, coverage: float = COVERAGE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all columns, into which no item is leaked. Only rows with known windows are joined."""
    marked, key, leaks, _ = _leaks(docs, benchmark, text_col, docs.columns, min_tile, coverage, limit)
    leaked = leaks.select(F.col("key").alias(key), "n").distinct()
    total = leaked.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= total
    some = marked.where(F.col(key).isNotNull()).join(F.broadcast(leaked.where(hot).select(key)), key, "left_anti").join(leaked.where(~hot).select(key), key, "left_anti")
    return marked.where(F.col(key).isNull()).unionByName(some).select(*(f"`{c}`" for c in docs.columns))
