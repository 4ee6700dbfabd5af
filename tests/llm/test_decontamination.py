"""Tiles against the definition of greedy string tiling, and whole tables against pairs compared one by one."""

import random
import re
import time

import numpy as np
import pytest

from corpuscle.llm import decontamination

SCHEMA = "doc_id long, text string, lang string, words string, key string, form string"


def brute_tiles(item, text, least):
    """Again and again the longest free match, of the longest ones the first in the item, then in the text."""
    used, seen, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used and j + n not in seen:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = i, j, n
        if best is None:
            return out
        out.append(best)
        i, j, n = best
        used |= set(range(i, i + n))
        seen |= set(range(j, j + n))


def test_each_tile_is_the_longest_free_match():
    r = random.Random(1)
    for _ in range(400):
        letters, least = r.choice([2, 3, 5]), r.choice([1, 2, 3, 5])
        item, text = (np.array([r.randrange(letters) for _ in range(r.randrange(1, 26))], np.uint64) + 1 for _ in range(2))
        assert decontamination.tile(item, text, least) == brute_tiles(item, text, least)


def test_a_shortened_match_goes_back_to_the_queue():
    item, text = (np.array([int(c) for c in s]) + 1 for s in ("111001011011111100100110", "111001000011101111"))
    assert [n for *_, n in decontamination.tile(item, text, 3)] == [n for *_, n in brute_tiles(item, text, 3)]
    assert sum(n for *_, n in decontamination.tile(item, text, 3)) == 17


def test_tiles_of_repeated_words():
    assert decontamination.tile(np.zeros(40, int), np.zeros(25, int)) == [(0, 0, 25)]
    assert decontamination.tile(np.ones(400, int), np.ones(50_000, int)) == [(0, 0, 400)]


def brute_leaks(rows, items):
    words = lambda t: decontamination.TOKEN.findall((t or "").lower())
    out = []
    for doc, text in rows:
        for item, own in items:
            a, b = words(own), words(text)
            if len(a) >= decontamination.MIN_TILE:
                code = {w: k for k, w in enumerate({*a, *b})}
                tiles = brute_tiles([code[w] for w in a], [code[w] for w in b], decontamination.MIN_TILE)
                size = sum(n for *_, n in tiles)
                if size >= decontamination.COVERAGE * len(a):
                    out.append((doc, item, size, len(tiles)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocabulary = [f"q{k}" for k in range(60)]
    common = [f"c{k}" for k in range(9)]  # stands in every item and every second text
    items = [(k, " ".join(common[: r.randrange(10)] + [r.choice(vocabulary) for _ in range(r.randrange(3, 25))])) for k in range(30)]
    items += [(100, None), (101, ""), (102, "one two three four"), (0, items[0][1]), (103, items[3][1].upper()), (104, "東京都の人口は約千四百万人です")]
    rows = []
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20))]
        for _ in range(r.randrange(3)):
            own = items[r.randrange(30)][1].split()
            a, b = sorted((r.randrange(len(own) + 1), r.randrange(len(own) + 1)))
            words += own[b:] + ["gap"] * (k % 3 == 0) + own[:a] if k % 2 else own
        rows.append((k, " ".join(words + common * (k % 2))))
    rows += [(500, None), (501, ""), (502, "x " * 20_000), (7, rows[7][1]), (None, items[5][1]), (503, "昨日、東京都の人口は約千四百万人ですと聞いた")]
    return rows, items


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_ROWS, 0])
def test_leaks_equal_brute_force(spark, corpus, limit, monkeypatch):
    rows, items = corpus
    if not limit:  # every table is shuffled, hot keys are dealt
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(decontamination, "HOT", 5)
        monkeypatch.setattr(decontamination, "LEAST_BITS", 7)
        monkeypatch.setattr(decontamination, "MOST_BITS", 7)
    table = spark.createDataFrame([(d, t, "en", "w", "k", "f") for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, doc_id string")
    want = brute_leaks(rows, items)
    found = decontamination.find_leaks(table, bench, limit=limit).collect()
    assert sorted(((x["doc_id"], x["item_id"], x["matched_words"], x["n_tiles"]) for x in found), key=str) == want
    assert all(x["coverage"] * len(re.findall(r"\w+", dict(items)[x["item_id"]])) == pytest.approx(x["matched_words"]) for x in found if x["item_id"] < 100)
    kept = decontamination.drop_leaks(table, bench, limit=limit)
    leaked = {d for d, *_ in want}
    assert kept.columns == table.columns
    assert sorted((x["doc_id"], x["text"] or "") for x in kept.collect()) == sorted((d, t or "") for d, t in rows if d not in leaked)
    for none in (table.limit(0), table):
        nothing = bench if none.isEmpty() else bench.limit(0)
        assert decontamination.find_leaks(none, nothing).count() == 0 and decontamination.drop_leaks(none, nothing).count() == none.count()


def test_part_of_a_text_has_all_tiles():
    """Tiles in the words that an item shares equal those in the whole text."""
    rng = random.Random(12)
    for _ in range(400):
        item = np.array([rng.randint(1, 4) for _ in range(rng.randint(3, 25))], np.uint64)
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 80))], np.uint64)
        part, known = decontamination.Shared(text, 3).part(item)
        whole, own = decontamination.tile(item, text, 3), decontamination.tile(item, part, 3)
        assert [(i, n) for i, _, n in whole] == [(i, n) for i, _, n in own]
        windows = {tuple(text[k : k + 3]) for k in range(len(text) - 2)}
        assert known == len({i for k in range(len(item) - 2) if tuple(item[k : k + 3]) in windows for i in range(k, k + 3)})


def test_a_whole_benchmark_in_one_text(spark):
    """10,000 items quoted by one text, some with their halves swapped, and a text that quotes none."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    items = [[rng.choice(words) for _ in range(70)] for _ in range(10_000)]
    quoted = [i[35:] + i[:35] if k % 10 == 0 else i for k, i in enumerate(items)]
    docs = spark.createDataFrame([(1, " ".join(w for i in quoted for w in i)), (2, " ".join(rng.choice(words) for _ in range(300)))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    began = time.time()
    found = decontamination.find_leaks(docs, benchmark).collect()
    assert time.time() - began < 60
    assert {(r["doc_id"], r["item_id"], r["matched_words"], r["n_tiles"]) for r in found} == {(1, k, 70, 2 if k % 10 == 0 else 1) for k in range(10_000)}
