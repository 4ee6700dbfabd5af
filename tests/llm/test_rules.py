"""The quality rules' verdicts against the method in plain Python, with exact binomial sums."""

import zlib
from fractions import Fraction
from math import comb

import pytest
from test_operators import brute_counts

from corpuscle.llm import quality_rules as rules

DATA = "/root/testdata/sf0.01"


def rates(text):
    n_words, _, symbols, dup_lines, repeats = brute_counts(text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip(" \t-\r")]
    part = {"symbols": (symbols, n_words), "capitals": (sum(w.isupper() for w in words), n_words), "exclamations": (text.count("!"), n_words), "dup_lines": (dup_lines, len(lines)), "repeats": (repeats, n_words)}
    return {r: a / max(b, 1) for r, (a, b) in part.items()}


def passes(good, rejected, alpha, delta):
    p = Fraction(str(alpha))
    return good and rejected <= alpha * good and sum(comb(good, x) * p**x * (1 - p) ** (good - x) for x in range(rejected + 1)) <= Fraction(str(delta)) / 5


def brute_kept(docs, labels, alpha, delta):
    base = {d: (c := brute_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0] for d, t, _ in docs}
    rate = {d: rates(t) for d, t, _ in docs}
    trials = {}
    for d, t, lang in docs:
        if not base[d] and labels.get(d) is not None:
            key = lang, t
            trials[key] = d, min(labels[d], trials[key][1] if key in trials else 1)
    cutoffs = {}
    for s in {lang for _, _, lang in docs}:
        own = [(d, y, zlib.crc32(t.encode()) % 2) for (lang, t), (d, y) in trials.items() if lang == s]
        over = lambda rows, r, c: sum(rate[d][r] > c for d in rows)
        good, bad = ([d for d, y, half in own if y == want and half == 0] for want in (1, 0))
        now, kept = {}, {}
        holdout = [d for d, y, half in own if y == 1 and half == 1]
        while True:
            open_ = []
            for k, (r, levels) in ((k, (r, rules.CUTOFFS)) for r in rules.RULES for k in range(len(rules.CUTOFFS))):
                if levels[k] < now.get(r, 9):
                    lost = over(good, r, levels[k]) - over(good, r, now.get(r, 9))
                    won = over(bad, r, levels[k]) - over(bad, r, now.get(r, 9))
                    if won > rules.GOOD_WEIGHT * lost:
                        open_.append((lost, -won, k, r))
            if not open_:
                break
            *_, k, r = min(open_)
            now[r] = rules.CUTOFFS[k]
            if not passes(len(holdout), sum(any(rate[d][x] > c for x, c in now.items()) for d in holdout), alpha, delta):
                break
            kept = dict(now)
        cutoffs[s] = kept
    return {d: not base[d] and not any(rate[d][r] > c for r, c in cutoffs[lang].items()) for d, _, lang in docs}, cutoffs


@pytest.mark.parametrize("alpha, delta", [(0.05, 0.05), (0.3, 0.4)])
def test_verdicts_equal_brute_force(spark, alpha, delta):
    table, marks = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    marks = marks.unionByName(marks.limit(20))  # repeated labels are no further trials
    docs = [(r["doc_id"], r["text"] or "", r["lang"]) for r in table.collect()]
    labels = {r["doc_id"]: r["quality"] for r in marks.collect()}
    want, cutoffs = brute_kept(docs, labels, alpha, delta)
    assert any(cutoffs.values()) and (alpha < 0.1 or sum(map(bool, cutoffs.values())) > 1)
    found = {r["doc_id"]: r["kept"] for r in rules.judge(table, marks, alpha=alpha, delta=delta).collect()}
    assert found == want
    clash = table.selectExpr("*", "lang as q", "lang as th", "doc_id as half")
    kept = rules.keep_good(clash, marks, alpha=alpha, delta=delta)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {d for d, k in want.items() if k}
