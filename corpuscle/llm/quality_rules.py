"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose rate (symbols, capital words, exclamation marks, repeated lines, repeated windows) is over a
cutoff. Labelled holdouts choose the cutoffs of all rules together, in each stratum. Distinct labelled texts that pass the
base rule are dealt to two halves by their hash. The first half only puts tightening steps of the rules in an order: the ones
that reject fewest good texts first, among those that reject over ten bad texts for each good one. Along that order the second half tests,
with the exact binomial test, that all rules together falsely reject at most alpha of good texts, and stops at the first step that isn't certified
(fixed-sequence testing), at level delta / strata (Bonferroni). So with probability 1 - delta, in every stratum at most
alpha of the good texts that pass the base rule are rejected. Without a certified step no rule rejects anything.

What the base rule rejects is not under this control. Null and empty texts have no words (base_failed). A text that any
label calls bad counts as bad; null labels don't count; a text that is labelled often is one trial (near copies are
trials of their own). Repeated rows get repeated results; an empty table gives an empty one; other columns are carried or
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.common import WORD, materialize, narrow, unused

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_exclamations")
#: Rule: what is counted, by what it is divided.
RULES = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capital_words", "n_words"), "exclamations": ("n_exclamations", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
CUTOFFS = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
STRATA, OTHER = ("en", "de", "fr", "es"), "other"
#: Bad texts that a step must reject more for each good one.
GOOD_WEIGHT = 10


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    words = WORD.findall(text)
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            until = 0
            for k, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += k + 3 - max(k, until)
                    until = k + 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), sum(map(str.isupper, words)), text.count("!")


def _features(batches: Iterator[pa.RecordBatch], at: int, keep: tuple[str, ...], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.fromiter(chain.from_iterable(count_text(t or "") for t in batch.column(at).to_pylist()), np.int64).reshape(-1, len(COUNTS))
        counts = pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))
        yield pa.record_batch([*(batch.column(c) for c in keep), counts], names=[*keep, name])


def with_counts(df: DataFrame, text_col: str, keep: list[str], name: str) -> DataFrame:
    """The columns keep of df and the COUNTS of each text as a struct."""
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField(name, counts)])
    return df.mapInArrow(partial(_features, at=df.columns.index(text_col), keep=tuple(keep), name=name), schema)


def rate(rule: str, counts: str) -> Column:
    part, whole = RULES[rule]
    return F.col(counts)[part] / F.greatest(F.col(counts)[whole], F.lit(1))


def base_failed(counts: str) -> Column:
    n = F.col(counts)["n_words"]
    return (n < 50) | (100 * F.col(counts)["n_repeat_words"] > 50 * n)


def stratum(col: Column, strata: tuple[str, ...]) -> Column:
    """A bounded set of strata: the given values and one for all others."""
    return F.when(col.isin(*strata), col).otherwise(OTHER)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with probability p, summed exactly from k down until terms no longer count."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for x in range(k, 0, -1):
        term *= x * (1 - p) / ((n - x + 1) * p)
        total += term
        if x < n * p and term < total * 1e-17:
            break
    return min(total, 1.0)


def steps(false: dict[str, list[int]], caught: dict[str, list[int]]) -> list[tuple[str, int]]:
    """The order of tightening steps (rule, place in CUTOFFS); false and caught: good and bad texts over each cutoff."""
    now, path = dict.fromkeys(false, -1), []
    at = lambda counts, r, k: counts[r][k] if k >= 0 else 0
    while True:
        open_ = []
        for r in false:
            for k in range(now[r] + 1, len(CUTOFFS)):
                lost, won = false[r][k] - at(false, r, now[r]), caught[r][k] - at(caught, r, now[r])
                if won > GOOD_WEIGHT * lost:
                    open_.append((lost, -won, k, r))
        if not open_:
            return path
        *_, k, r = min(open_)
        now[r] = k
        path.append((r, k))


def certified(good: int, rejected: list[int], alpha: float, delta: float) -> int:
    """How many steps pass, tested one after another; rejected: good texts that the rules reject after each step."""
    for n, k in enumerate(rejected):
        if not good or k > alpha * good or binomial_tail(k, good, alpha) > delta:
            return n
    return len(rejected)


def calibrate(counted: DataFrame, labels: DataFrame, strata: tuple[str, ...] = STRATA, alpha: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule, from all labelled rows of counted (doc_id, stratum, th, half, q: counts).

    The driver gets one row of sums for each stratum, and then one for each stratum and step.
    """
    marks = narrow(labels, _id="doc_id", label="quality").where("label is not null").groupBy("_id").agg(F.min("label").alias("label"))
    # cutoffs fall, so the first one that a rate is over has as many before it as the rate isn't over
    first = F.struct(*(reduce(lambda a, b: a + b, ((rate(r, "q") <= c).cast("int") for c in CUTOFFS)).alias(r) for r in RULES))
    rows = counted.where(~base_failed("q")).select("doc_id", stratum(F.col("stratum"), strata).alias("stratum"), "th", "half", first.alias("first"))
    rows = rows.join(marks, F.col("doc_id") == F.col("_id")).groupBy("stratum", "th", "half").agg(F.min("label").alias("label"), F.min("first").alias("first"))
    rows = materialize(rows, "trials")
    over = [F.sum(F.when((F.col("label") == y) & (F.col("first")[r] <= k), 1).otherwise(0)).alias(f"{r}_{y}_{k}") for r in RULES for y in (0, 1) for k in range(len(CUTOFFS))]
    sums = rows.where("half = 0").groupBy("stratum").agg(*over).collect()
    paths = {x["stratum"]: steps(*({r: [x[f"{r}_{y}_{k}"] for k in range(len(CUTOFFS))] for r in RULES} for y in (1, 0))) for x in sums}
    # the first step of its stratum's order that rejects a text
    step = F.lit(None).cast("int")
    for s, path in paths.items():
        if path:
            step = F.when(F.col("stratum") == s, F.array_min(F.array(*(F.when(F.col("first")[r] <= k, n) for n, (r, k) in enumerate(path))))).otherwise(step)
    tested = rows.where("half = 1 and label = 1").groupBy("stratum", step.alias("step")).agg(F.count("*").alias("n")).collect()
    out = {}
    for s, path in paths.items():
        own = {x["step"]: x["n"] for x in tested if x["stratum"] == s}
        rejected = np.cumsum([own.get(n, 0) for n in range(len(path))]).astype(int).tolist()
        out[s] = {r: CUTOFFS[k] for r, k in path[: certified(sum(own.values()), rejected, alpha, delta / (len(strata) + 1))]}
    return out


def verdict(cutoffs: dict[str, dict[str, float]], stratum_col: str, counts: str, strata: tuple[str, ...] = STRATA) -> Column:
    """True where neither the base rule nor a certified cutoff rejects a row with counts."""
    own = stratum(F.col(stratum_col), strata)
    over = [(own == s) & (rate(r, counts) > c) for s, rules in cutoffs.items() for r, c in rules.items()]
    return ~reduce(lambda a, b: a | b, over, base_failed(counts))


def _trial(text: Column) -> tuple[Column, Column]:
    """What tells texts apart, and the half that a text is dealt to."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.crc32(text.cast("binary")) % 2


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang", strata: tuple[str, ...] = STRATA, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept. Texts are read once; their counts are kept in the shared folder."""
    given = narrow(docs, doc_id="doc_id", stratum=stratum_col, text=text_col)
    th, half = _trial(F.col("text"))
    counted = materialize(with_counts(given.withColumns({"th": th, "half": half}), "text", ["doc_id", "stratum", "th", "half"], "q"), "counts")
    cutoffs = calibrate(counted, labels, strata, alpha, delta)
    return counted.select("doc_id", *(F.col("q")[c].alias(c) for c in COUNTS[:5]), base_failed("q").alias("base_failed"), verdict(cutoffs, "stratum", "q", strata).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang", strata: tuple[str, ...] = STRATA, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are counted once and not shuffled."""
    counts, th, half = unused(docs, "q", "th", "half")
    marked = docs.withColumns(dict(zip((th, half), _trial(F.col(f"`{text_col}`")), strict=True)))
    counted = materialize(with_counts(marked, text_col, marked.columns, counts), "counted")
    cutoffs = calibrate(narrow(counted, doc_id="doc_id", stratum=stratum_col, th=th, half=half, q=counts), labels, strata, alpha, delta)
    return counted.where(verdict(cutoffs, stratum_col, counts, strata)).select(*(f"`{c}`" for c in docs.columns))
