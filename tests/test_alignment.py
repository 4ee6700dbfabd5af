"""Alignments against a plain cell-by-cell version in whole numbers, and the time that long ones take."""

import random
import time

from corpuscle.operators import learn

LOW = -(10**15)


def plain(a, b, local, match=20, mismatch=-10, gap_open=-5, gap_extend=-1):
    n, k = len(a), len(b)
    best, up, left = ([[LOW] * (k + 1) for _ in range(n + 1)] for _ in range(3))
    best[0][0] = 0
    pair = lambda i, j: match if a[i - 1] == b[j - 1] else mismatch
    for i in range(n + 1):
        for j in range(k + 1):
            if i:
                up[i][j] = max(best[i - 1][j] + gap_open, up[i - 1][j] + gap_extend) if j else gap_open + (i - 1) * gap_extend
            if j:
                left[i][j] = max(best[i][j - 1] + gap_open, left[i][j - 1] + gap_extend) if i else gap_open + (j - 1) * gap_extend
            if i or j:
                best[i][j] = max(best[i - 1][j - 1] + pair(i, j) if i and j else LOW, up[i][j], left[i][j], 0 if local else LOW)
    i, j = max(((i, j) for i in range(n + 1) for j in range(k + 1)), key=lambda c: (best[c[0]][c[1]], -c[0], -c[1])) if local else (n, k)
    score, x, y, at = best[i][j], "", "", "best"
    while i or j:
        if at == "best":
            if local and best[i][j] <= 0:
                break
            if i and j and best[i][j] == best[i - 1][j - 1] + pair(i, j):
                i, j = i - 1, j - 1
                x, y = a[i] + x, b[j] + y
                continue
            at = "up" if i and best[i][j] == up[i][j] else "left"
        if at == "up":
            at = "best" if up[i][j] == best[i - 1][j] + gap_open else "up"
            i -= 1
            x, y = a[i] + x, "-" + y
        else:
            at = "best" if left[i][j] == best[i][j - 1] + gap_open else "left"
            j -= 1
            x, y = "-" + x, b[j] + y
    return score, x, y


def test_rows_equal_cells():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choice("ACDE"[: rng.choice([2, 4])]) for _ in range(rng.randint(0, 14))) for _ in "ab")
        local = rng.random() < 0.5
        score, x, y = learn.align(a, b, local)
        assert (round(10 * score), x, y) == plain(a, b, local), (a, b, local)


def test_long_sequences():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("ACDEFGHIKL") for _ in range(2500)) for _ in "ab")
    began = time.time()
    _, x, y = learn.align(a, b)
    assert time.time() - began < 5 and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
