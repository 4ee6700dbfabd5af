"""Periodic runs against the definition, and the query against the same on rows of all kinds."""

import hashlib
import random
import re
import time
import zlib

from corpuscle.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    """All maximal stretches for each period, those with a smaller period left out."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n, s = j - i + q, w[i : j + q]
            if j > i and n >= max(least, 2 * q) and not any(all(s[k] == s[k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for least in (2, 5, 12):
        for _ in range(300):
            texts = []
            for _ in range(rng.randint(1, 4)):
                n, letters = rng.randint(0, 70), [b"%d" % k for k in range(rng.choice([1, 2, 3, 9]))]
                w = [rng.choice(letters) for _ in range(n)]
                if n and rng.random() < 0.6:
                    a = rng.randrange(n)
                    p = rng.randint(1, max(1, (n - a) // 2))
                    w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                    w[rng.randrange(n)] = rng.choice([b"x", w[0]])
                texts.append(w)
            assert periodic_runs.text_runs(texts, least) == [brute_runs(w, least) for w in texts]


def test_sieve_keeps_neighbouring_texts_apart():
    text = [b"a"] * 20
    assert periodic_runs.text_runs([text, text, [], text]) == [[(0, 20, 1)], [(0, 20, 1)], [], [(0, 20, 1)]]


def test_automaton_has_the_suffixes():
    words = [0, 1, 1, 0, 1, 0, 0, 1, 1, 0]
    length, link, prefix = periodic_runs.suffix_automaton(words)
    assert [length[s] for s in prefix] == list(range(1, len(words) + 1))
    for i in range(len(words)):  # a prefix's longest suffix that ends elsewhere too
        ends = lambda x: [e for e in range(len(words)) if words[e + 1 - len(x) : e + 1] == x and e + 1 >= len(x)]
        n = next(n for n in range(i, -1, -1) if n == 0 or len(ends(words[i + 1 - n : i + 1])) > len(ends(words[: i + 1])))
        assert length[link[prefix[i]]] == n


def test_long_texts_in_time():
    began = time.time()
    for n, p in ((150_000, 1), (150_000, 39_989)):
        assert (0, n, p) in periodic_runs.text_runs([[b"%d" % (i % p * i % p) for i in range(p)] * (n // p) + [b"%d" % (i % p * i % p) for i in range(n % p)]])[0]
    assert time.time() - began < 60


def brute_query(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a " * 40, "a b " * 11, "a b c d e f " * 2, "x y\x1cz " * 13, "é ü " * 30 + "end", "one two three " * 7 + "one two", "\x0b\x0c a\r\nb " * 9]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(120)]
    rows = [(k, t, "z", "z", 1, "z") for k, t in enumerate(texts)] + [(4, "a " * 40, None, None, None, None)] * 2 + [(None, "b " * 20, None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, runs string, n_words long, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.periodic(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute_query(r[0], r[1]) for r in rows), key=str)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts)))
    kept = periodic_runs.find_runs(docs, least=4).where("doc_id = 5").first()
    assert kept["n_words"] == 22 and [tuple(r) for r in kept["runs"]] == [(0, 22, 2)] and kept["collapsed"] == "a b"
    assert queries.periodic_runs.find_runs(docs.limit(0)).count() == 0
