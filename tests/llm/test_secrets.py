"""Spans, ownership and redaction against brute force over random texts, and the time that a very long text takes."""

import hashlib
import random
import re
import time

import pytest

from corpuscle.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, repo string, n_chars long, found string, rid string, spans string"
PIECES = ["password", "SECRET", "token=", "api_key: '", "=", ": ", '"', " ", "é😀", "abcdefabcdef12345678", "AKIA", "AKIA" + "Z9" * 9, "Zk9" + "aB3" * 6, "Yq8cD4+/" * 3, "0123456789abcdef", "x", "\n", "-", "_", "Zz0"]


def brute_spans(text):
    found = [(x.start(), 0, x.end(), x[2]) for x in re.finditer(secret_scan.ASSIGN, text, re.A) if len(x[2]) >= 12]
    found += [(x.start(), 1, x.end(), x[0]) for x in re.finditer(secret_scan.ACCESS, text) if len(x[0]) >= 18]
    found += [(x.start(), 2, x.end(), x[0]) for x in re.finditer(secret_scan.HEX, text) if len(x[0]) >= 16]
    live = []
    for x in re.finditer(secret_scan.LIVE, text):
        if all(re.search(c, x[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not any(x.start() < e and a < x.end() for a, _, e, _ in found):
            live.append((x.start(), 3, x.end(), x[0]))
    return sorted(found), live


def brute_scan(rows):
    found = [brute_spans(t or "") for _, t, *_ in rows]
    owners, repos = {}, {}
    for (_, _, owner, repo, *_), (base, live) in zip(rows, found, strict=True):
        for *_, v in base + live:
            owners.setdefault(v, set()).add(owner or "")
            repos.setdefault(v, set()).add(repo or "")
    copied = {v for v in owners if len(owners[v]) >= secret_scan.COPIED and len(repos[v]) >= secret_scan.REPOS}
    out = []
    for (doc, text, *_), (base, live) in zip(rows, found, strict=True):
        stay = sorted(base + [x for x in live if x[3] not in copied])
        listed = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e, _ in s)
        clean, at = "", 0
        for a, _, e, v in stay:
            if v not in copied:
                clean, at = (clean + text[at:a] + "[secret]", e) if a >= at else (clean, max(at, e))
        out.append((doc, hashlib.sha256(listed(base).encode()).hexdigest(), listed(stay), sum(v in copied for *_, v in stay), ",".join(f"{len(owners[v])}:{len(repos[v])}" for *_, v in stay), clean + text[at:] if text is not None else None))
    return out


@pytest.mark.parametrize("blocks", [(2, 3), (256, 256)])
def test_spans_owners_and_redaction(spark, monkeypatch, blocks):
    monkeypatch.setattr(secret_scan, "BLOCK", blocks[0])
    monkeypatch.setattr(secret_scan, "CHARS", blocks[1])
    r = random.Random(3)
    rows = [(k, "".join(r.choice(PIECES) for _ in range(r.randrange(30))), f"s{r.randrange(4)}" if k % 9 else None, f"r{r.randrange(3)}", 1, "f", "r", "s") for k in range(250)]
    rows += [(900, None, None, None, None, None, None, None), (901, "", "s1", "r1", 0, "", "", ""), (902, "Zk9" + "aB3" * 30, "s1", "r1", 0, "", "", "")]
    rows += [(1000 + k, f"see Only9{'dE5' * 7} here", f"s{k % o}", f"r{k % n}", 1, "", "", "") for k, (o, n) in enumerate([(5, 1)] * 5)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = brute_scan(rows)
    got = {x["doc_id"]: x for x in secret_scan.scan(table, repo_col="repo").collect()}
    assert len(got) == len(rows)
    for doc, base, spans, n_copied, owners, _ in want:
        x = got[doc]
        assert (x["base_sha256"], x["spans"], x["n_copied"], x["owners"]) == (base, spans, n_copied, owners)
        assert x["n_live"] + x["n_copied"] == (spans.count(",") + 1 if spans else 0)
    assert got[1000]["n_live"] == 1  # five owners, but one repository: no widely copied example
    clean = secret_scan.redact(table, repo_col="repo")
    assert clean.columns == table.columns
    clean = {x["doc_id"]: (x["text"], x["n_chars"]) for x in clean.collect()}
    assert {d: t for d, (t, _) in clean.items()} == {d: t for d, *_, t in want}
    assert clean[902][1] == len(clean[902][0])


def test_a_very_long_text_takes_linear_time(spark):
    text = "é " + " ".join(f"{k * 7919 + 2**60:016x} lorem ipsum dolor sit amet elit" for k in range(100_000))
    table = spark.createDataFrame([(1, text, "a", "r", 0, "", "", "")], SCHEMA)
    began = time.time()
    row = secret_scan.scan(table).collect()[0]
    assert row["n_hex"] == 100_000 and time.time() - began < 20
    began = time.time()
    assert len(secret_scan.redact(table).collect()[0]["text"]) == len(text) - 8 * 100_000 and time.time() - began < 40


def test_owners_and_repositories_both_decide(spark):
    """What flips the verdict: a third owner, and a second repository."""
    value = lambda k: f"Zk9{k}" + "aB3" * 8
    held = {0: [("a", "r"), ("b", "r"), ("c", "r")], 1: [("a", "r"), ("b", "r"), ("c", "q")], 2: [("a", "r"), ("a", "q"), ("a", "p"), ("b", "o")], 3: [("a", "r"), ("b", "q"), ("c", "p"), ("c", "p")], 4: [("a", "r")] * 9}
    rows = [(10 * k + n, f"see {value(k)}", owner, repo) for k, own in held.items() for n, (owner, repo) in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = {(r["doc_id"] // 10, r["n_live"]) for r in secret_scan.scan(docs, repo_col="lang").collect()}
    assert found == {(0, 1), (1, 0), (2, 1), (3, 0), (4, 1)}
    texts = {(r["doc_id"] // 10, r["text"]) for r in secret_scan.redact(docs, repo_col="lang").collect()}
    assert texts == {(k, "see [secret]" if k in (0, 2, 4) else f"see {value(k)}") for k in held}
