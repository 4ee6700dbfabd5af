import importlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from corpuscle.llm import bpe, secret_scan

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), re.sub(r"\W", "-", name))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert before > sizes[0] > 0 and sizes == sorted(sizes, reverse=True)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == sizes[-1] and out.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


def brute_pipeline(docs, items):
    """doc_id to the ids of its redacted text, stage by stage in plain Python; sf0.001 has too few labels for any cutoff."""
    from test_operators import brute_counts, brute_join, brute_spans

    kept = [r for r in docs if (c := brute_counts(r["text"] or ""))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    first = {cls for _, cls, *_ in brute_join([(r["doc_id"], r["text"]) for r in kept])}
    kept = [r for r in kept if r["doc_id"] in first]
    words = lambda t: f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} "
    kept = [r for r in kept if not any(words(t) in words(r["text"]) for t in items)]
    found, owners, repos = {}, {}, {}
    for r in kept:
        t = r["text"]
        spans = [(a, e, re.search(secret_scan.ASSIGN, t[a:e], re.A)[2] if k == 0 else t[a:e]) for a, k, e in brute_spans(t)]
        for x in re.finditer(secret_scan.LIVE, t):
            if all(re.search(c, x[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not any(x.start() < e and a < x.end() for a, e, _ in spans):
                spans.append((x.start(), x.end(), x[0]))
        found[r["doc_id"]] = spans
        for *_, v in spans:
            owners.setdefault(v, set()).add(r["source"])
            repos.setdefault(v, set()).add(r["lang"])
    out = {}
    for r in kept:
        text, at = "", 0
        for a, e, v in sorted(found[r["doc_id"]]):
            if len(owners[v]) < secret_scan.COPIED or len(repos[v]) < secret_scan.REPOS:
                text, at = (text + r["text"][at:a] + "[secret]", e) if a >= at else (text, max(at, e))
        out[r["doc_id"]] = text + r["text"][at:]
    return out


def test_run_equals_brute_force(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = brute_pipeline(spark.read.parquet(f"{DATA}/documents.parquet").collect(), [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    rows = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert rows == {d: np.array(library.encode_ordinary(t), "<u4").tobytes() for d, t in want.items()}


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
