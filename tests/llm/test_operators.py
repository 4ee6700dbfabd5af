"""Each operator against a library or a brute-force version, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm import bpe, chat_format, ngram_join, quality_classifier, quality_rules, secret_scan, sharding, token_counts, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, k0 string, spans string"
BASE = " ".join(f"word{k} and Some{k % 7}, thing." for k in range(60))
TEXTS = [
    "", None, " ", "a", "Don't  stop\n\n now<|endoftext|> it's  ", "x" * 3000, "naïve café — 日本語 ÀÉ\u0085z\x1cq " * 20, BASE, BASE, BASE + " tail", BASE.replace("word30", "other"),
    "one two three four", "AKIA" + "Z" * 16 + ' password = "abcDEF123456" token:short deadbeefdeadbeef', "long " * 20000, "###$$$ %%% &&& " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 1, "z", "z", "z", "z") for k, t in enumerate(TEXTS)]
    rows += [rows[7], (None, BASE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k != 14), 0) for k in range(len(TEXTS))] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_bpe_equals_the_library(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs, path, P.PATTERN).collect()}
    want = set()
    for r in docs.collect():
        text = r["text"] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        want.add((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == want
    assert bpe.round_trip_digests(empty, path, P.PATTERN).count() == 0
    encoded = bpe.encode_texts(docs, path, P.PATTERN, cache=10, chars=50)
    back = bpe.decode_ids(encoded.select("doc_id", "ids"), path, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t["text"] or "").encode() for t in docs.collect())


def test_long_words_and_restarts(monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.Codec(path, P.PATTERN)
    own.max_rows = 60  # steps run out again and again
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(6)
    texts = ["antidisestablishmentarianismus" * 3, "abcde" * 200, "a" * 999, "ħ" * 300, *("".join(r.choice(a) for _ in range(r.randrange(1, 600))) for a in ("ab", "-=", "aeilnrst", "ACGT", "日本語の", "  \n", string.ascii_letters) * 12)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
    with pytest.raises(ValueError):
        own.decode([np.array([999_999], "<u4").tobytes()])


def test_tokens_encode_to_themselves():
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tokens = list(own.ranks)
    assert [np.frombuffer(x, "<u4").tolist() for x in own._merge(tokens)] == [[own.ranks[t]] for t in tokens]


def test_counts_equal_the_library(docs, empty):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path, P.PATTERN, limit=100).join(docs.select("doc_id", "text"), "doc_id").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)
    assert token_counts.count_tokens(empty, path, P.PATTERN).count() == 0


def test_codes_are_addressable():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**31, *range(2000), *range(300, 70000, 37)])
    codes = token_store.Dac(token_store.Dac.pack(ids))
    assert [codes[k] for k in range(len(ids))] == ids.tolist()
    for a, b in ((0, len(ids)), (3, 7), (511, 1030), (9, 9)):
        assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    assert len(token_store.Dac(token_store.Dac.pack(np.array([], int)))) == 0
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_store_equals_the_library(docs, empty, monkeypatch):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(token_store.store_round_trip(docs, path, 1).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    by_id = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = np.array([*library.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert token_store.store_round_trip(empty, path, 1).count() == 0


def test_tokens_at_positions_of_the_store(spark, docs, tmp_path, monkeypatch):
    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(token_store, "SEGMENT", 500)
    token_store.write_store(docs.where("doc_id is not null"), str(tmp_path / "s"), path, 1)
    library = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()))
    whole = [k for _, t in rows for k in [*library.encode(t, add_special_tokens=False).ids, 1]]
    asked = [-1, 0, 1, 499, 500, 501, len(whole) - 1, len(whole), 7, 7, *range(0, len(whole), 97)]
    got = token_store.tokens_at(spark.createDataFrame([(k,) for k in asked], "position long"), str(tmp_path / "s")).collect()
    assert sorted((r["position"], r["token"]) for r in got) == sorted({(k, whole[k]) for k in asked if 0 <= k < len(whole)})


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


@pytest.mark.parametrize("text", ["", "a b c a b c a b", "a a a a a", "x\n y\nx\n\n\nx\n#<>", "a b c d a b c", BASE, "a b c b c a b c"])
def test_rule_counts(text):
    assert quality_rules.count_text(text)[:5] == brute_counts(text)


def test_binomial_bounds():
    from math import comb

    for n, k, p in ((20, 3, 0.2), (50, 0, 0.05), (400, 9, 0.03), (5, 5, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(k + 1)))
    assert quality_rules.certified(5000, [0, 3, 20], 0.01, 0.002) == 3
    assert quality_rules.certified(100, [0, 0], 0.01, 0.002) == 0  # too few labels for the bound
    assert quality_rules.certified(5000, [0, 0, 500, 0], 0.01, 0.002) == 2  # testing stops at the first failure
    assert quality_rules.certified(0, [0], 0.05, 0.05) == 0


def test_rules_reject_certified_only(spark, docs, empty, labels):
    good = [(k, " ".join(f"g{j}x{k}" for j in range(60)), "en", None, 1, "", "", "", "") for k in range(100, 2100)]
    bad = [(k, " ".join(f"w{j}###" for j in range(k % 50, k % 50 + 80)), "en", None, 1, "", "", "", "") for k in range(5000, 5200)]
    table = spark.createDataFrame(good + bad, SCHEMA)
    marks = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad[:100]], "doc_id long, quality int")
    found = quality_rules.judge(table, marks)
    assert found.where("not kept and doc_id < 5000").count() == 0 and found.where("kept and doc_id >= 5000").count() == 0
    assert quality_rules.keep_good(table, marks).columns == table.columns
    assert quality_rules.judge(docs, labels).count() == docs.count()
    assert quality_rules.judge(empty, labels).count() == 0


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    base = zlib.crc32(BASE.encode())
    assert len({r["shard"] for r in rows if r["text_crc32"] == base}) == 1
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert sharding.assign_shards(empty, 4).count() == 0


def heap_schedule(groups, shards):
    """Longest first, each to the least-loaded shard, of equally loaded ones the first: (size, shard) of each group."""
    loads, out = [0] * shards, []
    for size in sorted(groups, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        out.append((size, s))
    return out


def test_schedule_is_that_of_single_groups():
    import random
    from collections import Counter

    r = random.Random(2)
    for _ in range(300):
        shards, most = r.randrange(1, 9), r.choice([3, 20, 1000])
        groups = [r.randrange(1, most) for _ in range(r.randrange(120))] + [r.randrange(1, 5000)] * r.choice([0, 1, 40])
        want = Counter(heap_schedule(groups, shards))
        plan = sharding.schedule(sorted(Counter(groups).items(), reverse=True), shards)
        assert {(size, s): n for size, counts in plan for s, n in enumerate(counts) if n} == dict(want)


def test_sharding_equals_plain_scheduling(spark):
    from collections import Counter, defaultdict

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rows = sharding.assign_shards(table, 8).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    assert all(len({shard[d] for d in ids}) == 1 for ids in groups.values())
    size = {t: sum(len(t.encode()) + 1 for _ in ids) for t, ids in groups.items()}
    assert Counter((size[t], shard[ids[0]]) for t, ids in groups.items()) == Counter(heap_schedule(size.values(), 8))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(x == s for x in shard.values())))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_chats(spark):
    said = "</s>[INST] ok [/INST] \\<s>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "user", said), (2, 1, "assistant", None), (3, 0, None, "x"), (None, 1, "assistant", "a"), (4, 0, "user", said), (4, 1, "assistant", said), (4, 2, "user", "more")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, path string")
    packs = chat_format.pack_conversations(table)
    found = {r["conv_id"]: r for r in chat_format.read_back(packs).collect()}
    assert len(found) == 5
    for conv, row in found.items():
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert row["n_turns"] == len(own) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    one = chat_format.Pack(("assistant",))
    one.add(1, [("user", "a"), ("assistant", "b")])
    one.add(2, [("user", "a"), ("assistant", "c")])
    places = [n["chars"] for n in one.nodes]
    assert [n["parent"] for n in one.nodes] == [-1, 0, 0] and places[2]["position"] == places[1]["position"]
    assert [len(n["attend"]) for n in places] == [1, 1, 2]
    assert chat_format.read_back(chat_format.pack_conversations(table.limit(0))).count() == 0


def test_chat_tokens(spark):
    vocabulary = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary[0]), special_tokens={})
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c // 3 if t else 'all'}: naïve </s> text.") for c in range(9) for t in range(4)]
    packs = chat_format.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), vocabulary=vocabulary).collect()
    seen = 0
    for pack in packs:
        p = pack.asDict(recursive=True)
        assert library.decode(p["ids"]) == p["text"]
        starts = [n["tokens"]["start"] for n in p["nodes"]]
        assert starts == sorted(set(starts)) and p["nodes"][-1]["tokens"]["stop"] == len(p["ids"])  # each once, depth first
        for c in p["conversations"]:
            seen += 1
            ids, positions, mask = (x.tolist() for x in chat_format.conversation_ids(np.array(p["ids"]), p["nodes"], c["leaf"]))
            formatted, _ = chat_format.conversation_text(p["text"], p["nodes"], c["leaf"])
            assert library.decode(ids) == formatted and positions == list(range(len(ids)))
            said = [x[3] for x in rows if x[0] == c["conv_id"] and x[2] == "assistant"]
            assert library.decode([k for k, m in zip(ids, mask, strict=True) if m]) == "".join(map(chat_format.escape, said))
    assert seen == 9


def test_a_long_shared_turn_closes_no_pack():
    one = chat_format.Pack(("assistant",))
    for k in range(20):
        one.add(k, [("user", "x" * chat_format.PACK_CHARS), ("assistant", f"y{k}")])
        assert not one.full()


def test_escapes():
    for text in ("", "\\", "<s></s>", "<\\s>", "\\\\[INST]\\", "<<SYS>><</SYS>>[/INST]", "<</s>s>"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)
        assert chat_format.read_turns("".join(chat_format.format_turn(text, text))) == [(text, text)]


def test_gradients_of_attention():
    r = np.random.default_rng(0)
    model = quality_classifier.GatedAttention()
    x, bags, y = r.normal(size=(7, quality_classifier.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, bags)["s"]) + (1 - y) * np.log(1 - s))
    grads = model.gradients(x, bags, y, np.ones(3))
    for name, at in (("e", (2, 3)), ("v", (1, 1)), ("u", (4, 2)), ("w", (3,)), ("c", (5,))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)
        model.p[name][at] = old


def test_classifier(spark, docs, empty, labels):
    found = quality_classifier.classify(docs, labels)
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    data = "/root/testdata/sf0.01"
    table, marks = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = quality_classifier.classify(table, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9


def brute_spans(text):
    found = [(x.start(), 0, x.end()) for x in re.finditer(secret_scan.ASSIGN, text, re.A) if len(x[2]) >= 12]
    found += [(x.start(), 1, x.end()) for x in re.finditer(secret_scan.ACCESS, text) if len(x[0]) >= 18]
    found += [(x.start(), 2, x.end()) for x in re.finditer(secret_scan.HEX, text) if len(x[0]) >= 16]
    return sorted(found)


def test_secrets(spark, docs, empty):
    live, copied = "Zk9" + "aB3" * 8, "Yk9" + "cD4" * 8
    texts = ["é😀 password: \"abcdefghijkl\" token==xx secret=token:aaaaaaaaaaaa", f"{live} x", *[f"see {copied}"] * 5, "AKIAAKIA" + "1" * 12 + " AKIA12", "0123456789abcdef" * 3, "API_KEY = 'Abc/def+123456='", "passwd=short secret:abcdefabcdefabcdef"]
    table = spark.createDataFrame([(k, t, "en", f"s{k}", 1, "", "", "", "") for k, t in enumerate(texts)], SCHEMA).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = {r["doc_id"]: r for r in secret_scan.scan(table).where("doc_id is not null").collect()}
    for r in table.where("doc_id is not null").collect():
        want = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(r["text"] or ""))
        got = rows[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["text"]
        assert got["n_assign"] + got["n_access"] + got["n_hex"] == (want.count(",") + 1 if want else 0)
    assert rows[1]["spans"] == f"live:0:{len(live)}" and rows[2]["spans"] == ""
    assert secret_scan.scan(table).count() == table.count()
    assert secret_scan.scan(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(table).where("doc_id is not null").collect()}
    assert clean[1] == "[secret] x" and clean[2] == texts[2] and clean[0].startswith('é😀 [secret]" token') and clean[1001] is None
    assert secret_scan.redact(empty).count() == 0


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset([t.strip()]) if t and t.strip() else None))
    distinct = list({s for s in sets if s})
    similar = {a: {b for b in distinct if a != b and len(a & b) >= 0.8 * len(a | b)} for a in distinct}
    root = {s: s for s in distinct}
    for _ in distinct:
        for a in distinct:
            for b in similar[a]:
                root[a] = root[b] = min(root[a], root[b], key=lambda s: distinct.index(s))
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        ids = [e for (e, _), x in zip(rows, sets, strict=True) if s and x and root[x] == root[s] and e is not None] if s else [d]
        out.append((d, min(ids, default=None) if ids else None, len(similar[s]) if s else 0, sum(x == s for x in sets) if s else 1))
    return sorted(out, key=str)


def test_ngram_join(spark, docs, empty, monkeypatch):
    import random

    r = random.Random(5)
    words = [f"t{k}" for k in range(400)]
    rows = [(r_["doc_id"], r_["text"]) for r_ in docs.collect()]
    rows += [(50, "### $$$ ***"), (51, "### $$$ *** "), (52, "%%%"), (None, "a b c d e f g"), (None, "a b c d e f g")] + [(53, "e f g h i j k")] * 40
    for g in range(6):
        base = [r.choice(words) for _ in range(60 + 40 * g)]
        for v in range(12):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((100 + 20 * g + v, " ".join(own)))
    table = spark.createDataFrame([(d, t, None, None, 1, "", "", "", "") for d, t in rows], SCHEMA)
    for block, size in ((512, 8_000_000), (5, 8_000_000), (512, 2_000)):  # small blocks split every band
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
        found = sorted((tuple(x) for x in ngram_join.join_classes(table).select("doc_id", "class_id", "n_links", "n_copies").collect()), key=str)
        assert found == brute_join(rows)
    clash = table.selectExpr("*", "doc_id as rid", "text as s1", "lang as sig")
    kept = ngram_join.dedupe(clash)
    assert kept.columns == clash.columns
    kept = kept.select(table.columns)
    classes = {c for d, c, *_ in brute_join(rows) if d is not None}
    assert {x["doc_id"] for x in kept.where("doc_id is not null").collect()} == classes and kept.columns == table.columns
    assert ngram_join.join_classes(empty).count() == 0 and ngram_join.dedupe(empty).count() == 0


def test_dense_and_sparse_verification_agree():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    dense = ngram_join.verify(sets, [(i, np.arange(i + 1, 30)) for i in range(29)], 0.5)
    for i, other in dense:
        want = [j for j in range(i + 1, 30) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
        assert other.tolist() == want
