"""WARC archives read back as written, by place and by index, and the report against brute force."""

import gzip
import hashlib
import random

import pyarrow.fs as pafs
import pytest

from corpuscle.llm import queries, warc

SCHEMA = "page_id long, url string, html string, size long, sha string, refers_to string, file string"
BIG = "<p>é</p>" * 200


def rows():
    rng = random.Random(4)
    out = [(k, f"https://h{k % 5}.example.com/{rng.randint(0, 9)}?q={k % 3}", rng.choice([BIG, BIG + "x", "a" * 999, "a" * 1000, "b" * 1001, None, "", f"<i>{k}</i>" * rng.randint(1, 400)])) for k in range(150)]
    out += [out[3]] * 3 + [(None, "http://x.org", BIG), (None, None, "n" * 2000), (None, None, "n" * 2000), (500, None, None), (501, "no address \r\n\t at all", "z" * 5000), (502, "https://a.b:8443", "z" * 5000), (502, "https://a.b:8443", "z" * 5000), (-9, "http://u:p@[::1]:80#f", "z" * 5000)]
    return out


def brute(rows):
    top = {}
    for page, _, html in rows:
        top[html] = max(top.get(html, (0, 0)), (page is not None, page or 0))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and (page is not None, page or 0) < top[html]
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[html][1] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "s", "r", "f") for r in rows()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def archive(pages):
    return warc.write_archive(pages, block=8)


def test_report_equals_brute_force(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.capture_pages(spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows())
    assert {r[3] for r in brute(rows())} == {"response", "revisit"}


def test_files_are_warc(archive):
    """Each file, unpacked as a whole, is one record after another, at the places that the captures have."""
    seen = 0
    for name in {r["file"] for r in archive.captures.collect()}:
        files, path = warc._open(archive.root, name)
        with files.open_input_file(path) as f:
            data = f.read()
        text, at, ends = gzip.decompress(data), 0, []
        while at < len(text):
            head, _, _ = text[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(head.rpartition(b"Content-Length: ")[2])
            at += len(head) + 4 + size + 4
            assert text[at - 4 : at] == b"\r\n\r\n"
            ends.append(at)
        own = sorted((r["offset"], r["length"]) for r in archive.captures.where(f"file = '{name}'").collect())
        assert [a + n for a, n in own] == [b for b, _ in own[1:]] + [len(data)] and len(own) == len(ends)
        seen += len(ends)
    assert seen == len(rows())


def test_payloads_come_back(archive, pages):
    found = warc.read_records(archive, archive.captures).where("record_type = 'response'").collect()
    want = {(r[0], r[2] or "") for r in rows()}
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in found} <= want
    assert {hashlib.sha1(h.encode()).hexdigest() for _, h in want} == {r["payload_digest"] for r in found}


def test_lookup_by_url(spark, archive):
    asked = ["https://h1.example.com/3?q=1", "HTTPS://H1.Example.com:443/3?q=1", "http://x.org/", None, "https://nowhere.org/"]
    wanted = spark.createDataFrame([(u,) for u in asked], "url string")
    found = warc.lookup(archive, wanted).collect()
    keys = {warc.reversed_key(u) for u in asked}
    want = [(warc.reversed_key(u), p) for p, u, _ in rows() if warc.reversed_key(u) in keys]
    assert sorted(((r["key"], r["page_id"]) for r in found), key=str) == sorted(want, key=str) and len(want) > 3


def test_index_reads_only_what_it_needs(archive):
    name, _ = archive.parts[0]
    index = warc.IndexFile(archive.root, name)
    assert index.firsts == sorted(index.firsts) and len(index.firsts) > 1
    all_rows = [r for k in range(len(index.directory)) for r in index.block(k)[0]]
    index = warc.IndexFile(archive.root, name)
    low, high = warc._order(*all_rows[-1][:2]), warc._order(*all_rows[-1][:2])
    assert list(index.find(low, high)) == [r for r in all_rows if r[:2] == all_rows[-1][:2]] and index.reads <= 2


def test_keys():
    for url, key in {
        "http://www.Example.com": "com,example,www)/", "https://example.com:443/a?b#c": "com,example)/a?b", "http://example.com:8080?x": "com,example:8080)/?x", "http://u@[::1]/": "[::1])/",
        "//e.org./p q": "org,e)/p%20q", "mailto:x": "mailto:x", "": "", None: "", "http://é.fr/ü": "fr,é)/ü",
    }.items():
        assert warc.reversed_key(url) == key


def test_damage_is_seen():
    good = warc.record(1, "http://a.b/", b"text", 4, hashlib.sha1(b"text").hexdigest(), None, warc.DATE)
    assert warc.parse_record(good)[0] == 1 and warc.parse_record(good)[-1] == b"text"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(warc.record(1, "", b"text", 4, "0", None, warc.DATE))
    assert warc.parse_record(warc.record(None, None, b"", 7, "d", "5", warc.DATE)) == (None, "", "revisit", "5", 7, "d", None)


def test_empty_table(pages):
    none = warc.write_archive(pages.limit(0))
    assert none.parts == [] and warc.lookup(none, pages, "url", "page_id").collect() == []
    assert pafs.FileSystem.from_uri(none.root)[0].get_file_info(f"{pafs.FileSystem.from_uri(none.root)[1]}/archive").type == pafs.FileType.NotFound
    assert warc.resolve(warc.read_records(none, none.captures)).count() == 0
