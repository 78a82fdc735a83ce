"""Web archives: what is written, legacy archives as they occur, and repeated payloads, against plain Python."""

import base64
import collections
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import arc, queries


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def stored(folder):
    """The unpacked content of every file."""
    return [gzip.decompress(open(f, "rb").read()) for f in sorted(glob.glob(f"{folder}/part-*"))]


def brute(rows, least=0):
    """By (id, html): bytes, digest, type, what it refers to; of rows that repeat an id and a payload one responds."""
    groups = collections.defaultdict(list)
    for i, html in rows:
        groups[html or ""].append(i)
    out = collections.Counter()
    for text, ids in groups.items():
        data, ids = text.encode(), sorted(ids, key=lambda i: (i is not None, i or 0))
        kept = ids if len(data) < least else ids[-1:]
        for k, i in enumerate(ids):
            first = len(data) < least or k == len(ids) - 1
            out[i, len(data), sha1(data), "response" if first else "revisit", None if first else kept[-1]] += 1
    return out


AWKWARD = [
    (1, "http://a.example/x y", "one"), (2, None, "one"), (3, "", None), (4, "http://ü.example/ñ?q=1 2", ""), (5, "http://b.example/", "one"), (5, "http://b.example/", "one"),
    (None, "http://c.example/", "one"), (None, None, None), (6, "x\ny", "line\nWARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nmore"), (7, "http://d.example/", "🙂" * 50000), (8, "http://d.example/", "🙂" * 50000),
    (9, "filedesc://not/one", "http://e 0.0.0.0 20000101000000 text/html 5\n12345\n"), (10, "http://f.example/", "\n\n\n"), (11, "http://f.example/", "\0\0"),
]


@pytest.mark.parametrize("size, least", [(1, 0), (1 << 24, 0), (200, 4)])
def test_round_trip(spark, tmp_path, size, least):
    """Archives of one record each, of all, and between; null and repeated ids, URLs that need encoding, clashing names."""
    rng = random.Random(2)
    rows = AWKWARD + [(k, f"http://g.example/{k}", f"text {rng.randrange(8)}") for k in range(100, 160)]
    pages = spark.createDataFrame([(*r, "a", 1, "c") for r in rows], "page_id long, url string, html string, archive string, number int, content string").repartition(3)
    arcs = arc.write_arc(pages, str(tmp_path / "arc"), "page_id", "url", "html", size=size)
    described = arc.convert(spark, arcs, str(tmp_path / "warc"), least=least)
    assert described.where("problem is not null").count() == 0 and described.where("type = 'response'").count() == len(rows)
    read = arc.read_warc(spark, str(tmp_path / "warc"))
    assert read.where("not intact").count() == 0 and read.select("record_id").distinct().count() == read.count()
    found = read.where("type in ('response', 'revisit')").select(F.col("source_id").cast("long"), "payload_bytes", "payload_digest", "type", F.col("refers_to_source_id").cast("long"))
    assert collections.Counter(map(tuple, found.collect())) == brute([(i, html) for i, _, html in rows], least)
    ids = {r.record_id: r for r in read.collect()}
    for r in ids.values():
        if r.type == "revisit":
            assert ids[r.refers_to].type == "response" and ids[r.refers_to].payload_digest == r.payload_digest and ids[r.refers_to].source_id == r.refers_to_source_id
    versions = {text.split(b"\n")[1][:1] for text in stored(arcs)}
    assert versions == ({b"1", b"2"} if size < 1000 else {b"1"})


def test_files_by_plain_reading(spark, tmp_path):
    """Declared lengths and offsets of the ARC files, and lengths and digests of the WARC files, without the library."""
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", f"page {k // 2}\n" * k) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    arcs = arc.write_arc(pages, str(tmp_path / "arc"), "page_id", "url", "html", size=1000)
    arc.convert(spark, arcs, str(tmp_path / "warc"))
    n = 0
    for file, text in zip(sorted(glob.glob(f"{arcs}/part-*")), stored(arcs)):
        packed, version, pos = open(file, "rb").read(), int(text.split(b"\n")[1][:1]), 0
        while pos < len(text):
            end = text.index(b"\n", pos)
            fields = text[pos:end].split(b" ")
            assert len(fields) == (5 if version == 1 else 10)
            block = text[end + 1 : end + 1 + int(fields[-1])]
            if version == 2:
                assert fields[5].decode() == sha1(block) and gzip.decompress(packed[int(fields[7]) :]).startswith(text[pos:end])
            pos = end + 2 + len(block)
            n += 1
            assert text[pos - 1 : pos] == b"\n"
    assert n == 30 + len(stored(arcs)) > 34
    kinds = collections.Counter()
    for text in stored(tmp_path / "warc"):
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block, text = rest[: int(named["Content-Length"])], rest[int(named["Content-Length"]) :]
            assert head.startswith(b"WARC/1.1\r\n") and text.startswith(b"\r\n\r\n") and named["WARC-Block-Digest"] == "sha1:" + sha1(block)
            text = text[4:]
            kinds[named["WARC-Type"]] += 1
            if named["WARC-Type"] == "response":
                assert named["WARC-Payload-Digest"] == "sha1:" + sha1(block.partition(b"\r\n\r\n")[2]) and named["WARC-Date"] == "2000-01-01T00:00:00Z"
    assert kinds["response"] == 30 and kinds["warcinfo"] == len(stored(arcs))
    assert queries.folder(spark, "x") != queries.folder(spark, "x")


HTTP = b"HTTP/1.0 200 OK\nServer: x\n\n"


def record(head, block, declared=None):
    return b"%s %d\n%s\n" % (head, len(block) if declared is None else declared, block)


ONE = b"".join([
    record(b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain", b"1 0 Example\n" + arc.FIELDS[1] + b"\n\n"),
    record(b"dns:www.example.com 192.0.2.1 19970101 text/dns", b"www A ..."),
    record(b"http://www.example.com/a b 192.0.2.1 199701020304 text/html; charset=x", HTTP + b"hello"),
    record(b"http://www.example.com/short 192.0.2.1 19970102030405 text/html", HTTP + b"longer than declared", 20),
    record(b"http://www.example.com/same 192.0.2.1 19970102030405 text/html", HTTP + b"hello"),
    b"some garbage here\nand here\n",
    record(b"http://www.example.com/cut 192.0.2.1 19970102030405 text/html", HTTP + b"never ends", 4000)[:-1],
])
TWO = b"".join([
    record(b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc", b"2 0 Example\n" + arc.FIELDS[2] + b"\n"),
    record(b"http://v2.example/ 192.0.2.2 20010101000001 text/html 404 abc - 190 new.arc", HTTP + b"other"),
    record(b"ftp://v2.example/f 192.0.2.2 20010101000001 application/pdf - - - 300 new.arc", b"PDF!"),
])


@pytest.mark.parametrize("packed", [False, True])
def test_legacy_archives(spark, tmp_path, packed):
    """Both versions, unpacked and packed as one member: spaces in URLs, short dates, name lookups, wrong lengths, garbage,
    an archive that is cut, an empty file, and one that is no archive."""
    (tmp_path / "arc").mkdir()
    for name, content in {"one.arc": ONE, "two.arc": TWO, "empty.arc": b"", "none.arc": b"no\narchive"}.items():
        (tmp_path / "arc" / name).write_bytes(gzip.compress(content) if packed and content else content)
    described = arc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), rank=F.col("target_uri")).collect()
    seen = sorted((r.archive.rsplit("/")[-1], r.number, r.type, r.problem, r.target_uri, r.payload_bytes) for r in described)
    at = "http://www.example.com/"
    assert seen == [
        ("none.arc", 0, "resource", "header", "", 10), ("one.arc", 0, "warcinfo", None, "filedesc://old.arc", 69), ("one.arc", 1, "resource", None, "dns:www.example.com", 9),
        ("one.arc", 2, "response", None, at + "a b", 5), ("one.arc", 3, "response", "length", at + "short", 20), ("one.arc", 4, "response", None, at + "same", 5),
        ("one.arc", 5, "resource", "header", "", 27), ("one.arc", 6, "response", "truncated", at + "cut", 10),
        ("two.arc", 0, "warcinfo", None, "filedesc://new.arc", 114), ("two.arc", 1, "response", None, "http://v2.example/", 5), ("two.arc", 2, "resource", None, "ftp://v2.example/f", 4),
    ]
    rows = {r.target_uri: r for r in arc.read_warc(spark, str(tmp_path / "warc")).collect() if r.target_uri}
    assert all(r.intact for r in rows.values()) and len(rows) == 7
    assert rows[at + "a b"].type == "revisit" and rows[at + "a b"].refers_to == rows[at + "same"].record_id and rows[at + "a b"].payload_digest == sha1(b"hello")
    assert rows[at + "short"].payload_digest == sha1(b"longer than declared") and rows["dns:www.example.com"].date == "1997-01-01T00:00:00Z"
    assert rows[at + "a b"].date == "1997-01-02T03:04:00Z" and rows["ftp://v2.example/f"].type == "resource"


def test_damaged_packing():
    """What was packed before the damage is read; a piece of a header is reported."""
    parts = [arc.member(b"http://x/ 0.0.0.0 20000101000000 text/html 3\nabc\n", 6), arc.member(b"http://y/ 0.0.0.0 20000101000000 text/html 3\ndef\n", 6)]
    assert [r.url for r in arc.arc_records(parts[0] + parts[1][:12]) if r.problem is None] == ["http://x/"] and len(list(arc.arc_records(b"".join(parts)))) == 2


def test_empty_table_and_hot_payload(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k}") for k in range(3000)], "page_id long, url string, html string").repartition(5)
    for name, rows in (("none", pages.where("false")), ("hot", pages)):
        arcs = arc.write_arc(rows, str(tmp_path / name), "page_id", "url", "html")
        records = arc.convert(spark, arcs, str(tmp_path / f"{name}-warc"))
        read = arc.read_warc(spark, str(tmp_path / f"{name}-warc")).where("type <> 'warcinfo'")
        found = collections.Counter((r.type, r.refers_to_source_id) for r in read.collect())
        assert found == ({} if name == "none" else {("response", None): 1001, ("revisit", "2999"): 1999}) and records.where("type = 'response'").count() == rows.count()
