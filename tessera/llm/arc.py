"""Legacy web archives (ARC) and their conversion to WARC.

An archive is one row of bytes and one file, as large as ``size`` says (or as its largest record), so tasks hold one
archive at a time.  Files are written by Spark's committed text writer, a row a file: each record is a gzip member of its
own, and the zero byte that ends a file is padding that readers of gzip skip.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyspark.cloudpickle
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held

# The lines that describe and head the records of either version of ARC, and names of WARC.
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
HEADS = {
    1: re.compile(rb"(\S.*) ([0-9A-Fa-f.:]+|-) (\d{8,14}) (\S.*) (\d+)"),
    2: re.compile(rb"(\S.*) ([0-9A-Fa-f.:]+|-) (\d{8,14}) (\S.*) (\d+|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Own names: the id of the source's row, that of the record a revisit refers to, and the bytes of the full payload.
SOURCE, REFERS, FULL = "X-Source-Id", "X-Refers-To-Source-Id", "X-Payload-Length"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int) -> bytes:
    """``data`` as one gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def unpacked(content: bytes) -> bytes:
    """The bytes of an archive, packed or not; of a damaged or cut one, those before the damage."""
    if content[:2] != b"\x1f\x8b":
        return content.rstrip(b"\0")
    out, pos = io.BytesIO(), 0
    try:
        while content[pos : pos + 2] == b"\x1f\x8b":
            # A member is fed in growing pieces, for what is left of a piece behind its end is copied.
            opened, step = zlib.decompressobj(31), 1 << 11
            while not opened.eof and pos < len(content):
                out.write(opened.decompress(content[pos : pos + step]))
                pos, step = min(pos + step, len(content)), min(2 * step, 1 << 18)
            pos -= len(opened.unused_data)
    except zlib.error:
        pass
    return out.getvalue()


# ---- ARC


@dataclass
class ArcRecord:
    """One record of an archive: its place in it (``number``, from 0), the fields of its header, its block, and what was wrong:
    ``length`` (the declared length ends inside of something else; the block ends before the next header), ``truncated``
    (the archive ends first) or ``header`` (bytes that are no header, up to the next one)."""

    number: int
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    problem: str | None = None

    @property
    def http(self) -> int:
        """Where the payload starts; -1 if the block is no HTTP response."""
        if not self.block.startswith(b"HTTP/"):
            return -1
        found = re.search(rb"\r?\n\r?\n", self.block)
        return found.end() if found else len(self.block)

    @property
    def type(self) -> str:
        return "warcinfo" if self.number == 0 and self.url.startswith("filedesc:") else "response" if self.http >= 0 else "resource"

    @property
    def payload(self) -> bytes:
        return self.block[max(self.http, 0) :]

    @property
    def source(self) -> str | None:
        found = re.search(rb"(?im)^" + SOURCE.encode() + rb": *([^\r\n]*)", self.block[: max(self.http, 0)])
        return unquote(found[1].decode()) if found else None

    @property
    def iso_date(self) -> str:
        """The date as ISO 8601; missing digits are those of the first moment."""
        d = self.date + "00000101000000"[len(self.date) :]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def header_at(line: bytes, version: int | None) -> re.Match | None:
    for v in (version,) if version else (2, 1):
        if found := HEADS[v].fullmatch(line.removesuffix(b"\r")):
            return found
    return None


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """The records of an archive in order.  Each header line is read as its version, which the first record declares, says:
    from the right, for URLs may hold spaces.  An archive without that record is read by whichever form a line has."""
    data, version, number, pos = unpacked(content), None, 0, 0
    line_end = lambda at: end if (end := data.find(b"\n", at)) >= 0 else len(data)

    def next_header(at: int) -> int:
        """The start of the next line, from ``at`` on, that is a header; the end of the archive without one."""
        while at < len(data) and header_at(data[at : line_end(at)], version) is None:
            at = line_end(at) + 1
        return min(at, len(data))

    while pos < len(data):
        end = line_end(pos)
        line = data[pos:end]
        if not line.strip():
            pos = end + 1
            continue
        if number == 0 and line.startswith(b"filedesc:"):
            declared = re.match(rb"(\d+)", data[end + 1 :][:4])
            version = int(declared[1]) if declared and int(declared[1]) in HEADS else 1
            # The version block is headed by the form of version 1 in some archives of version 2.
            head = header_at(line, version) or header_at(line, 1)
        else:
            head = header_at(line, version)
        if head is None:
            stop = next_header(end + 1)
            yield ArcRecord(number, "", "-", "", "", data[pos:stop], "header")
            number, pos = number + 1, stop
            continue
        start, problem = end + 1, None
        stop = start + int(head[head.lastindex])
        if stop > len(data):
            stop, problem = len(data), "truncated"
        elif stop < len(data) and data[stop : stop + 1] not in (b"\n", b"\r"):
            stop, problem = next_header(start), "length"
        block = data[start:stop].rstrip(b"\r\n") if problem == "length" else data[start:stop]
        yield ArcRecord(number, head[1].decode("utf-8", "replace"), head[2].decode(), head[3].decode(), head[4].decode("latin-1"), block, problem)
        number, pos = number + 1, stop


def write_arc(rows: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, captured: str = "20000101000000", size: int = 1 << 24, level: int = 4) -> str:
    """The rows as ARC files below ``path``, of versions 1 and 2 in turn, about ``size`` packed bytes each; gives ``path``.

    A row's block is an HTTP response with the text of ``payload_col`` in UTF-8 (null: empty); its header carries the id,
    if there is one.  URLs are percent-encoded where they need it, and made from the id where null or empty.  Repeated
    rows are records of their own, a table without rows makes no record, other columns aren't looked at.  There is no
    shuffle; archives are named by partition and number, so a lost task writes the same again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(f"pages-{TaskContext.get().partitionId():06d}", captured, size, level)
        for batch in batches:
            for key, url, text in zip(*(batch.column(k) for k in range(3))):
                if full := archive.add(key.as_py(), url.as_py(), (text.as_py() or "").encode()):
                    yield pa.RecordBatch.from_arrays([pa.array([full], pa.binary())], ["content"])
        if full := archive.close():
            yield pa.RecordBatch.from_arrays([pa.array([full], pa.binary())], ["content"])

    named = rows.select(F.col(id_col).cast("string").alias("key"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    return _write(named.mapInArrow(run, "content binary"), path)


class Archive:
    """ARC files in the making, one after the other."""

    def __init__(self, name: str, captured: str, size: int, level: int):
        self.name, self.captured, self.size, self.level = name, captured, size, level
        self.made, self.parts, self.length = 0, [], 0

    def _put(self, head: bytes, block: bytes) -> None:
        self.parts.append(member(head + b"\n" + block + b"\n", self.level))
        self.length += len(self.parts[-1])

    def add(self, key: str | None, url: str | None, payload: bytes) -> bytes | None:
        """Adds a record; gives the archive before it where that one is full."""
        full = self.close() if self.length >= self.size else None
        version, file = 1 + self.made % 2, f"{self.name}-{self.made:05d}.arc.gz"
        if not self.parts:
            block = b"%d 0 tessera\n%s\n" % (version, FIELDS[version])
            self._put(self._head(version, f"filedesc://{file}", "text/plain", block, file), block)
        named = f"{SOURCE}: {quote(key)}\r\n" if key is not None else ""
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        self._put(self._head(version, quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:source:{quote(key or '')}", "text/html", block, file), block)
        return full

    def _head(self, version: int, url: str, kind: str, block: bytes, file: str) -> bytes:
        more = f"200 {sha1(block)} - {self.length} {file} " if version == 2 else ""
        return f"{url} 0.0.0.0 {self.captured} {kind} {more}{len(block)}".encode()

    def close(self) -> bytes | None:
        full, self.parts, self.length = b"".join(self.parts), [], 0
        self.made += 1
        return full or None


def _write(archives: DataFrame, path: str) -> str:
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


# ---- conversion


def record_id(name: str, number: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}')}"


def _name(path: str, records: list[ArcRecord]) -> str:
    """What an archive calls itself, or else the last part of its path."""
    return records[0].url.removeprefix("filedesc://") if records and records[0].url.startswith("filedesc:") else path.rsplit("/", 1)[-1]


RECORDS = "archive string, number int, type string, problem string, source_id string, target_uri string, date string, record_id string, payload_bytes bigint, payload_key string"


def describe_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the ARC files below ``path``, without its block: ``archive`` (the file), ``number``, ``type``
    (warcinfo, response, resource), ``problem`` (null for a sound one), ``source_id``, ``target_uri``, ``date``, ``record_id``,
    ``payload_bytes`` and ``payload_key`` (SHA-256)."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int32() if n == "number" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name, rows = None, []
                for r in arc_records(content.as_py()):
                    name = name or _name(file.as_py(), [r])
                    rows.append((file.as_py(), r.number, r.type, r.problem, r.source, r.url, r.iso_date if r.date else None, record_id(name, r.number), len(r.payload), hashlib.sha256(r.payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names)

    return _files(spark, path).mapInArrow(run, RECORDS)


def revisits(records: DataFrame, rank: Column, least: int = 0) -> DataFrame:
    """``archive, number`` of the responses that repeat another's payload, of ``least`` bytes at least, with ``best``: archive,
    number, source_id, target_uri, date and record_id of the one that keeps it, which has the largest ``rank`` (nulls
    last; of equal ranks one).

    Payloads are equal if their SHA-256 is.  ``records`` is read several times and should be held.  Groups of more than a
    thousandth of all records, of which there are less than a thousand, are broadcast; only the others are joined by a
    shuffle, so no key of it has more rows than that."""
    found = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    best = F.max(F.struct(rank.alias("rank"), "archive", "number", "source_id", "target_uri", "date", "record_id")).alias("best")
    groups = held(found.groupBy("payload_key").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1"))
    hot = 1 + found.count() // 1000
    key = F.col("payload_key") == F.col("of")
    marked = found.join(F.broadcast(groups.where(F.col("n") > hot).select(F.col("payload_key").alias("of"), "best")), key, "left")
    rest = marked.where("of is null").drop("of", "best").join(groups.where(F.col("n") <= hot).select(F.col("payload_key").alias("of"), "best"), key)
    both = marked.where("of is not null").select("archive", "number", "best").unionByName(rest.select("archive", "number", "best"))
    return both.where((F.col("archive") != F.col("best.archive")) | (F.col("number") != F.col("best.number")))


def to_warc(name: str, records: list[ArcRecord], repeats: dict[int, dict], level: int = 4) -> bytes:
    """The WARC archive of an ARC archive's records. ``repeats``: what the revisits among them refer to, by number.
    Stretches that are no record aren't carried over."""
    def made(r: ArcRecord, kind: str, more: dict[str, str], content_type: str, block: bytes) -> bytes:
        named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(name, r.number)}>", "WARC-Date": r.iso_date} | more
        named |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
        return member("".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in named.items()], "\r\n"]).encode() + block + b"\r\n\r\n", level)

    warc, parts = re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz", []
    for r in records:
        if r.problem == "header":
            continue
        if r.type == "warcinfo":
            parts.append(made(r, "warcinfo", {"WARC-Filename": warc}, "application/warc-fields", f"format: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()))
            continue
        more = {"WARC-Target-URI": r.url} | ({"WARC-IP-Address": r.ip} if r.ip not in ("-", "0.0.0.0") else {}) | {"WARC-Payload-Digest": f"sha1:{sha1(r.payload)}"}
        if r.problem == "truncated":
            more["WARC-Truncated"] = "unspecified"
        if r.source is not None:
            more[SOURCE] = quote(r.source)
        if r.type == "resource":
            parts.append(made(r, "resource", more, "text/dns" if r.url.startswith("dns:") else r.kind, r.block))
        elif (of := repeats.get(r.number)) is None:
            parts.append(made(r, "response", more, "application/http; msgtype=response", r.block))
        else:
            more |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{of['record_id']}>", "WARC-Refers-To-Target-URI": of["target_uri"], "WARC-Refers-To-Date": of["date"], FULL: str(len(r.payload))}
            if of["source_id"] is not None:
                more[REFERS] = quote(of["source_id"])
            parts.append(made(r, "revisit", more, "application/http; msgtype=response", r.block[: r.http]))
    return b"".join(parts)


def convert(spark: SparkSession, arc_path: str, warc_path: str, rank: Column | None = None, least: int = 0, level: int = 4) -> DataFrame:
    """Writes the ARC files below ``arc_path`` as WARC files below ``warc_path``, and gives ``describe_arc`` of the former.

    Records are response, resource or warcinfo records; ids follow from the archive's own name and the record's place in
    it, dates and types from its header, digests from its block and payload.  Of the responses with equal payloads one is
    kept (``revisits``; ``rank`` defaults to the source's id as a number), the others become revisit records.  A record
    that the archive's end cuts is marked as truncated; one whose declared length is wrong ends before the next header;
    both, and stretches without a header, which are left out, have their ``problem`` in the result.  A folder without
    records gives none.

    Archives are read twice: once for what describes their records, once to be rewritten, joined with the few facts on
    their own revisits.  Each is held in one task."""
    records = held(describe_arc(spark, arc_path))
    found = revisits(records, F.col("source_id").try_cast("bigint") if rank is None else rank, least)
    grouped = found.groupBy("archive").agg(F.collect_list(F.struct("number", "best.source_id", "best.target_uri", "best.date", "best.record_id")).alias("repeats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, repeats in zip(*(batch.column(k) for k in range(3))):
                there = list(arc_records(content.as_py()))
                if there:
                    warc = to_warc(_name(file.as_py(), there), there, {x["number"]: x for x in repeats.as_py() or []}, level)
                    yield pa.RecordBatch.from_arrays([pa.array([warc], pa.binary())], ["content"])

    joined = _files(spark, arc_path).join(grouped.withColumnRenamed("archive", "of"), F.col("archive") == F.col("of"), "left").select("archive", "content", "repeats")
    _write(joined.mapInArrow(run, "content binary"), warc_path)
    return records


# ---- WARC

WARC_RECORDS = "archive string, number int, type string, record_id string, target_uri string, date string, source_id string, payload_bytes bigint, payload_digest string, refers_to string, refers_to_source_id string, intact boolean"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record of a WARC archive."""
    data, pos = unpacked(content), 0
    while (end := data.find(b"\r\n\r\n", pos)) >= 0:
        lines = data[pos:end].decode().split("\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(named["content-length"])
        yield named, data[start:stop]
        pos = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files below ``path``.  ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are those
    of the full payload, also of revisits; ``intact``: block and, where it is there, payload have their digests."""
    names = [f.split()[0] for f in WARC_RECORDS.split(", ")]
    kinds = [{"number": pa.int32(), "payload_bytes": pa.int64(), "intact": pa.bool_()}.get(n, pa.string()) for n in names]

    def row(file: str, number: int, named: dict[str, str], block: bytes) -> tuple:
        get, digest = named.get, lambda name: (named.get(name) or "").removeprefix("sha1:") or None
        record = ArcRecord(number, "", "", "", "", block)
        payload = record.payload if get("warc-type") in ("response", "resource") else None
        sound = digest("warc-block-digest") == sha1(block) and (payload is None or digest("warc-payload-digest") == sha1(payload))
        size = len(payload) if payload is not None else int(get(FULL.lower(), 0)) if get("warc-type") == "revisit" else None
        plain = lambda x: None if x is None else unquote(x)
        return (file, number, get("warc-type"), get("warc-record-id", "").strip("<>"), get("warc-target-uri"), get("warc-date"), plain(get(SOURCE.lower())), size,
                digest("warc-payload-digest"), get("warc-refers-to", "").strip("<>") or None, plain(get(REFERS.lower())), sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = [row(file.as_py(), k, named, block) for k, (named, block) in enumerate(warc_records(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return _files(spark, path).mapInArrow(run, WARC_RECORDS)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
