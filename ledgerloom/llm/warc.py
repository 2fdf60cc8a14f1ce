"""WARC archives: a distributed writer and a reader that salvages what follows damage."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, cut, lean, lookup, scratch_path, slices

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_BAD = re.compile(r"[\x00-\x20\x7f]")


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    """Why no record starts here."""


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member; an empty member follows records of 16 MiB or more, so that its last byte is zero."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out


class _Ends:
    """Where headers end: the first empty line after a place, looked for once for all places before it."""

    def __init__(self, data: bytes):
        self.data, self.since, self.end = data, 0, -2

    def after(self, at: int) -> int:
        if self.end == -2 or at < self.since or -1 < self.end < at:
            self.since, self.end = at, self.data.find(b"\r\n\r\n", at)
        return self.end


def _plain(data: bytes, at: int, whole: bool, ends: _Ends) -> Record:
    """The record whose version line starts at `at`; whole: it must fill the data.

    Lines are read one by one, and a version line is a bad header line, so that of many false ones each
    is read up to the next.
    """
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    head = ends.after(at)
    if head < 0:
        raise Damaged("no end of headers")
    headers = {}
    line = data.find(b"\r\n", at) + 2
    while line < head:
        stop = data.find(b"\r\n", line, head + 2)
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        line = stop + 2
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    end = head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n" or whole and end + 4 != len(data):
        raise Damaged("content length does not meet the record's end")
    block = data[head + 4 : end]
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and headers.get("warc-type") == "response":
        if hashlib.sha256(payload(headers, block)).hexdigest() != digest[7:]:
            raise Damaged("payload digest differs")
    return Record(at, end + 4, headers, block)


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends; its checksum and length are checked."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    pos = at
    try:
        while not unpack.eof:
            if pos >= len(data):
                raise Damaged("gzip member is cut short")
            out.append(unpack.decompress(view[pos : pos + step]))
            pos += step
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data)


def _one(data: bytes, at: int, ends: _Ends) -> Record | int:
    """The record at `at`, or where an empty gzip member there ends."""
    if data.startswith(GZIP, at):
        inside, end = _inflate(data, at)
        if not inside:
            return end
        found = _plain(inside, 0, True, _Ends(inside))
        return Record(at, end, found.headers, found.block)
    return _plain(data, at, False, ends)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive, compressed by record or not, in order.

    Where no valid record starts (bad checksum, length, digest or headers), the bytes up to the next
    gzip member or version line that starts a valid one are a gap; the rest is read on from there.
    """
    at, ends = 0, _Ends(data)
    while at < len(data):
        try:
            found = _one(data, at, ends)
        except Damaged as why:
            reason, start, found = str(why), at, None
            spot = NEXT.search(data, at + 1)
            while spot:
                try:
                    found = _one(data, spot.start(), ends)
                    break
                except Damaged:
                    spot = NEXT.search(data, spot.start() + 1)
            if found is None:
                yield Gap(start, len(data), reason)
                return
            at = spot.start()
            yield Gap(start, at, reason)
        if isinstance(found, Record):
            yield found
            at = found.end
        else:
            at = found


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """The HTTP body of a record's block, the whole block of other kinds."""
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        return block[head + 4 :] if head >= 0 else b""
    return block


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 100) -> DataFrame:
    """(id, digest, refers_to): pages that repeat the payload of a page with a smaller id.

    Only digests are shuffled, and they are counted before: payloads that stand alone go no further.
    """
    raw = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    prints = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("n")).where(F.col("n") >= least)
    prints = cut(prints.select("id", "digest"))
    first = cut(prints.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select("digest", "refers_to"))
    return cut(lookup(prints, first, "digest", rows=FEW >> 2).where("id <> refers_to").select("id", "digest", "refers_to").distinct())


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, per_file: int = 8, chunk: int = 4 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes .warc.gz files, a gzip member for each row, into the folder `path` of any file system Spark knows.

    Of rows with equal payloads of `least` bytes or more, those with the smallest id are responses and
    the others revisits of it; smaller payloads and rows without an id are responses. A null payload is
    empty; a null URL becomes the record's id. The text writer stores the bytes: each member ends in a
    zero byte, which is the writer's line separator, so the files hold nothing but members.

    A row of the writer is a run of members that ends once it has `chunk` bytes, and a file has per_file
    rows: its size is below per_file times the sum of chunk and the longest member.
    """

    def run(batches):
        out, held = [], 0
        for batch in slices(batches):
            pages_, urls, htmls, refs = (batch.column(i).to_pylist() for i in range(4))
            for page, url, html, ref in zip(pages_, urls, htmls, refs):
                body = (html or "").encode()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                headers = [
                    ("WARC-Type", "response" if ref is None else "revisit"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", date),
                    ("WARC-Target-URI", _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page)[1:-1]),
                    ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest()), ("Content-Type", "application/http; msgtype=response"),
                ]
                if ref is not None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(ref))]
                out.append(member(build(headers, http if ref is not None else http + body)))
                held += len(out[-1])
                if held >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["member"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["member"])

    lean(pages.sparkSession)
    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    again = revisits(chosen, "id", "html", least)
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    known = lookup(chosen.withColumn("digest", digest), again, ["id", "digest"], "left", FEW >> 2).select("id", "url", "html", "refers_to")
    members = known.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


SCHEMA = "file string, start long, end long, gap string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of SCHEMA for all archives in a folder: a row for each record, and one for each byte gap.

    gap is null for records and the reason for gaps, whose other fields are null. Digest and size of
    a response are those of the payload read, of a revisit those its headers tell. An archive is one
    task's and one value, so it must be below 2 GiB; write() bounds its size in bytes. payloads=True adds the payload of responses.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def row(file, x):
        if isinstance(x, Gap):
            return (file, x.start, x.end, x.reason, *[None] * 7)
        kind, get = x.headers.get("warc-type"), x.headers.get
        body = payload(x.headers, x.block)
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)", x.block)
            size, digest, body = int(told[1]) if told else None, get("warc-payload-digest", "").removeprefix("sha256:") or None, None
        return file, x.start, x.end, None, kind, _page(get("warc-record-id")), get("warc-target-uri"), _page(get("warc-refers-to")), size, digest, body if payloads else None

    def run(batches):
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("start", "end", "page_id", "refers_to", "payload_bytes") else pa.string()) for n in names])
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, held = batch.column(0)[i].as_py(), [], 0
                for x in salvage(batch.column(1)[i].as_py()):
                    rows.append(row(file, x))
                    held += len(rows[-1][-1] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages into archives in the shared folder and returns what the reader finds there."""
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return whole(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def whole(records: DataFrame) -> DataFrame:
    """Records of archives that may have no gap: the first one found ends the job with its file and place."""
    told = F.concat(F.lit("unreadable bytes in "), "file", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "gap")
    return records.withColumn("page_id", F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(F.raise_error(told).cast("long")))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
