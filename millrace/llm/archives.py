"""Legacy web archives (ARC) to WARC, and back to rows.

An ARC file opens with a version block that names its version; every record is a header
line and as many bytes as the line declares. Version 1 lines have five fields, version 2
lines ten. The converter reads lines by their version and bodies by their declared length
(never by a separator), and makes WARC records of them: identifiers derived from the
record's place and content, 14-digit dates as timestamps, record types, and SHA-1 digests
of block and payload. A block that is an HTTP response becomes a response record; all else
(dns: lookups, plain files) a resource, whose payload is the whole block and which keeps
its declared type. A payload that occurs in several responses is stored once; the others
become revisits that refer to it.

What can't be read is left out with a reason, and the rest of the file is read on: a URL
may hold spaces (the fields are counted from the end of the line); a line that is no
header, or has no length or no date, is passed over up to the next line that is one; a
record longer than the rest of its file, and damaged compression, end the file.

Files are cut by running bytes: a task gathers records up to FILE_BYTES before compression
(or one record that is larger by itself) and hands them to Spark's text writer as one row,
which makes one gzip-compressed file. They are read as whole binary files, inflated in a
stream. Which record is the response is one aggregate over digests and one join, on Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shelf

ARC_DATE = "20240101000000"
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SOURCE_HEADER = b"X-Source-Id"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of a file before compression; a larger record has a file of its own.
FILE_BYTES = 32 << 20
_STEP = 1 << 20
_FLUSH = 4 << 20


class Stream:
    """Bytes of a gzip-compressed or plain file, by line or by length."""

    def __init__(self, data):
        self.data, self.at, self.buffer, self.pos = memoryview(data), 0, b"", 0
        self.inflate = zlib.decompressobj(31) if bytes(self.data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        step = bytes(self.data[self.at : self.at + _STEP])
        self.at += len(step)
        if self.inflate is None:
            out = step
        else:
            out = self.inflate.decompress(step)
            while self.inflate.eof and self.inflate.unused_data:
                rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                out += self.inflate.decompress(rest)
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer, self.pos = self.buffer[self.pos :] + out, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (k := self.buffer.find(b"\n", self.pos)) < 0:
            if not self._more():
                rest, self.pos = self.buffer[self.pos :], len(self.buffer)
                return rest or None
        out, self.pos = self.buffer[self.pos : k], k + 1
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.pos < n and self._more():
            pass
        out = self.buffer[self.pos : self.pos + n]
        self.pos += len(out)
        if len(out) < n:
            raise Damaged(f"a record declares {n} bytes, the file has {len(out)} more")
        return out


class Damaged(Exception):
    """A record that can't be read; the message says why."""


def _header(line: bytes, version: int) -> dict:
    """Fields of a header line of a version; 0, where no version block stands before it, goes by the number of fields."""
    parts = line.split(b" ")
    if not version:
        version = 2 if len(parts) >= 10 and parts[-1].isdigit() and parts[-8].isdigit() else 1
    more = len(ARC_FIELDS[version].split(" ")) - 1
    if len(parts) <= more:
        raise Damaged("no header line")
    fields = parts[-more:]
    if not fields[-1].isdigit():
        raise Damaged("no length")
    if not (fields[1].isdigit() and 8 <= len(fields[1]) <= 14):
        raise Damaged("no date")
    # Old dates may lack hours, minutes or seconds.
    return {"url": b" ".join(parts[:-more]), "ip": fields[0], "date": fields[1].ljust(14, b"0"), "type": fields[2], "length": int(fields[-1])}


def arc_records(data) -> Iterator[dict]:
    """The records of an ARC file after its version block; where one can't be read, a `reason` and the line instead."""
    stream, version, lost = Stream(data), 0, False
    line = b""
    try:
        while (line := stream.line()) is not None:
            if not line:
                continue
            try:
                head = _header(line, 0 if line.startswith(b"filedesc://") else version)
            except Damaged as e:
                # One report for all lines up to the next header.
                if not lost:
                    yield {"reason": str(e), "line": line[:200]}
                lost = True
                continue
            lost = False
            body = stream.take(head.pop("length"))
            if line.startswith(b"filedesc://"):
                first = body.split(b" ", 1)[0]
                version = int(first) if first in (b"1", b"2") else 0
                continue
            yield {**head, "body": body, "reason": None}
    except (Damaged, zlib.error) as e:
        yield {"reason": str(e) if isinstance(e, Damaged) else "damaged compression", "line": (line or b"")[:200]}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    return head + blank, payload


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _quoted(url: str | None, page) -> bytes:
    """A URL without white space or control characters, as header lines need it."""
    text = url if url else f"urn:x-page:{page}"
    return b"".join(bytes([b]) if 0x20 < b < 0x7F else b"%%%02X" % b for b in text.encode())


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """ARC files of pages: version 1 and version 2 by turns of the task, one version to a file; each file opens with its version block."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    most = FILE_BYTES

    def run(batches):
        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        about = f"{version} {1 if version == 1 else 0} millrace\n{ARC_FIELDS[version]}\n".encode()

        def name(file: int) -> str:
            return f"part-{task:05d}-{file:05d}.arc"

        def opening(file: int) -> bytes:
            line = f"filedesc://{name(file)} 0.0.0.0 {ARC_DATE} text/plain " + ("" if version == 1 else f"200 - - 0 {name(file)} ") + str(len(about))
            return line.encode() + b"\n" + about

        def records():
            for batch in batches:
                for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    source = b"" if page is None else SOURCE_HEADER + b": %d\r\n" % page
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + source + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                    more = b"" if version == 1 else b"200 " + sha1_base32(payload).encode() + b" - 0 " + name(0).encode() + b" "
                    yield _quoted(url, page) + f" 0.0.0.0 {ARC_DATE} text/html ".encode() + more + b"%d\n" % len(block) + block

        yield from _archived(records(), opening, b"\n", most)

    _write(rows.mapInArrow(run, "file binary"), path, "\n")


def _archived(records: Iterator[bytes], opening, end: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """Rows that are a file each: what opens it, then records until their bytes reach `most`."""
    held, size, files = [], 0, 0
    for record in records:
        if held and size + len(record) > most:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])
            held, size, files = [], 0, files + 1
        if not held:
            held.append(opening(files))
        held.append(record)
        size += len(record) + len(end)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["file"])


def _write(files: DataFrame, path: str, end: str) -> None:
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Records of ARC files with the parts of a WARC record that need no other record; payloads are zstd-compressed.

    A record that can't be read has a `reason`, and its line as `url`.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, rows, held = name.rsplit("/", 1)[-1], [], 0
                for k, r in enumerate(arc_records(content.as_buffer())):
                    if r["reason"]:
                        rows.append((None, None, r["line"].decode(errors="replace"), None, None, None, None, None, None, r["reason"], None, None))
                        continue
                    http = r["body"].startswith(b"HTTP/")
                    head, payload = split_http(r["body"]) if http else (b"", r["body"])
                    digest, date, url = sha1_base32(payload), r["date"].decode(), _quoted(r["url"].decode(errors="surrogateescape"), k).decode()
                    source = http_field(head, SOURCE_HEADER)
                    made = uuid.uuid5(_SPACE, f"{file}|{k}|{url}|{date}|{digest}")
                    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
                    kind, mime = ("response", "application/http;msgtype=response") if http else ("resource", _quoted(r["type"].decode(errors="replace"), k).decode())
                    rows.append((int(source) if source is not None and source.lstrip(b"-").isdigit() else None, str(made), url, r["ip"].decode(errors="replace"), stamp, digest, len(payload), kind, mime, None, *((head, pa.compress(payload, "zstd", asbytes=True)) if payloads else (None, None))))
                    held += len(payload)
                    if held > _FLUSH:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    s = pa.string()
    schema = pa.schema([("page_id", pa.int64()), *((c, s) for c in ("record_id", "url", "ip", "date", "digest")), ("n", pa.int64()), ("kind", s), ("mime", s), ("reason", s), ("head", pa.binary()), ("payload", pa.binary())])
    return _files(spark, path).mapInArrow(run, "page_id long, record_id string, url string, ip string, date string, digest string, n long, kind string, mime string, reason string, head binary, payload binary")


def rejected(spark: SparkSession, arc: str) -> DataFrame:
    """(reason, line) of what convert() leaves out."""
    return read_arc(spark, arc, False).where("reason is not null").select("reason", F.col("url").alias("line"))


def convert(spark: SparkSession, arc: str, warc: str, shelf: Shelf, least_bytes: int = 0) -> None:
    """WARC files of ARC files. Of responses with equal payloads of at least `least_bytes` bytes the one with the largest source id stays one."""
    response = F.max(F.struct("page_id", "record_id", "url", "date")).alias("first")
    first = read_arc(spark, arc, False).where((F.col("kind") == "response") & (F.col("n") >= least_bytes)).groupBy("digest", "n", "kind").agg(response)
    first = shelf.put(first, "responses")  # stored, so that the join can split a payload that many records share
    records = read_arc(spark, arc, True).where("reason is null").join(first, ["digest", "n", "kind"], "left")
    columns = ["record_id", "url", "ip", "date", "digest", "n", "kind", "mime", "head", "payload", "first"]
    most = FILE_BYTES

    def run(batches):
        task = TaskContext.get().partitionId()
        about = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"

        def opening(file: int) -> bytes:
            made = uuid.uuid5(_SPACE, f"info|{warc}|{task}|{file}")
            return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{made}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about

        def made():
            for batch in batches:
                for record, url, ip, date, digest, n, kind, mime, head, payload, top in zip(*(batch.column(c) for c in columns), strict=True):
                    record, top, head = record.as_py(), top.as_py(), head.as_py()
                    kept = top is None or top["record_id"] == record
                    block = head + pa.decompress(payload.as_buffer(), n.as_py(), "zstd", asbytes=True) if kept else head
                    more = "" if kept else f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:uuid:{top['record_id']}>\r\nWARC-Refers-To-Target-URI: {top['url']}\r\nWARC-Refers-To-Date: {top['date']}\r\n"
                    fields = (
                        f"WARC/1.1\r\nWARC-Type: {kind if kept else 'revisit'}\r\nWARC-Record-ID: <urn:uuid:{record}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\n"
                        f"WARC-IP-Address: {ip}\r\nWARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{sha1_base32(block)}\r\n{more}"
                        f"Content-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n"
                    )
                    yield fields.encode() + block

        yield from _archived(made(), opening, b"\r\n\r\n", most)

    _write(records.select(columns).mapInArrow(run, "file binary"), warc, "\r\n\r\n")


def warc_records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record of a WARC file; where one can't be read, the last is a field `reason` only."""
    stream = Stream(data)
    try:
        while (line := stream.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise Damaged("no WARC record")
            fields = {}
            while line := stream.line():
                name, _, value = line.decode(errors="replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            if not fields.get("content-length", "").isdigit():
                raise Damaged("no length")
            yield fields, stream.take(int(fields["content-length"]))
    except (Damaged, zlib.error) as e:
        yield {"reason": str(e) if isinstance(e, Damaged) else "damaged compression"}, b""


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource and revisit: source_id, record_id, record_type, refers_to_record, payload_bytes, payload_digest, url, date, reason.

    The digest of a stored payload is computed and must be the one declared; a revisit has
    no payload, its length and digest are those that it declares. A record that can't be
    read, or isn't what it declares, has a `reason`.
    """

    def row(fields: dict[str, str], block: bytes):
        if "reason" in fields:
            return (*[None] * 8, fields["reason"])
        kind = fields.get("warc-type")
        if kind not in ("response", "resource", "revisit"):
            return None
        head, payload = (b"", block) if kind == "resource" else split_http(block)
        declared, reason = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
        length = http_field(head, b"Content-Length") or b""
        if kind == "revisit":
            n = int(length) if length.isdigit() else None
        else:
            n, made = len(payload), sha1_base32(payload)
            reason = None if declared in ("", made) else "another digest than declared"
            declared = made
        source = http_field(head, SOURCE_HEADER) or b""
        return (int(source) if source.lstrip(b"-").isdigit() else None, fields.get("warc-record-id"), kind, fields.get("warc-refers-to"), n, declared, fields.get("warc-target-uri"), fields.get("warc-date"), reason)

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in warc_records(content.as_buffer()):
                    if (one := row(fields, block)) is not None:
                        rows.append(one)
                    if len(rows) == 4096:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    s = pa.string()
    schema = pa.schema([("source_id", pa.int64()), ("record_id", s), ("record_type", s), ("refers_to_record", s), ("payload_bytes", pa.int64()), ("payload_digest", s), ("url", s), ("date", s), ("reason", s)])
    return _files(spark, path).mapInArrow(run, "source_id long, record_id string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, url string, date string, reason string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC read back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date.

    Null html counts as empty; a page without URL gets a urn of its id; URL characters that
    a header line can't hold are percent-encoded. Of rows with one id and payload one is
    the response. A null id comes before all others. An empty table gives an empty result;
    other columns play no part. A record of these archives that can't be read back raises.
    """
    spark, shelf = pages.sparkSession, Shelf(pages.sparkSession, "archives")
    write_arc(pages, shelf.path("arc"), id_col, url_col, html_col)
    convert(spark, shelf.path("arc"), shelf.path("warc"), shelf, least_bytes)
    shelf.drop("arc")
    rows = read_warc(spark, shelf.path("warc"))
    sound = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("an archive can't be read back: "), "reason")).cast("string")).otherwise(F.col("record_type"))
    # A response looks itself up, so that no key stands for all of them.
    rows = rows.withColumn("record_type", sound).withColumn("key", F.coalesce("refers_to_record", "record_id"))
    first = rows.where("record_type = 'response'").select(F.col("record_id").alias("key"), F.col("source_id").alias("response_id"))
    refers = F.when(F.col("record_type") == "revisit", F.col("response_id")).alias("refers_to")
    return rows.join(first, "key", "left").select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers, "record_id", "url", "date")
