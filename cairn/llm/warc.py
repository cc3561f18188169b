"""Legacy ARC archives to WARC, and both read and written."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bitmap, marked

#: Fields of a record's header line by the archive's version (fixed values of the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = b"WARC/1.0"
#: Bytes of an ARC file's payload and of a WARC file's records at most, unless one record is larger.
ARC_BYTES, WARC_BYTES = 4 << 20, 16 << 20
#: Bytes of a gzip file that are read at a time, and a member of no content, which stands between records in place of the text writer's line breaks (fixed value of the format).
STEP = 1 << 14
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _field(x: str | None) -> str:
    """A value for a header line: never empty, no white space."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x or "") or "-"


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "archive.arc") -> bytes:
    """records: url, ip, date (14 digits), type, content."""
    about = f"{version} 0 cairn\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = "" if version == 1 else "200 - - 0 " + name + " "
    out = [f"filedesc://{name} 0.0.0.0 {records[0][2] if records else '19960101000000'} text/plain {rest}{len(about)}\n".encode(), about, b"\n"]
    size = sum(map(len, out))
    for url, ip, date, kind, content in records:
        middle = "" if version == 1 else f"200 {base64.b32encode(hashlib.sha1(content).digest()).decode()} - {size} {name} "
        out += [f"{_field(url)} {_field(ip)} {date} {_field(kind)} {middle}{len(content)}\n".encode(), content, b"\n"]
        size += sum(map(len, out[-3:]))
    return b"".join(out)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file, each read to its end in small steps: what follows a member is not copied for each."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        if data.startswith(EMPTY_MEMBER, at):
            at += len(EMPTY_MEMBER)
            continue
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            step = view[at : at + STEP]
            out.append(member.decompress(step))
            at += len(step)
        if not member.eof:
            raise ValueError("a gzip member ends before its trailer")
        at -= len(member.unused_data)
    return b"".join(out)


def read_arc(data: bytes):
    """Records of an ARC file (gzip or not) after its version block, as (fields, content): by the header line that the version
    block declares and by declared lengths. A header line or length that doesn't fit raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        data = _gunzip(data)
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if names and len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"a header line at byte {at} that the archive's version doesn't declare")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"the record at byte {at} ends before its declared length")
        at = end + 1 + length
        if names is None:
            head = content.decode("utf-8", "replace").split("\n")
            version = head[0].split(" ")[0]
            names = head[1].rstrip("\r").split(" ") if len(head) > 1 and head[1] else ARC_FIELDS[int(version)]
        else:
            yield dict(zip(names, values)), content


def _http(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head with its blank line, body and header fields in lower case; content that isn't HTTP is all body."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return b"", content, {}
    lines = content[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return content[: end + 4], content[end + 4 :], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


CONVERTED = "url string, ip string, date string, record_id string, source_id long, head binary, payload binary, payload_bytes long, payload_digest string"


def convert_arcs(archives: DataFrame) -> DataFrame:
    """One row (CONVERTED) per record of ARC files (content binary): WARC identifier (from url, date and content, and so the same
    in every run), ISO date, HTTP head, payload and digest. Null or empty content has no records."""

    def convert(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, content in read_arc(data.as_py() or b""):
                    head, body, http = _http(content)
                    url, d = fields.get("URL", "-"), (fields.get("Archive-date", "") + "19960101000000"[len(fields.get("Archive-date", "")) :])[:14]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {d} {hashlib.sha1(content).hexdigest()}")
                    own = http.get("x-source-id", "")
                    rows.append((url, fields.get("IP-address"), date, f"<urn:uuid:{name}>", int(own) if re.fullmatch(r"-?\d+", own) else None, head, body, len(body), _digest(body)))
                if rows:
                    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in CONVERTED.split(", ")])

    return archives.select(F.col("content").cast("binary")).mapInArrow(convert, CONVERTED)


def pages_to_arcs(pages: DataFrame) -> DataFrame:
    """ARC files (content) of pages (page_id, url, html), one HTTP response each; files of either version by turns."""

    def write(batches):
        held, size, version = [], 0, 1
        schema = pa.schema([("content", pa.binary())])
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = (html or "").encode("utf-8", "replace")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Source-Id: {'' if page is None else page}\r\n\r\n"
                held.append((url, "0.0.0.0", "20000101000000", "text/html", head.encode() + body))
                size += len(body)
                if size >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_file(held, version)], pa.binary())], schema=schema)
                    held, size, version = [], 0, 3 - version
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([arc_file(held, version)], pa.binary())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "content binary")


def mark_revisits(records: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Adds record_type, refers_to and refers_to_id to converted records, a table of Scratch.save: of equal payloads of at least
    `least` bytes the smallest source_id is the response (all rows of it, where it repeats), the others revisit it. Records without
    source_id are responses.

    Only digests and ids are grouped. Records that bitmap() leaves unmarked are read past the join; of the others, revisits for
    all but a few, no payload is needed where the join finds one."""
    slim = records.filter((F.col("payload_bytes") >= least) & F.col("source_id").isNotNull()).select("payload_digest", "payload_bytes", "source_id", "record_id")
    first = slim.groupBy("payload_digest", "payload_bytes").agg(F.min_by(F.struct("source_id", "record_id"), F.struct("source_id", "record_id")).alias("first"))
    again = slim.join(first.hint("merge"), ["payload_digest", "payload_bytes"]).filter("source_id != first.source_id")
    again = scratch.save(again.select("source_id", "payload_digest", "payload_bytes", F.col("first.source_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_id")).distinct())
    marks, at = bitmap(again, "source_id"), records.columns.index("source_id")

    def rows(want: bool):
        return lambda batches: (marked(b, marks, want, at) for b in batches)

    unsure = records.mapInArrow(rows(True), records.schema).join(again.hint("merge"), ["source_id", "payload_digest", "payload_bytes"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type")
    unsure = unsure.select(*records.columns, kind, "refers_to", "refers_to_id")
    sure = records.mapInArrow(rows(False), records.schema)
    return sure.select(*records.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_id")).unionByName(unsure)


def _record(fields: list[str], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own."""
    head = WARC_VERSION + b"\r\n" + "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 1, mtime=0)


def _about() -> bytes:
    block = b"software: cairn\r\nformat: WARC File Format 1.0\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, "cairn warcinfo")
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/warc-fields"], block)


def write_warc(records: DataFrame, folder: str) -> None:
    """Writes marked records as WARC files of about WARC_BYTES: a warcinfo record, then each record a gzip member. Spark's text
    writer writes one row a file, and its committer makes retried tasks safe; what it writes after a row is an empty member.
    Files bear that writer's .txt; they are .warc.gz by content."""

    def render(batches):
        schema = pa.schema([("value", pa.binary())])
        held, size = [], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([_about() + b"".join(held)], pa.binary())], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                again = r["record_type"] == "revisit"
                block = (r["head"] or b"") + (b"" if again else r["payload"])
                lines = [f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}"]
                lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{_digest(block)}", f"X-Payload-Length: {r['payload_bytes']}"]
                lines += [f"X-Source-Id: {'' if r['source_id'] is None else r['source_id']}"]
                if again:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {r['refers_to_id']}", f"X-Refers-To-Source-Id: {r['refers_to']}"]
                held.append(_record(lines, block))
                size += len(held[-1])
                if size >= WARC_BYTES:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    files = records.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(folder)


def parse_warc(data: bytes):
    """Records of a WARC file, as (header fields, block), by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = _gunzip(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["Content-Length"])
        yield fields, data[end + 4 : stop]
        at = stop + 4


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target string, block_bytes long, block_intact boolean"


def read_warc(spark, folder: str) -> DataFrame:
    """One row (READ) per record of the WARC files of a folder; digests of responses are computed from the payload read."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for f, block in parse_warc(data.as_py()):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    response = f["WARC-Type"] == "response"
                    body = _http(block)[1]
                    size, digest = (len(body), _digest(body)) if response else (int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"))
                    own, to = f.get("X-Source-Id"), f.get("X-Refers-To-Source-Id")
                    rows.append((int(own) if own else None, size, digest, f["WARC-Type"], int(to) if to else None, f["WARC-Record-ID"], f["WARC-Target-URI"], len(block), f["WARC-Block-Digest"] == "sha1:" + _digest(block)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select("content").mapInArrow(read, READ)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC, converts to WARC files in the shared folder and reads these back: READ.

    Null html is an empty payload, a null url `-`; white space in urls is percent-encoded. Rows of one page_id are
    records of their own; a null page_id is a response that nothing refers to. Empty input gives no record. Other columns
    are ignored. Only digests and identifiers are grouped; a payload that a third of all pages share is one row there. Files are
    bounded by bytes, so one holds a few long pages or many short ones.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    records = scratch.save(convert_arcs(pages_to_arcs(pages)))
    folder = scratch.folder()
    write_warc(mark_revisits(records, least, scratch), folder)
    scratch.drop(records)
    return read_warc(spark, folder)
