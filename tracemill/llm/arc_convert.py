"""Convert legacy ARC archives to WARC, with revisit records for equal payloads.

ARC files start with a version block whose first line names the file and whose second line has the version
number; it says which fields the header line of every record has.  The last field is the declared length of
the record's block, by which alone records are told apart.  The converter derives what WARC wants from the
header and the block: an identifier from place and content, the ISO form of the 14-digit time, the type from
the scheme, and digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.files import new_file, open_file

#: Header fields of the two ARC versions, and WARC's names: fixed values of the formats.
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "20240101000000"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _address(url: str | None) -> str:
    """The URL as one word: blanks and control characters percent-encoded; '-' for none."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"


def arc_version_block(name: str, version: int) -> bytes:
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "code": "Result-code",
             "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
    body = f"{version} 0 converter\n{' '.join(names[f] for f in FIELDS[version])}\n".encode()
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": WHEN, "type": "text/plain", "code": "200", "checksum": "-",
              "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return (" ".join(values[f] for f in FIELDS[version]) + "\n").encode() + body + b"\n"


def arc_record(url: str | None, page_id: int | None, payload: bytes, name: str, version: int, offset: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    block = (head + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n").encode() + payload
    values = {"url": _address(url), "ip": "192.0.2.1", "date": WHEN, "type": "text/html", "code": "200", "checksum": "-",
              "location": "-", "offset": str(offset), "filename": name, "length": str(len(block))}
    return (" ".join(values[f] for f in FIELDS[version]) + "\n").encode() + block + b"\n"


def _plain(source):
    """The content of a file that may be gzip, one member after the other."""
    return gzip.GzipFile(fileobj=source) if source.peek(2)[:2] == b"\x1f\x8b" else source


def read_arc(source):
    """(header fields, block) of each record after the version block of an ARC file."""
    stream = _plain(source)
    first = stream.readline()
    if not first:
        return
    version_block = stream.read(int(first.rsplit(b" ", 1)[1]))
    fields = FIELDS[int(version_block.split(b" ", 1)[0])]
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8").rstrip("\n").rsplit(" ", len(fields) - 1)  # a URL may hold blanks
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line with {len(parts)} of {len(fields)} fields")
        header = dict(zip(fields, parts))
        block = stream.read(int(header["length"]))
        if len(block) != int(header["length"]):
            raise ValueError("ARC record is shorter than its declared length")
        yield header, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of an HTTP response; without headers all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.split(":", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, head + b"\r\n\r\n", payload


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, place: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{place}')}"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields.items(), ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def convert(header: dict[str, str], block: bytes, path: str, place: int, refers: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; refers: identifier, URL and date of the response it revisits."""
    parts, head, payload = http_parts(block)
    kind = "revisit" if refers else "response" if parts or header["url"].startswith(("http://", "https://")) else "resource"
    body = head if refers else block
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(path, place)}>", "WARC-Date": warc_date(header["date"]),
              "WARC-Target-URI": header["url"], "WARC-IP-Address": header["ip"],
              "Content-Type": "application/http; msgtype=response" if head else header["type"],
              "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(body)}"}
    if refers:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers[0]}>", "WARC-Refers-To-Target-URI": refers[1], "WARC-Refers-To-Date": refers[2]}
    return warc_record(fields, body)


def read_warc(source):
    """(header fields by lower-case name, block) of each record of a WARC file."""
    stream = _plain(source)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields["content-length"]))


def write_arc(pages: DataFrame, folder: str, per_file: int = 32 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as legacy archives of both versions; (path) of each file."""

    def write(batches):
        paths, rows = [], ((v.as_py(), u.as_py(), h.as_py()) for b in batches for v, u, h in zip(*b.columns))
        row = next(rows, None)
        while row is not None:
            version = 1 + len(paths) % 2
            with new_file(folder, f".v{version}.arc.gz") as (out, path):
                name = path.rpartition("/")[2]
                at = out.write(gzip.compress(arc_version_block(name, version), 1))
                while row is not None and at < per_file:
                    page_id, url, html = row
                    at += out.write(gzip.compress(arc_record(url, page_id, (html or "").encode(), name, version, at), 1))
                    row = next(rows, None)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return common.materialize(pages.mapInArrow(write, "path string"), "arc-files")


def _dealt(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows of files(path), or the files themselves, by path into a task for each file, up to 10,000.

    A path is a small row and its work is not, so the number of tasks must not follow the rows' size.
    """
    return (files if rows is None else rows).repartition(max(1, min(files.count(), 10_000)), "path")


def index_arc(files: DataFrame) -> DataFrame:
    """A row for each record of ARC files(path): place in the file, page, payload digest and size, identifier, URL, date."""

    def scan(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with open_file(path) as source:
                    for place, (header, block) in enumerate(read_arc(source)):
                        parts, _, payload = http_parts(block)
                        page = parts.get("x-page-id")
                        rows.append((path, place, int(page) if page else None, digest(payload), len(payload), record_id(path, place), header["url"], warc_date(header["date"])))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)],
                                                 names=["path", "place", "page_id", "digest", "size", "id", "url", "date"])

    schema = "path string, place long, page_id long, digest string, size long, id string, url string, date string"
    return _dealt(files).mapInArrow(scan, schema)


def convert_arc(files: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Convert ARC files(path) to WARC files, one for each; (path) of these.

    Of the records with equal payloads of at least `least` bytes, that with the largest page (the last in
    place among equal pages) is a response and the others revisit it.
    """
    index = common.materialize(index_arc(files), "arc-index")
    last = F.max(F.struct("page_id", "path", "place", "id", "url", "date"))
    groups = index.filter(F.col("size") >= least).groupBy("digest", "size").agg(last.alias("r"), F.count("*").alias("n")).filter("n > 1")
    own = (F.col("path") == F.col("r.path")) & (F.col("place") == F.col("r.place"))
    plan = index.select("path", "place", "digest", "size").join(groups.select("digest", "size", "r"), ["digest", "size"], "left")
    plan = plan.select("path", "place", F.when(F.col("r").isNotNull() & ~own, F.struct("r.id", "r.url", "r.date")).alias("refers"))

    def write(batches):
        made, records, source, now, out, close = [], None, None, None, None, None
        rows = ((p, k, r) for b in batches for p, k, r in zip(*(c.to_pylist() for c in b.columns)))
        for path, place, refers in rows:
            if path != now:
                if close:
                    for c in close:
                        c.__exit__(None, None, None)
                reader, writer = open_file(path), new_file(folder, ".warc.gz")
                source, (out, target) = reader.__enter__(), writer.__enter__()
                close, now, records = (reader, writer), path, enumerate(read_arc(source))
                made.append(target)
                info = b"software: converter\r\nformat: WARC File Format 1.1\r\n"
                out.write(gzip.compress(warc_record({
                    "WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id(path, -1)}>", "WARC-Date": warc_date(WHEN),
                    "WARC-Filename": target.rpartition("/")[2], "Content-Type": "application/warc-fields"}, info), 1))
            at, (header, block) = next(records)
            if at != place:
                raise ValueError("plan and archive differ")
            out.write(gzip.compress(convert(header, block, path, place, (refers["id"], refers["url"], refers["date"]) if refers else None), 1))
        if close:
            for c in close:
                c.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    plan = _dealt(files, plan).sortWithinPartitions("path", "place")
    return common.materialize(plan.mapInArrow(write, "path string"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id) of WARC files(path).

    Digests of responses are computed anew from what was read; a revisit's are those of its header fields.
    """

    def scan(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with open_file(path) as source:
                    for fields, block in read_warc(source):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        parts, _, payload = http_parts(block)
                        revisit = fields["warc-type"] == "revisit"
                        page = parts.get("x-page-id")
                        rows.append((
                            int(page) if page else None, int(parts["content-length"]) if revisit else len(payload),
                            fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(payload), fields["warc-type"],
                            fields.get("warc-refers-to", "").strip("<>") or None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"].strip("<>")))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "of", "url", "date", "record_id"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, of string, url string, date string, record_id string"
    rows = common.materialize(_dealt(files).mapInArrow(scan, schema), "warc-rows")
    targets = rows.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
    hit = rows.select("of").filter("of is not null").distinct().join(targets, "of")
    return rows.join(hit, "of", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to legacy archives, these to WARC, and the WARC files read back; a row for each page.

    Null html is an empty payload, like an empty one; null url is '-'.  Repeated rows are records of their
    own that revisit the last of them.  A null page_id is kept and loses to any other.  An empty table makes
    no files and no rows.
    """
    spark = pages.sparkSession
    files = write_arc(pages, common.shared_folder(spark, "arc"))
    return read_archives(convert_arc(files, common.shared_folder(spark, "warc"), least))
