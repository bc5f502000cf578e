"""Legacy web archives (ARC) to WARC.

An ARC file begins with a record whose URL is filedesc://; its body names the version and the fields of the header lines that
follow (5 fields in version 1, 10 in version 2). Each record is such a line, then as many bytes as its last field declares, then a
line end. The converter reads the lines by their version and makes the WARC records that say the same: identifiers from
the archive's name and the record's place in it, W3C timestamps, types (response, resource, warcinfo; revisit for a payload that another record
holds), and SHA-1 digests of block and payload.

Archives are made, indexed, converted and read back by tasks, one archive at a time, record by record; a record is compressed
on its own. Which record of equal payloads stays whole is decided by a grouped maximum over the index of all archives. A file counts
only if a manifest, written when all tasks have ended, names it, so failed or repeated attempts leave nothing that is read.

Edge cases: a null html is an empty payload, which is a payload like others; a null url becomes urn:page:<id>; blanks and control
characters in a URL are percent-encoded, and what is encoded already stays as it is; rows without an id have no id header, and stand behind all others when the response is chosen; rows that share an
id share a payload's response by place; an empty table makes no archive. Lines between records that are no
header are skipped. An archive with a declared length beyond its end raises EOFError. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, stage, utf8
from .token_ids import filesystem

#: Field counts of header lines by version, and the lines that name them; fixed values of the format.
ARC_FIELDS = {1: 5, 2: 10}
ARC_LINES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The response header that carries a page's id through the archives.
ID_HEADER = "X-Page-Id"
LEVEL = 1
#: Blanks and control characters cannot stand in the URL field of a header line; others stay as they are.
_ESCAPES = {c: f"%{c:02X}" for c in (*range(33), 127)} | {c: f"%C2%{c:02X}" for c in range(0x80, 0xA1)} | {c: "".join(f"%{b:02X}" for b in chr(c).encode()) for c in (0x2028, 0x2029)}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{place}')}>"


def warc_date(stamp: bytes) -> str:
    """YYYYMMDDhhmmss, or a shorter stamp, as a W3C timestamp."""
    s = stamp.decode("ascii", "replace")
    s = (s + "19700101000000"[len(s) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


class Output:
    """A file of records, each compressed on its own."""

    def __init__(self, path: str):
        where, name = filesystem(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        self.path, self.out, self.n = path, where.open_output_stream(name, compression=None), 0

    def write(self, *parts: bytes) -> None:
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for part in parts:
            self.out.write(deflate.compress(part))
        self.out.write(deflate.flush())
        self.n += 1

    def close(self) -> None:
        self.out.close()


def open_archive(path: str) -> BinaryIO:
    where, name = filesystem(path)
    raw = where.open_input_stream(name, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise EOFError(f"a record declares {n} bytes, {len(data)} are left")
    return data


def arc_opening(version: int, name: str) -> bytes:
    body = b"%d 0 tallyspark\n%s\n" % (version, ARC_LINES[version])
    head = [f"filedesc://{name}".encode(), b"0.0.0.0", b"19700101000000", b"text/plain"]
    return arc_line(version, head, len(body), name) + body + b"\n"


def arc_line(version: int, first_four: list[bytes], length: int, name: str, status: int = 200) -> bytes:
    more = [b"%d" % status, b"-", b"-", b"0", name.encode()] if version == 2 else []
    return b" ".join([*first_four, *more, b"%d" % length]) + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[tuple[int, int, list[bytes], bytes]]:
    """(place, version, header fields, content) of every record, the opening one included."""
    place, fields, version = 0, ARC_FIELDS[1], 1
    while line := stream.readline():
        parts = line.rstrip(b"\r\n").rsplit(b" ", fields - 1)
        if place == 0:
            parts = line.rstrip(b"\r\n").split(b" ")
        if len(parts) < (5 if place == 0 else fields) or not parts[-1].isdigit():
            continue
        content = _exactly(stream, int(parts[-1]))
        if place == 0:
            version = int(content.split(b" ", 1)[0])
            fields = ARC_FIELDS[version]
        yield place, version, parts, content
        place += 1


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Header (with its empty line) and payload."""
    at = content.find(b"\r\n\r\n")
    return (content, b"") if at < 0 else (content[: at + 4], content[at + 4 :])


def _id_in(header: bytes) -> int | None:
    for line in header.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.decode("latin-1").lower() == ID_HEADER.lower():
            return int(value)
    return None


def warc_record(fields: list[tuple[str, str]], block: bytes) -> list[bytes]:
    fields = [*fields, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return [head.encode(), block, b"\r\n\r\n"]


def converted(archive: str, place: int, fields: list[bytes], content: bytes, other: dict | None) -> list[bytes]:
    """The WARC record of an ARC record. other: the record (archive, place, url, date) that holds its payload, if not it itself."""
    url, ip, stamp, kind = (x.decode("utf-8", "replace") for x in fields[:4])
    head = [("WARC-Record-ID", record_id(archive, place)), ("WARC-Date", warc_date(fields[2]))]
    if place == 0:
        return warc_record([("WARC-Type", "warcinfo"), *head, ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], b"software: tallyspark\r\nformat: WARC File Format 1.0\r\n")
    head += [("WARC-Target-URI", url), ("WARC-IP-Address", ip)]
    if not content.startswith(b"HTTP/"):
        return warc_record([("WARC-Type", "resource"), *head, ("WARC-Payload-Digest", "sha1:" + sha1_base32(content)), ("Content-Type", kind)], content)
    header, payload = http_parts(content)
    head += [("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("Content-Type", "application/http; msgtype=response")]
    if other is None:
        return warc_record([("WARC-Type", "response"), *head], content)
    refers = [("WARC-Refers-To", record_id(other["archive"], other["place"])), ("WARC-Refers-To-Target-URI", other["url"]), ("WARC-Refers-To-Date", other["date"])]
    return warc_record([("WARC-Type", "revisit"), *head, ("WARC-Profile", REVISIT_PROFILE), *refers, ("WARC-Truncated", "length")], header)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]))


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as archives, of version 1 for even ids and 2 for odd ones. The manifest: (archive, path, n)."""
    folder = new_dir(pages.sparkSession, "arc")
    manifest = pa.schema([("archive", pa.string()), ("path", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = uuid.uuid4().hex, {}
        for batch in batches:
            for i, u, h in zip(*[batch.column(k) for k in range(3)], strict=True):
                page, url, html = i.as_py(), u.as_py(), h.as_py()
                version = 2 if page is not None and page % 2 else 1
                name = f"{task}-v{version}.arc.gz"
                if version not in files:
                    files[version] = Output(f"{folder}/{name}")
                    files[version].write(arc_opening(version, name))
                address = (url or f"urn:page:{page}").translate(_ESCAPES)
                own = b"" if page is None else f"{ID_HEADER}: {page}\r\n".encode()
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(html) + html
                line = arc_line(version, [address.encode(), b"0.0.0.0", b"20200101000000", b"text/html"], len(content), name)
                files[version].write(line, content, b"\n")
        for out in files.values():
            out.close()
        rows = [{"archive": os.path.basename(o.path), "path": o.path, "n": o.n} for o in files.values()]
        yield pa.RecordBatch.from_pylist(rows, manifest)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(F.col(html_col)).alias("html"))
    return stage(rows.mapInArrow(run, "archive string, path string, n long"), "arc-manifest")


def _each(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(min(max(manifest.count(), 1), 10_000))


def index_arcs(manifest: DataFrame) -> DataFrame:
    """(archive, place, id, url, date, digest, length) of the records with an HTTP payload."""
    schema = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with open_archive(row["path"]) as stream:
                    for place, _, fields, content in read_arc(stream):
                        if place and content.startswith(b"HTTP/"):
                            header, payload = http_parts(content)
                            out.append({"archive": row["archive"], "place": place, "id": _id_in(header), "url": fields[0].decode("utf-8", "replace"), "date": warc_date(fields[2]), "digest": sha1_base32(payload), "length": len(payload)})
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return stage(_each(manifest).mapInArrow(run, "archive string, place long, id long, url string, date string, digest string, length long"), "arc-index")


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, others): for every archive with such records, (place, other) of those whose payload another record holds.

    Of equal payloads of at least ``least_bytes`` bytes the record with the largest id holds it.
    """
    whole = index.where(F.col("length") >= least_bytes)
    holder = whole.groupBy("digest", "length").agg(F.max(F.struct("id", "archive", "place", "url", "date")).alias("other"), F.count(F.lit(1)).alias("n"))
    # written down, so the join has an exchange of its own and a payload that very many records have can be split
    holder = stage(holder.where("n > 1").select("digest", "length", "other"), "warc-holders")
    again = whole.join(holder, ["digest", "length"])
    again = again.where((F.col("archive") != F.col("other.archive")) | (F.col("place") != F.col("other.place")))
    return again.groupBy("archive").agg(F.collect_list(F.struct("place", "other")).alias("others"))


def convert(manifest: DataFrame, others: DataFrame) -> DataFrame:
    """Writes a WARC file for every archive. The manifest: (path, n)."""
    folder = new_dir(manifest.sparkSession, "warc")
    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = {x["place"]: x["other"] for x in row["others"] or ()}
                out = Output(f"{folder}/{row['archive'].removesuffix('.arc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz")
                with open_archive(row["path"]) as stream:
                    for place, _, fields, content in read_arc(stream):
                        out.write(*converted(row["archive"], place, fields, content, held.get(place)))
                out.close()
                yield pa.RecordBatch.from_pylist([{"path": out.path, "n": out.n}], schema)

    work = stage(manifest.join(others, "archive", "left").select("archive", "path", "others"), "warc-work")
    return stage(_each(work).mapInArrow(run, "path string, n long"), "warc-manifest")


def read_warcs(manifest: DataFrame) -> DataFrame:
    """(record_id, type, url, date, page_id, digest, length, refers_to_id) of all records; digest and length are computed from a
    response's payload, and a revisit has the digest that it declares and no length."""
    names = ["record_id", "type", "url", "date", "page_id", "digest", "length", "refers_to_id"]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "length") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with open_archive(row["path"]) as stream:
                    for f, block in read_warc(stream):
                        kind = f["warc-type"]
                        header, payload = http_parts(block) if kind in ("response", "revisit") else (b"", block)
                        whole = kind != "revisit"
                        digest = sha1_base32(payload) if whole else f["warc-payload-digest"].removeprefix("sha1:")
                        values = [f["warc-record-id"], kind, f.get("warc-target-uri"), f["warc-date"], _id_in(header), digest, len(payload) if whole else None, f.get("warc-refers-to")]
                        out.append(dict(zip(names, values, strict=True)))
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return _each(manifest).mapInArrow(run, ", ".join(f"{x.name} {'long' if x.type == pa.int64() else 'string'}" for x in schema))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages as ARC files, converts them, and returns the WARC files' records as read back.

    (page_id, length, digest, type, refers_to): a revisit's length is that of the response it refers to, found by its record id.
    """
    arcs = write_arcs(pages, id_col, url_col, html_col)
    records = stage(read_warcs(convert(arcs, revisits(index_arcs(arcs), least_bytes))), "warc-records")
    whole = records.where("type = 'response'")
    held = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("length").alias("held_length"))
    again = records.where("type = 'revisit'").join(held, "refers_to_id", "left")
    again = again.select("page_id", F.col("held_length").alias("length"), "digest", "type", "refers_to")
    return whole.select("page_id", "length", "digest", "type", F.lit(None).cast("long").alias("refers_to")).unionByName(again)
