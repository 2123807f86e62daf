"""Legacy archive converter: ARC files (versions 1 and 2) become equivalent WARC 1.1 files.

An ARC record is a header line, whose fields depend on the version named in the file's first
record, and exactly as many content bytes as the line declares; a line feed parts records.
``parse_arc`` honours the declared lengths, never the payload. ``convert`` synthesises the WARC
identifier (a name-based UUID of archive, place and URL), timestamp, type and digests, and turns
later records with the payload of an earlier one into revisits. ``write_warc`` writes the
records with Spark's text writer, so archives land wherever Spark can write; ``read_warc`` reads them. A file is
one gzip member, as that writer makes it, and has no ``warcinfo`` record.

Defined results: a null or empty payload is an empty payload; payloads of under ``MIN_REVISIT``
bytes never become revisits; where rows share one page id and one payload they count as one page,
and all are responses if that id is the smallest; a null id counts as the largest. A header line
that cannot be parsed ends its archive with an error that names file and offset.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import materialise, scratch_dir, session_conf

MIN_REVISIT = 100
#: Bytes of content in one legacy archive made from a table; the next record starts a new one.
ARC_BYTES = 8 << 20
ARC_COLUMNS = {
    b"1": (b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"),
    b"2": (b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename", b"Archive-length"),
}
RECORD_SCHEMA = (
    "archive string, offset long, arc_version int, url string, ip string, warc_date string, content_type string, "
    "status int, http_head binary, page_id long, payload_bytes long, payload_digest string, record_id string"
)
#: Bytes of one WARC file before compression, at most (one record at least): a reader holds one file at a time.
FILE_BYTES = 64 << 20
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- legacy archives ---------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file: it names the version and the fields of later header lines."""
    key = str(version).encode()
    body = key + (b" 0 InternetArchive\n" if version == 1 else b" 0 strandworks\n") + b" ".join(ARC_COLUMNS[key]) + b"\n"
    head = f"filedesc://{name} 0.0.0.0 20200101000000 text/plain "
    if version == 2:
        head += f"200 - - 0 {name} "
    return head.encode() + str(len(body)).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, page_id: int | None, payload: bytes) -> bytes:
    """One ARC record whose content is an HTTP response with ``payload`` as its body."""
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
    clean = re.sub(r"[\s\x00-\x1f]", "", url or "") or "urn:none"
    line = f"{clean} 127.0.0.1 {date} text/html "
    if version == 2:
        line += f"200 - - {offset} {name} "
    return line.encode() + str(len(http) + len(payload)).encode() + b"\n" + http + payload + b"\n"


def arcs_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``path, content``: legacy archives, as ``binaryFile`` would list them, of both versions in turn."""
    slim = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, parts, size, name, version = TaskContext.get().partitionId(), 0, [], 0, "", 1

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for batch in batches:
            for pid, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    version, serial = serial % 2 + 1, serial + 1
                    name = f"legacy-{part:06d}-{serial:06d}.arc"
                    parts = [arc_version_block(version, name)]
                    size = len(parts[0])
                parts.append(arc_record(version, name, size, url, "20200101000000", pid, payload))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield out()
                    parts = []
        if parts:
            yield out()

    return slim.mapInArrow(pack, "path string, content binary")


def parse_arc(name: str, content: bytes) -> Iterator[tuple]:
    """(offset, version, url, ip, date, content type, content) of each record after the version block."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    fields, version, at = None, b"", 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # line feeds between records
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        values = line.split(b" ")
        try:
            length = int(values[-1])
            if fields is None:
                if not line.startswith(b"filedesc://"):
                    raise ValueError("no version block")
                block = content[end + 1 : end + 1 + length]
                version = block.split(b" ", 1)[0].strip()
                fields = ARC_COLUMNS[version]
            elif len(values) != len(fields) or length < 0 or end + 1 + length > len(content):
                raise ValueError(f"{len(values)} fields, declared length {length}")
            else:
                row = dict(zip(fields, values, strict=True))
                yield at, int(version), row[b"URL"].decode("utf-8", "replace"), row[b"IP-address"].decode(), row[b"Archive-date"].decode(), row[b"Content-type"].decode("utf-8", "replace"), content[end + 1 : end + 1 + length]
        except (ValueError, KeyError, IndexError) as e:
            raise ValueError(f"{name}: bad ARC header line at offset {at}: {line[:200]!r} ({e})") from e
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and the body; content without a head is all body."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def parse_records(arcs: DataFrame, with_payload: bool) -> DataFrame:
    """One row per ARC record with what WARC needs of it; ``payload`` only if asked for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, version, url, ip, date, kind, body in parse_arc(path, content.as_buffer().to_pybytes()):
                    head, payload = split_http(body)
                    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", head)
                    status = re.match(rb"HTTP/\S+ (\d{3})", head)
                    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if len(date) == 14 else "1970-01-01T00:00:00Z"
                    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}:{url}')}>"
                    rows.append((path, offset, version, url, ip, when, kind, int(status[1]) if status else None, head, int(found[1]) if found else None, len(payload), hashlib.sha256(payload).hexdigest(), rid) + ((payload,) if with_payload else ()))
                    size += len(payload) if with_payload else 0
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORD_SCHEMA.split(", ")] + [pa.binary()] * with_payload

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return arcs.mapInArrow(parse, RECORD_SCHEMA + (", payload binary" if with_payload else ""))


# --- conversion --------------------------------------------------------------------------------


def first_copies(records: DataFrame) -> DataFrame:
    """For each payload that comes twice: the page that stays a response. One light shuffle, no payloads."""
    first = F.min_by(F.struct("page_id", "record_id", "url", "warc_date"), F.struct(F.col("page_id").isNull(), "page_id", "record_id"))
    return (
        records.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .filter((F.col("n") > 1) & F.col("first.page_id").isNotNull())
        .select(F.col("payload_digest").alias("f_digest"), F.col("payload_bytes").alias("f_bytes"), "first")
    )


def convert(arcs: DataFrame) -> DataFrame:
    """``archive, page_id, record string``: each ARC record as a WARC record, ready for ``write_warc``.

    Two passes: the first brings together digests only, so payloads are shuffled only if the table
    of repeated payloads is too large to broadcast (Spark decides by its written size).
    """
    firsts = materialise(first_copies(parse_records(arcs, with_payload=False)), "firsts")
    full = parse_records(arcs, with_payload=True)
    j = full.join(firsts, (F.col("payload_digest") == F.col("f_digest")) & (F.col("payload_bytes") == F.col("f_bytes")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    body = F.when(revisit, F.col("http_head")).otherwise(F.concat("http_head", "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, "WARC-Type: revisit\r\n").when(F.length("http_head") > 0, "WARC-Type: response\r\n").otherwise("WARC-Type: resource\r\n"),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(body, 256))),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {_REVISIT_PROFILE}\r\n"),
                line("WARC-Refers-To", F.col("first.record_id")),
                line("WARC-Refers-To-Target-URI", F.col("first.url")),
                line("WARC-Refers-To-Date", F.col("first.warc_date")),
                line("X-Refers-To-Page", F.col("first.page_id").cast("string")),
            ),
        ).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Arc-Version", F.col("arc_version").cast("string")),
        F.when(F.length("http_head") > 0, "Content-Type: application/http; msgtype=response\r\n").otherwise(line("Content-Type", F.col("content_type"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    # A record ends with two line breaks; the text writer's own separator is the second one.
    whole = F.concat(head.cast("binary"), body, F.lit("\r\n").cast("binary"))
    return j.select("archive", "page_id", whole.cast("string").alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records as gzipped WARC files, each of ``FILE_BYTES`` before it is packed or of one record that is longer.

    A task counts the bytes of its records as they come and numbers files by the sum, so one long page makes one file of its own at most.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            files = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if size and size + n + 4 > FILE_BYTES:
                    file, size = file + 1, 0
                size += n + 4
                files.append(f"{part:06d}-{file:06d}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files)], ["record", "file"])

    numbered = records.select(F.col("record").cast("binary").alias("record")).mapInArrow(number, "record binary, file string")
    # files follow one another, so a few writers at a time do without a sort
    with session_conf(records.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "16"}):
        numbered.select(F.col("record").cast("string").alias("record"), "file").write.partitionBy("file").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_warc(name: str, content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no WARC record at offset {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = int(headers["Content-Length"])
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``. Stored payloads are held against their digests."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block in parse_warc(name, content.as_buffer().to_pybytes()):
                    digest, length = h["WARC-Payload-Digest"].split(":", 1)[1], int(h["X-Payload-Length"])
                    head, payload = split_http(block)
                    if h["WARC-Type"] != "revisit" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: payload of {h['WARC-Record-ID']} does not match its digest")
                    page = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", head)
                    to = h.get("X-Refers-To-Page")
                    rows.append((int(page[1]) if page else None, length, digest, h["WARC-Type"], int(to) if to else None, h["WARC-Record-ID"], h["WARC-Date"], h.get("WARC-Target-URI")))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "url"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, url string",
    )


def convert_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` in the legacy format, convert to WARC files under ``path``, and read those back."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/strandworks-warc-{uuid.uuid4().hex}"
    write_warc(convert(arcs_from_pages(pages)), path)
    return read_warc(spark, path)
