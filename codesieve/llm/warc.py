"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC file starts with a version block that names the fields of its record headers; each record is
one header line, a declared number of bytes and a line end. A WARC record has named header lines, a
blank line, a block of the declared length, and two line ends. Records are gathered where they are
until they make a file of FILE_BYTES; a file is one row of Spark's text sink, whose row separator is
what ends a record, and is read whole. Contents are bytes throughout, of any encoding. What is
written can be any folder Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import new_folder, staged

FILE_BYTES = 16 << 20
#: Rows of shared payloads, some 50 bytes each, up to which they are sent to every task.
BROADCAST_ROWS = 100_000

# The formats' own field names and line ends.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, ip string, date string, mime string, status string, http binary, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -------------------------------------------------------------------------------

def _safe_url(url: str | None) -> str:
    """No white space or control characters, which would break the header line."""
    return quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]")


def _arc_line(version: int, url: str, date: str, mime: str, status: str, body: bytes, name: str) -> bytes:
    values = {
        "URL": _safe_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime,
        "Result-code": status, "Checksum": payload_digest(body), "Location": "-", "Offset": "0", "Filename": name,
        "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version].split()).encode()


def _files(records: Iterator, head, gap: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """One row per file: ``head(number)`` and records, made by ``record(number)``, until they pass
    ``most`` bytes. A larger record has a file of its own."""
    held, size, number = [], 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([gap.join(held)], pa.binary())], ["file"])

    for record in records:
        if not held:
            held.append(head(number))
        held.append(record(number))
        size += len(held[-1])
        if size >= most:
            yield row()
            held, size, number = [], 0, number + 1
    if held:
        yield row()


def _write_files(files: DataFrame, folder: str, gap: str) -> None:
    """Each row of bytes as a file. The fast level of compression takes a third of the usual time."""
    (files.select(F.col("file").cast("string")).write.option("lineSep", gap).option("maxRecordsPerFile", 1)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder))


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = "20240101000000") -> None:
    """Writes pages as gzipped ARC files, where they are; every other file has version 2.

    The record of a page is an HTTP response with the page id in a header of its own. Null html is
    an empty payload, a null url is ``-``, a null id has no id header.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))

    most = FILE_BYTES

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version_of = lambda number: 1 + (part + number) % 2
        name_of = lambda number: f"part-{part:05d}-{number}.arc.gz"

        def head(number: int) -> bytes:
            intro = f"{version_of(number)} 0 codesieve\n{ARC_FIELDS[version_of(number)]}\n".encode()
            name = name_of(number)
            line = _arc_line(version_of(number), f"filedesc://{name}", date, "text/plain", "200", intro, name)
            return line + b"\n" + intro

        def record(id_: int | None, url: str | None, html: bytes):
            own = "" if id_ is None else f"X-Page-Id: {id_}{CRLF}"
            body = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{own}"
                    f"Content-Length: {len(html)}{CRLF}{CRLF}").encode() + html
            return lambda number: _arc_line(
                version_of(number), url, date, "text/html", "200", body, name_of(number)) + b"\n" + body

        rows = (record(*(v.as_py() for v in row)) for batch in batches for row in zip(*batch.columns))
        yield from _files(rows, head, b"\n", most)

    _write_files(slim.mapInArrow(files, "file binary"), folder, "\n")


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def _text(raw: bytes) -> str:
    """UTF-8 where it is valid, else Latin-1, which any bytes are."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, by the fields its version block names and the declared lengths."""
    fields = ARC_FIELDS[1].split()
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without an end")
        line = _text(data[at:end])
        if not line.strip():
            at = end + 1
            continue
        values = line.split(" ")
        length = int(values[-1])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError(f"an ARC record of {length} bytes is cut off")
        if values[0].startswith("filedesc:"):
            intro = _text(content).split("\n")
            version = int(intro[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = intro[1].split(" ")
            yield ArcRecord(dict(zip(fields, values)), b"")
        else:
            if len(values) != len(fields):
                raise ValueError(f"an ARC header of {len(values)} fields, {len(fields)} are declared")
            yield ArcRecord(dict(zip(fields, values)), content)
        at = end + 1 + length


def _whole_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")


def _http_parts(content: bytes) -> tuple[bytes | None, bytes]:
    """Head and payload of an HTTP response; no head for anything else, as a ``dns:`` record."""
    head, blank, payload = content.partition(b"\r\n\r\n")
    return (head, payload) if blank and head.startswith(b"HTTP/") else (None, content)


def _header(head: bytes | None, name: str) -> str | None:
    found = re.search(rf"^{re.escape(name)}:[ \t]*(.*?)[ \t]*$", _text(head or b"").replace(CRLF, "\n"), re.M | re.I)
    return found[1] if found else None


def _page_id(head: bytes | None) -> int | None:
    value = _header(head, "X-Page-Id") or ""
    return int(value) if re.fullmatch(r"-?[0-9]{1,18}", value) else None


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ARC files of a folder; version blocks are left out. http is the head of an HTTP
    response, null for other records; payload is what follows, bytes of any kind."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD.replace(",", "").split()[::2]
        kinds = {"page_id": pa.int64(), "http": pa.binary(), "payload": pa.binary()}
        for batch in batches:
            for content in batch.column(0):
                rows = {n: [] for n in names}
                for record in parse_arc(gzip.decompress(content.as_py())):
                    if record.fields["URL"].startswith("filedesc:"):
                        continue
                    head, payload = _http_parts(record.content)
                    for n, v in zip(names, (
                            _page_id(head), record.fields["URL"], record.fields["IP-address"],
                            record.fields["Archive-date"], record.fields["Content-type"],
                            record.fields.get("Result-code"), head, payload)):
                        rows[n].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names)

    return _whole_files(spark, folder).mapInArrow(parsed, RECORD)


# --- WARC ------------------------------------------------------------------------------

def record_id(page_id: int | None, digest: str, number: int) -> str:
    """An id of its own for each record of the archives that are converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{number}')}>"


def _warc_date(arc_date: str) -> str:
    d = (arc_date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_record(r: dict) -> bytes:
    """An HTTP response or its revisit; a ``dns:`` answer is a response too, anything else a resource."""
    revisit, http, digest = r["revisit"], r["http"], r["digest"]
    block = r["payload"] if http is None else http + b"\r\n\r\n" + (b"" if revisit else r["payload"])
    kind = "revisit" if revisit else "response" if http is not None or r["url"].startswith("dns:") else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}",
             f"WARC-Record-ID: {record_id(r['page_id'], digest, r['number'])}", f"WARC-Date: {_warc_date(r['date'])}",
             f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
             f"Content-Type: {r['mime'] if http is None else 'application/http; msgtype=response'}",
             f"Content-Length: {len(block)}"]
    if revisit:
        first = r["first"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first['page_id'], digest, first['number'])}",
                  f"X-Payload-Length: {r['n_bytes']}"]
    return (CRLF.join(lines) + CRLF + CRLF).encode() + block


def arc_to_warc(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 0) -> None:
    """Converts all ARC files of a folder to gzipped WARC files.

    Of HTTP responses with equal payloads of at least ``least_bytes`` bytes the one of the smallest
    page id stays a response, a record without a page id only if none has one, and of records of one page
    id, as repeated rows, one; the others become revisits of it. Other records stay whole.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [p.as_py() for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([payload_digest(p) for p in raw]), pa.array([len(p) for p in raw], pa.int64())],
                [*batch.schema.names, "digest", "n_bytes"])

    # Written once: the archives are parsed, numbered and their payloads hashed one time only.
    rows = staged(read_arc(spark, arc_folder).mapInArrow(measured, f"{RECORD}, digest string, n_bytes long")
                  .withColumn("number", F.monotonically_increasing_id()), "arc-records")
    # One row per payload and task before the shuffle, however many pages share it; only payloads
    # that more than one page has are looked up.
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "number")
    firsts = rows.where((F.col("n_bytes") >= least_bytes) & F.col("http").isNotNull()).groupBy("digest", "n_bytes").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = staged(firsts, "arc-firsts")
    # The pages stay where they are as long as the table is small, which is counted.
    small = firsts.count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(firsts) if small else firsts, ["digest", "n_bytes"], "left").withColumn(
        "revisit", F.col("http").isNotNull() & F.coalesce(F.col("number") != F.col("first.number"), F.lit(False)))

    most = FILE_BYTES

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def head(number: int) -> bytes:
            text = f"software: codesieve{CRLF}format: WARC File Format 1.1{CRLF}"
            own = uuid.uuid5(uuid.NAMESPACE_URL, f"{arc_folder}:{part}:{number}")
            return (CRLF.join([
                "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>",
                "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/warc-fields",
                f"Content-Length: {len(text)}"]) + CRLF + CRLF + text).encode()

        def record(names: list[str], row: tuple):
            made = _warc_record({n: v.as_py() for n, v in zip(names, row)})
            return lambda _: made

        rows = (record(batch.schema.names, row) for batch in batches for row in zip(*batch.columns))
        yield from _files(rows, head, b"\r\n\r\n", most)

    _write_files(named.mapInArrow(files, "file binary"), warc_folder, CRLF * 2)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of one WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = _text(data[at:end]).split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"a WARC record starts with {version[:20]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length or data[end + 4 + length:end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield headers, block
        at = end + 8 + length


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All records but the files' own: page_id, record_id, record_type, url, date, payload_bytes,
    payload_digest, refers_to_record. Digests of blocks and payloads are computed again."""
    names = ["page_id", "record_id", "record_type", "url", "date", "payload_bytes", "payload_digest", "refers_to_record"]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64()}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(gzip.decompress(content.as_py())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, payload = _http_parts(block) if h["content-type"].startswith("application/http") else (None, block)
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    whole = h["warc-type"] != "revisit"
                    if h["warc-block-digest"] != f"sha1:{payload_digest(block)}" or whole and digest != payload_digest(payload):
                        raise ValueError(f"a digest of {h['warc-record-id']} is wrong")
                    rows.append((_page_id(head), h["warc-record-id"], h["warc-type"],
                                 h["warc-target-uri"], h["warc-date"],
                                 len(payload) if whole else int(h["x-payload-length"]), digest,
                                 h.get("warc-refers-to")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kinds.get(n, pa.string())) for k, n in enumerate(names)], names)

    return _whole_files(spark, folder).mapInArrow(parsed, ", ".join(
        f"{n} {'long' if n in kinds else 'string'}" for n in names))


def convert_pages(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the records read back, with refers_to as a
    page id. An empty table gives empty archives and no records."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc, **columns)
    arc_to_warc(spark, arc, warc, least_bytes)
    rows = read_warc(spark, warc)
    # Only records that are revisited are looked up, each once.
    firsts = rows.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    wanted = rows.where("refers_to_record IS NOT NULL").select("refers_to_record").distinct()
    return rows.join(firsts.join(wanted, "refers_to_record", "left_semi"), "refers_to_record", "left")
