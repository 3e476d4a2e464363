"""Converter of legacy ARC archives to WARC, with a writer and a reader of WARC folders.

An ARC archive starts with a version block whose second line names the version; each record has one header line (5
fields in version 1, 10 in version 2), then as many bytes as the line declares, then a line feed. Conversion
keeps the bytes and synthesises what WARC asks for: a record id from the archive's facts, an ISO timestamp from the
digits of the archive date, a type from the scheme and content, block and payload digests.

Folders of .arc and .arc.gz files are read as a table of records (`read_arc`) and converted as a whole (`convert_arc`). A file is
a row on the way, so it must fit a worker's memory, and 2 GB.

A payload that other records share is stored once: the record with the largest key is the response, the others are
revisits, which keep the HTTP header and refer to it. Who refers to whom is settled by digest before anything is
written, with one narrow aggregate; payloads are not shuffled as long as the shared ones are few enough to be broadcast.

WARC files are written through Spark's text writer (the line separator is the two empty lines that end a record, so
the files are plain WARC, compressed) into the cluster's shared folder, and read as a stream of bytes by declared
lengths, whatever the payload holds.

Defined results: a null payload is empty; a null or empty url becomes `urn:unknown`; white space in urls is percent-encoded;
rows that repeat the largest key of their payload are all responses; a null key can only be a response where no other
key has the payload; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, HEAVY, Scratch, in_workers, slices, wanted

# The header fields of the two ARC versions, as their version blocks list them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b"
#: Bytes of ARC blocks in one batch of records, about.
ARC_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive after its version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no header line at byte {at}")
        values = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if version == 0 and not values[0].startswith("filedesc:"):
            raise ValueError("the archive does not begin with a version block")
        names = ARC_FIELDS[version or 1].split(" ")
        if len(values) != len(names) and version or not values[-1].isdigit():
            raise ValueError(f"a header line of {len(values)} fields at byte {at}, version {version}")
        length = int(values[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes, {len(block)} are there")
        at = stop + 1 + length
        if version:
            yield ArcRecord(version, dict(zip(names, values, strict=True)), block)
        else:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")


def write_arc(records: list[tuple[str, str, str, bytes]], version: int, origin: str = "logloom") -> bytes:
    """An archive of (url, 14-digit date, content type, block) records."""
    names = ARC_FIELDS[version]
    about = f"{version} 0 {origin}\n{names}\n".encode()
    out = [f"filedesc://{origin}.arc 0.0.0.0 {records[0][1] if records else '19700101000000'} text/plain {len(about)}\n".encode(), about]
    for url, date, kind, block in records:
        middle = "" if version == 1 else f"200 - - 0 {origin}.arc "
        out += [b"\n", f"{url} 0.0.0.0 {date} {kind} {middle}{len(block)}\n".encode("utf-8", "surrogateescape"), block]
    return b"".join([*out, b"\n"])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(arc_date: str) -> str:
    """WARC's timestamp for 12 or 14 digits; missing parts are the earliest."""
    d = re.sub(r"\D", "", arc_date)
    d = (d + "00000101000000"[len(d) :])[:14] if len(d) < 14 else d[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload."""
    cut = block.find(END)
    return (block[: cut + 4], block[cut + 4 :]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def record_id(url: str, date: str, payload_digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, payload_digest, key)))}>"


def to_warc(record: ArcRecord, key: str = "", original: tuple[str, str] | None = None) -> bytes:
    """The WARC record, without the two empty lines that end it. original: key and url of the response it revisits."""
    url, date = record.fields["URL"], iso_date(record.fields["Archive-date"])
    http, payload = split_http(record.block)
    payload_digest = digest(payload)
    kind, block = "response" if http else "resource", record.block
    head = []
    if original and http:
        kind, block = "revisit", http
        head = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original[1], date, payload_digest, original[0])}", f"WARC-Refers-To-Target-URI: {original[1]}", f"X-Refers-To-Key: {original[0]}"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(url, date, payload_digest, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {record.fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else record.fields['Content-type']}",
        f"X-Key: {key}",
        *head,
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block


class WarcStream:
    """Takes bytes of WARC files as they come and gives (header, block) of each whole record.

    surplus: the empty lines that end a record may come twice, as no record begins with them.
    """

    def __init__(self, surplus: bool = False) -> None:
        self.held = bytearray()
        self.surplus, self.ended = surplus, False

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        at = 0
        while (cut := self.held.find(END, at)) >= 0:
            if cut == at and self.surplus and self.ended:
                at, self.ended = at + 4, False
                continue
            head = bytes(self.held[at:cut]).decode("utf-8", "surrogateescape").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {head[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in head[1:])
            stop = cut + 4 + int(fields["Content-Length"])
            if len(self.held) < stop + 4:
                break
            yield fields, bytes(self.held[cut + 4 : stop])
            at, self.ended = stop + 4, True
        del self.held[:at]


def _utf8(text: str) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _safe(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"


def _converted(date: str):
    """Rows as ARC archives of both versions, parsed and converted; one WARC record a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(p for batch in batches for p in slices(batch, "payload")):
            keys, urls = part.column("key").to_pylist(), part.column("url").to_pylist()
            firsts, first_urls = part.column("first").to_pylist(), part.column("first_url").to_pylist()
            records = []
            for url, payload in zip(urls, part.column("payload").to_pylist(), strict=True):
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                records.append((_safe(url), date, "text/html", http + payload))
            archive = write_arc(records, 1 + number % 2)
            out = []
            for record, key, first, first_url in zip(parse_arc(archive), keys, firsts, first_urls, strict=True):
                original = None if first is None else (str(first), _safe(first_url))
                out.append(to_warc(record, "" if key is None else str(key), original))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "20240101000000", key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write every row as a WARC record. Payloads of `least_bytes` or more that are equal are stored once."""
    rows = pages.select(pages[key_col].cast("long").alias("key"), pages[url_col].alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    scratch = Scratch(pages.sparkSession, "firsts")
    firsts = rows.select("key", "url", "digest", F.length("payload").alias("size")).where(F.col("size") >= least_bytes)
    firsts = firsts.groupBy("digest").agg(F.max(F.struct("key", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.keep(firsts.select("digest", F.col("top.key").alias("first"), F.col("top.url").alias("first_url"), "n"), "firsts")
    number = firsts.agg(F.count("*").alias("rows"), F.sum(F.length(F.coalesce("first_url", F.lit("")))).alias("bytes"), F.sum("n").alias("n")).first()
    if number["rows"] <= BROADCAST_ROWS // 8 and (number["bytes"] or 0) <= 8 * BROADCAST_ROWS:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        # Payloads that very many records share are broadcast (fewer than HEAVY of them); no task of the other join meets one.
        often = F.col("n") > number["n"] / HEAVY
        heavy = F.broadcast(firsts.where(often))
        light = rows.join(heavy.select("digest"), "digest", "left_anti")
        joined = rows.join(heavy, "digest").unionByName(wanted(light, firsts.where(~often), ["digest"], "left", number["rows"]))
    revisits = ~F.col("key").eqNullSafe(F.col("first"))
    joined = joined.select("key", "url", "payload", F.when(revisits, F.col("first")).alias("first"), F.when(revisits, F.col("first_url")).alias("first_url"))
    records = joined.transform(in_workers, _converted(date), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A file whose last block ends in CRLF is split within its end: what is left, CRLF, comes as a piece of its own.
    stream = WarcStream(surplus=True)
    for batch in batches:
        rows = []
        for piece in batch.column("value"):
            for fields, block in stream.feed(piece.as_py() + END):
                http, payload = split_http(block)
                revisit = fields["WARC-Type"] == "revisit"
                size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1]) if revisit else len(payload)
                found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and digest(payload) != found:
                    raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                key, first = fields["X-Key"], fields.get("X-Refers-To-Key", "")
                rows.append((int(key) if key else None, size, found, fields["WARC-Type"], int(first) if first else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
        names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in READ_SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    if stream.held:
        raise ValueError(f"{len(stream.held)} bytes after the last whole record")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder that `write` has written."""
    pieces = spark.read.option("lineSep", END.decode()).text(folder).select(F.col("value").cast("binary").alias("value"))
    return pieces.transform(in_workers, _read, READ_SCHEMA)


ARC_SCHEMA = "file string, number long, version int, url string, ip string, date string, content_type string, block binary"


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in ARC_SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            rows, size = [], 0
            for number, r in enumerate(parse_arc(gzip.decompress(data) if data[:2] == GZIP else data)):
                rows.append((path, number, r.version, *(_utf8(r.fields[f]) for f in ("URL", "IP-address", "Archive-date", "Content-type")), r.block))
                size += len(r.block)
                if size >= ARC_BYTES:
                    yield _arc_batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _arc_batch(rows, names)


def _arc_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"number": pa.int64(), "version": pa.int32(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the .arc and .arc.gz files of a folder; number counts them within their file. Bytes of a header that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(folder)
    return files.select("path", "content").transform(in_workers, _archives, ARC_SCHEMA)


def convert_arc(spark: SparkSession, folder: str, output: str) -> None:
    """Write the records of a folder of ARC files as WARC records, each by itself; the key of one is its file's name and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fields = {"URL": _safe(row["url"]), "IP-address": row["ip"], "Archive-date": row["date"], "Content-type": row["content_type"]}
                out.append(to_warc(ArcRecord(row["version"], fields, row["block"]), f"{row['file'].rsplit('/', 1)[-1]}:{row['number']}"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = read_arc(spark, folder).transform(in_workers, run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(output)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC in the shared folder and read the archives back."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, scratch.path("archive"), least_bytes)
    scratch.release()
    return read(pages.sparkSession, scratch.path("archive"))
