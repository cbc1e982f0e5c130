"""WARC archives made from legacy ARC records: converter, deduplicating writer and reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Field names of a URL record's header line, by the version that the version block declares.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
ARC_LEGEND = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
#: Bytes of payload in an archive, before compression and on average.
ARCHIVE_BYTES = 256 << 20


@dataclass
class ArcRecord:
    fields: dict[str, str]
    payload: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    payload: bytes


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _token(text: str | None) -> str:
    """A header line's field: no white space or control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or "-"


def arc_bytes(pages: Iterable[tuple[str | None, bytes]], *, version: int = 1, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """An ARC file of version 1 or 2: a version block, then one record for each (url, payload)."""
    legend = f"{version} 0 attestor\n{ARC_LEGEND[version]}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(legend)}\n".encode(), legend, b"\n"]
    for url, payload in pages:
        out += [f"{_token(url)} 0.0.0.0 {date} text/html {more}{len(payload)}\n".encode(), payload, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The URL records of an ARC file. The version block says which header fields there are; the declared length,
    not the content, says where a record ends. Raises ValueError for a header that does not fit its version or a
    record cut short."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line cut short")
        values = data[at:end].decode("utf-8").strip("\r").split(" ")
        if fields is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("no version block")
            length = _length(values[-1])
            block = data[end + 1 : end + 1 + length]
            version = int(block.split(b" ", 1)[0])
            fields = ARC_FIELDS.get(version)
            if fields is None:
                raise ValueError(f"unknown version {version}")
            at = end + 1 + length
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} header fields where {len(fields)} are declared")
        named = dict(zip(fields, values))
        length = _length(named["length"])
        payload = data[end + 1 : end + 1 + length]
        if len(payload) < length:
            raise ValueError("record cut short")
        yield ArcRecord(named, payload)
        at = end + 1 + length


def _length(text: str) -> int:
    if not text.isdigit():
        raise ValueError(f"bad length {text!r}")
    return int(text)


def warc_date(date: str) -> str:
    """ISO 8601 of an ARC date of 8, 12 or 14 digits."""
    date = (date + "000000")[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(record: ArcRecord, *, name: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The WARC record that equals an ARC record: a response, or a revisit without payload where ``refers_to`` names
    the record that holds it. The identifier is ``name``, else derived from address, date and payload; the timestamp
    is the archive date; the type follows the payload; the digest is of the full payload."""
    payload, fields = record.payload, record.fields
    digest = sha1_base32(payload)
    name = name or uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['url']} {fields['date']} {digest}").urn
    kind = "application/http;msgtype=response" if payload.startswith(b"HTTP/") else fields["type"]
    headers = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": warc_date(fields["date"]),
        "WARC-Target-URI": fields["url"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if fields["ip"] not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = fields["ip"]
    if refers_to:
        headers |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    body = b"" if refers_to else payload
    headers |= {"Content-Type": kind, "Content-Length": str(len(body))}
    return WarcRecord(headers, body)


def warc_bytes(record: WarcRecord) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + "\r\n"
    return head.encode() + record.payload + b"\r\n\r\n"


class _Stream:
    """Bytes of an archive that come piece by piece."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.ready, self.pos = iter(pieces), b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.ready, self.pos = self.ready[self.pos :] + piece, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.ready.find(mark, self.pos)) < 0:
            if not self.more():
                if self.ready[self.pos :].strip():
                    raise ValueError("record header cut short")
                return None
        out, self.pos = self.ready[self.pos : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while len(self.ready) - self.pos < missing:
            parts.append(self.ready[self.pos :])
            missing -= len(parts[-1])
            self.ready, self.pos = next(self.pieces, None), 0
            if self.ready is None:
                raise ValueError("record cut short")
        parts.append(self.ready[self.pos : self.pos + missing])
        self.pos += missing
        return b"".join(parts)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, plain or gzipped as a whole or by record."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    inflate = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        piece = data[at : at + step]
        while piece:
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof and (piece or at + step < len(data)):
                inflate = zlib.decompressobj(31)


def parse_warc(pieces: bytes | Iterable[bytes]) -> Iterator[WarcRecord]:
    """The records of an archive, given whole (plain or gzipped) or as plain pieces. Content-Length says where a record
    ends; a payload whose digest differs from its header raises ValueError."""
    stream = _Stream(inflated(pieces) if isinstance(pieces, bytes) else pieces)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        payload = stream.take(int(headers["Content-Length"]))
        stream.take(4)
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{sha1_base32(payload)}":
            raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
        yield WarcRecord(headers, payload)


def _page_name(page_id) -> str:
    return f"{PAGE_URN}{'' if page_id is None else page_id}"


def _page_of(name: str | None):
    text = name.strip("<>").removeprefix(PAGE_URN) if name else ""
    return int(text) if text else None


def write_archives(
    pages: DataFrame,
    path: str,
    work: Workspace,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    version: int = 1,
    date: str = "20240101000000",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes one WARC record for each row of ``pages`` as gzipped archives in the folder ``path``.

    Rows become ARC records of ``version``, which the converter turns into WARC. Of rows with one payload of at
    least ``min_bytes`` bytes the one with the largest id is a response and the others revisit it; smaller payloads
    are all responses. A null payload is empty, a null url ``-``; rows that share the largest id, and payloads of
    null ids only, are all responses. SHA-256 digests are grouped with partial aggregation and joined back, so copies of
    one payload are never gathered. Files are written by Spark's own committer, in any store that Spark can write, and
    the text of one record at a time is in memory besides its batch. A new archive begins after so many records as hold
    ``archive_bytes`` on average.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256))).withColumn("n", F.octet_length("html").cast("long"))
    best = work.save(rows.groupBy("digest", "n").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("copies")), "best")
    size = best.agg(F.sum(F.col("n") * F.col("copies")).alias("bytes"), F.sum("copies").alias("records")).first()
    max_records = max(1, archive_bytes * (size["records"] or 0) // (size["bytes"] or 1))
    best = best.select("digest", "n", F.when(F.col("n") >= min_bytes, F.col("best")).alias("best"))
    rows = rows.join(best, ["digest", "n"]).select("page_id", "url", "html", "best")

    def run(batches):
        for batch in batches:
            ids, urls, htmls, first = (c.to_pylist() for c in batch.columns)
            payloads = [h.encode("utf-8", "surrogatepass") for h in htmls]
            arc = arc_bytes(zip(urls, payloads), version=version, date=date)
            out = []
            for i, b, record in zip(ids, first, parse_arc(arc)):
                warc = convert(record, name=_page_name(i), refers_to=None if b is None or b == i else _page_name(b))
                out.append(warc_bytes(warc)[:-1])  # the writer's line end is the last byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    records = rows.mapInArrow(run, "value string")
    records.write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", max_records).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row for each record of the archives in ``path``: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri, record_id, warc_date, payload`` (null for revisits). Archives are read line by line and put
    together again record by record, so a task holds one record and a batch, however large the archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "warc_date", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def row(record):
        h = record.headers
        kind = h["WARC-Type"]
        size = len(record.payload) if kind == "response" else int(h["WARC-Payload-Length"])
        name = h["WARC-Record-ID"].strip("<>")
        return (
            _page_of(name),
            size,
            h["WARC-Payload-Digest"].removeprefix("sha1:"),
            kind,
            _page_of(h.get("WARC-Refers-To")),
            h["WARC-Target-URI"],
            name,
            h["WARC-Date"],
            record.payload if kind == "response" else None,
        )

    def lines(batches):
        # an archive is not split, so its lines come in their order, and each archive ends with a record
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 1000):
                yield b"\n".join([*column.slice(at, 1000).to_pylist(), b""])

    def run(batches):
        rows, size = [], 0
        for record in parse_warc(lines(batches)):
            rows.append(row(record))
            size += len(record.payload)
            if size > 16 << 20 or len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, "
        "record_id string, warc_date string, payload binary"
    )
    return spark.read.option("lineSep", "\n").text(path).mapInArrow(run, schema)


def archive(pages: DataFrame, **how) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back (see write_archives, read_archives)."""
    work = Workspace(pages.sparkSession, "warc")
    write_archives(pages, work.path("archives"), work, **how)
    return read_archives(pages.sparkSession, work.path("archives"))
