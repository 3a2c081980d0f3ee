"""Legacy web archives (ARC, versions 1 and 2) turned into WARC files, and both read as streams.

An ARC file opens with a version block, whose second line names the version; from there on each record is one header
line, of five fields in version 1 and ten in version 2, and as many bytes as its last field declares.  The
converter gives every record what WARC asks for beyond that: an identifier, an ISO timestamp, a type and
digests.  Records with equal payloads become revisits of one of them.

Spark's text source and sink carry the bytes: a record is a row, and the line separator is what the format puts
between records (a newline in ARC, two CRLF in WARC).  Read back, rows are mere pieces; the readers
put them together and cut them by the declared lengths alone, so payloads may hold any separator.
Files are compressed as a whole, which also keeps Spark from splitting them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.session import shared_folder

from .common import groups

# Fixed by the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BETWEEN = b"\r\n\r\n"

ID_FIELD = "X-Page-Id"  # the field of the HTTP head that carries the id of a row
LENGTH_FIELD = "X-Payload-Length"  # length of the payload that a revisit does not repeat

ARC_RECORDS = ("file long, at long, record_id string, type string, uri string, ip string, date string, mime string, doc long, "
               "payload_bytes long, payload_digest string, truncated boolean, head binary, payload binary")
WARC_RECORDS = ("file long, at long, record_id string, type string, uri string, date string, refers_to string, doc long, "
                "payload_bytes long, payload_digest string, verified boolean, payload binary")


# ---- streams of bytes

class Pieces:
    """The bytes of one file, given piece by piece; only what is not yet taken is held."""

    def __init__(self):
        self.pieces, self.size, self.data, self.at = [], 0, b"", 0

    def feed(self, piece: bytes) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def left(self) -> int:
        return self.size + len(self.data) - self.at

    def have(self, n: int) -> bool:
        """Whether n bytes lie in one piece from here on, after joining the pieces if that is of use."""
        if len(self.data) - self.at < n <= self.left():
            self.data, self.at = b"".join([self.data[self.at:], *self.pieces]), 0
            self.pieces, self.size = [], 0
        return len(self.data) - self.at >= n

    def find(self, mark: bytes, start: int = 0) -> int:
        """Distance of the first ``mark`` from here, or -1."""
        self.have(self.left())
        found = self.data.find(mark, self.at + start)
        return found - self.at if found >= 0 else -1

    def take(self, n: int) -> bytes:
        out = self.data[self.at:self.at + n]
        self.at += n
        return out


def records(cls, batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[int, object]]:
    """(file, record) of every record of the files whose pieces (file, piece) are the rows, file after file."""
    file = reader = None
    for batch in batches:
        keys = batch.column("file")
        start = 0
        while start < batch.num_rows:
            key = keys[start].as_py()
            same = pc.index(pc.not_equal(keys.slice(start), key), True).as_py()
            stop = batch.num_rows if same < 0 else start + same
            if key != file:
                if reader:
                    yield from ((file, r) for r in reader.read(True))
                file, reader = key, cls(key)
            rows = batch.column("piece").slice(start, stop - start)
            reader.bytes.feed(separator.join(rows.to_pylist()) + separator)
            yield from ((file, r) for r in reader.read(False))
            start = stop
    if reader:
        yield from ((file, r) for r in reader.read(True))


def pieces(spark, folder: str, separator: bytes) -> DataFrame:
    """The rows (file, piece) of compressed files, in order within each file."""
    return (spark.read.option("lineSep", separator.decode()).option("recursiveFileLookup", "true").text(folder)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")))


def write_pieces(rows: DataFrame, folder: str, separator: bytes) -> str:
    """Write a binary column, every value followed by the separator, as one compressed file per task."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.option("lineSep", separator.decode()) \
        .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)
    return folder


# ---- ARC

def http_head(doc: bytes) -> int:
    """Length of the HTTP head of a document, its empty line included; 0 without a head, all of it if no empty line ends the head."""
    if not doc.startswith(b"HTTP/"):
        return 0
    ends = [i + n for i, n in ((doc.find(b"\r\n\r\n"), 4), (doc.find(b"\n\n"), 2)) if i >= 0]
    return min(ends, default=len(doc))


def field(head: bytes, name: str) -> str | None:
    """Value of a field of an HTTP head or of WARC named fields; None if it is not there."""
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def iso_date(date: str, other: str = "1970-01-01T00:00:00Z") -> str:
    """WARC timestamp of an ARC date of 4 to 14 digits; missing parts are the first of their kind."""
    if not re.fullmatch(r"[0-9]{4,14}", date):
        return other
    full = date + "00000101000000"[len(date):] if len(date) % 2 == 0 else date[:-1] + "00000101000000"[len(date) - 1:]
    y, mo, d, h, mi, s = full[:4], *(full[i:i + 2] for i in range(4, 14, 2))
    fine = "01" <= mo <= "12" and "01" <= d <= "31" and h < "24" and mi < "60" and s < "61"
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z" if fine else other


class ArcReader:
    """Records of one ARC file as tuples (at, name, version, fields, document, truncated).

    Lines that are no header of the file's version are passed over until one is.  A document that
    the file ends in is given as far as it goes, with the separator that the text source takes for its end.
    """

    def __init__(self, key):
        self.bytes, self.version, self.name, self.count, self.need = Pieces(), 1, str(key), 0, 0

    def header(self, line: bytes):
        parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", 9 if self.version == 2 else 4)
        if line.startswith(b"filedesc://"):  # its own version is told only below it
            parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
            if len(parts) not in (5, 10):
                return None
        fine = len(parts) == (10 if self.version == 2 and not line.startswith(b"filedesc://") else len(parts)) and len(parts) >= 5
        return parts if fine and re.fullmatch("[0-9]+", parts[-1]) and ":" in parts[0] else None

    def read(self, last: bool):
        b = self.bytes
        if b.left() < self.need and not last:  # a long record is put together once, not with every piece
            return
        while True:
            end = b.find(b"\n")
            if end < 0:
                return
            parts = self.header(b.data[b.at:b.at + end])
            if parts is None:
                b.take(end + 1)
                continue
            n = end + 1 + int(parts[-1])
            if not b.have(n) and not last:
                self.need = n
                return
            short = not b.have(n)
            doc = b.take(min(n, b.left()))[end + 1:]
            if parts[0].startswith("filedesc://"):
                self.name = parts[0].removeprefix("filedesc://")
                second = doc.split(b" ", 1)[0]
                self.version = 2 if second == b"2" else 1
            yield self.count, self.name, self.version, parts, doc, short
            self.count += 1


def write_arc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", versions: tuple[int, ...] = (1, 2),
              date: str = "20240101000000", folder: str | None = None) -> str:
    """Write rows as ARC files, one record each; returns the folder.

    One file per task, the versions taking turns.  A record is an HTTP response whose payload is the text in UTF-8 (null:
    empty) and whose head names the row's id, unless that is null.  URLs are percent-encoded where a header line
    could not hold them; a null one is written as ``unknown:``.  Repeated rows are written as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, opened = versions[part % len(versions)], f"part-{part:05d}.arc", False
        for batch in groups(batches):
            out = []
            if not opened:
                block = f"{version} 0 codesieve\n{ARC_FIELDS[version]}\n".encode()
                more = f"200 - - 0 {name} " if version == 2 else ""
                out.append(f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(block)}\n".encode() + block)
                opened = True
            for doc, url, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "url", "text"))):
                payload = text.encode()
                named = f"{ID_FIELD}: {doc}\r\n" if doc is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode()
                uri = quote(url or "unknown:", safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
                uri = uri if ":" in uri else f"unknown:{uri}"
                more = f"200 {hashlib.md5(payload).hexdigest()} - 0 {name} " if version == 2 else ""
                out.append(f"{uri} 0.0.0.0 {date} text/html {more}{len(head) + len(payload)}\n".encode() + head + payload)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return write_pieces(rows.mapInArrow(run, "record binary"), folder or shared_folder(df.sparkSession, "arc"), b"\n")


def read_arc(spark, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files with what WARC needs to know of them.

    ``record_id`` follows from the file's name and the record's place in it, ``type`` from the document: the version
    block is a warcinfo, HTTP responses are responses, all else is a resource.  ``payload_digest`` is SHA-1 in hex.
    With ``payloads`` the documents come along: ``head`` and ``payload``, as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, (at, name, _, parts, doc, short) in records(ArcReader, batches, b"\n"):
            cut = http_head(doc)
            payload = doc[cut:]
            kind = "warcinfo" if parts[0].startswith("filedesc://") else "response" if cut else "resource"
            doc_id = field(doc[:cut], ID_FIELD)
            rows.append((file, at, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}", kind, parts[0], parts[1], iso_date(parts[2]), parts[3],
                         int(doc_id) if doc_id and re.fullmatch("-?[0-9]{1,19}", doc_id) else None, len(payload), hashlib.sha1(payload).hexdigest(), short,
                         doc[:cut] if payloads else None, payload if payloads else None))
            size += len(doc) if payloads else 200
            if size > 4_000_000:
                yield as_batch(rows, ARC_RECORDS)
                rows, size = [], 0
        if rows:
            yield as_batch(rows, ARC_RECORDS)

    return pieces(spark, folder, b"\n").mapInArrow(run, ARC_RECORDS)


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.record_batch([pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


# ---- WARC

def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two CRLF that end it; fields that are None are left out."""
    fields = [*fields, ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + block


def revisits(index: DataFrame, least_bytes: int) -> DataFrame:
    """(file, at, refers_to, refers_uri, refers_date) of each response whose payload another one keeps.

    Of responses with equal payloads of at least ``least_bytes`` bytes the one with the largest id is kept (null ids
    last, equal ids by the larger record id).  The groups are reduced to that one before they meet their members.
    """
    found = index.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    kept = (found.groupBy("payload_digest").agg(F.max(F.struct("doc", "record_id", "uri", "date")).alias("kept"), F.count("*").alias("n"))
            .where("n > 1").select("payload_digest", "kept"))
    return (found.join(kept, "payload_digest").where("record_id != kept.record_id")
            .select("file", "at", F.col("kept.record_id").alias("refers_to"), F.col("kept.uri").alias("refers_uri"), F.col("kept.date").alias("refers_date")))


def convert(spark, arc_folder: str, least_bytes: int = 1000, folder: str | None = None) -> str:
    """Write the records of ARC files as WARC files, one per task; returns the folder.

    Every file opens with a warcinfo record of its own; version blocks become warcinfo records as well.  A first
    pass over the archives reads digests only and settles the revisits; documents are moved once.
    """
    index = read_arc(spark, arc_folder, payloads=False).drop("head", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened = TaskContext.get().partitionId(), False
        for batch in groups(batches, "payload", 2_000_000):
            out = []
            if not opened:
                name = f"part-{part:05d}.warc.gz"
                out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                                        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                       b"software: codesieve\r\nformat: WARC File Format 1.1\r\n"))
                opened = True
            out += map(render, batch.to_pylist())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    rows = read_arc(spark, arc_folder).join(revisits(index, least_bytes), ["file", "at"], "left")
    return write_pieces(rows.mapInArrow(run, "record binary"), folder or shared_folder(spark, "warc"), BETWEEN)


def render(r: dict) -> bytes:
    """The WARC record of an ARC record."""
    again = r["refers_to"] is not None
    payload = b"" if again else r["payload"]
    address = r["ip"] if r["ip"] != "0.0.0.0" and re.fullmatch("[0-9a-fA-F.:]+", r["ip"]) else None
    kind = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(r["type"], r["mime"])
    return warc_record([
        ("WARC-Type", "revisit" if again else r["type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]),
        ("WARC-Target-URI", r["uri"] if r["type"] != "warcinfo" else None), ("WARC-Filename", r["uri"].removeprefix("filedesc://") if r["type"] == "warcinfo" else None),
        ("WARC-IP-Address", address), ("WARC-Payload-Digest", base32(r["payload_digest"])),
        ("WARC-Truncated", "length" if r["truncated"] else None), ("WARC-Profile", PROFILE if again else None),
        ("WARC-Refers-To", f"<{r['refers_to']}>" if again else None), ("WARC-Refers-To-Target-URI", r["refers_uri"]),
        ("WARC-Refers-To-Date", r["refers_date"]), (LENGTH_FIELD, r["payload_bytes"] if again else None), ("Content-Type", kind)],
        r["head"] + payload)


class WarcReader:
    """Records of one WARC file as tuples (at, named fields, block)."""

    def __init__(self, key):
        self.bytes, self.count, self.need = Pieces(), 0, 0

    def read(self, last: bool):
        b = self.bytes
        if b.left() < self.need and not last:  # a long record is put together once, not with every piece
            return
        while True:
            start = b.find(b"WARC/")
            if start < 0:
                return
            end = b.find(BETWEEN, start)
            length = field(b.data[b.at + start:b.at + end], "Content-Length") if end >= 0 else None
            if end < 0:
                return
            if length is None or not re.fullmatch("[0-9]+", length):  # no record after all
                b.take(start + 5)
                continue
            n = end + 4 + int(length)
            if not b.have(n) and not last:
                self.need = n
                return
            record = b.take(min(n, b.left()))
            yield self.count, record[start:end + 4], record[end + 4:]
            self.count += 1


def read_warc(spark, folder: str, payloads: bool = False) -> DataFrame:
    """The records of WARC files; ids without their angle brackets, digests of payloads as hex.

    Length and digest are those of the payload itself; a revisit has no payload and gives those it names.  ``verified`` tells whether
    the digests that a record names are those of its block and payload.  ``payload`` is null unless ``payloads``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, (at, named, block) in records(WarcReader, batches, BETWEEN):
            kind, cut = field(named, "WARC-Type"), http_head(block)
            payload, told = block[cut:], field(named, "WARC-Payload-Digest")
            digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
            fine = field(named, "WARC-Block-Digest") == base32(hashlib.sha1(block).hexdigest())
            if kind == "revisit":
                digest, length = base64.b32decode(told.removeprefix("sha1:")).hex() if told else None, int(field(named, LENGTH_FIELD) or 0)
            elif told:
                fine = fine and told == base32(digest)
            record_id, refers = ((field(named, k) or "").strip("<>") or None for k in ("WARC-Record-ID", "WARC-Refers-To"))
            doc = field(block[:cut], ID_FIELD)
            rows.append((file, at, record_id, kind, field(named, "WARC-Target-URI"), field(named, "WARC-Date"), refers, int(doc) if doc else None,
                         length, digest, fine, payload if payloads else None))
            size += len(block) if payloads else 200
            if size > 4_000_000:
                yield as_batch(rows, WARC_RECORDS)
                rows, size = [], 0
        if rows:
            yield as_batch(rows, WARC_RECORDS)

    return pieces(spark, folder, BETWEEN).mapInArrow(run, WARC_RECORDS)


def pages(spark, warc_folder: str) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to (an id), uri, date, verified."""
    found = read_warc(spark, warc_folder).drop("payload").where("type in ('response', 'revisit')")
    kept = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("doc").alias("kept_id"))
    return (found.join(kept, "refers_to", "left")
            .select(F.col("doc").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                    F.col("kept_id").alias("refers_to"), "uri", "date", "verified"))
