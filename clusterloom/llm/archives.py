"""ARC archives, and their conversion to WARC.

ARC, the older format of web archives, starts a file with a ``filedesc`` record that
names the version and the fields of a record's header line; a header line is followed
by as many bytes as its last field declares:

1. ``URL IP-address Archive-date Content-type Archive-length``
2. ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset
   Filename Archive-length``

The converter reads each file by the version it declares, checks lengths and, where
there is one, the checksum, and writes what WARC wants and ARC has not: a record id
(a name-based UUID of file, place, URL, date and digest, so a rerun of a task gives it
again), an ISO date, a type, and SHA-1 digests of block and payload in base32. HTTP
answers become ``response`` records, anything else ``resource``, and an answer whose
payload another one has as well a ``revisit`` that refers to it and holds the HTTP
head only.

**Scale.** Files are written by Spark's text writer, whose line separator is what ends
a record, one file for each task and ``RECORDS_PER_FILE`` records, and are read back
as bytes, one task a file, unpacked as a stream. Which record is a revisit is decided
on digests alone: a minimum for each digest, combined before the shuffle, and a join
back that the planner can split. Payloads are never grouped; files, still packed, meet
the list of their revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage

RECORDS_PER_FILE = 4096
ARCHIVE_DATE = "20200101000000"
#: Record batches of a reader hold about this many bytes.
BATCH_BYTES = 16 << 20
#: How many fields a header line has behind its URL, and their order, by version (fixed values).
FIELDS = {
    1: "IP-address Archive-date Content-type Archive-length",
    2: "IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "X-Page-Id"


# --- writing ARC -----------------------------------------------------------


def _line_safe(url: Column) -> Column:
    """The URL with white space and control characters escaped; ``-`` without any."""
    escaped = url
    for code in [*range(0x21), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    kept = F.when(url.rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(url)
    return F.when(F.octet_length(url) > 0, kept).otherwise(F.lit("-"))


def _definition(version: int) -> str:
    return f"{version} 0 clusterloom\nURL {FIELDS[version]}\n"


def _filedesc(version: int, date: str) -> str:
    block = _definition(version)
    more = "" if version == 1 else " 200 - - 0 -"
    return f"filedesc://clusterloom.arc 0.0.0.0 {date} text/plain{more} {len(block)}\n{block}\n"


def arc_records(pages: DataFrame, date: str = ARCHIVE_DATE, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """One ARC record as ``value`` for each row of ``pages (page_id, url, html)``.

    Of every ``records_per_file`` rows of a task the first begins with the ``filedesc``
    record of a file; files take turns between versions 1 and 2. The page's id travels in
    the HTTP head. A null or empty url is ``-``, a null html no bytes.
    """
    row = F.monotonically_increasing_id()
    within = row.bitwiseAND((1 << 33) - 1)
    version = (F.floor(within / records_per_file) + F.shiftright(row, 33)) % 2 + 1
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        within.alias("within"), version.alias("version"), _line_safe(F.col("url").cast("string")).alias("url"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(html),
            F.when(F.col("page_id").isNotNull(), F.concat(F.lit(f"\r\n{PAGE_ID}: "), F.col("page_id"))).otherwise(""),
            F.lit("\r\n\r\n"), html,
        ).alias("content"),
    )
    length = F.octet_length("content")
    first = F.concat(F.col("url"), F.lit(f" 0.0.0.0 {date} text/html "), length)
    second = F.concat(
        F.col("url"), F.lit(f" 0.0.0.0 {date} text/html 200 "), F.md5(F.col("content").cast("binary")), F.lit(" - 0 - "), length
    )
    begins = F.col("within") % records_per_file == 0
    is_first = F.col("version") == 1
    head = F.when(begins & is_first, _filedesc(1, date)).when(begins, _filedesc(2, date)).otherwise("")
    return own.select(F.concat(head, F.when(is_first, first).otherwise(second), F.lit("\n"), F.col("content")).alias("value"))


def write_arc(pages: DataFrame, path: str, date: str = ARCHIVE_DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``pages`` as packed ARC files; no rows move between tasks."""
    records = arc_records(pages, date, records_per_file)
    records.write.option("maxRecordsPerFile", records_per_file).text(path, compression="gzip", lineSep="\n")


# --- reading ---------------------------------------------------------------


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Stream:
    """Lines and counted bytes of a packed file."""

    def __init__(self, name: str, content: bytes):
        self.name = name
        self.file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content else io.BytesIO()

    def line(self) -> bytes:
        return self.file.readline()

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"{self.name}: a record of {n} bytes ends after {len(data)}")
        return data


def arc_contents(name: str, content: bytes) -> Iterator[dict]:
    """The records of an ARC file, by the version that it declares.

    Gives ``at`` (the record's number), ``version``, ``url``, ``ip``, ``date``, ``mime`` and
    ``block``. The ``filedesc`` record is number 0.
    """
    stream, version, at = _Stream(name, content), 0, 0
    while line := stream.line():
        if not line.strip(b"\r\n"):
            continue
        header = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        n_fields = len(FIELDS[version].split()) if version else len(header.split(" ")) - 1
        parts = header.rsplit(" ", n_fields)
        if len(parts) != n_fields + 1 or not parts[-1].isdigit():
            raise ValueError(f"{name}: no ARC header line: {header[:200]!r}")
        block = stream.take(int(parts[-1]))
        if not version:
            declared = block.split(b" ", 1)[0]
            if not parts[0].startswith("filedesc:") or declared not in (b"1", b"2"):
                raise ValueError(f"{name}: no ARC file, or of an unknown version")
            version = int(declared)
        elif parts[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])  # archives may be joined end to end
        if len(parts) > 9 and re.fullmatch("[0-9a-f]{32}", parts[5]) and hashlib.md5(block).hexdigest() != parts[5]:
            raise ValueError(f"{name}: the checksum of record {at} is not that of its bytes")
        yield {"at": at, "version": version, "url": parts[0], "ip": parts[1], "date": parts[2], "mime": parts[3], "block": block}
        at += 1


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with the empty line) and payload of an HTTP answer; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if end is None else (block[:end.end()], block[end.end():])


def iso_date(date: str) -> str:
    """A 14-digit ARC date in the form of WARC; shorter ones begin their period."""
    digits = (date + "00000101000000"[len(date):])[:14] if len(date) >= 4 else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(archive: str, record: dict, digest: str) -> str:
    name = f"{archive}\n{record['at']}\n{record['url']}\n{record['date']}\n{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name.encode('utf-8', 'surrogateescape').hex())}>"


def _clean(text: str) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def page_id_of(head: bytes) -> int | None:
    found = re.search(rb"(?mi)^%b: *(-?[0-9]+)\s*$" % PAGE_ID.encode(), head)
    return int(found[1]) if found else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("archive"), "content")


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 256
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


ANSWERS = "archive string, at bigint, record_id string, url string, date string, page_id bigint, payload string, n_bytes bigint"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What decides on revisits, of each HTTP answer of ARC files ``(archive, content)``."""
    schema = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in map(str.split, ANSWERS.split(", "))])

    def found() -> Iterator[dict]:
        for archive, content in _each_file(batches):
            for record in arc_contents(archive, content):
                if http := split_http(record["block"]):
                    head, payload = http
                    digest = base32(hashlib.sha1(payload).digest())
                    yield {
                        "archive": archive, "at": record["at"], "record_id": record_id(archive, record, digest),
                        "url": _clean(record["url"]), "date": iso_date(record["date"]), "page_id": page_id_of(head),
                        "payload": hashlib.sha256(payload).hexdigest(), "n_bytes": len(payload),
                    }

    return _batches(found(), schema)


def revisits(answers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(archive, at, refers_to, uri, date)`` of the answers that repeat another's payload.

    Of equal payloads of at least ``min_bytes`` bytes the answer with the smallest page id
    (null last; then by record id) is the original. Payloads are equal where their SHA-256 is.
    """
    enough = answers.filter(F.col("n_bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "url", "date")
    originals = enough.groupBy("payload").agg(F.min(rank).alias("original"), F.count(F.lit(1)).alias("n"))
    repeated = originals.filter("n > 1").select("payload", "original")
    return enough.select("archive", "at", "record_id", "payload").join(repeated, "payload").filter(
        F.col("record_id") != F.col("original.record_id")
    ).select("archive", "at", F.col("original.record_id").alias("refers_to"), F.col("original.url").alias("uri"),
             F.col("original.date").alias("date"))


# --- WARC ------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def converted(archive: str, record: dict, original: dict | None) -> bytes:
    """The WARC record of an ARC record; ``original``: what a revisit refers to."""
    block = record["block"]
    if record["url"].startswith("filedesc:"):
        said = f"software: clusterloom\r\nformat: WARC File Format 1.1\r\ndescription: from ARC version {record['version']}\r\n".encode()
        return warc_record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, record, "")),
            ("WARC-Date", iso_date(record["date"])), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields"),
        ], said)
    http = split_http(block)
    payload = block if http is None else http[1]
    digest = base32(hashlib.sha1(payload).digest())
    kind = "resource" if http is None else "response" if original is None else "revisit"
    if kind == "revisit":
        block = http[0]
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(archive, record, digest)), ("WARC-Date", iso_date(record["date"])),
        ("WARC-Target-URI", record["url"]), ("WARC-IP-Address", record["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", record["mime"] if http is None else "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original["refers_to"]),
            ("WARC-Refers-To-Target-URI", original["uri"]), ("WARC-Refers-To-Date", original["date"]),
        ]
    return warc_record(fields, block)


def _converting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[dict]:
        for archive, content, repeats in _each_file(batches):
            originals = {r["at"]: r for r in repeats or []}
            for record in arc_contents(archive, content):
                yield {"value": converted(archive, record, originals.get(record["at"]))}

    return _batches(records(), pa.schema([("value", pa.binary())]))


def convert_arc(
    spark: SparkSession, arc: str, warc: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Converts the packed ARC files in folder ``arc`` to packed WARC files in folder ``warc``.

    Payloads of at least ``min_bytes`` bytes that several answers have are kept once.
    """
    answers = cut_lineage(_files(spark, arc).mapInArrow(_answers, ANSWERS))
    repeats = revisits(answers, min_bytes).groupBy("archive").agg(
        F.collect_list(F.struct("at", "refers_to", "uri", "date")).alias("repeats")  # no more than a file has records
    )
    files = _files(spark, arc).join(repeats, "archive", "left").select("archive", "content", "repeats")
    records = files.mapInArrow(_converting, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", records_per_file).text(warc, compression="gzip", lineSep="\r\n\r\n")


def warc_contents(name: str, content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    stream = _Stream(name, content)
    while line := stream.line():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{name}: no WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.line()).strip(b"\r\n"):
            key, _, value = line.rstrip(b"\r\n").decode("utf-8", "replace").partition(":")
            fields[key.lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"{name}: a WARC record without a length")
        yield fields, stream.take(int(fields["content-length"]))


RECORDS = (
    "archive string, record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, page_id bigint, payload_bytes bigint, payload binary"
)


def _records(with_payload: bool):
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for archive, content in _each_file(batches):
            for fields, block in warc_contents(archive, content):
                kind = fields.get("warc-type")
                http = split_http(block) if kind in ("response", "revisit") else None
                head, payload = http or (b"", block)
                said = {k: fields.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in ("payload", "block")}
                if said["block"] and said["block"] != base32(hashlib.sha1(block).digest()):
                    raise ValueError(f"{archive}: the block of {fields.get('warc-record-id')} has another digest")
                n_bytes = len(payload)
                if kind == "revisit":
                    declared = re.search(rb"(?mi)^Content-Length: *([0-9]+)\s*$", head)
                    n_bytes = int(declared[1]) if declared else None
                elif said["payload"] and said["payload"] != base32(hashlib.sha1(payload).digest()):
                    raise ValueError(f"{archive}: the payload of {fields.get('warc-record-id')} has another digest")
                yield {
                    "archive": archive, "record_id": fields.get("warc-record-id"), "record_type": kind,
                    "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
                    "payload_digest": said["payload"] or None, "refers_to": fields.get("warc-refers-to"),
                    "page_id": page_id_of(head), "payload_bytes": n_bytes,
                    "payload": payload if with_payload and kind != "revisit" else None,
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, kinds[k]) for n, k in map(str.split, RECORDS.split(", "))])
        return _batches(found(batches), schema)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the packed WARC files in folder ``path``, digests checked.

    ``payload_bytes`` of a revisit is the length that its HTTP head declares; its payload
    is null, as all are without ``payloads``. ``refers_to`` is the original's record id.
    """
    return _files(spark, path).mapInArrow(_records(payloads), RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every answer.

    ``refers_to`` becomes the page id of the record that a revisit refers to.
    """
    own = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    originals = own.filter("record_type = 'response'").select(
        F.col("record_id").alias("original"), F.col("page_id").alias("original_page")
    )
    return own.join(originals, F.col("refers_to") == F.col("original"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("original_page").alias("refers_to")
    )


def archived_pages(
    spark: SparkSession, pages: DataFrame, arc: str, warc: str, min_bytes: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
) -> DataFrame:
    """Writes ``pages (page_id, url, html)`` to ARC, converts it to WARC and reads that back.

    Returns :func:`page_records`, one row for each row of ``pages``. A null html is an empty
    payload, a null url ``-``, a null page id stays null and is no page's original as long as
    there is another. Repeated rows are records of their own. Bytes that are no UTF-8 are
    archived as they are. An empty table gives empty archives and no rows; further columns
    are not looked at. A file's packed bytes are held whole, its records one by one.
    """
    write_arc(pages, arc, records_per_file=records_per_file)
    convert_arc(spark, arc, warc, min_bytes, records_per_file)
    return page_records(cut_lineage(read_warc(spark, warc, payloads=False)))
