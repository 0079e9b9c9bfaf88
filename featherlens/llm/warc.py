"""WARC archives with an index: write once, then read byte ranges.

Each task streams its rows into archives of its own (one gzip member a record, so any record can be read alone) in the
shared folder, under a name no other attempt uses, and returns one index row a record: archive, offset, length, url,
payload digest. The index is written as a table first; only records it lists count, so what a lost or repeated task left
behind is never read. Readers sort the selected index rows by archive and offset, in tasks by the bytes that they stand for, join neighbouring
ranges into one read of bounded size, and parse the records.

Payloads aren't shuffled: repeated digests are found on narrow rows and broadcast up to MAX_BROADCAST_FIRSTS of them; beyond
that pages are joined by id and digest, which no repeated payload makes hot.

The shared folder may be on a local path or any store that pyarrow opens; s3a and s3n addresses are read as s3. For other
schemes archives can't be written, and an error says so.

Of the records with equal payloads (SHA-256) of at least MIN_DUPLICATE bytes, the one with the smallest page_id is a
response and the others are revisits, which carry no payload. Rows that repeat the smallest page_id are all responses; a
null page_id is never the smallest unless all are null. Null html is an empty payload; a null url gets a urn.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, raw_bytes

MIN_DUPLICATE = 100
ROLL_BYTES = 256 << 20
#: Ranges at most this far apart are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
GZIP_LEVEL = 4
#: Archive bytes that one task reads; small selections go to as many tasks as there are cores, if each gets SMALL_BYTES.
TASK_BYTES, SMALL_BYTES = 64 << 20, 1 << 20
#: Repeated digests that are broadcast, of about 100 bytes each.
MAX_BROADCAST_FIRSTS = 200_000
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Target-URI: {_field(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
        *([f"Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []),
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def plan(pages: DataFrame, max_broadcast: int | None = None) -> DataFrame:
    """page_id, url, html, digest, bytes and first (null unless the payload repeats): what each record will be."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    narrow = rows.filter(F.col("bytes") >= MIN_DUPLICATE).select("page_id", "digest")
    again = cut(narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("digest", "first"), "repeated")
    if again.count() <= (MAX_BROADCAST_FIRSTS if max_broadcast is None else max_broadcast):
        return rows.join(F.broadcast(again), "digest", "left")
    marks = narrow.distinct().join(again, "digest").withColumnsRenamed({"page_id": "p", "digest": "d"})
    return rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address in the shared folder."""
    scheme, sep, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise RuntimeError(f"archives can't be opened under {uri}: {e}") from e


def write(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes the archives and returns their index, itself a written table."""
    root = root or fresh_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            columns = {k: batch.column(k).to_pylist() for k in ("page_id", "url", "digest", "first")}
            for page_id, url, digest, first, payload in zip(*columns.values(), raw_bytes(batch.column("html")), strict=True):
                if out is None or at >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: featherlens\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    at = out.write(_gzip(head.encode() + info + b"\r\n\r\n"))
                revisit = first is not None and first != page_id
                data = _gzip(record(page_id, url, payload, digest, first if revisit else None, revisit))
                out.write(data)
                rows.append((page_id, name, at, len(data), url, digest, "revisit" if revisit else "response"))
                at += len(data)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ("page_id", "archive", "offset", "length", "url", "payload_digest", "record_type")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
        if out is not None:
            out.close()

    rows = plan(pages).select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("first").cast("long"))
    index = cut(rows.mapInArrow(archive, INDEX), "index")
    return index.withColumn("archive", F.concat(F.lit(f"{root}/"), "archive"))


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) -> (archive, start, stop, members) of the joined reads."""
    now: list | None = None
    for archive, offset, length in rows:
        if now and now[0] == archive and offset - now[2] <= GAP_BYTES and offset + length - now[1] <= READ_BYTES:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
        else:
            if now:
                yield tuple(now)
            now = [archive, offset, offset + length, [(offset, length)]]
    if now:
        yield tuple(now)


def read(selected: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the selected index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Sizes and digests of responses are taken from the payload read back, those of revisits from their headers.
    payload: also the payload as html (null for revisits).
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True))
        opened, file = None, None
        for archive, start, stop, members in ranges(rows):
            if archive != opened:
                if file is not None:
                    file.close()
                fs, path = store(archive)
                opened, file = archive, fs.open_input_file(path)
            data, out = file.read_at(stop - start, start), []
            for offset, length in members:
                headers, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                http, _, body = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response":
                    size, found = len(body), hashlib.sha256(body).hexdigest()
                    if found != digest:
                        raise ValueError(f"{archive} at {offset}: the payload's digest is {found}, not {digest}")
                page, refers = headers.get("page-id"), headers.get("refers-to-page-id")
                out.append((page and int(page), size, digest, kind, refers and int(refers), headers["warc-target-uri"], body.decode() if kind == "response" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.string()] * payload))
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names[: len(kinds)])
        if file is not None:
            file.close()

    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-size // TASK_BYTES), min(selected.sparkSession.sparkContext.defaultParallelism, -(-size // SMALL_BYTES)), 1)
    ordered = selected.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(load, RECORD + ", html string" * payload)
