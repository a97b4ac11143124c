"""WARC archives with segmented records: writing, and reading by segment reassembly.

Each page becomes an HTTP response (or a revisit of an earlier equal payload). The body uses
chunked transfer framing, and a record whose block exceeds ``segment_bytes`` is written as a first
record and continuations (WARC-Segment-Number, WARC-Segment-Origin-ID, and the total length on
the last), which may land in different archives. Reading parses archives as streams; whole records
are settled on the spot, and only segments are shuffled: grouped by origin, ordered by number,
checked against the total length, then decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import arrow_schema, broadcast_if_small, discard, records, resting, saved, scratch, ship, tune

ship(__name__)

#: Longest block of a record before it is written in segments. Long enough that most pages are one
#: record, short enough that archives of ordinary pages hold segments.
SEGMENT_BYTES = 1 << 14
#: An archive is closed once it exceeds this.
ARCHIVE_BYTES = 64 << 20
#: Chunk of the transfer framing.
CHUNK_BYTES = 8192

#: Fixed value: the name space of record ids made from a row's number.
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_PAGES = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, intact boolean, payload binary"
_FOUND = _PAGES + ", record_id string, segment long, total long, block binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is not closed")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def header_safe(value: str | None) -> str:
    return "" if value is None else "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


_DATE = ("WARC-Date", "2024-01-01T00:00:00Z")


def page_records(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in one or more segments.

    A response's id follows from page and payload, so that revisits can name it; rows that repeat
    both have ids of their own, and what revisits them names its address and date only.
    """
    payload = (row["html"] or "").encode()
    sha = digest(payload)
    revisit = row["refers_to"] is not None
    name = record_id(row["page_id"], sha) if row["named"] and not revisit else record_id(row["page_id"], sha, row["uid"])
    shared: list[tuple[str, object]] = [_DATE, ("WARC-Target-URI", header_safe(row["url"])), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-ID", row["page_id"]), ("X-Payload-Bytes", len(payload))]
    http = ("Content-Type", "application/http;msgtype=response")
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        origin = record_id(row["refers_to"], sha) if row["origin_named"] else None
        refers = [("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", header_safe(row["origin_url"])), ("WARC-Refers-To-Date", _DATE[1]), ("X-Refers-To-Page-ID", row["refers_to"])]
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared, profile, *refers, http], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *shared, ("WARC-Segment-Number", 1 if several else None), http], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = len(block) if i == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(name, i)), _DATE, ("WARC-Segment-Number", i), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Total-Length", last)], part)


@resting
def write_partition(batches: Iterator[pa.RecordBatch], uri: str, segment_bytes: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives of one partition. Names are private to the attempt; the manifest that Spark
    commits lists those of the attempt that counted."""
    filesystem, path = common.file_system(uri)
    filesystem.create_dir(path, recursive=True)
    out, name, names, written = None, "", [], 0
    for b in batches:
        for row in b.to_pylist():
            for data in page_records(row, segment_bytes):
                if out is None:
                    name = f"{uri}/{common.partition_id():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, written = filesystem.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None), 0
                out.write(data)
                written += len(data)
                if written >= archive_bytes:
                    out.close()
                    names.append(name)
                    out = None
    if out is not None:
        out.close()
        names.append(name)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])


_GZIP = b"\x1f\x8b\x08"


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of an archive. A broken one is left out, and reading goes on
    at the next place that looks like the start of a member."""
    data, ended = b"", False
    while True:
        at = data.find(_GZIP)
        while at < 0 and not ended:
            more = stream.read(size)
            ended = not more
            data = data[-2:] + more  # a start may be cut in two
            at = data.find(_GZIP)
        if at < 0:
            return
        data = data[at:]
        inflate, out, used = zlib.decompressobj(31), [], 0
        try:
            while not inflate.eof:
                if used == len(data):
                    more = stream.read(size)
                    if not more:
                        break
                    data += more
                out.append(inflate.decompress(data[used:]))
                used = len(data)
        except zlib.error:
            data = data[1:]
            continue
        if not inflate.eof:
            ended, data = True, data[1:]  # the archive ends inside a member, or that was no start
            continue
        yield b"".join(out)
        data = inflate.unused_data


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive of gzip members. A member may hold several. What
    is no record, or says no usable length, ends its member: the others are read."""
    for content in members(stream):
        src = io.BytesIO(content)
        while line := src.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                break
            headers: dict[str, str] = {}
            while (line := src.readline()).strip():
                k, _, v = line.decode(errors="replace").partition(":")
                headers[k.strip().lower()] = v.strip()
            length = whole(headers.get("content-length"))
            if length is None or length < 0 or "warc-type" not in headers:
                break
            block = src.read(length)
            if len(block) < length:
                break
            yield headers, block


def whole(v: str | None) -> int | None:
    """A header's integer; none if there is none."""
    try:
        return None if v is None else int(v)
    except ValueError:
        return None


def settle(first: dict, block: bytes, complete: bool, keep_payload: bool) -> tuple:
    """A page from its whole block: digest and length are those of the decoded payload."""
    payload, intact = None, complete
    if first["record_type"] == "response" and complete:
        head, _, body = block.partition(b"\r\n\r\n")
        try:
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError:
            intact = False
    sha, n = first["payload_digest"], first["payload_bytes"]
    if payload is not None:
        sha, n = digest(payload), len(payload)
        intact = intact and sha == first["payload_digest"]
    return first["page_id"], first["url"], first["record_type"], first["refers_to"], sha, n, intact, payload if keep_payload else None


@resting
def read_archives(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    """Whole records come out settled; segments as they are, with their origin and number."""
    schema = arrow_schema(_FOUND)
    for b in batches:
        for name in b.column(0).to_pylist():
            filesystem, path = common.file_system(name)
            rows, held = {f.name: [] for f in schema}, 0
            with filesystem.open_input_file(path) as src:
                for h, block in parse(src):
                    if h["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    first = {
                        "page_id": whole(h.get("x-page-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": whole(h.get("x-refers-to-page-id")),
                        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": whole(h.get("x-payload-bytes")),
                    }
                    number = whole(h.get("warc-segment-number"))
                    if number is None:
                        values = (*settle(first, block, True, keep_payload), None, None, None, None)
                        held += 500 + len(values[7] or b"")
                    else:
                        values = (*first.values(), None, None, h.get("warc-segment-origin-id", h.get("warc-record-id")), number, whole(h.get("warc-segment-total-length")), block)
                        held += len(block)
                    for k, v in zip(rows, values, strict=True):
                        rows[k].append(v)
                    if held > 4 << 20:
                        yield records(rows, schema)
                        rows, held = {f.name: [] for f in schema}, 0
            yield records(rows, schema)


def reassemble(table: pa.Table, keep_payload: bool) -> pa.Table:
    """The segments of one origin: in order, gapless from 1, and as long as the last one says."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    block = b"".join(r["block"] for r in rows)
    complete = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["total"] == len(block)
    schema = arrow_schema(_PAGES)
    if rows[0]["record_type"] == "continuation":
        return schema.empty_table()  # its first record is in no archive: there is no page to return
    found = settle(rows[0], block, complete, keep_payload)
    return pa.Table.from_batches([records({f.name: [x] for f, x in zip(schema, found, strict=True)}, schema)])


@resting
def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [(x or "").encode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64()), b.column(2)], names=["page_id", "sha", "n", "url"])


def write_archives(pages: DataFrame, uri: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, revisit_from: int = 0) -> DataFrame:
    """Write a record a row; returns the manifest, one row an archive.

    Of rows with equal payloads of ``revisit_from`` bytes or more, the smallest page_id is the
    response and the others revisit it; rows that repeat that page_id are responses too. A null
    page_id never leads: such rows revisit the smallest id, and are responses where no equal
    payload has an id. Null html is an empty payload; null url an empty header.
    """
    spark = pages.sparkSession
    tune(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    thin = saved(own.select("page_id", "html", "url").mapInArrow(digests, "page_id long, sha binary, n long, url string"), "digests")
    same = saved(thin.groupBy("sha", "n", "page_id").agg(F.count("*").alias("rows"), F.min("url").alias("url")), "same")
    # Of equal payloads, the row of the least id; min skips structs that are null.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows", "url"))).alias("first")
    leaders = same.where(F.col("n") >= revisit_from).groupBy("sha").agg(first, F.count("*").alias("ids")).where("ids > 1 and first is not null")
    led = same.join(leaders, "sha", "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    marks = led.select(
        F.col("page_id").alias("mark_id"), F.col("sha").alias("mark_sha"), (F.col("rows") == 1).alias("named"),
        *[F.when(later, F.col(c)).alias(n) for c, n in (("first.page_id", "refers_to"), ("first.url", "origin_url"))], F.when(later, F.col("first.rows") == 1).alias("origin_named"),
    ).where("refers_to is not null or not named")
    # A counted, small list of revisits and repeated rows meets the pages where they are. A longer one
    # joins by id and payload: ids are spread evenly even where a third of the payloads are equal.
    html = F.coalesce("html", F.lit(""))
    listed = saved(marks, "marks")
    discard(thin, same)
    joined = own.join(broadcast_if_small(listed), F.col("page_id").eqNullSafe(F.col("mark_id")) & (F.unhex(F.sha2(html.cast("binary"), 256)) == F.col("mark_sha")), "left")
    columns = ["page_id", "url", "html", F.coalesce("named", F.lit(True)).alias("named"), "refers_to", "origin_url", "origin_named"]
    numbered = joined.select(*columns).withColumn("uid", F.monotonically_increasing_id())
    manifest = saved(numbered.mapInArrow(lambda it: write_partition(it, uri, segment_bytes, archive_bytes), "archive string"), "manifest")
    discard(listed)
    return manifest


def read_pages(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row a page of the listed archives. ``intact`` is false where a segment is missing, the
    total length differs, the framing is broken or the digest does not match. A revisit has the digest and
    length that its headers state, as the standard means it. Broken gzip members, records without a
    usable length and records of other types give no row."""
    files = manifest.repartition(max(1, manifest.count()), "archive")
    found = saved(files.mapInArrow(lambda it: read_archives(it, keep_payload), _FOUND), "records")
    names = [f.name for f in arrow_schema(_PAGES)]
    joined = found.where("segment is not null").groupBy("record_id").applyInArrow(lambda t: reassemble(t, keep_payload), _PAGES)
    return found.where("segment is null").select(*names).unionByName(joined)


def round_trip(spark: SparkSession, pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. An empty table gives an empty result; extra columns are ignored."""
    began = common.mark()
    manifest = write_archives(pages, scratch(spark, "archives"), segment_bytes, archive_bytes)
    out = saved(read_pages(manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"), "pages")
    common.clear(spark, began, (out,))
    return out
