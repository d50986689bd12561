"""WARC archives: writing with segmented records, and reading with segment reassembly.

Writing: every row is one record (response, or revisit where an equal payload of at least
REVISIT_BYTES bytes has a smaller id). A response's block is an HTTP message in chunked transfer framing;
a block over SEGMENT_BYTES is cut into a first record and continuation records, which name it by
WARC-Segment-Origin-ID, count on by WARC-Segment-Number, and state the total in the last. Files are written by
Spark's text writer, one record per row, with the two line ends that close a record as line separator: plain
WARC/1.1 files, committed like any other output, and bounded by RECORDS_PER_FILE.

Reading: files are parsed by Content-Length alone; segments are grouped by origin, put in order,
held against their numbers and the total, joined, and the chunk framing is decoded.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, materialize, text_or_empty

SEGMENT_BYTES = 8_192
CHUNK_BYTES = 3_000
RECORDS_PER_FILE = 2_048
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"  # records of one input are equal whenever they are written

_END = b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are read over. Anything else is an error."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            if data[at : at + 2] != b"\r\n" and data.find(_END, at) < 0:
                raise ValueError("the last chunk is not closed")
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not closed")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def page_records(page_id, url: str | None, payload: bytes, refers_to, segment_bytes: int = SEGMENT_BYTES, number: int = 0) -> list[bytes]:
    """The records of one page: one, or one and its continuations. A page without an id is named by number."""
    digest = hashlib.sha256(payload).hexdigest()
    name = f"<urn:page:none-{number}:{digest[:16]}>" if page_id is None else f"<urn:page:{page_id}:{digest[:16]}>"
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        common.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        more = [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest[:16]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *more, ("Content-Type", "application/http; msgtype=response")], head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(first, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(own, part))
    return out


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Writes one WARC record (with its continuations) per row of pages to files in path.

    A null payload is empty. A row with a null id is always a response. Rows that share id and payload are records of
    one name, each as often as it is in pages (the table has no other means to tell them apart); rows without an id have names of their own; the smallest id's rows are all responses.
    Other columns of pages are not looked at; an empty table makes archives without a page.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(text_or_empty(payload_col), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    leaders = long_enough.groupBy("digest").agg(F.min("page_id").alias("leader"), F.max("page_id").alias("last")).where("leader < last").select("digest", "leader")
    marked = rows.join(materialize(leaders, "warc-leaders"), "digest", "left")
    refers = F.when((F.col("leader") < F.col("page_id")) & (F.octet_length("payload") >= REVISIT_BYTES), F.col("leader"))
    info = record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", "<urn:archive:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def write(batches):
        schema = pa.schema([("value", pa.binary())])
        yield pa.RecordBatch.from_pydict({"value": [info]}, schema)
        for batch in in_slices(batches, 256):
            for page_id, url, payload, leader, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"value": page_records(page_id, url, payload, leader, segment_bytes, number)}, schema)

    records = marked.select("page_id", "url", "payload", refers.alias("leader"), F.monotonically_increasing_id().alias("number")).mapInArrow(write, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


def parse(data: bytes):
    """(headers by lower-case name, block) of every record of an archive."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.strip().lower().decode()] = v.strip().decode()
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a block is shorter than its Content-Length")
        yield headers, block
        at = end + 4 + size


_FIELDS = ["type", "name", "number", "total", "digest", "refers_to", "url", "block"]
_SEGMENTS = pa.schema([("type", pa.string()), ("name", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("block", pa.binary())])


def _parse_files(batches):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)

    for batch in batches:
        for i in range(batch.num_rows):
            data = batch["content"][i].as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows = []
            for h, block in parse(data):
                kind = h.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                name = h["warc-segment-origin-id"] if kind == "continuation" else h["warc-record-id"]
                rows.append((kind, name, int(h.get("warc-segment-number", 1)), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h.get("warc-payload-digest"), h.get("warc-refers-to"), h.get("warc-target-uri"), block))
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def reassemble(segments: list[dict]) -> tuple[bytes, int]:
    """(block, copies) from a record's segments in any order; repeated records come as so many copies of each segment."""
    by: dict[int, list[dict]] = {}
    for s in segments:
        by.setdefault(s["number"], []).append(s)
    order = sorted(by)
    if order != list(range(1, len(order) + 1)) or len({len(v) for v in by.values()}) != 1:
        raise ValueError("segments are missing")
    if any(s["block"] != v[0]["block"] for v in by.values() for s in v):
        raise ValueError("segments of one number differ")
    block = b"".join(by[n][0]["block"] for n in order)
    total = by[order[-1]][0]["total"]
    if len(order) > 1 and total != len(block):
        raise ValueError(f"the segments have {len(block)} bytes, not the stated {total}")
    return block, len(by[1])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: name, url, record_type, payload (null for a revisit), payload_digest (bare, checked), refers_to (a name)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    segments = files.mapInArrow(_parse_files, "type string, name string, number int, total long, digest string, refers_to string, url string, block binary")
    grouped = segments.groupBy("name").agg(F.collect_list(F.struct("number", "total", "block")).alias("parts"), *[F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "digest", "refers_to", "url")])  # one record's segments

    def decode(batches):
        schema = pa.schema([("name", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                block, copies = reassemble(row["parts"])
                head, _, body = block.partition(_END)
                stated = (row["digest"] or "").removeprefix("sha256:")
                payload = None
                if row["type"] == "response":
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if stated and hashlib.sha256(payload).hexdigest() != stated:
                        raise ValueError(f"{row['name']} does not have its payload digest")
                yield pa.RecordBatch.from_pylist([{"name": row["name"], "url": row["url"], "record_type": row["type"], "payload": payload, "payload_digest": stated, "refers_to": row["refers_to"]}] * copies, schema)

    return grouped.select("name", "url", "type", "digest", "refers_to", "parts").mapInArrow(decode, "name string, url string, record_type string, payload binary, payload_digest string, refers_to string")


def page_of(name: str):
    """The id within a record's name."""
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
