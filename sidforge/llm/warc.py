"""WARC archives: writing, reading, and putting segmented records together again.

A page becomes an HTTP response in chunked transfer framing. A response whose block is
longer than SEGMENT_BYTES is written as a first segment and continuation records that name
their origin, their number and, in the last one, the total length. Pages whose payload
equals that of a page with a larger id become revisit records without payload.

Reading groups continuation records by origin identifier, orders them by segment number,
checks numbers and total length, and undoes the chunked framing. An archive that does not
parse, a gap or repeat among the segments, a wrong length, a broken chunk or a wrong digest
stops the job. A group is one record, so its size is that of one page.

A null payload is empty; pages with a null id get no record. Rows that share a page id get a
record each: the first has the id alone as its identifier, the others a copy number as well.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.operators.identity import with_idx
from sidforge.session import materialize

SEGMENT_BYTES = 64 << 10  # of one record's block
CHUNK_BYTES = 8 << 10  # of one transfer chunk
FILE_RECORDS = 2000  # pages of one archive file
BATCH_BYTES = 4 << 20  # of blocks that a reader hands on at a time
LEAST_REVISIT = 1000  # shorter payloads are stored every time
_END = b"\r\n"
_PAGE = "urn:page:"


# --- writing ------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP/1.1 chunked framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, _END]
    return b"".join([*parts, b"0\r\n\r\n"])


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END * 2 + block


def page_name(page_id: int, copy: int | None = 0) -> str:
    """The identifier of a page's record without brackets; later copies have a number."""
    return f"{_PAGE}{page_id}" + (f"#{copy}" if copy else "")


def page_records(
    page_id: int, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0, refers_copy: int = 0
) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in one or more segments."""
    digest = hashlib.sha1(payload).hexdigest()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or f"{_PAGE}{page_id}")
    about = [
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    own = page_name(page_id, copy)
    name = ("WARC-Record-ID", f"<{own}>")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        more = [("WARC-Refers-To", f"<{page_name(refers_to, refers_copy)}>"), ("WARC-Profile", profile)]
        yield record("revisit", [name, *about, *more], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record("response", [name, *about], block)
        return
    yield record("response", [name, *about, ("WARC-Segment-Number", "1")], block[:SEGMENT_BYTES])
    starts = range(SEGMENT_BYTES, len(block), SEGMENT_BYTES)
    for number, start in enumerate(starts, 2):
        fields = [
            ("WARC-Record-ID", f"<{own}:{number}>"),
            about[0],
            about[1],
            ("WARC-Segment-Origin-ID", name[1]),
            ("WARC-Segment-Number", str(number)),
        ]
        if start + SEGMENT_BYTES >= len(block):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", fields, block[start : start + SEGMENT_BYTES])


def revisit_plan(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the largest page id among equal
    payloads of LEAST_REVISIT bytes or more, null for that page itself. ``copy`` numbers rows that
    share a page id from 0, and ``refers_copy`` is that of the first row with the payload.

    Digests are counted before they are shuffled, and only those that repeat are joined.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.where("page_id is not null").select(
        "page_id", "url", "html", F.octet_length(body).alias("_bytes"), F.sha1(body).alias("_sha1")
    )
    long = known.where(f"_bytes >= {LEAST_REVISIT}")
    first = long.groupBy("_sha1").agg(F.max("page_id").alias("_kept"), F.min("page_id").alias("_low"))
    first = first.where("_kept > _low").select("_sha1", "_kept")
    # A third of all pages may share a payload: the join splits such a key at run time.
    found = known.join(first, "_sha1", "left")
    refers = F.when((F.col("_bytes") >= LEAST_REVISIT) & (F.col("_kept") > F.col("page_id")), F.col("_kept"))
    found = found.withColumn("refers_to", refers)
    repeated = known.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select("page_id")
    repeated = materialize(repeated, "repeated")
    names = ["page_id", "url", "html", "refers_to"]
    if repeated.isEmpty():
        return found.select(*names, F.lit(0).cast("bigint").alias("copy"), F.lit(0).cast("bigint").alias("refers_copy"))
    # Equal rows are spread by their place, which is written out before it is used.
    again = found.join(repeated, "page_id").withColumn("_place", F.monotonically_increasing_id())
    again = with_idx(materialize(again, "again"), ["page_id", "_sha1", "_place"], "_row")
    again = materialize(again.select(*names, "_sha1", "_row"), "copies")
    start = again.groupBy("page_id").agg(F.min("_row").alias("_start"))
    again = again.join(start, "page_id").withColumn("copy", F.col("_row") - F.col("_start"))
    single = found.join(repeated, "page_id", "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    every = single.select(*names, "_sha1", "copy").unionByName(again.select(*names, "_sha1", "copy"))
    # The first copy that holds the payload, where a revisit refers to a repeated id.
    holds = again.groupBy(F.col("page_id").alias("refers_to"), "_sha1").agg(F.min("copy").alias("refers_copy"))
    every = every.join(holds, ["refers_to", "_sha1"], "left")
    return every.select(*names, "copy", F.coalesce("refers_copy", F.lit(0)).cast("bigint").alias("refers_copy"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (the columns of ``revisit_plan``) as gzip WARC files below ``path``.

    The text writer puts each record, byte for byte, between record ends, so a file is a
    valid archive and a lost task is simply written again.
    """

    def encode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                records = list(page_records(row["page_id"], row["url"], payload, row["refers_to"], row["copy"], row["refers_copy"]))
                yield pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})

    rows = pages.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(path)


# --- reading ------------------------------------------------------------------------


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        stop = data.find(_END * 2, at)
        lines = data[at : max(stop, at)].decode().split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = stop + 4
        end = start + int(fields["content-length"])
        if end > len(data) or data[end : end + 4] != _END * 2:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start:end]
        at = end + 4


def dechunk(body: bytes) -> bytes:
    """Undo chunked framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        stop = body.find(_END, at)
        if stop < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:stop].split(b";")[0].strip(), 16)
        at = stop + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != _END:
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2
    return b"".join(parts)


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and decoded body of an HTTP response."""
    head, _, body = block.partition(_END * 2)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    chunks = fields.get("transfer-encoding", "").lower().endswith("chunked")
    return fields, dechunk(body) if chunks else body


RECORD = (
    "record_id string, origin_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, segment int, total_length bigint, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``; ``origin_id`` is the record's own id but for
    continuation records."""

    def parse(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_archive(gzip.decompress(content.as_py())):
                    total = fields.get("warc-segment-total-length")
                    row = {
                        "record_id": fields["warc-record-id"],
                        "origin_id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                        "record_type": fields["warc-type"],
                        "target_uri": fields.get("warc-target-uri"),
                        "refers_to": fields.get("warc-refers-to"),
                        "payload_digest": fields.get("warc-payload-digest"),
                        "segment": int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None,
                        "total_length": int(total) if total else None,
                        "block": block,
                    }
                    rows.append(row)
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


_ARROW = pa.schema(
    [
        *((n, pa.string()) for n in ("record_id", "origin_id", "record_type", "target_uri", "refers_to", "payload_digest")),
        ("segment", pa.int32()),
        ("total_length", pa.int64()),
        ("block", pa.binary()),
    ]
)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record, with the block of all its segments in order.

    Records without a segment number pass as they are. Numbers must run from 1 without
    gap or repeat, and the last segment must state the length of the whole block.
    """
    alone = records.where("segment is null")
    pieces = records.where("segment is not null")
    whole = pieces.groupBy("origin_id").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in
          ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")),
        F.count("*").alias("_n"),
        F.max("segment").alias("segment"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("_parts"),
    )
    blocks = F.transform("_parts", lambda p: p["block"].cast("string"))
    whole = whole.withColumn("block", F.array_join(blocks, "").cast("binary"))
    right = F.expr(
        "record_id = origin_id and _n = segment and size(array_distinct(transform(_parts, p -> p.segment))) = _n "
        "and octet_length(block) = total_length"
    )
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments of "), "origin_id", F.lit(" do not add up")))
    )
    whole = whole.withColumn("block", checked.cast("binary"))
    return alone.unionByName(whole.select(*alone.columns))


def payloads(logical: DataFrame) -> DataFrame:
    """``(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, payload)``.

    A revisit has the length and digest of the payload it stands for, and no payload.
    """
    names = ["record_id", "record_type", "target_uri", "refers_to"]

    def decode(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out: dict[str, list] = {n: [r[n] for r in rows] for n in names}
            out |= {"payload_bytes": [], "payload_digest": [], "payload": []}
            for r in rows:
                fields, payload = http_payload(r["block"])
                stated = (r["payload_digest"] or "").removeprefix("sha1:")
                revisit = r["record_type"] == "revisit"
                digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                if digest != stated:
                    raise ValueError(f"the payload of {r['record_id']} does not have its digest")
                out["payload_bytes"].append(int(fields["content-length"]) if revisit else len(payload))
                out["payload_digest"].append(digest)
                out["payload"].append(None if revisit else payload)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(out[n], pa.string()) for n in names), pa.array(out["payload_bytes"], pa.int64()),
                 pa.array(out["payload_digest"], pa.string()), pa.array(out["payload"], pa.binary())],
                names=list(out),
            )

    schema = ", ".join(f"{n} string" for n in names) + ", payload_bytes bigint, payload_digest string, payload binary"
    return logical.select(*names, "payload_digest", "block").mapInArrow(decode, schema)


def page_number(column: str):
    """The page id in a record identifier."""
    return F.regexp_extract(column, rf"^<{_PAGE}(-?\d+)(?:#\d+)?>$", 1).cast("bigint")
