"""WARC archives: writing with segments, chunked framing and revisits; reading with reassembly of continuation records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calipra.llm.common import bound_batches, materialize, new_path

#: Bytes of a record's block at most, records of an archive at most: an archive is read as a whole, and holds about their product at most.
SEGMENT_BYTES, ARCHIVE_RECORDS = 32 << 10, 2000
#: Bytes of a chunk in the chunked transfer coding.
CHUNK_BYTES = 8 << 10
#: Payloads from so many bytes on are written once; records with the same payload refer to it.
REVISIT_BYTES = 0

# Fixed values of the formats.
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id {kind}, type string, digest string, refers_to {kind}, payload_bytes long, record_id string, origin_id string, segment int, total long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, a body that ends early is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of a stored HTTP response, by its own framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        return unchunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records_of(page_id, url: str | None, payload: bytes, refers_to, row: str, date: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response's first segment and its continuations, the last with the total length."""
    digest = digest_of(payload)
    name = lambda k: f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}|{row}|{k}'.encode()).digest()[:16])}>"
    uri = "".join(c for c in url or "" if c >= " ") or None
    common = [("WARC-Record-ID", name(1)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id)]
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), *common, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", refers_to), http], _HTTP)]
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *common, http], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), http], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", min_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes gzipped archives to path, a record or several for each row; Spark's writer commits them, so lost tasks leave nothing.

    Of rows with equal payloads of at least min_bytes, those with the smallest id are responses; others revisit it. Which, is
    found from digests, which are counted before they are shuffled; pages meet it by id. Null html is an empty payload. Rows with
    a null id, and rows that repeat with the smallest id, are responses.
    """
    bound_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    p = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keys = p.filter("id is not null").filter(F.octet_length("html") >= min_bytes).select("id", F.sha1("html").alias("sha1"))
    first = keys.groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("sha1", "first")
    later = keys.join(first, "sha1").filter("id > first").select(F.col("id").alias("later"), F.col("sha1"), "first").distinct()
    told = p.join(later, (F.col("id") == F.col("later")) & (F.sha1("html") == F.col("sha1")), "left").select("id", "url", F.col("html").cast("binary").alias("html"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        part = uuid.uuid4().hex
        for batch in batches:
            out = []
            for i, u, h, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                out += [r[:-1] for r in records_of(i, u, h, f, f"{part}-{row}", date, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the text writer puts bytes as they are, and a line feed: each record's last byte
    lines = told.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, plain or gzipped; names of fields are in lower case. What is no record is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(head["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        yield head, data[start:at]
        at += 4


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit in the archives below path.

    Records that are whole are decoded where they are read; of others, segments are grouped by their origin's id, ordered by number,
    and held against the total length. Each payload is held against the digest in its header. A revisit's length is that of
    the response it refers to. Missing segments, wrong lengths or digests are errors. Records of other types are passed over.
    """
    as_id = int if id_type in ("bigint", "int", "smallint", "tinyint") else str
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string() if id_type == "string" else {"smallint": pa.int16(), "tinyint": pa.int8()}[id_type]
    schema = _RECORD.format(kind=id_type)
    names = [x.split()[0] for x in schema.split(", ")]
    types = [arrow_id, pa.string(), pa.string(), arrow_id, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for head, block in parse_archive(content.as_py()):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page, to = (as_id(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id"))
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    segment, total = (int(head[k]) if k in head else None for k in ("warc-segment-number", "warc-segment-total-length"))
                    size = None
                    if kind == "response" and segment is None:
                        payload = payload_of(block)
                        if digest != digest_of(payload):
                            raise ValueError(f"the payload of {head['warc-record-id']} does not match its digest")
                        size = len(payload)
                    origin = None if segment is None else head.get("warc-segment-origin-id", head["warc-record-id"])
                    out.append((page, kind, digest, to, size, head["warc-record-id"], origin, segment, total, None if segment is None else block))
                cols = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, sizes, digests = [], [], []
            for origin, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"segments of {origin} are missing")
                payload = payload_of(block)
                if parts[0]["digest"] != digest_of(payload):
                    raise ValueError(f"the payload of {origin} does not match its digest")
                pages.append(parts[0]["page_id"])
                sizes.append(len(payload))
                digests.append(parts[0]["digest"])
            yield pa.RecordBatch.from_arrays([pa.array(pages, arrow_id), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialize(files.mapInArrow(parse, schema), "records")
    part = F.struct("segment", "page_id", "digest", "block")
    segments = records.filter("segment is not null").groupBy("origin_id").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = segments.mapInArrow(join, f"page_id {id_type}, payload_bytes long, payload_digest string")
    whole = records.filter("segment is null and type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"))
    responses = materialize(whole.unionByName(joined), "responses")
    revisits = records.filter("type = 'revisit'").select("page_id", "digest", "refers_to")
    sizes = responses.filter("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    again = revisits.join(sizes, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    known = F.assert_true(F.col("payload_bytes").isNotNull(), F.lit("a revisit refers to no response"))
    again = again.filter(known.isNull())
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to")).unionByName(again)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", path: str | None = None) -> DataFrame:
    """Writes archives (below the shared folder, if no path is given) and reads them back; see read_warc()."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, id_col, url, html)
    return read_warc(spark, path, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("page_id", id_col)
