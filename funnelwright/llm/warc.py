"""WARC archives: pages written as segmented records, and records put together again.

``write_archive`` makes one record of each page: a response with the HTTP message (chunked transfer
framing), or a revisit that names the response with the same payload. A record longer than
``segment_bytes`` is split: the first piece keeps its type and has segment number 1, the others are
continuation records with their number and the origin's identifier, the last with the total length.
So no record is long, and files hold a bounded number of records. Every record ends with the
separator that the text writer puts after its rows, which makes the files plain WARC 1.1.

``read_archive`` parses the files by content length, groups the pieces by origin, orders them by
number, verifies number and total length, decodes the chunked framing, and verifies the digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelwright.llm.common import pieces

SEGMENT_BYTES, CHUNK, RECORDS_A_FILE = 16 << 10, 4 << 10, 512
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; sizes may carry extensions, trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body without its last chunk")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = line + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def records_of(
    name: str,
    url: str | None,
    payload: bytes,
    digest: str,
    page: int | None,
    response: tuple[str, int | None] | None,
    segment: int,
) -> Iterator[bytes]:
    """The records of one page. ``response``: record and page that this page revisits, if it does."""
    fields: dict[str, object] = {
        "WARC-Type": "revisit" if response else "response",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page is not None:
        fields["X-Page-ID"] = page
    if response:
        fields |= {"WARC-Refers-To": f"<{response[0]}>", "WARC-Profile": REVISIT_PROFILE}
        if response[1] is not None:
            fields["X-Refers-To-Page"] = response[1]
        yield _record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        piece = block[at : at + segment]
        if number == 1:
            yield _record(fields | {"WARC-Segment-Number": 1}, piece)
            continue
        more: dict[str, object] = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{number}').urn}>",
            "WARC-Date": DATE,
            "WARC-Segment-Number": number,
            "WARC-Segment-Origin-ID": f"<{name}>",
        }
        if number == len(cuts):
            more["WARC-Segment-Total-Length"] = len(block)
        yield _record(more, piece)


def _name(page: int | None, sha: str, copy: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page}/{sha}/{copy}").urn


def _write(segment: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            records: list[bytes] = []
            for x in zip(*(batch.column(k) for k in ("page_id", "url", "html", "sha", "copy", "shared", "response_page"))):
                page, url, html, sha, copy, shared, first = (v.as_py() for v in x)
                own = not shared or (page == first and copy == 1)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                response = None if own else (_name(first, sha, 1), first)
                records += records_of(_name(page, sha, copy), url, (html or "").encode(), digest, page, response, segment)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    return of


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with sha (hexadecimal), copy (from 1 among equal rows), shared, and response_page.

    Of pages with equal payloads of ``least_bytes`` at least (these are shared), the one with the
    smallest page_id is the response; of equal rows the first. A null id is never smallest.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select("page_id", F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    smallest = marked.groupBy("sha").agg(F.min("page_id").alias("response_page"))
    one = marked.select("page_id", "sha", (F.col("n") >= least_bytes).alias("shared")).distinct()
    known = one.join(smallest, "sha").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), "sha", "shared", "response_page"
    )
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), F.sha1(html).alias("sha"), "page_id", "url", "html"
    )
    # Numbering uses the partitioning of the join; equal ids with equal payloads are repeated rows.
    copy = F.row_number().over(Window.partitionBy("id", "sha").orderBy("url"))
    return rows.join(known, ["id", "sha"]).withColumn("copy", copy)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0) -> None:
    """One record, in segments if it is long, for each row of ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload, a null url an empty one; extra columns are left out. Repeated rows
    give a response and revisits of it.
    """
    records = with_responses(pages, least_bytes).select(
        "page_id", "url", "html", "sha", "copy", "shared", "response_page"
    ).mapInArrow(_write(segment_bytes), "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_A_FILE)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of a file, by content length."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(VERSION[:5], at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + len(END), int(fields["content-length"])
        block = data[start : start + size]
        if len(block) != size or data[start + size : start + size + 4] != END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, block
        at = start + size + len(END)


_PIECE = "origin string, number int, total long, type string, page_id long, digest string, refers_to long, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _PIECE.split(", ")])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0

            def number(fields: dict[str, str], name: str) -> int | None:
                return int(fields[name]) if name in fields else None

            for fields, block in parse_records(gzip.decompress(content.as_py())):
                rows.append(
                    (
                        fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                        number(fields, "warc-segment-number"),
                        number(fields, "warc-segment-total-length"),
                        fields["warc-type"],
                        number(fields, "x-page-id"),
                        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        number(fields, "x-refers-to-page"),
                        block,
                    )
                )
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def reassembled(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a record from its numbered segments; verifies numbers and total length."""
    parts = sorted(parts)
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {[n for n, _ in parts]}")
    block = b"".join(x for _, x in parts)
    if len(block) != total:
        raise ValueError(f"{len(block)} bytes of {total}")
    return block


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP message and its full length; a revisit has the length only."""
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunked(body)
        return body, len(body)
    return body, int(fields.get(b"content-length", len(body)))


def _decode(keep: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in zip(*(batch.column(k) for k in ("page_id", "digest", "type", "refers_to", "total", "parts"))):
                page, digest, kind, refers, total, parts = (v.as_py() for v in x)
                whole = parts[0]["block"] if parts[0]["number"] is None else reassembled([(p["number"], p["block"]) for p in parts], total)
                payload, size = payload_of(whole)
                if kind != "revisit" and (digest_of(payload) != digest or len(payload) != size):
                    raise ValueError(f"page {page}: the payload doesn't have its digest")
                rows.append((page, size, digest, kind, refers, payload if keep and kind != "revisit" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return of


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each response and revisit.

    Raises on a cut record, missing or surplus segments, a wrong total length, broken chunks, or a
    payload that doesn't match its digest. Only segmented records are shuffled.
    """
    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _PIECE)
    piece = F.struct("number", "block")
    columns = ["page_id", "digest", "type", "refers_to", "total", "parts"]
    # Both branches read the files: parsing is cheaper than shuffling whole records.
    single = parts.where("number is null").withColumn("parts", F.array(piece)).select(columns)
    first = F.col("number") == 1
    grouped = (
        parts.where("number is not null")
        .groupBy("origin")
        .agg(
            *(F.max(F.when(first, F.col(k))).alias(k) for k in ("page_id", "digest", "type", "refers_to")),
            F.max("total").alias("total"),
            F.collect_list(piece).alias("parts"),
        )
        .select(columns)
    )
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return single.union(grouped).mapInArrow(_decode(payloads), schema)
