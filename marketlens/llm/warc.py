"""Operator 3: WARC archives and transaction assembly.

``write_archives`` turns each page into one transaction of three records: a
``request``, a ``response`` (or a ``revisit`` that refers to the response with
an equal payload) and a ``metadata`` record; request and metadata name the
response in ``WARC-Concurrent-To``.  Each record is a gzip member of its own,
so a file can be read from any record on.  ``read_records`` parses archives,
``assemble`` joins the records of a transaction through their concurrent-to
identifiers and emits one nested row per capture.

Rows: a null payload is empty; a null url writes no target; rows that repeat
page_id and payload are one capture; of equal payloads under one page_id the
single capture is the response; pages without a page_id are written under an id
made from their payload; an empty table gives no records; further columns of
any name are ignored.  A record whose partner is missing keeps nulls there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.shared import read_files, scratch, write_files
from marketlens.llm.text import byte_texts

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target string, payload_bytes long, payload_digest string, fields map<string,string>"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{key}')}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers if v is not None] + [b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def _clean(text: str | None) -> str | None:
    """A header value on one line."""
    return None if text is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _hashed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), F.col("url").cast("string").alias("url"), F.sha1(html.cast("binary")).alias("sha"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload, of at least
    ``least_bytes`` bytes, a smaller page_id has too.  Only hashes are
    shuffled; equal payloads are reduced to their smallest page before."""
    facts = _hashed(pages).where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).select("page_id", "sha")
    first = facts.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return facts.join(first, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 16 << 20) -> None:
    """Writes one transaction per page into archives of about ``file_bytes``
    compressed bytes (a single larger record makes a larger file)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, payload in enumerate(byte_texts(batch.column(1))):
                page, url, sha, refers = (batch.column(c)[i].as_py() for c in (0, 2, 3, 4))
                own = base64.b32encode(bytes.fromhex(sha)).decode()
                revisit = refers is not None
                key = f"{page}:{own}" if page is not None else f"none:{own}"
                name, target = record_name("response", key), _clean(url)
                common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{own}")]
                made = [
                    record([("WARC-Type", "request"), ("WARC-Record-ID", record_name("request", key)), ("WARC-Concurrent-To", name), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=request")],
                           f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()),
                    record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", record_name("response", f"{refers}:{own}")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], b"")
                    if revisit else record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "text/html;charset=utf-8")], payload),
                    record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_name("metadata", key)), ("WARC-Concurrent-To", name), ("WARC-Target-URI", target), ("Content-Type", "application/warc-fields")],
                           "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page), ("payload-bytes", len(payload)), ("refers-to-page", refers if revisit else None)) if v is not None).encode()),
                ]
                held += made
                size += sum(map(len, made))
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])

    again = revisits(pages, least_bytes)
    # Only revisits are joined; where they are few the join broadcasts them and
    # no payload is shuffled.
    write_files(_hashed(pages).join(again, ["page_id", "sha"], "left").select("page_id", "html", "url", "sha", "refers_to").mapInArrow(write, "blob binary"), path)


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file in turn; zero padding after the last is skipped."""
    view, at = memoryview(content), 0
    while at < len(view) and view[at]:
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(view[at:at + (1 << 20)])
        end = at + (1 << 20)
        parts = [data]
        while not inflate.eof:
            if end >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(inflate.decompress(view[end:end + (1 << 20)]))
            end += 1 << 20
        at = min(end, len(view)) - len(inflate.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); the block is cut by Content-Length, whatever it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``, one a row, as in ``RECORD``.

    Size and digest of a response are those of its block as read; of a revisit
    they are left to its partners.  ``fields`` are a metadata record's lines.
    ``with_payload`` adds the block."""
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + ([pa.binary()] if with_payload else [])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [str(i) for i in range(len(kinds))])

        for contents in batches:
            for content in contents.column(0):
                rows, size = [], 0
                for member in members(content.as_buffer()):
                    head, block = parse_record(member)
                    kind = head["WARC-Type"]
                    fields = [tuple(x.split(": ", 1)) for x in block.decode().splitlines()] if kind == "metadata" else None
                    own = (len(block), digest(block)) if kind == "response" else (None, head["WARC-Payload-Digest"].removeprefix("sha1:")) if kind == "revisit" else (None, None)
                    rows.append((head["WARC-Record-ID"], kind, head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), *own, fields, *([block] if with_payload else [])))
                    size += len(block) if with_payload else 200
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = RECORD + (", payload binary" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    return read_files(spark, path).select("content").mapInArrow(parse, schema).toDF(*columns)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction_id and the structs request,
    response (a response or revisit record) and metadata.

    The records meet by the response they are concurrent to; a transaction is
    a few records, so the groups are small however large the corpus."""
    whole = F.struct(*records.columns)
    kind = F.col("record_type")
    part = lambda *kinds: F.min_by(F.when(kind.isin(*kinds), whole), F.when(kind.isin(*kinds), F.col("record_id")))
    return (records.withColumn("transaction_id", F.coalesce("concurrent_to", "record_id")).groupBy("transaction_id")
            .agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder, reads them back and assembles them."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return assemble(read_records(pages.sparkSession, path))
