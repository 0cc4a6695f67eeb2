"""Operator 9: WARC archives, written by Spark and read sequentially.

Writing. Each record is a gzip member of its own. Records with equal payloads are revisits of the one
with the smallest id, so a payload is stored once. Tasks pack records into archives of some MB; Spark's
file writer commits them, so archives of lost or repeated tasks never appear, in any store that Spark
can write. Between rows that writer puts a separator; here it is an empty gzip member, which adds no
byte to the decompressed stream.

Reading. An archive is decompressed piece by piece, member by member; the content length frames the
block, and block and payload digests are verified. Memory is one archive and one record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.scratch import Scratch, small

PIECE = 1 << 16
ARCHIVE = 8 << 20
EMPTY_MEMBER = b"\x1f\x8b\x08" + bytes(6) + b"\x03\x03" + bytes(9)
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


class WarcError(ValueError):
    """An archive that breaks the framing."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit with its HTTP headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    h = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if url is not None:
        h.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        h += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member(h, http if refers_to is not None else http + payload)


def write_pages(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, tmp: Scratch | None = None) -> None:
    """Write one record for each row to archives under path.

    Null html is an empty payload; a null url has no target; a row with a null id is always a response
    without an id. Rows that repeat the smallest id of a payload are all responses. An empty table
    gives no archive.
    """
    tmp = tmp or Scratch(pages.sparkSession)
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keys = tmp.put(own.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("n")), "keys")
    first = keys.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    first = tmp.put(first.select(F.col("sha").alias("_sha"), "first"), "first")
    revisits = keys.join(first, F.col("sha") == F.col("_sha")).where("page_id > first").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
    revisits = small(tmp.put(revisits, "revisits"))
    rows = own.join(revisits, (F.col("page_id") == F.col("_id")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        parts, size = [info], 0
        for b in batches:
            ids, urls, bodies, refers = (b.column(k) for k in range(4))
            for i, u, h, r in zip(ids.to_pylist(), urls.to_pylist(), bodies.cast(pa.binary()), refers.to_pylist(), strict=True):
                parts.append(page_record(i, u, h.as_py(), r))
                size += len(parts[-1])
                if size >= ARCHIVE:
                    yield pack(parts)
                    parts, size = [info], 0
        if size:
            yield pack(parts)

    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def members(f: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as pieces of decompressed bytes; a member must be read to its end."""
    rest = b""
    while True:
        rest = rest or f.read(PIECE)
        if not rest:
            return
        z = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            data = rest
            while not z.eof:
                if not data and not (data := f.read(PIECE)):
                    raise WarcError("the archive ends inside a record")
                if out := z.decompress(data, PIECE):
                    yield out
                data = z.unconsumed_tail
            rest = z.unused_data

        yield pieces()


def records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers in lower case, block, whether its digest holds) of each record; empty members are skipped."""
    for member in members(f):
        got = bytearray()
        for piece in member:
            got += piece
            if b"\r\n\r\n" in got:
                break
        if not got:
            continue
        head, end, _ = bytes(got).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not end or not lines[0].startswith("WARC/"):
            raise WarcError("a record without WARC headers")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        body = got[len(head) + 4 :]
        for piece in member:
            body += piece
            if len(body) > n + 4:
                raise WarcError("more bytes than the content length")
        if bytes(body[n:]) != b"\r\n\r\n" or len(body) != n + 4:
            raise WarcError("the content length does not frame the block")
        block = bytes(body[:n])
        named = headers.get("warc-block-digest")
        yield headers, block, named is None or named == "sha1:" + base32_sha1(block)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path, one row each: see RECORDS. digest_ok: the block's digest and, of responses, the payload's hold.

    Broken framing is an error. A revisit's payload_bytes is the length in its HTTP headers.
    """

    def number(s: str | None) -> int | None:
        s = (s or "").removeprefix("<urn:page:").removesuffix(">")
        return int(s) if s.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block, ok in records(io.BytesIO(content.as_buffer())):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    named = h["warc-payload-digest"].removeprefix("sha1:")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
                    n = int(fields["content-length"])
                    if h["warc-type"] == "response":
                        ok = ok and n == len(payload) and base32_sha1(payload) == named
                    rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), n, named, ok))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                columns = list(zip(*rows, strict=True)) or [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)
