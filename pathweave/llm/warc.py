"""WARC archives: written with an index, read back through it by byte ranges.

Writing makes one archive per task, each record a gzip member of its own, and an index with
file, offset, length, URL and digest of every record. The index is a table that Spark commits:
what a lost task has left behind is in no index. Of records with equal payloads of at least
``revisit_from`` bytes the one with the largest id is a response and the others revisit it.

Reading starts from any selection of index rows. They are dealt out by stretches of the
archives, sorted by offset, and neighbouring records are fetched in one read if the gap
between them is small; a read is bounded in length unless a single record is longer.

Payloads are compared by their SHA-1 and length. Only digests are shuffled to find the equal
ones. Digests that occur more than once are joined back to the pages, by broadcast if their
checked number allows it, else by a shuffle.

Cases: a null payload is empty; a null id is written as such, never chosen as the response if
another record has one, and read back as null; rows that repeat the largest id are all
responses; a null URL leaves the field out; control characters and blanks in URLs are
percent-encoded; an empty table gives no archives and an empty result; only the named columns
are read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm import files
from pathweave.session import cut_lineage, scratch_path, write_and_reread

#: Up to this number of repeated digests (some 70 bytes each) are sent to all tasks.
BROADCAST_ROWS = 100_000
#: Bytes between two records that are read along rather than skipped, of one read, and of the
#: stretch of an archive that a task reads.
GAP, READ, STRETCH = 1 << 16, 1 << 23, 1 << 24
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, id long, record_type string"


def _name(record: int | None) -> str:
    return f"<urn:x-page:{'none' if record is None else record}>"


def _number(name: str) -> int | None:
    part = name.strip("<>").rpartition(":")[2]
    return None if part == "none" else int(part)


def record_bytes(record: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, as a gzip member. ``digest`` is hexadecimal; archives write it in base 32."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(record)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """The fields of a record and its payload; of a revisit, the length its HTTP head states."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().lower().rpartition("content-length: ")[2].split("\r\n")[0])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = field["WARC-Type"] == "revisit"
    return {
        "id": _number(field["WARC-Record-ID"]),
        "url": field.get("WARC-Target-URI"),
        "record_type": field["WARC-Type"],
        "refers_to": _number(field["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
    }


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """``id, url, payload, digest, response_id``: the record that each page revisits, null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = p.filter(F.octet_length("payload") >= revisit_from).select("id", "digest")
    repeated = cut_lineage(large.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("largest")).filter("n > 1 and largest is not null").drop("n"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    joined = p.join(side, "digest", "left")
    revisits = (F.octet_length("payload") >= revisit_from) & F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    return joined.select("id", "url", "payload", "digest", F.when(revisits, F.col("largest")).alias("response_id"))


def write(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; returns their index, read back from where Spark has committed it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        rows: list[tuple] = []

        def parts() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for record, url, payload, digest, response in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    part = record_bytes(record, url, payload, digest, response, response is not None, date)
                    rows.append((path, at, len(part), url, digest, record, "response" if response is None else "revisit"))
                    at += len(part)
                    yield part

        stream = parts()
        first = next(stream, None)
        if first is None:
            return

        def again() -> Iterator[bytes]:
            yield first
            yield from stream

        files.write_bytes(path, again())
        out = pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "id", "record_type"]).astype({"id": "Int64"})
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("id", pa.int64()), ("record_type", pa.string())]), preserve_index=False)

    return write_and_reread(planned.select("id", "url", "payload", "digest", "response_id").mapInArrow(run, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined to reads: (begin, end, ranges)."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        end = offset + length
        if reads and offset - reads[-1][1] <= GAP and end - reads[-1][0] <= READ:
            begin, last, own = reads[-1]
            own.append((offset, length))
            reads[-1] = (begin, max(last, end), own)
        else:
            reads.append((offset, end, [(offset, length)]))
    return reads


def read(index: DataFrame) -> DataFrame:
    """The records of the given index rows: ``id, url, record_type, refers_to, payload, payload_bytes, payload_digest``."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for path, own in rows.groupby("file", sort=False):
                for begin, end, ranges in coalesced(list(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))):
                    data = files.read_range(path, begin, end - begin)
                    records = [parse_record(data[o - begin : o - begin + size]) for o, size in ranges]
                    yield pa.RecordBatch.from_pylist(records, schema=schema)

    return dealt.mapInArrow(run, "id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to a fresh folder in the shared one and return the index."""
    return write(plan_records(pages, **options), scratch_path(pages.sparkSession, "warc"))
