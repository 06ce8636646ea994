"""WARC archives with a Zstandard dictionary in a leading skippable frame and one frame a record.

An archive is what a .warc.zst file holds: a skippable frame (magic 0x184D2A5D) with the dictionary, then each record as a Zstandard frame
of its own, compressed with it. Archives are kept as rows (name, data) of a Parquet table in the shared folder, so any store that Spark
writes will do and Spark's commit protocol covers lost executors; `export` writes them out as files. Each writing task trains one dictionary
from its first SAMPLE_BYTES of records, which are a random part of the table as rows come hash-partitioned, and starts a new archive at
ARCHIVE_BYTES. A sample affects the compression only, never what is stored.

Defined cases: null html is an empty payload; null url has no WARC-Target-URI; null page_id keeps a record and comes back null; rows with
equal page_id are records of their own; of equal payloads with equal largest page_id, rows with that id are all responses; an empty table
gives no rows; a very long payload is one record, and an archive of its own when it passes ARCHIVE_BYTES; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import join_salted, materialize

MIN_BYTES = 1000
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
ARCHIVE_BYTES = 4 << 20
LEVEL = 3
SALTS = 64
MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) if page_id is None else page_id % (1 << 64))}>"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn[10:-1]).int
    return None if n >> 64 else n - (1 << 64 if n >> 63 else 0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only, whose Content-Length is that of the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields in lower case, and payload (of a revisit: None); the digest of a stored payload is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    fields["digest"] = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
    fields["payload"] = payload if fields["warc-type"] == "response" else None
    if fields["payload"] is not None and (len(payload) != fields["payload_bytes"] or hashlib.sha1(payload).hexdigest() != fields["digest"]):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return fields


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; raw content where they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples, k=200, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1\r\n"


def archives(records: Iterator[bytes]) -> Iterator[bytes]:
    """Whole archives; holds SAMPLE_BYTES of records at first, then one archive."""
    sample, size = [], 0
    for x in records:
        sample.append(x)
        size += len(x)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    raw = train(sample)
    lead = struct.pack("<II", MAGIC, len(raw)) + raw
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    out, held = [lead], 0
    for part in (sample, records):
        for x in part:
            out.append(pack.compress(x))
            held += len(out[-1])
            if held >= ARCHIVE_BYTES:
                yield b"".join(out)
                out, held = [lead], 0
    if held:
        yield b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    rest = memoryview(data)[8 + n :]
    while rest:
        one = d.decompressobj()
        yield one.decompress(rest)
        if not one.eof:
            raise ValueError("cut off within a record")
        rest = rest[len(rest) - len(one.unused_data) :]


def decide(pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to: the largest page_id of an equal payload of MIN_BYTES or more, null for that record itself."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    # The digest of a payload too short to be revisited has no partner.
    keys = rows.where(F.octet_length("html") >= MIN_BYTES).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    return join_salted(rows, keys, "digest", SALTS, F.coalesce(F.col("page_id"), F.lit(0))).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("last", "__one")


def write(pages: DataFrame) -> DataFrame:
    """The archive table (name, data, records) of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for b in batches:
                for page_id, url, html, digest, to in zip(b.page_id.astype(object), b.url, b.html, b.digest, b.refers_to.astype(object), strict=True):
                    yield record(None if pd.isna(page_id) else int(page_id), None if url is None else url, html.encode(), digest, None if pd.isna(to) else int(to))

        for k, data in enumerate(archives(records())):
            yield pd.DataFrame({"name": [f"pages-{TaskContext.get().partitionId():05d}-{k:05d}.warc.zst"], "data": [data]})

    # Ids as text: pandas would turn a long column with nulls into doubles, which lose digits.
    rows = decide(pages).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(rows.mapInPandas(run, "name string, data binary"), "warc")


def read(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of an archive table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b.data:
                rows = []
                for x in map(parse, read_archive(data)):
                    to = x.get("warc-refers-to")
                    rows.append((page_of(x["warc-record-id"]), x["payload_bytes"], x["digest"], x["warc-type"], None if to is None else page_of(to)))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"}) if rows else out.head(0)

    return table.mapInPandas(run, RESULT)


def export(table: DataFrame, folder: str) -> None:
    """Write the archives as .warc.zst files into a folder that the executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for name, data in zip(b.name, b.data, strict=True):
                part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
            yield pd.DataFrame({"name": b.name})

    table.mapInPandas(run, "name string").count()
