"""Media columns: texts as PNG images in a binary column, read back through zlib chunks, and 64-bit cosine-transform hashes of them.

An image has WIDTH pixels a row of CHANNELS 8-bit samples. Rows are filtered by None, Sub or Up, whichever gives the least sum of signed
values; the reader knows all five filters, tests every chunk's checksum and the length and order of chunks. The hash shrinks the image's
luminance to 32 x 32 by area means, transforms it (DCT-II) and compares the 8 x 8 lowest frequencies with their median.

Defined cases: null text is empty; an empty text is a row of spaces; equal texts give equal values; null doc_id is kept; an empty table
gives no rows; a very long text is a taller image, held whole; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 4
SIDE, LOW = 32, 8
_N = np.arange(SIDE)
DCT = np.cos(np.pi * (2 * _N[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """payload, a positive multiple of ROW bytes, as an RGB image."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = x.copy(), x.copy()
    sub[:, CHANNELS:] -= x[:, :-CHANNELS]
    up[1:] -= x[:-1]
    cost = np.stack([np.abs(f.view(np.int8).astype(np.int16)).sum(1, dtype=np.int32) for f in (x, sub, up)])
    kind = cost.argmin(0).astype(np.uint8)
    rows = np.empty((len(x), ROW + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.where((kind == 0)[:, None], x, np.where((kind == 1)[:, None], sub, up))
    head = struct.pack(">IIBBBBB", WIDTH, len(x), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks up to IEND; raises on a wrong signature, length or checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            break
    if at != len(png):
        raise ValueError("bytes after IEND")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """rows of a filter byte and samples -> samples. None and Sub rows are undone together, the others one by one."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if len(sub := np.flatnonzero(kind == 1)):
        n = out.shape[1] // bpp
        out[sub] = np.cumsum(out[sub].reshape(len(sub), n, bpp), axis=1, dtype=np.uint8).reshape(len(sub), -1)
    none = np.zeros(out.shape[1], np.uint8)
    for r in np.flatnonzero(kind > 1):
        up = out[r - 1] if r else none
        if kind[r] == 2:
            out[r] += up
            continue
        line, above = out[r].astype(np.int32).reshape(-1, bpp), up.astype(np.int32).reshape(-1, bpp)
        left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
        for k in range(len(line)):
            line[k] = left = (line[k] + ((left + above[k]) // 2 if kind[r] == 3 else _paeth(left, above[k], corner))) % 256
            corner = above[k]
        out[r] = line.reshape(-1).astype(np.uint8)
    return out


def decode_png(png: bytes) -> np.ndarray:
    """(height, width * channels) samples of a non-interlaced 8-bit image."""
    parts = list(chunks(png))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("IHDR must come first and IEND last")
    width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or method or filters or interlace:
        raise ValueError("unsupported PNG")
    raw = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong amount of image data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels)


def shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Area means of x along its first axis in n cells; rows repeat where there are fewer than n."""
    edges = np.arange(n + 1) * len(x) / n
    total = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    low = np.floor(edges).astype(np.int64)
    part = np.vstack([x, np.zeros((1, x.shape[1]))])[low]
    at = total[low] + part * (edges - low)[:, None]
    return np.diff(at, axis=0) * (n / len(x))


def feature(samples: np.ndarray) -> str:
    """16 hex digits: the lowest frequencies above their median."""
    grey = samples.reshape(len(samples), -1, CHANNELS).astype(np.float64).mean(axis=2)
    small = shrink(shrink(grey, SIDE).T, SIDE).T
    low = np.round(DCT @ small @ DCT.T, 6).ravel()
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


def encode(docs: DataFrame) -> DataFrame:
    """The media table (doc_id, n_bytes, media) of docs, in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                both = [payload_of(t) for t in part.text]
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "n_bytes": [n for _, n in both], "media": [encode_png(p) for p, _ in both]})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return materialize(ids.mapInPandas(run, "doc_id string, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold, read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for png in b.media:
                x = decode_png(png)
                back = x.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(x)))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield pd.concat([b[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)

    out = media.mapInPandas(run, RESULT.replace("doc_id long", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
