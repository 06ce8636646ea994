"""Exact removal of strings of MIN_BYTES bytes that a document of smaller doc_id holds too, by suffix arrays of shared passages.

1. Each scan task packs its rows into blocks of about BLOCK_BYTES and writes them, compressed, as rows of a table; texts are not shuffled
   for it, and what is shuffled later is the packed block. In each window of MIN_BYTES bytes the K-grams of least hash are anchors; equal
   windows have equal anchors. A block sends its distinct anchors' hashes, packed, to the hashes' buckets.
2. A bucket answers each block with a bitmap: which of its anchors occur in two documents at least. (A hash collision costs work only.)
   The answers also count those anchors, so the buckets of the next step are cut by the bytes that can reach them, not by those of the table.
3. For each such anchor a block cuts out the run of windows that it is the least of, at most 2 * MIN_BYTES - K bytes, and sends each
   distinct piece once, with its least doc_id, to the anchor's bucket.
4. A bucket sorts the suffixes of its distinct pieces by two-stage sorting: only suffixes smaller than their successors are sorted
   directly (by DEPTH bytes), the others are induced by one scan over the first-byte buckets. Neighbours in the array with a common prefix of
   MIN_BYTES form classes of equal windows; the least doc_id of each goes back to the blocks that sent the pieces.
5. A block removes the windows whose class has a smaller doc_id than the document.

A passage in a third of all documents reaches a bucket once per block, not once per document. Equal windows meet in the bucket of their
anchor, so nothing is compared across buckets, and no step holds more than a block or a bucket.

Defined cases: null text is empty; null doc_id is kept, never a source and never cut; rows of equal doc_id are not sources of each other;
repeated rows give a row each; a text longer than BLOCK_BYTES is a block of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialize, remove_table

MIN_BYTES = 50
K = 20
WINDOWS = MIN_BYTES - K + 1
DEPTH = 56
BLOCK_BYTES = 4 << 20
#: Bytes of documents for each bucket of hashes, and of pieces, at their longest, for each bucket of pieces.
HASH_BUCKET_BYTES = 8 << 20
BUCKET_BYTES = 2 << 20
#: Zstandard levels of blocks, which are shuffled twice, and of messages.
BLOCK_LEVEL, LEVEL = 5, 3
#: Doc ids are compared as longs; this stands for "none".
NONE = np.iinfo(np.int64).max
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)


def slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each run of n entries, by doubling."""
    out, have = x, 1
    while 2 * have <= n:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (n - have)], out[n - have :]) if have < n else out


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a big-endian number; data ends with 7 bytes of padding or more."""
    n = len(data) - 7
    return np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view(_U).ravel().byteswap(inplace=True)


class Anchors:
    """Anchors of texts, concatenated: place `at`, document `doc`, hash `h` and the window starts `lo`..`hi` that each is least of."""

    def __init__(self, data: bytes, size: np.ndarray):
        self.start = np.cumsum(size) - size
        n = int(size.sum())
        self.data = np.frombuffer(data[:n] + bytes(K + 8), np.uint8)
        self.at = self.doc = np.zeros(0, np.int64)
        self.h, self.short = np.zeros(0, _U), np.zeros(0, np.uint32)
        if n < MIN_BYTES:
            return
        w = words8(self.data)[: n + K - 8]
        h = w[:n] * _A
        h ^= w[8 : n + 8] * _B
        h ^= w[K - 8 : n + K - 8] * _C
        del w
        h ^= h >> _U(32)
        h *= _A
        h ^= h >> _U(29)
        short = (h >> _U(32)).astype(np.uint32)
        whole = n - MIN_BYTES + 1
        least = slide(short[: n - K + 1], WINDOWS, np.minimum)
        inside = np.ones(whole, bool)
        for a, k in zip(self.start.tolist(), size.tolist(), strict=True):  # windows that would leave their document
            inside[max(0, a + max(0, k - MIN_BYTES + 1)) : a + k] = False
        top = np.zeros(n - K + WINDOWS, np.uint32)  # place i looks at the windows that start at i - WINDOWS + 1 to i
        top[WINDOWS - 1 : WINDOWS - 1 + whole] = np.where(inside, least, 0)
        self.at = np.flatnonzero(slide(top, WINDOWS, np.maximum) == short[: n - K + 1])
        self.short, self.h = short, h[self.at]
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1

    def runs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows of which anchor self.at[some] is least; empty (lo > hi) if there is none."""
        at, s = self.at[some], self.short
        own = s[at]
        lo = at.copy()
        left, right = np.ones(len(at), bool), np.ones(len(at), bool)
        reach = at.copy()
        for d in range(1, WINDOWS):
            left &= (at - d >= 0) & (s[np.maximum(at - d, 0)] >= own)
            lo[left] = at[left] - d
            right &= s[np.minimum(at + d, len(s) - 1)] >= own
            reach[right] = at[right] + d
        hi = np.minimum(at, reach - WINDOWS + 1)
        begin = self.start[self.doc[some]]
        ends = np.append(self.start[1:], len(self.data) - K - 8)[self.doc[some]]
        return np.maximum(lo, begin), np.minimum(hi, ends - MIN_BYTES)


def two_stage(text: np.ndarray) -> np.ndarray:
    """Suffix array of text by its first DEPTH bytes at least; a suffix that is another's start sorts first, ties go any way."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    # A suffix goes as its first byte does, where that differs from the next; the last suffix is larger than the empty one.
    tells = np.arange(n, dtype=np.int32)
    tells[:-1][text[1:] == text[:-1]] = n
    tells = np.minimum.accumulate(tells[::-1])[::-1]
    direct = np.append(text[1:] > text[:-1], False)[tells]  # smaller than the successor
    del tells
    b = np.flatnonzero(direct).astype(np.int32)
    # Later keys sort only what is still tied; past its end the text counts as zeros.
    w = words8(np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)]))
    order, tied, key, new = b, np.zeros(len(b), np.int32), None, None
    for k in range(0, DEPTH, 8):
        key = w[order + k]
        if k == 0:
            put = np.argsort(key, kind="stable")
            order, key = order[put], key[put]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        else:
            size = np.bincount(tied)
            open_ = np.flatnonzero(size[tied] > 1)
            if not len(open_):
                break
            some = order[open_]
            put = np.lexsort((w[some + k], tied[open_]))
            order[open_] = some[put]
            key = w[order + k]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (tied[1:] != tied[:-1])])
        tied = np.cumsum(new, dtype=np.int32) - 1
    del w, key, new, tied
    sa = np.empty(n, np.int32)
    start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
    head = start[:-1].copy()
    b_of = np.concatenate([[0], np.cumsum(np.bincount(text[b], minlength=256))])

    def induce(done: np.ndarray, byte: int) -> np.ndarray:
        """Put the larger predecessors of done, suffixes in order, at the heads of their buckets; those of bucket `byte` come back."""
        p = done[done > 0] - 1
        p = p[~direct[p] & (text[p] >= byte)]
        first = text[p]
        put = np.argsort(first, kind="stable")
        p, first = p[put], first[put]
        values, at, count = np.unique(first, return_index=True, return_counts=True)
        own = np.zeros(0, np.int64)
        for v, a, c in zip(values.tolist(), at.tolist(), count.tolist(), strict=True):
            sa[head[v] : head[v] + c] = p[a : a + c]
            head[v] += c
            if v == byte:
                own = p[a : a + c]
        return own

    # The empty suffix is least of all and induces the last one.
    sa[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for byte in range(256):
        done = sa[start[byte] : head[byte]]
        while len(done):
            done = induce(done, byte)
        same = order[b_of[byte] : b_of[byte + 1]]
        sa[start[byte + 1] - len(same) : start[byte + 1]] = same
        induce(same, byte + 1)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each entry of sa but the first, whether it and the entry before have MIN_BYTES bytes in common."""
    w = words8(np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)]))
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in [*range(0, MIN_BYTES - 8, 8), MIN_BYTES - 8]:
        key = w[sa + k]
        same &= key[1:] == key[:-1]
    return same


def least_docs(pieces: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets): for each window start of each piece, the least doc of all pieces that hold the window."""
    size = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sa = two_stage(text)
    begin = np.flatnonzero(np.concatenate([[True], ~common_prefixes(text, sa)])).astype(np.int32)
    fits = np.ones(len(text), bool)
    fits[(starts[1:, None] - np.arange(1, MIN_BYTES)).ravel()] = False
    value = np.repeat(doc, size)
    value[~fits] = NONE
    least = np.minimum.reduceat(value[sa], begin)
    value[sa] = np.repeat(least, np.diff(np.append(begin, len(sa))))
    return value[fits], np.concatenate([[0], np.cumsum(size - MIN_BYTES + 1)])


class _Pack:
    """Compressed arrays and bytes of messages."""

    def __init__(self):
        self.to, self.back = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False), zstandard.ZstdDecompressor()

    def put(self, x: np.ndarray | bytes) -> bytes:
        return self.to.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).data)

    def get(self, raw: bytes, kind: type) -> np.ndarray:
        return np.frombuffer(self.back.decompress(raw), kind)


class _Block:
    """A packed block: those of its rows with an id come first, and only they have anchors."""

    def __init__(self, row):
        self.gid, self.did, self.size = int(row.gid), np.frombuffer(row.did, np.int64), np.frombuffer(row.size, np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(self.size.sum())))

    def anchors(self) -> tuple[Anchors, np.ndarray]:
        """The anchors and each anchor's doc_id."""
        found = Anchors(self.data, self.size[: len(self.did)])
        return found, self.did[found.doc]


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of docs: gid, the doc_ids of the rows that have one, the sizes of all rows, and their texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gid, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0

        def block() -> pa.RecordBatch:
            did, own, rest = held
            texts = own + rest
            return pa.RecordBatch.from_pydict({"gid": pa.array([gid], pa.int64()), "did": [np.array(did, np.int64).tobytes()], "size": [np.array([len(x) for x in texts], np.int64).tobytes()], "data": [zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress(b"".join(texts))]})

        for b in batches:
            for did, raw in zip(b.column(0), b.column(1), strict=True):
                did, raw = did.as_py(), raw.as_py() or b""
                cost = len(raw) + 16  # 8 bytes of id and of size
                if size and size + cost > BLOCK_BYTES:
                    yield block()
                    gid, held, size = gid + 1, ([], [], []), 0
                if did is None:
                    held[2].append(raw)
                else:
                    held[0].append(did)
                    held[1].append(raw)
                size += cost
        if held[1] or held[2]:
            yield block()

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "gid long, did binary, size binary, data binary"), "blocks")


def _dealt(found: Anchors, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, key, first): anchors by bucket and 40-bit key; first marks where a new pair begins."""
    bucket, key = (found.h & _U(0xFFFFFF)).astype(np.int64) % buckets, found.h >> _U(24)
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]) if len(order) else np.zeros(0, bool)
    return order, bucket, key, first


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    blocks = pack(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // HASH_BUCKET_BYTES))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each bucket of hashes a block's distinct keys, how often each occurs (127 at most) and, in the high bit, whether in two documents."""
        for batch in batches:
            for row in batch.itertuples():
                found, doc = _Block(row).anchors()
                order, bucket, key, first = _dealt(found, buckets)
                at = np.flatnonzero(first)
                if not len(at):
                    continue
                doc = doc[order]
                times = np.minimum(np.diff(np.append(at, len(order))), 127).astype(np.uint8)
                times |= (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.uint8) << 7
                key, bucket = key[at], bucket[at]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                packed = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                parts = [(int(b[0]), k.tobytes(), t.tobytes()) for b, k, t in zip(np.split(bucket, cut), np.split(packed, cut), np.split(times, cut), strict=True)]
                yield pd.DataFrame({"p": [x[0] for x in parts], "gid": row.gid, "keys": [x[1] for x in parts], "times": [x[2] for x in parts]})

    def answer(bucket: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) for x in bucket.times])
        raw = np.frombuffer(b"".join(bucket["keys"]), np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        times = np.frombuffer(b"".join(bucket.times), np.uint8)
        _, which, count = np.unique(key.view("<u8").ravel(), return_inverse=True, return_counts=True)
        again = ((count > 1) | (np.bincount(which, times >> 7) > 0))[which]
        ends = np.cumsum(n)
        open_ = np.add.reduceat(np.where(again, times & 127, 0).astype(np.int64), ends - n)
        return pd.DataFrame({"gid": bucket.gid, "p": bucket.p, "n": open_, "bits": [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]})

    sent = blocks.mapInPandas(anchors, "p int, gid long, keys binary, times binary")
    answers = materialize(sent.groupBy("p").applyInPandas(answer, "gid long, p int, n long, bits binary"), "answers")
    open_ = answers.agg(F.sum("n")).first()[0] or 0
    piece_buckets = max(1, -(-open_ * (2 * MIN_BYTES - K) // BUCKET_BYTES))

    def cut(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Rows (p, gid, kind 0: pieces, compressed, their sizes, their least documents) and one of kind 1: place, bucket and number of each piece used."""
        if not len(block) or not len(answers):
            return pd.DataFrame({"p": [], "gid": [], "kind": [], "a": [], "b": [], "c": []}).astype({"p": "int32", "gid": "int64", "kind": "int32"})
        own = _Block(next(block.itertuples()))
        found, doc = own.anchors()
        order, bucket, _, first = _dealt(found, buckets)
        ps, n = np.unique(bucket[first], return_counts=True)
        bits = dict(zip(answers.p.tolist(), answers.bits, strict=True))
        again = np.concatenate([np.unpackbits(np.frombuffer(bits[p], np.uint8), count=k) for p, k in zip(ps.tolist(), n.tolist(), strict=True)]).astype(bool)
        chosen = order[again[np.cumsum(first) - 1]]
        lo, hi = found.runs(chosen)
        fine = lo <= hi
        chosen, lo, hi = chosen[fine], lo[fine], hi[fine]
        by = ((found.h[chosen] >> _U(24)) % _U(piece_buckets)).astype(np.int64)
        put = np.argsort(by, kind="stable")
        chosen, lo, hi, by = chosen[put], lo[put], hi[put], by[put]
        where, ends, of = lo.tolist(), (hi + MIN_BYTES).tolist(), doc[chosen].tolist()
        del found, order, bucket, first, doc
        data, out, used_k, pack_ = own.data, [], [], _Pack()
        for part in np.split(np.arange(len(by)), np.flatnonzero(np.diff(by)) + 1) if len(by) else []:
            known: dict[bytes, int] = {}
            least: list[int] = []
            for k in part.tolist():
                piece = data[where[k] : ends[k]]
                i = known.setdefault(piece, len(known))
                if i == len(least):
                    least.append(of[k])
                elif of[k] < least[i]:
                    least[i] = of[k]
                used_k.append(i)
            out.append((int(by[part[0]]), own.gid, 0, pack_.put(b"".join(known)), np.array([len(x) for x in known], np.uint8).tobytes(), pack_.put(np.array(least, np.int64))))
        if out:
            out.append((-1, own.gid, 1, pack_.put(lo.astype(np.int64)), pack_.put(by.astype(np.int32)), pack_.put(np.array(used_k, np.int32))))
        return pd.DataFrame(out, columns=["p", "gid", "kind", "a", "b", "c"])

    def judge(bucket: pd.DataFrame) -> pd.DataFrame:
        """For each block's pieces: runs (first window, windows, least document), and how many runs each piece has."""
        known: dict[bytes, int] = {}
        least: list[int] = []
        lists, pack_ = [], _Pack()
        for a, b, c in zip(bucket.a, bucket.b, bucket.c, strict=True):
            ends = np.cumsum(np.frombuffer(b, np.uint8), dtype=np.int64).tolist()
            a = pack_.get(a, np.uint8).tobytes()
            ids, at = [], 0
            for end, d in zip(ends, pack_.get(c, np.int64).tolist(), strict=True):
                i = known.setdefault(a[at:end], len(known))
                if i == len(least):
                    least.append(d)
                elif d < least[i]:
                    least[i] = d
                ids.append(i)
                at = end
            lists.append(np.array(ids, np.int32))
        value, offset = least_docs(list(known), np.array(least, np.int64))
        del known
        new = np.concatenate([[True], value[1:] != value[:-1]])
        new[offset[:-1]] = True
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(value)))
        runs = np.searchsorted(begin, offset)  # the runs of piece i are runs[i] to runs[i + 1]
        first = begin - offset[:-1][np.searchsorted(offset, begin, side="right") - 1]
        value = value[begin]
        out = []
        for gid, ids in zip(bucket.gid, lists, strict=True):
            count = runs[ids + 1] - runs[ids]
            each = np.repeat(runs[ids] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            out.append((bucket.p.iat[0], gid, 2, count.astype(np.uint8).tobytes(), np.concatenate([first[each], length[each]]).astype(np.uint8).tobytes(), pack_.put(value[each])))
        return pd.DataFrame(out, columns=["p", "gid", "kind", "a", "b", "c"])

    def strip(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own = _Block(next(block.itertuples()))
        start = np.concatenate([[0], np.cumsum(own.size)])
        change = np.zeros(start[-1] + 1, np.int32)
        place = told[told.kind == 1]
        if len(place):
            unpack = _Pack().get
            lo, p, k = unpack(place.a.iat[0], np.int64), unpack(place.b.iat[0], np.int32), unpack(place.c.iat[0], np.int32)
            doc = own.did[np.searchsorted(start, lo, side="right") - 1]
            for x in told[told.kind == 2].itertuples():
                a, z = np.searchsorted(p, [x.p, x.p + 1])
                count = np.frombuffer(x.a, np.uint8).astype(np.int64)
                both, value = np.frombuffer(x.b, np.uint8).astype(np.int64), unpack(x.c, np.int64)
                first, length = both[: len(value)], both[len(value) :]
                at = np.concatenate([[0], np.cumsum(count)])
                mine = k[a:z]
                each = np.repeat(at[mine] - np.concatenate([[0], np.cumsum(count[mine])[:-1]]), count[mine]) + np.arange(count[mine].sum())
                use = np.repeat(np.arange(a, z), count[mine])
                hit = value[each] < doc[use]
                begin = lo[use[hit]] + first[each[hit]]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length[each[hit]] - 1 + MIN_BYTES, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        data = np.frombuffer(own.data, np.uint8)
        out = []
        for i, (at, end) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
            off = gone[at:end]
            n = int(off.sum())
            kept = data[at:end] if not n else data[at:end][~off]
            spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if n else 0
            none = i >= len(own.did)
            out.append((0 if none else int(own.did[i]), none, end - at, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["did", "none", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    in_blocks = blocks.groupBy("gid")
    kinds = "p int, gid long, kind int, a binary, b binary, c binary"
    pieces = materialize(in_blocks.cogroup(answers.groupBy("gid")).applyInPandas(cut, kinds), "pieces")
    remove_table(answers)
    told = pieces.where("kind = 0").groupBy("p").applyInPandas(judge, kinds).unionByName(pieces.where("kind = 1"))
    out = in_blocks.cogroup(told.groupBy("gid")).applyInPandas(strip, "did long, none boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(~F.col("none"), F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
