"""Benchmark decontamination: shared word n-grams pair documents with test items; Smith-Waterman scores edited copies.

Every document is looked up for every n-gram of SEED words of the items, however common, and each document and item that share one are aligned
around it, word by word (match +2, mismatch and gap -1); the score is the best local alignment's share of the item's own, and THRESHOLD of it
makes a leak. No pair is left out for how often its n-grams occur: a frequency counted over the leaks themselves says nothing about an edited
copy. Windows of a batch are scored together, item by item; windows that hold too few of an item's words to reach THRESHOLD are not.

Items are taken in blocks of about BLOCK_CHARS characters, each block against all documents, so the constant that a task holds is bounded.
Documents are not shuffled. Equal texts are looked up and aligned once a batch.

Defined cases: null and empty texts hold nothing; items of fewer than SEED words are looked for as a whole; null item texts are skipped; null
doc_id is kept; repeated rows of a document give one; a very long text is searched whole, and only windows around shared n-grams are aligned;
of equally good windows the first counts; an empty table on either side gives no rows; other columns are ignored, and kept by `clean` whatever
their names, unless they start with two underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, materialize

SEED = 3
THRESHOLD = 0.5
BLOCK_CHARS = 4 << 20
#: So many words of windows are scored at once.
CELLS = 1 << 19
WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(item: list[str]) -> list[tuple[str, ...]]:
    """The item's n-grams in order; a shorter item is one gram."""
    return [tuple(item[k : k + SEED]) for k in range(max(1, len(item) - SEED + 1))] if item else []


def _rows(doc: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local score and the places (in doc, in item) at which it ends; ties go to the earliest."""
    slope = GAP * np.arange(1, len(doc) + 1)
    last = np.zeros(len(doc) + 1)
    best, at, row = 0.0, 0, 0
    for k, w in enumerate(item):
        now = np.maximum(np.maximum(last[:-1] + np.where(doc == w, MATCH, MISMATCH), last[1:] - GAP), 0.0)
        now = np.maximum(now, np.maximum.accumulate(now + slope) - slope)
        j = int(now.argmax())
        if now[j] > best:
            best, at, row = float(now[j]), j + 1, k + 1
        last = np.concatenate([[0.0], now])
    return best, at, row


def align(doc: list[str], item: list[str]) -> tuple[float, int, int]:
    """(score as a share of the item's own, first word, end word) of the best local alignment."""
    if not doc or not item:
        return 0.0, 0, 0
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    d, x = np.array([ids.get(w, -1) for w in doc]), np.array([ids[w] for w in item])
    score, end, row = _rows(d, x)
    if not score:
        return 0.0, 0, 0
    _, back, _ = _rows(d[:end][::-1], x[:row][::-1])
    return score / (MATCH * len(item)), end - back, end


def _blocks(benchmark: DataFrame) -> Iterator[dict[int, list[str]]]:
    rows = materialize(benchmark.where("item_id is not null and text is not null").select("item_id", "text"), "items")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        block = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect():
            if found := words(r["text"]):
                block.setdefault(r["item_id"], []).append(found)
        yield block


def _keys(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """One number for each n successive ids. Should it overflow, equal n-grams stay equal."""
    keys = np.zeros(max(0, len(ids) - n + 1), np.int64)
    for k in range(n if len(keys) else 0):
        keys = keys * base + ids[k : k + len(keys)]
    return keys


class _Lookup:
    """The items of a block as numbers of their words, and in `grams`, by length, the n-grams in order with the items that have each."""

    def __init__(self, block: dict[int, list[list[str]]]) -> None:
        self.items = [(i, item) for i, some in block.items() for item in some]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, item in self.items for w in item), 1)}
        self.ids = [self.code(item) for _, item in self.items]
        found: dict[int, list] = {}
        for k, x in enumerate(self.ids):
            n = min(SEED, len(x))
            own = np.unique(_keys(x, n, len(self.vocabulary) + 1))
            found.setdefault(n, []).append((own, np.full(len(own), k, np.int32)))
        self.grams = {}
        for n, some in found.items():
            keys, of = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(keys, kind="stable")
            names, start = np.unique(keys[order], return_index=True)
            self.grams[n] = names, np.append(start, len(keys)), of[order]

    def code(self, text: list[str]) -> np.ndarray:
        """Numbers of words; 0 is a word that no item has."""
        return np.fromiter((self.vocabulary.get(w, 0) for w in text), np.int32, len(text))

    def places(self, doc: np.ndarray) -> dict[int, list[int]]:
        """Where doc has an n-gram of an item, in order, by the item's place in items."""
        out: dict[int, list[int]] = {}
        for n, (names, start, of) in self.grams.items():
            keys = _keys(doc, n, len(self.vocabulary) + 1)
            gram = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            for at in np.flatnonzero(names[gram] == keys).tolist():
                g = gram[at]
                for k in of[start[g] : start[g + 1]].tolist():
                    out.setdefault(k, []).append(at)
        return out


def _spans(places: list[int], length: int) -> list[tuple[int, int]]:
    """Windows of an item's length and a half on both sides of places, merged where they meet."""
    reach, out = length + length // 2 + SEED, []
    for p in places:
        a, b = max(0, p - reach), p + reach
        if out and p - reach <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _scores(windows: list[np.ndarray], item: np.ndarray) -> np.ndarray:
    """The score of item in each window, as align gives it; 0 where a window has too few of item's words for THRESHOLD."""
    out, order = np.zeros(len(windows)), sorted(range(len(windows)), key=lambda k: len(windows[k]))
    while order:
        widest = len(windows[order[-1]])
        part, order = order[-max(1, CELLS // widest) :], order[: -max(1, CELLS // widest)]
        doc = np.full((len(part), widest), -1, np.int32)
        for r, k in enumerate(part):
            doc[r, : len(windows[k])] = windows[k]
        held = np.zeros(len(part), np.int32)
        for w, n in zip(*np.unique(item, return_counts=True), strict=True):
            held += (doc == w).any(1) * np.int32(n)
        open_ = np.flatnonzero(held / len(item) >= THRESHOLD)
        if not len(open_):
            continue
        doc = doc[open_]
        slope = (GAP * np.arange(1, widest + 1)).astype(np.float32)
        last, best = np.zeros((len(doc), widest + 1), np.float32), np.zeros(len(doc), np.float32)
        for w in item:
            now = last[:, :-1] + np.where(doc == w, np.float32(MATCH), np.float32(MISMATCH))
            np.maximum(now, last[:, 1:] - np.float32(GAP), out=now)
            np.maximum(now, 0, out=now)
            now += slope
            np.maximum.accumulate(now, axis=1, out=now)
            now -= slope
            np.maximum(best, now.max(1), out=best)
            last[:, 1:] = now
        out[np.array(part)[open_]] = best.astype(float) / (MATCH * len(item))
    return out


def _aligned(texts: dict[int, str], lookup: _Lookup) -> dict[int, list[tuple]]:
    """By text hash (item_id, score, first word, end word) of each item that aligns; texts is by hash too."""
    docs, windows = {}, {}
    for th, text in texts.items():
        w = words(text)
        ids = lookup.code(w)
        places = lookup.places(ids)
        if places:
            docs[th] = w
        for k, at in places.items():
            windows.setdefault(k, []).extend((th, a, ids[a:b]) for a, b in _spans(at, len(lookup.ids[k])))
    out: dict[int, list[tuple]] = {}
    for k, some in windows.items():
        i, item = lookup.items[k]
        best: dict[int, tuple] = {}
        for (th, a, ids), score in zip(some, _scores([x for _, _, x in some], lookup.ids[k]), strict=True):
            if score >= THRESHOLD and score > best.get(th, (0.0,))[0]:
                s, start, end = align(docs[th][a : a + len(ids)], item)
                best[th] = s, a + start, a + end
        for th, x in best.items():
            out.setdefault(th, []).append((i, *x))
    return out


def _digest() -> F.Column:
    """What tells texts apart: 128 bits, so that among 10 ** 10 texts no innocent one is expected to share a leak's."""
    return F.md5(F.col("text").cast("binary"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, score, first_word, end_word) of each document and item that align at THRESHOLD or more."""
    out = None
    for block in _blocks(benchmark):
        if not block:
            continue

        def run(batches: Iterator[pd.DataFrame], lookup=_Lookup(block)) -> Iterator[pd.DataFrame]:
            for b in batches:
                known = _aligned(dict(zip(b.th, b.text, strict=True)), lookup)
                rows = [(doc_id, th, *x) for doc_id, th in zip(b.doc_id, b.th, strict=True) for x in known.get(th, ())]
                yield pd.DataFrame(rows, columns=["doc_id", "th", "item_id", "score", "first_word", "end_word"])

        rows = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), _digest().alias("th"), "text")
        rows = rows.mapInPandas(run, "doc_id string, th string, item_id long, score double, first_word int, end_word int")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, th string, item_id long, score double, first_word int, end_word int")
    # Two texts of one item_id may both align.
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("score", "first_word", "end_word")).alias("x")).select("doc_id", "th", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item; columns as they were."""
    bad = materialize(leaks(docs, benchmark).select(F.col("th").alias("__th")).distinct(), "leaking")
    return docs.withColumn("__th", _digest()).join(broadcast_if_small(bad), "__th", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
