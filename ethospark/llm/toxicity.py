"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's logit is a bias plus the sum of its words' weights; a word's weight is the sum of hashed weights of the word and
its prefixes of four to six characters, so unseen forms of a seen stem still count. A document's score is the noisy-or of its sentences,
1 - prod(1 - p). Weights are fitted to document labels by the noisy-or likelihood; the sentence scores then locate what made a document toxic.

Training reads a bounded sample: of the SAMPLE documents of either label that come first by a hash of their id, the first whose texts have
SAMPLE_CHARS characters together at most. One task of an executor fits
them, and a lost executor's task is run again; the driver gets the weights alone. Everything else covers all rows: each whole text is scored,
a sentence at a time, on the executors with the weights as a constant of fixed size (2 ** BITS floats).

Defined cases: null and empty texts have one empty sentence; null doc_id is scored (held_out null); labels that are null or of null doc_id
teach nothing and of repeated labels the largest counts; repeated rows are scored each and teach once, by their least text; a very long text is
scored whole, sentence by sentence; without labels of both kinds every score is 0; an empty table gives no rows; other columns are ignored,
and kept by `score` whatever their names, unless they start with two underscores.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from math import exp, expm1, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import first_by

BITS = 18
SAMPLE, SAMPLE_CHARS = 4000, 16_000_000
STEPS = 300
RATE = 0.2
DECAY = 1e-6
#: A hashed feature is used if so many documents of the sample have it.
MIN_DOCS = 20
THRESHOLD = 0.7
SPAN_FROM = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
CACHE_WORDS = 400_000


def slots(word: str) -> list[int]:
    """Hashed features of a word."""
    marked = f"<{word}>"
    grams = [marked, *(marked[:k] for k in (5, 6, 7) if k < len(marked))]
    return [zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in grams]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence; one empty sentence where there is none."""
    return [m.span() for m in SENTENCE.finditer(text or "")] or [(0, 0)]


def fit(texts: list[str | None], toxic: list[int], prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias). prior: the share of toxic documents the model is for; the sample's own share may differ."""
    vocab: dict[str, int] = {}
    each: list[list[int]] = []
    counts = np.zeros(1 << BITS, np.int64)
    word_at, sent_at, doc_at = array("i"), array("i"), array("i")
    n_sent = 0
    for d, text in enumerate(texts):
        lower, seen = (text or "").lower(), set()
        for a, b in sentences(lower):
            found = {vocab.setdefault(w, len(vocab)) for w in WORD.findall(lower, a, b)}
            word_at.extend(found)
            sent_at.extend(array("i", [n_sent]) * len(found))
            doc_at.append(d)
            seen |= found
            n_sent += 1
        each += map(slots, islice(vocab, len(each), None))
        counts[list({s for w in seen for s in each[w]})] += 1
    word_of = np.repeat(np.arange(len(vocab)), [len(x) for x in each])
    used, slot = np.unique(np.array([s for x in each for s in x], np.int64), return_inverse=True)
    docs_of = counts[used]
    del each, counts
    y, n = np.array(toxic, float), len(texts)
    # Views of the lists: places are kept as 32-bit numbers until those of unused words are gone.
    word_at, sent_at, doc_at = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word_at, sent_at, doc_at))
    doc_at = doc_at.astype(np.int64)
    kept = docs_of >= MIN_DOCS
    word_of, slot = word_of[kept[slot]], slot[kept[slot]]
    told = np.zeros(len(vocab), bool)
    told[word_of] = True
    on = told[word_at]
    word_at, sent_at = word_at[on].astype(np.int64), sent_at[on].astype(np.int64)
    del on
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) / n
    w, bias = np.zeros(len(used)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        by_word = np.bincount(word_of, w[slot], len(vocab))
        z = bias + np.bincount(sent_at, by_word[word_at], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_at, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight
        g_sent = pull[doc_at] * p
        g_word = np.bincount(word_at, g_sent[sent_at], len(vocab))
        g, gb = np.bincount(slot, g_word[word_of], len(used)) + DECAY * w, g_sent.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = RATE / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return full, float(bias)


class Scorer:
    """Scores texts; keeps the weights of words seen, up to CACHE_WORDS."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights.tolist(), bias, {}

    def word(self, w: str) -> float:
        x = self.known.get(w)
        if x is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            x = self.known[w] = sum(map(self.weights.__getitem__, slots(w)))
        return x

    def parts(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence."""
        lower = (text or "").lower()
        if len(lower) != len(text or ""):  # a few letters have longer lower forms, which would shift spans
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for a, b in sentences(lower):
            z = self.bias + sum(map(self.word, set(WORD.findall(lower, a, b))))
            out.append((a, b, 1 / (1 + exp(-min(max(z, -30.0), 30.0)))))
        return out


def noisy_or(scores: list[float]) -> float:
    return -expm1(sum(log1p(-min(p, 1 - 1e-12)) for p in scores))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame | None, float]:
    """The sample's (doc_id, text, y), or None where labels of one kind lack, and the share of toxic documents among all that may teach."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    may = labels.where("doc_id is not null and toxic is not null").where(fold != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in may.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if set(counts) != {0, 1}:
        return None, 0.0
    chosen = None
    for kind in (0, 1):
        h = F.xxhash64("doc_id", F.lit(4))
        some = may.where((F.col("toxic") > 0) == bool(kind)).where(first_by(h, sample, counts[kind])).select("doc_id", F.lit(kind).alias("y")).orderBy(h, "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    # At most 2 * sample ids are broadcast; repeated rows of a document teach once.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # The window is over at most sample rows of each label.
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id"))
    rows = rows.withColumn("__upto", upto).where(F.col("__upto") <= SAMPLE_CHARS).drop("__upto")
    return rows, counts[1] / sum(counts.values())


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    rows, prior = training_rows(docs, labels)
    nothing = np.zeros(1 << BITS, np.float32), -30.0
    if rows is None:
        return nothing

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        texts, y = [t if isinstance(t, str) else None for t in sample["text"]], sample["y"].tolist()
        weights, bias = fit(texts, y, prior) if len(set(y)) == 2 else nothing
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    # One group of at most 2 * SAMPLE documents.
    model = rows.groupBy().applyInPandas(run, "weights binary, bias double").first()
    return (np.frombuffer(model["weights"], np.float32), model["bias"]) if model else nothing


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with toxicity (double) and spans: (start, end, score) of sentences of at least SPAN_FROM. Offsets count code points."""
    weights, bias = model
    out = "toxicity double, spans array<struct<start: int, end: int, score: double>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights, bias)
        for texts in batches:
            rows = []
            for t in texts:
                parts = scorer.parts(t)
                rows.append((noisy_or([p for *_, p in parts]), [{"start": a, "end": b, "score": float(p)} for a, b, p in parts if p >= SPAN_FROM]))
            yield pd.DataFrame(rows, columns=["toxicity", "spans"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, out)(F.col("text"))
    return docs.withColumn("__tox", found).withColumns({"__toxicity": F.col("__tox.toxicity"), "__spans": F.col("__tox.spans")}).drop("__tox")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row of docs."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", (fold == 1).alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.col("__spans").alias("spans"))
