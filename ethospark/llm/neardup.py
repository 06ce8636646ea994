"""Near-duplicate classes by ProbMinHash: weighted word shingles, banding, exact verification, connected components.

A text's shingles of SHINGLE words weigh 1 + ln(count). Each is a Poisson process whose rate is its weight and whose arrivals, drawn from a
hash of the shingle, each hit one of REGISTERS registers; a register keeps the shingle that reaches it first. Two texts agree in a register
with their probability Jaccard J_P. Processes run to a time by which the registers are likely full and are stopped there; texts with an
empty register go on to a later time, so results are those of running for ever.

BANDS bands of ROWS registers make buckets. Pairs of a bucket are verified exactly (J_P or plain Jaccard of the shingle sets at least
THRESHOLD), but not all of them: STAR_ROUNDS rounds test each text against one bucket leader (in turn the one with most company and one drawn anew) and join what agrees into
components; then every pair of a bucket that still lies in two components is tested. Pairs within a component can change nothing, so the
components are those of testing all pairs. Equal texts meet by digest first and are one node.

That last test names pairs only in buckets of up to PAIRS_UP_TO texts. The texts of a larger bucket are dealt into blocks of about BLOCK texts
and BLOCK_CHARS characters, and a task compares two blocks by matrix products, giving a spanning forest of what is similar and no other pair.

Defined cases: null text and null doc_id are in no class but their own (class_id = doc_id); texts without words match equal texts only; texts
of fewer than SHINGLE words are one shingle; rows with equal doc_id share a node; repeated rows give a row each; a very long text is taken
whole, one at a time; an empty table gives no rows; other columns are ignored, and kept by `representatives` whatever their names, unless they
start with two underscores. Without text a row is in no class and stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, components, join_salted, materialize

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
STAR_ROUNDS = 3
BATCH_SHINGLES = 400_000
#: Buckets of up to this many open texts are tested pair by pair, larger ones by blocks.
PAIRS_UP_TO = 16
#: A bucket's rows are spread over so many join keys where they meet what is known of the bucket.
SALTS = 32
#: Texts and characters of a block, by expectation, and columns of one matrix product.
BLOCK, BLOCK_CHARS, COLUMNS = 512, 8_000_000, 4096
WORD = re.compile(r"\w+")
_U = np.uint64
#: Odd 64-bit constants of the splitmix64 finalizer and of golden-ratio multiples.
_C1, _C2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word; cleared when large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def shingles(text: str | None, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, weights)."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, _U), np.empty(0)
    h = np.fromiter(map(known.__getitem__, found), _U, len(found))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, _U)
    for k in range(min(SHINGLE, len(h))):
        s = mix(s * _GOLD + h[k : k + n])
    s, count = np.unique(s, return_counts=True)
    return s, 1.0 + np.log(count)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over all e of max(a(e)/a(d), b(e)/b(d)), by sorting on the ratio of weights."""
    ids, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.bincount(at[: len(a[0])], a[1], len(ids)), np.bincount(at[len(a[0]) :], b[1], len(ids))
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    above = np.cumsum(x[::-1])[::-1]
    below = np.cumsum(y) - y
    return float((1.0 / (above[both] / x[both] + below[both] / y[both])).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of J_P and the plain Jaccard of the sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return max(common / (len(a[0]) + len(b[0]) - common), probability_jaccard(a, b))


def similar(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(n, n) bool: similarity() of at least THRESHOLD. Jaccard is exact from products of incidence columns.

    J_P is at most (A - s) / (T - s): A the weights of both texts on common shingles, T all their weights, s the number of common shingles
    (no weight is below 1). That is Jaccard itself where nothing repeats. Only pairs that this bound leaves open are summed one by one.
    """
    n, size = len(sets), np.array([len(s) for s, _ in sets], np.float64)
    doc = np.repeat(np.arange(n), size.astype(np.int64))
    ids, col, seen = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in sets])
    total = np.bincount(doc, weight, n)
    two = seen[col] > 1  # what one text alone holds is common to no pair
    doc, col, weight = doc[two], np.unique(col[two], return_inverse=True)[1], weight[two]
    order = np.argsort(col, kind="stable")
    doc, col, weight = doc[order], col[order], weight[order]
    common, held = np.zeros((n, n)), np.zeros((n, n))
    repeated = bool((weight != 1).any())
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        part = slice(*np.searchsorted(col, [at, at + COLUMNS]))
        there = np.zeros((n, COLUMNS), np.float32)
        there[doc[part], col[part] - at] = 1
        common += there @ there.T
        if repeated:
            heavy = np.zeros((n, COLUMNS), np.float32)
            heavy[doc[part], col[part] - at] = weight[part]
            held += heavy @ there.T
    common = np.rint(common)
    if not repeated:
        held = common
    out = common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-9
    bound = (held + held.T - common) / np.maximum(total[:, None] + total[None, :] - common, 1e-9)
    for i, j in zip(*np.nonzero(np.triu(~out & (bound >= THRESHOLD - 1e-5), 1)), strict=True):
        out[i, j] = out[j, i] = similarity(sets[i], sets[j]) >= THRESHOLD
    return out & (common > 0)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric bool matrix."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if free[root]:
            free[root], todo = False, [root]
            while todo:
                i = todo.pop()
                new = np.nonzero(linked[i] & free)[0]
                free[new] = False
                todo += new.tolist()
                out += [(i, j) for j in new.tolist()]
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(len(sets), REGISTERS) shingle hashes; sets must not be empty."""
    out = np.zeros((len(sets), REGISTERS), _U)
    todo, reach = np.arange(len(sets)), REGISTERS * (np.log(REGISTERS) + 2)
    while len(todo):
        s = np.concatenate([sets[k][0] for k in todo])
        w = np.concatenate([sets[k][1] for k in todo])
        doc = np.repeat(np.arange(len(todo)), [len(sets[k][0]) for k in todo])
        until = reach / np.bincount(doc, w)
        first = np.full(len(todo) * REGISTERS, np.inf)
        who = np.zeros(len(todo) * REGISTERS, _U)
        t = np.zeros(len(s))
        n = 0
        while len(s):
            n += 1
            x = mix(s + _U(2 * n * int(_GOLD) % 2**64))
            t = t - np.log(((x >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / w
            on = t <= until[doc]
            s, w, doc, t = s[on], w[on], doc[on], t[on]
            slot = doc * REGISTERS + (mix(s + _U((2 * n + 1) * int(_GOLD) % 2**64)) % _U(REGISTERS)).astype(np.int64)
            np.minimum.at(first, slot, t)
            new = first[slot] == t
            who[slot[new]] = s[new]
        full = np.isfinite(first).reshape(-1, REGISTERS).all(axis=1)
        out[todo[full]] = who.reshape(-1, REGISTERS)[full]
        todo, reach = todo[~full], reach * 1.6
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1).astype(_U) * _GOLD, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _GOLD + parts[:, :, k])
    return key.view(np.int64)


def _bands(docs: DataFrame) -> DataFrame:
    """(doc_id, md, keys) of documents with an id and a text; keys is empty for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            at = 0
            while at < len(b):
                sets, size, start = [], 0, at
                while at < len(b) and size < BATCH_SHINGLES:
                    sets.append(shingles(b.text.iat[at], known))
                    size += len(sets[-1][0])
                    at += 1
                keys = [np.empty(0, np.int64)] * len(sets)
                if some := [k for k, x in enumerate(sets) if len(x[0])]:
                    for k, row in zip(some, bands(signatures([sets[k] for k in some])), strict=True):
                        keys[k] = row
                yield pd.DataFrame({"doc_id": b.doc_id.to_numpy()[start:at], "md": b.md.to_numpy()[start:at], "keys": keys})

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md"), "text")
    return rows.mapInPandas(run, "doc_id long, md string, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            last, keep = (None, None), []
            for j, x, y in zip(b.b, b.text_a, b.text_b, strict=True):
                if last[0] != j:
                    last = (j, shingles(y, known))
                keep.append(similarity(shingles(x, known), last[1]) >= THRESHOLD)
            yield b.loc[keep, ["a", "b"]]

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInPandas(run, "a long, b long")


def _verified_blocks(open_: DataFrame, large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that span what is similar across components in the buckets `large` (key, n, chars) of open_(id, key, comp)."""

    def links(group: list[tuple[int, int, str]], known: _Words) -> list[tuple[int, int]]:
        ids, comp = [x[0] for x in group], np.array([x[1] for x in group])
        linked = similar([shingles(x[2], known) for x in group]) & (comp[:, None] != comp[None, :])
        return [(ids[i], ids[j]) for i, j in forest(linked)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, at, group = _Words(), None, []
        for b in batches:
            out = []
            for key, lo, hi, *row in zip(b.key, b.lo, b.hi, b.id, b.comp, b.text, strict=True):
                if (key, lo, hi) != at:
                    out += links(group, known) if len(group) > 1 else []
                    at, group = (key, lo, hi), []
                group.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if len(group) > 1:
            yield pd.DataFrame(links(group, known), columns=["a", "b"], dtype="int64")

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars_all") / BLOCK_CHARS)).cast("int")
    dealt = open_.join(large.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "key", "comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = dealt.join(texts.select("id", "text"), "id")
    near = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return near.mapInPandas(run, "a long, b long")


def _in_bucket(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Inner join of rows(id, key, ..) with keyed (one row a bucket), which no bucket's size makes uneven."""
    return join_salted(rows, keyed.withColumn("__on", F.lit(1)), "key", SALTS, F.col("id")).where("__on = 1").drop("__on")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of each row of docs."""
    rows = materialize(_bands(docs), "bands")
    nodes = materialize(rows.groupBy("md").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "nodes")
    # Rows of one doc_id with different texts are one document: link their nodes.
    same = rows.join(nodes.select("md", "id"), "md").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    many = rows.groupBy("doc_id").agg(F.min("md").alias("lo"), F.max("md").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("a"))
    same = same.join(many, "a")
    links = materialize(same.distinct(), "links")
    each = nodes.select("id", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(_in_bucket(each, shared), "members")
    # How much company a text has over all its buckets: what many were copied from has the most, and leads first.
    company = materialize(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
    members = materialize(members.drop("n").join(broadcast_if_small(company), "id"), "members")
    wanted = materialize(members.select("id").distinct(), "wanted")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text").join(broadcast_if_small(wanted), "id")
    texts = materialize(texts.groupBy("id").agg(F.min("text").alias("text")) if _repeats(rows) else texts, "texts")
    comp = None
    for n in range(STAR_ROUNDS + 1):
        open_ = members.withColumn("comp", F.col("id"))
        if comp is not None:
            open_ = members.join(comp, members["id"] == comp["node"], "left").select("id", "key", "company", F.coalesce("comp", "id").alias("comp"))
            split = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            open_ = materialize(_in_bucket(open_, split), "open")
        if n < STAR_ROUNDS:
            lead = open_.groupBy("key").agg(F.max_by(F.struct("id", "comp"), F.struct(F.lit(0) if n % 2 else F.col("company"), F.xxhash64("id", F.lit(n)))).alias("lead"))
            met = _in_bucket(open_, lead).where(F.col("comp") != F.col("lead.comp")).groupBy("id", F.col("lead.id").alias("to")).agg(F.count(F.lit(1)).alias("n"))
            pairs = met.groupBy("id").agg(F.max_by("to", F.struct("n", "to")).alias("to")).select(F.col("id").alias("a"), F.col("to").alias("b"))
        else:
            sizes = open_.join(texts.select("id", F.length("text").alias("chars")), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars_all"))
            sizes = materialize(sizes, "sizes")
            few = open_.join(sizes.where(F.col("n") <= PAIRS_UP_TO).select("key"), "key")
            left, right = few.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
            pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
            links = links.unionByName(materialize(_verified_blocks(open_, sizes.where(F.col("n") > PAIRS_UP_TO), texts), "links"))
        found = materialize(_verified(materialize(pairs, "pairs"), texts), "links")
        links = links.unionByName(found)
        comp = components(links)
    place = nodes.join(comp, nodes["id"] == comp["node"], "left").select("md", F.coalesce("comp", "id").alias("class_id"))
    known = rows.select("doc_id", "md").join(place, "md").select("doc_id", "class_id")
    rest = docs.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return known.unionByName(rest)


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the least doc_id; columns as they were. Rows without id or text stay."""
    there = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    bare, some = docs.where(~there), docs.where(there)
    found = materialize(classes(some.select("doc_id", "text")), "classes")
    away = materialize(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__away")).distinct(), "away")
    kept = some.join(broadcast_if_small(away), some["doc_id"] == F.col("__away"), "left_anti")
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "again")
    if not again.count():
        return kept.unionByName(bare)
    again = broadcast_if_small(again)
    # Of the rows of one doc_id the least by its text's digest, then by all columns, so reruns agree.
    first = Window.partitionBy("doc_id").orderBy(F.md5(F.col("text").cast("binary")), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    one = kept.join(again, kept["doc_id"] == F.col("__again"), "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.join(again, kept["doc_id"] == F.col("__again"), "left_anti").unionByName(one).unionByName(bare)
