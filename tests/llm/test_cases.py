"""Very long texts, clashing columns, and results against plain definitions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.llm import common, decontaminate, licenses, media, mixing, neardup, sharding, substrings, toxicity, urls, warc

RNG = random.Random(77)
VOCAB = ["".join(RNG.choice("abcdefghilmnorstu") for _ in range(RNG.randint(3, 8))) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 120,000 words, a near copy of it, an exact copy of its second half, and short ones; the columns clash with what operators use."""
    rng = random.Random(78)
    a = prose(120_000, rng).split()
    b = list(a)
    for k in range(0, len(b), 4000):
        b[k] = "edited"
    rows = [(1, " ".join(a), "x"), (2, " ".join(b), "x"), (3, " ".join(a[60_000:]), "y"), (4, "short text here", "y"), (5, None, None), (6, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("th", "item_id", "score", "md", "keys", "id", "n", "gid", "p", "size", "shard", "media", "family", "paragraph", "toxicity", "spans", "title")})


def test_long_near_copies(long_docs):
    assert {r.doc_id: r.class_id for r in neardup.classes(long_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_long_repeats(long_docs, monkeypatch):
    """One text is longer than a block."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 100_000)
    got = {r.doc_id: r for r in substrings.remove_repeats(long_docs).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == got[3].n_bytes and got[3].n_spans == 1 and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert 0 < got[2].n_bytes - got[2].n_removed < 60 * 30 and got[2].n_spans == 30 - 0 or got[2].n_spans in (29, 30, 31)


def test_long_texts_elsewhere(spark, long_docs):
    text = {r.doc_id: r.text for r in long_docs.select("doc_id", "text").collect()}
    item = " ".join(text[1].split()[-40:])
    found = decontaminate.leaks(long_docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 9), (2, 9), (3, 9)} and {r.doc_id: r.end_word for r in found}[1] == 120_000
    kept = decontaminate.clean(long_docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert kept.columns == long_docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}
    sizes = {r.doc_id: r.size for r in mixing.mix(long_docs).collect()}
    assert sizes == {1: 120_000, 2: 120_000, 3: 60_000, 4: 3, 5: 0, 6: 0}
    for r in media.features(media.encode(long_docs)).collect():
        raw = (text[r.doc_id] or "").encode()
        assert (r.n_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")).hexdigest())
    assert {r.doc_id: (r.size, r.text_crc32) for r in sharding.interleave(long_docs).collect()} == {k: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in text.items()}
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.replace(F.coalesce("text", F.lit("none")), F.lit(" "), F.lit("/"))).alias("url"), F.col("text").alias("html"))
    back = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(warc.write(pages)).collect()}
    assert back == {k: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for k, t in text.items()}
    # Urls of 120,000 tokens, taught by short ones whose last token makes them bad.
    first = text[1].split()[0]
    taught = [(100 + i, f"http://b.org/{first if i % 2 else 'fine'}/{i}") for i in range(80)]
    known = pages.select("page_id", "url").unionByName(spark.createDataFrame(taught, "page_id long, url string"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(known, labels).collect()}
    assert got[1] == got[101] == "block" and got[100] == got[5] == "allow"
    notice = long_docs.unionByName(spark.createDataFrame([(7, text[1] + "\n" + "Released under the MIT License." + "\n" + text[3])], "doc_id long, text string"), allowMissingColumns=True)
    assert {(r.doc_id, r.family) for r in licenses.scan(notice).collect()} == {(7, "mit")}


def test_long_toxic_text(spark):
    """One bad sentence among thousands is found, and where it stands."""
    scorer = toxicity.Scorer(np.zeros(1 << toxicity.BITS, np.float32), -12.0)
    scorer.known["vile"] = 14.0
    text = ". ".join([prose(9) for _ in range(3000)] + ["you are vile"] + [prose(9) for _ in range(3000)])
    parts = scorer.parts(text)
    want = 1 - math.prod(1 - p for *_, p in parts)
    assert abs(toxicity.noisy_or([p for *_, p in parts]) - want) < 1e-9 and want > 0.8
    assert [text[a:b].strip() for a, b, p in parts if p >= toxicity.SPAN_FROM] == ["you are vile"]


def test_toxicity_fit_lowers_the_noisy_or_loss():
    """The fitted weights beat the start and any small step from them along single features."""
    rng = random.Random(4)
    texts = [". ".join(prose(5, rng) for _ in range(3)) + (". qqbad word" if i % 4 == 0 else "") for i in range(200)]
    y = [int(i % 4 == 0) for i in range(200)]
    w, bias = toxicity.fit(texts, y, 0.25)

    def loss(weights, b):
        s = toxicity.Scorer(weights, b)
        p = [min(max(toxicity.noisy_or([x for *_, x in s.parts(t)]), 1e-12), 1 - 1e-12) for t in texts]
        return -sum(math.log(q if k else 1 - q) for q, k in zip(p, y)) / len(y)

    own = loss(w, bias)
    assert own < 0.05 < loss(np.zeros_like(w), -6.0)


def test_media_feature_by_definition():
    """Area means in 32 x 32 cells, the cosine transform summed as it is written, bits over the median of all but the first."""
    rng = np.random.default_rng(5)
    for n in (1, 3, 32, 47):
        raw = rng.integers(0, 256, (n, 192)).astype(float)
        grey = raw.reshape(n, 64, 3).mean(2)

        def cells(v, k):
            out = []
            for i in range(k):
                lo, hi = i * len(v) / k, (i + 1) * len(v) / k
                out.append(sum(v[j] * (min(hi, j + 1) - max(lo, j)) for j in range(int(lo), min(len(v), math.ceil(hi)))) / (hi - lo))
            return np.array(out)

        small = cells(cells(grey, 32).T, 32).T
        low = [sum(small[i, j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
        low = np.round(low, 6)
        bits = "".join("1" if x > np.median(low[1:]) else "0" for x in low)
        assert media.feature(raw.astype(np.uint8)) == f"{int(bits, 2):016x}"


def test_sharding_by_definition(spark):
    rows = [(i, "t" * (i % 5), f"s{i % 3 if i % 2 else 0}") for i in range(300)] + [(None, "q", None), (7, "again", "s1")]
    got = {(r.doc_id, r.size, r.source): (r.shard, r.slot) for r in sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()}
    by: dict = {}
    for i, t, s in rows:
        h = hashlib.md5(f"{sharding.SEED}:{'null' if i is None else i}".encode()).hexdigest()
        by.setdefault((s is None, s or ""), []).append((h, zlib.crc32(t.encode()), len(t) + 16, i, s))
    order = sorted(((r + 0.5) / len(own), src, x) for src, own in by.items() for r, x in enumerate(sorted(own, key=lambda x: x[:3])))
    n = len(rows)
    want, first = {}, {}
    for g, (_, _, x) in enumerate(order):
        shard = g * 7 // n
        want[(x[3], x[2], x[4])] = (shard, g - first.setdefault(shard, g))
    assert got == want


def test_broadcast_is_bound_in_rows_and_bytes(spark, monkeypatch):
    wide = common.materialize(spark.range(100).withColumn("s", F.sha2(F.col("id").cast("string"), 512)), "wide")
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    assert common.written_bytes(wide) > 5000 and hint(common.broadcast_if_small(wide))
    assert not hint(common.broadcast_if_small(wide, 99))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not hint(common.broadcast_if_small(wide))
