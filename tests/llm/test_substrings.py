import hashlib
import random

import numpy as np

from ethospark.llm import substrings as s


def test_two_stage_equals_sorting():
    rng = random.Random(1)
    for n, letters in [(0, 2), (1, 2), (50, 1), (300, 2), (2000, 3), (3000, 40)]:
        text = np.array([97 + rng.randrange(letters) for _ in range(n)], np.uint8)
        raw = text.tobytes()
        cut = [raw[i : i + s.DEPTH] for i in s.two_stage(text)]
        assert sorted(s.two_stage(text).tolist()) == list(range(n))
        assert cut == sorted(cut)


def brute(rows):
    out = []
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - s.MIN_BYTES + 1):
                w = t[i : i + s.MIN_BYTES]
                first[w] = min(first.get(w, d), d)
    for d, t in texts:
        off = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - s.MIN_BYTES + 1):
                if first[t[i : i + s.MIN_BYTES]] < d:
                    off[i : i + s.MIN_BYTES] = b"\1" * s.MIN_BYTES
        kept = bytes(c for c, x in zip(t, off) if not x)
        spans = sum(x and not (i and off[i - 1]) for i, x in enumerate(off))
        out.append((d, len(t), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 60))]
        if rng.random() < 0.6:
            parts += [rng.choice(shared), prose(rng.randint(0, 10))]
        if rng.random() < 0.1:
            parts += ["x" * rng.randint(40, 400)]
        rows.append((rng.choice([i, i, i, max(0, i - 1)]), " ".join(parts)))
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (n + 2, rows[0][1]), (n + 3, None), (n + 4, ""), (None, rows[0][1]), (None, None), (n + 5, "a" * 49), (n + 6, "a" * 50), (n + 7, "a" * 51)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    for seed, block in [(1, 1 << 20), (2, 3000)]:
        monkeypatch.setattr(s, "BLOCK_BYTES", block)
        monkeypatch.setattr(s, "HASH_BUCKET_BYTES", block)
        monkeypatch.setattr(s, "BUCKET_BYTES", block)
        rows = sample(seed, 120)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, did int")
        got = sorted((tuple(r) for r in s.remove_repeats(df).collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
