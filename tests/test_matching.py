"""Greedy matching, suppression, event folding, settings and matrices against loops."""

import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ethospark.operators import dense as D, intervals as I, labels as L, ranking as R


def iou(a, b):
    n = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
    return n / (a[1] - a[0] + b[1] - b[0] + 2 - n)


def loop_match(pred, true, threshold):
    free, tp = list(true), 0
    for p in pred:
        best = max((iou(p, t), t) for t in free) if free else (0, None)
        if best[1] is not None and best[0] >= threshold:
            free.remove(best[1])
            tp += 1
    return tp, len(pred) - tp, len(free)


def test_greedy_match_equals_loop(spark):
    rng = random.Random(3)
    pred, true, want = [], [], {}
    for s in range(60):
        n = 300 if s % 2 else 60
        p = sorted({(a, a + rng.randint(0, 20)) for a in rng.sample(range(n), rng.randint(0, 12))})
        t = sorted({(a, a + rng.randint(0, 20)) for a in rng.sample(range(n), rng.randint(0, 12))})
        given = p[:]
        rng.shuffle(given)
        pred += [(s, "k", a, z, i) for i, (a, z) in enumerate(given)]
        true += [(s, "k", a, z) for a, z in t]
        if p or t:
            want[s] = loop_match(given, t, 0.2)
    df = spark.createDataFrame(pred, "s long, g string, start_frame long, end_frame long, place long")
    got = I.greedy_match(df, spark.createDataFrame(true, "s long, g string, r_start long, r_end long"), ["s", "g"], 0.2, "place")
    assert {r.s: (r.tp, r.fp, r.fn) for r in got.collect()} == want


def test_suppression_equals_loop(spark):
    rng = random.Random(4)
    rows = [(s, a, a + rng.randint(1, 15), rng.choice([0.1, 0.5, 0.9]), rng.random()) for s in range(30) for a in rng.sample(range(150 if s % 3 else 40), 25)]
    want = set()
    for s in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], -r[4], r[1], r[2])):
            if all(r[2] <= k[1] or r[1] >= k[2] for k in kept):
                kept.append(r)
        want |= set(kept)
    df = spark.createDataFrame(rows, "s long, start_frame long, end_frame long, prob double, unsure double")
    assert {tuple(r) for r in I.suppress_overlaps(df, ["s"], ["prob", "unsure"]).collect()} == want


def test_late_events_equal_loop(spark):
    rng = random.Random(5)
    rows = [(s, k, float(a), a + rng.random() * 6) for s in range(20) for k, a in enumerate(sorted(rng.sample(range(60), 20)))]
    want = set()
    for s in range(20):
        last = float("-inf")
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3])):
            if r[2] >= last - 1:
                want.add(r)
                last = r[3]
    assert {tuple(r) for r in I.drop_late_events(spark.createDataFrame(rows, "s long, k long, start_s double, end_s double"), ["s"], 1.0).collect()} == want


def runs(values):
    out, at = [], None
    for i, v in enumerate([*values, 0]):
        if v and at is None:
            at = i
        if not v and at is not None:
            out.append((at, i - 1))
            at = None
    return out


def fill(values, gap):
    values = list(values)
    marks = runs(values)
    for (_, z), (a, _) in zip(marks, marks[1:]):
        if a - z - 1 <= gap:
            values[z + 1 : a] = [1] * (a - z - 1)
    return values


def test_suggested_settings_equal_loop(spark):
    rng = random.Random(6)
    rows, sessions = [], {}
    for s in range(6):
        p, y = [rng.random() for _ in range(120)], [int(rng.random() < 0.4) for _ in range(120)]
        sessions[s] = (p, y)
        rows += [(s, i, p[i], y[i]) for i in range(120)]
    got = {(r.onset, r.min_bout, r.gap): (r.tp, r.fp, r.fn, r["rank"]) for r in D.suggest_settings(spark.createDataFrame(rows, "s long, frame long, smooth double, y int"), ["s"], [0.5, 0.8], [1, 3], [0, 2]).collect()}
    want = {}
    for o in (0.5, 0.8):
        for m in (1, 3):
            for g in (0, 2):
                c = [0, 0, 0]
                for p, y in sessions.values():
                    pred = [(a, z) for a, z in runs(fill([int(v >= o) for v in p], g)) if z - a + 1 >= m]
                    c = [x + v for x, v in zip(c, loop_match(pred, runs(fill(y, g)), 0.2))]
                want[(o, m, g)] = tuple(c)
    assert {k: v[:3] for k, v in got.items()} == want

    def key(k):
        tp, fp, fn = want[k]
        pr, re = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        return -round(2 * pr * re / (pr + re) if pr + re else 0, 4), -round(re, 4), fp, -k[0], k[1], k[2]

    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][3])] == sorted(want, key=key)


def test_inhibition_matrix_and_overwriting(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.9), (1, 0, "b", 0.5), (1, 1, "a", 0.2), (1, 1, "b", 0.6)], "s long, chunk long, behavior string, raw double")
    got = {(r.chunk, r.behavior): (round(r.prob, 6), r.winner) for r in D.compete(df, ["s"], 0.0, 0, matrix={("a", "b"): 0.5, ("b", "a"): 2.0}).collect()}
    assert got == {(0, "a"): (0.65, "a"), (0, "b"): (0.0, "a"), (1, "a"): (0.0, "b"), (1, "b"): (0.2, "b")}
    seg = spark.createDataFrame([("s", 0, 0, 4, 0.2), ("s", 0, 3, 6, 0.8), ("s", 0, 9, 10, 0.4)], "s string, island long, start_frame long, end_frame long, p double")
    trace = [r.smooth for r in D.refined_trace(seg, ["s"], "p", 1).orderBy("frame").collect()]
    assert [round(v, 6) for v in trace] == [0.2, 0.2, 0.2, 0.8, 0.8, 0.8, 0.8, round(0.8 - 0.4 / 3, 6), round(0.8 - 0.8 / 3, 6), 0.4, 0.4]


def test_remap_does_not_depend_on_the_order_of_rows(spark):
    segments = spark.createDataFrame([(f"s{k}_{i}", k, i * 4, i * 4 + 15) for k in range(5) for i in range(12)], "segment string, k long, start_frame long, end_frame long")
    rows = [(f"c{k}_{i}", k, i * 7, i * 7 + 20) for k in range(5) for i in range(9)] + [("c0_0", 0, 0, 20), ("far", 0, 900, 920), ("far", 0, 900, 920), ("s1_2", 1, 8, 23)]
    # Rows that come in another order each time they are read, as they may from a shuffle.
    labels = spark.createDataFrame(rows, "id string, k long, start_frame long, end_frame long").coalesce(1).mapInPandas(lambda bs: (b.sample(frac=1) for b in bs), "id string, k long, start_frame long, end_frame long")
    want = []
    for name, k, a, z in rows:
        meet = [((s != a, e != a + 15), max(s, a) - min(e, a + 15) - 1, abs((s + e) // 2 - (2 * a + 15) // 2), s, i) for i in range(12) for s, e in [(i * 4, i * 4 + 15)] if s <= a + 15 and e >= a]
        meet = [((any(m[0]), *m[1:4]), f"s{k}_{m[4]}") for m in meet]
        want.append((name, name if name in ("far", "s1_2") else min(meet)[1]))
    got = L.remap(labels, segments, ["k"], "segment").collect()
    assert sorted((r.id, r.segment) for r in got) == sorted(want)


def test_nearest_points_equal_brute_force_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    some = np.vstack([rng.gamma(2, 20, (250, 3)).round(1), [[0.0, 0.0, 0.0]] * 200])
    x = np.vstack([rng.gamma(2, 20, (300, 3)).round(1), some[:20]])
    ref = spark.createDataFrame([(*map(float, r),) for r in some] + [(None, 1.0, 1.0), (math.nan, 0.0, 0.0)], "a double, b double, c double")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 0.0, 0.0)], "id long, a double, b double, c double")
    got = {r.id: r.distance for r in R.min_distance(df, "id", ["a", "b", "c"], ref).collect()}
    want = np.sqrt(sum((x[:, None, c] - some[None, :, c]) ** 2 for c in range(3))).min(1)
    assert [got[i] for i in range(len(x))] == want.tolist() and got[-1] is None
    assert R.min_distance(df, "id", ["a", "b", "c"], ref.limit(0)).where("distance is not null").count() == 0
    # 12 thousand million pairs: a comparison of all takes minutes.
    grid = lambda n, k: spark.range(n).select("id", *(((F.col("id") * k) % m).cast("double").alias(c) for c, m in zip("abc", (9973, 9967, 9949))))
    t = time.time()
    assert R.min_distance(grid(60_000, 17), "id", ["a", "b", "c"], grid(200_000, 31)).agg(F.count("distance")).first()[0] == 60_000
    assert time.time() - t < 40


def test_nearest_points_are_searched_for_many_batches_at_once(monkeypatch):
    monkeypatch.setattr(R, "SEARCHED", 2500)
    rng = np.random.default_rng(3)
    some, x = rng.random((3000, 3)), rng.random((6001, 3)) * 1.5 - 0.2
    x[17, 1] = np.nan
    batches = [tuple(map(pd.Series, x[i : i + 1000].T)) for i in range(0, len(x), 1000)]
    got = list(R._nearest_one(some).func(iter(batches)))
    want = np.sqrt(sum((x[:, None, c] - some[None, :, c]) ** 2 for c in range(3))).min(1)
    assert [len(g) for g in got] == [3000, 3000, 1] and np.array_equal(np.concatenate(got), want, equal_nan=True)


def test_ranked_segments_are_worked_out_once(spark, tmp_path):
    from ethospark.plans import ranking as P

    rng = random.Random(11)
    rows = [(i, i % 7, rng.choice(["view", "click", "purchase", "signup"]), round(rng.expovariate(1 / 50), 2), i // 3) for i in range(700)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").selectExpr("event_id", "timestamp_seconds(s) as ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    out = P.ranked_segments(spark, str(tmp_path))
    # What is left reads the segments and their distances, and no longer the table.
    assert not any("events.parquet" in f for f in out.inputFiles())
    frames = {u: [r for r in rows if r[1] == u] for u in range(7)}
    point = {}
    for u, f in frames.items():
        for w in range((len(f) - 16) // 4 + 1):
            v = [r[3] for r in f[w * 4 : w * 4 + 16]]
            types = [r[2] for r in f[w * 4 : w * 4 + 16]]
            point[f"seg_{u}_{w * 4}_{w * 4 + 15}"] = (w, sum(min(x / 100, 1) for x in v) / 16, float(np.mean(v)), float(np.std(v)), max(v), max(types.count(k) for k in ("view", "click", "signup")) / 16)
    near = {i: min(math.dist(p[2:5], q[2:5]) for q in point.values() if q[0] % 5 == 0) for i, p in point.items()}
    lo, hi = min(near.values()), max(near.values())
    got = {r.id: r for r in out.collect()}
    assert got.keys() == point.keys()
    for i, (w, p, *_, other) in point.items():
        u = int(i.split("_")[1])
        signs = [(1, -1, 0, 0)[u % 4]] + [1] * (u % 3 == 0) if w % 5 == 0 else [0]
        fb, eu = sum(signs) / len(signs), 1 - abs(p - other)
        rejected = sum(v % 4 == 1 and q[0] % 5 == 0 for v, q in ((int(k.split("_")[1]), q) for k, q in point.items()))
        hard = (p if u % 4 == 1 and w % 5 == 0 else max(0, -fb)) if rejected >= 8 else 0
        bau = max(1 - abs(2 * p - 1), min(1, eu + 0.05))
        want = (0.35 * p + 0.2 * bau + 0.15 * eu + 0.1 * (near[i] - lo) / (hi - lo + 1e-9) + 0.1 * eu + 0.07 * hard) / 0.97
        assert abs(got[i].priority - want) < 1e-9 and abs(got[i].rank_prototype - (p + 0.1 * fb + 0.2 * eu + (0.3 if p > 0.6 and fb < 0 else 0))) < 1e-9
