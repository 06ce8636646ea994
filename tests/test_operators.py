"""Small literal frames and loops against the operators."""

import math
import random

from pyspark.sql import functions as F

from ethospark.functions import geometry as G
from ethospark.operators import intervals as I, metrics as M, motifs as T, windows as W


def test_merge_intervals(spark):
    df = spark.createDataFrame([("a", 10, 20), ("a", 23, 35), ("a", 60, 61), ("b", 0, 9), ("b", 2, 5), ("b", 12, 12)], "s string, start_frame int, end_frame int")
    assert sorted(map(tuple, I.merge_intervals(df, ["s"], 3, 10).collect())) == [("a", 10, 35), ("b", 0, 12)]


def test_merge_intervals_that_tie_equals_loop(spark):
    rng = random.Random(8)
    rows = [(u, *sorted((a, a + rng.randrange(-4, 5)))) for u in range(200) for a in rng.sample(range(100), 20)]
    rows += rng.choices(rows, k=400)
    want = []
    for u, s, e in sorted(rows):
        if want and want[-1][0] == u and s <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([u, s, e])
    df = spark.createDataFrame(rows, "u int, start_frame int, end_frame int").repartition(7)
    assert sorted(map(list, I.merge_intervals(df, ["u"], 1, 1).collect())) == want


def loop_bouts(p, threshold, gap, least):
    on = [x >= threshold for x in p]
    runs, k = [], 0
    while k < len(on):
        if on[k]:
            j = k
            while j + 1 < len(on) and on[j + 1]:
                j += 1
            if runs and k - runs[-1][1] - 1 <= gap:
                runs[-1][1] = j
            else:
                runs.append([k, j])
            k = j
        k += 1
    return [tuple(r) for r in runs if r[1] - r[0] + 1 >= least]


def test_bouts_equal_loop(spark):
    rng = random.Random(3)
    traces = {s: [rng.random() for _ in range(200)] for s in "abc"}
    df = spark.createDataFrame([(s, k, x) for s, t in traces.items() for k, x in enumerate(t)], "s string, frame int, p double")
    got = {}
    for r in I.bouts_of_trace(df, ["s"], "p", 0.5, 2, 6).collect():
        got.setdefault(r.s, []).append((r.start_frame, r.end_frame))
    for s, t in traces.items():
        assert sorted(got[s]) == loop_bouts(t, 0.5, 2, 6)


def test_hopping_windows(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(23)] + [("b", 0, 1.0)], "s string, frame long, v double")
    got = W.window_stats(W.hopping_windows(df, ["s"], 8, 3), ["s"], "v", 8).orderBy("window").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 7), (3, 10), (6, 13), (9, 16), (12, 19), (15, 22)]
    assert got[0].v_delta == 6.0 and got[0].v_trend == 1.0 and got[0].v_mean == 3.5


def test_zscore_constant(spark):
    got = W.zscore(spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 5.0)], "s string, v double"), ["s"], ["v"]).collect()
    assert [r.v_z for r in got] == [0.0, 0.0, 0.0]


def test_confusion(spark):
    r = M.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int"), [], "y", "p").first()
    assert (r.precision, r.recall, round(r.f1, 6)) == (1.0, 0.5, 0.666667)


def test_auc_ties(spark):
    r = M.roc_auc(spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double"), [], "y", "s").first()
    assert r.auc == 0.875


def test_overlap_semi_anti(spark):
    a = spark.createDataFrame([("x", 0, 9), ("x", 200, 300), ("y", 5, 6)], "s string, start_frame int, end_frame int")
    b = spark.createDataFrame([("x", 9, 205)], "s string, r_start int, r_end int")
    assert I.overlap_join(a, b, ["s"], width=8).count() == 2
    assert [r.s for r in I.overlap_join(a, b, ["s"], "left_anti", 8).collect()] == ["y"]
    assert I.overlap_join(a, b, ["s"], "left_semi", 8).count() == 2


def test_greedy_takes_later_of_equals(spark):
    p = spark.createDataFrame([("x", 0, 9)], "s string, start_frame int, end_frame int")
    t = spark.createDataFrame([("x", 0, 4), ("x", 5, 9)], "s string, r_start int, r_end int")
    assert tuple(I.greedy_match(p, t, ["s"]).first()) == ("x", 1, 0, 1)


def test_ngrams_drop_uniform(spark):
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate("AABBA")], "s string, k int, l string")
    got = {r.motif: r.n for r in T.ngrams(df, ["s"], "l", ["k"], 2).collect()}
    assert got == {"A>B": 1, "B>A": 1}


def test_geometry(spark):
    x, y = F.col("x"), F.col("y")
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 4.0), (None, 1.0)], "x double, y double")
    got = df.select(G.polygon_contains(x, y, square).alias("p"), G.rect_signed_distance(x, y, F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)).alias("d")).collect()
    assert [r.p for r in got] == [True, False, False] and got[0].d == 1.0 and got[1].d == -1.0
    one = spark.range(1).select(G.wrap_angle(F.lit(3 * math.pi / 2)).alias("w"), G.format_duration(F.lit(245.0)).alias("t"), G.significant(F.lit(0.0123456), 3).alias("g"), G.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("h")).first()
    assert abs(one.w + math.pi / 2) < 1e-9 and one.t == "4m 05s" and one.g == 0.0123 and abs(one.h - math.log(2)) < 1e-9


def test_reports_handle_absent_behaviours(spark, tmp_path):
    """A behaviour that a session lacks counts as share 0; one behaviour alone has no entropy."""
    from ethospark.plans import reports

    rows = [(1, 7, "view", 10.0, 1), (2, 7, "view", 90.0, 2), (3, 8, "view", 20.0, 1), (4, 8, "purchase", 30.0, 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts long").write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    assert {(r["user_id"], r["event_type"]): r["share"] for r in reports.shares(spark, d).collect()} == {(7, "view"): 1.0, (7, "purchase"): 0.0, (8, "view"): 0.5, (8, "purchase"): 0.5}
    assert {r["event_type"]: r["prevalence"] for r in reports.label_prevalence(spark, d).collect()} == {"view": 0.75, "purchase": 0.25}
    assert {r["user_id"]: (round(r["entropy"], 4), r["margin"]) for r in reports.entropy_margin(spark, d).collect()} == {7: (0.0, 1.0), 8: (0.6931, 0.0)}


def test_zero_roster_has_every_customer_and_bin(spark, tmp_path):
    """Customers from 200 on and frames past 89 are in rows too; a customer without events has zeros."""
    from ethospark.plans import behaviour

    rows = [(k, 500, "view", 1.0, k) for k in range(125)] + [(900, 3, "view", 1.0, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts long").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(3,), (500,), (700,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["subject"], r["bin"]): r["n"] for r in behaviour.zero_roster_bins(spark, str(tmp_path)).collect()}
    want = {(s, b): 0 for s in (3, 500, 700) for b in (0, 30, 60, 90, 120)} | {(500, b): 30 for b in (0, 30, 60, 90)} | {(500, 120): 5, (3, 0): 1}
    assert got == want


def test_regions_reach_each_sessions_end(spark, tmp_path):
    """Bouts past frame 60 stay, and a short session ends at its own last frame."""
    from ethospark.plans import behaviour, reports

    on = {(1, k) for k in (*range(10, 15), *range(24, 28), *range(200, 206), *range(296, 300))} | {(2, k) for k in range(5, 20)}
    rows = [(1000 * u + k, u, "view", 90.0 if (u, k) in on else 10.0, k) for u, n in ((1, 300), (2, 20)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts long").write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    padded = [(1, 5, 19), (1, 19, 32), (1, 195, 210), (1, 291, 299), (2, 0, 19)]
    assert sorted((r["user_id"], r["start_frame"], r["end_frame"]) for r in behaviour.padded_regions(spark, d).collect()) == padded
    assert sorted((r["user_id"], r["start_frame"], r["end_frame"]) for r in reports.merged_regions(spark, d).collect()) == [(1, 5, 32), *padded[2:]]


def test_best_threshold_tries_37(spark, tmp_path):
    """The best cut lies between the coarse thresholds 0.25 and 0.5."""
    from ethospark.plans import behaviour

    chars = [(k, "s", 10 * k) for k in range(1, 200)]
    spark.createDataFrame(chars, "doc_id long, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(n > 690)) for k, _, n in chars], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = behaviour.best_threshold(spark, str(tmp_path)).first()
    assert (round(got["threshold"], 9), got["f1"]) == (0.35, 1.0)
