"""Queries over the supplied tables, each with SQL that must give the same rows.

Stand-ins: a session is a user of `events`, its frames are the user's rows in time order, a feature is `value`, a probability is
least(value / 100, 1), a behaviour is `event_type`. Raters are rules on `documents`; true labels are `labels`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G
from ..operators import intervals as I, metrics as M, motifs as T, windows as W
from .registry import register

S = ["user_id"]
FPS = 30.0
CTE = """WITH f AS (SELECT event_id, user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS p FROM events)"""
#: f with bouts b of p >= 0.5, gaps up to 2 frames merged, 3 frames at least.
BOUTS = CTE + """, o AS (SELECT *, CASE WHEN frame - lag(frame) OVER w - 1 <= 2 THEN 0 ELSE 1 END AS nw FROM f WHERE p >= 0.5 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY frame) AS k FROM o),
b AS (SELECT user_id, min(frame) AS start_frame, max(frame) AS end_frame, avg(p) AS mean_prob FROM i GROUP BY user_id, k HAVING max(frame) - min(frame) + 1 >= 3)"""
#: All windows of 16 frames every 4.
WINDOWS = CTE + """, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id),
w AS (SELECT n.user_id, k.k AS win FROM n, LATERAL (SELECT unnest(range(0, (n.n - 16) // 4 + 1)) AS k) k WHERE n.n >= 16),
x AS (SELECT w.user_id, w.win, f.frame, f.frame - w.win * 4 AS pos, f.value FROM w JOIN f ON f.user_id = w.user_id AND f.frame BETWEEN w.win * 4 AND w.win * 4 + 15)"""
LABELLED = "l AS (SELECT d.doc_id, d.source, l.quality AS y, CAST(d.n_chars >= 1000 AS INT) AS a, CAST(d.n_chars >= 500 AS INT) AS b, least(d.n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.frame_index(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts"), S, ["ts", "event_id"])
    return e.withColumn("p", F.least(F.col("value") / 100.0, F.lit(1.0)))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.bouts_of_trace(frames(spark, sf_dir), S, "p", 0.5, 2, 3)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hopping_windows(frames(spark, sf_dir).select("user_id", "frame", "value"), S, 16, 4)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return d.select("doc_id", "source", F.col("quality").alias("y"), (n >= 1000).cast("int").alias("a"), (n >= 500).cast("int").alias("b"), F.least(n / 2000.0, F.lit(1.0)).alias("p"))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("window_stats", WINDOWS + """ SELECT user_id, win AS "window", min(frame) AS start_frame, max(frame) AS end_frame, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std,
round(median(value), 6) AS value_median, round(max(value), 6) AS value_max, round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.9), 6) AS value_p90, round(avg(value * value), 8) AS value_energy,
round(regr_slope(value, pos), 6) AS value_trend, round(avg(value) FILTER (pos >= 12) - avg(value) FILTER (pos < 4), 6) AS value_delta FROM x GROUP BY user_id, win""")
def window_stats(spark, d):
    w = W.window_stats(windows(spark, d), S, "value", 16)
    w = r6(w, *(c for c in w.columns if c.startswith("value_") and c != "value_energy"))
    return w.withColumn("value_energy", F.round("value_energy", 8))


@register("zscore_by_session", CTE + " SELECT event_id, round((value - avg(value) OVER u) / coalesce(nullif(stddev_samp(value) OVER u, 0), 1), 6) AS value_z FROM f WINDOW u AS (PARTITION BY user_id)")
def zscore_by_session(spark, d):
    return r6(W.zscore(frames(spark, d), S, ["value"]).select("event_id", "value_z"), "value_z")


@register("finite_difference", CTE + " SELECT event_id, round(coalesce((value - lag(value) OVER u) * 30.0, 0), 6) AS velocity FROM f WINDOW u AS (PARTITION BY user_id ORDER BY frame)")
def finite_difference(spark, d):
    return r6(W.finite_difference(frames(spark, d), S, "value", FPS, "velocity").select("event_id", "velocity"), "velocity")


@register("centroid_speed", CTE + " SELECT event_id, round(coalesce(sqrt(pow(value - lag(value) OVER u, 2) + pow(p - lag(p) OVER u, 2)) * 30.0, 0), 6) AS speed FROM f WINDOW u AS (PARTITION BY user_id ORDER BY frame)")
def centroid_speed(spark, d):
    return r6(W.speed(frames(spark, d), S, "value", "p", FPS).select("event_id", "speed"), "speed")


@register("contact_duration", CTE + """ SELECT event_id, round(CASE WHEN value >= 50 THEN (frame - coalesce(max(CASE WHEN value < 50 THEN frame END) OVER (PARTITION BY user_id ORDER BY frame), 0)) / 30.0 ELSE 0 END, 6) AS contact_s FROM f""")
def contact_duration(spark, d):
    return r6(W.run_length_seconds(frames(spark, d), S, F.col("value") >= 50, FPS, "contact_s").select("event_id", "contact_s"), "contact_s")


@register("clean_series", CTE + """, v AS (SELECT *, CASE WHEN p >= 0.2 THEN value END AS v FROM f),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS pv, first_value(v IGNORE NULLS) OVER z AS nv, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS pf, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER z AS nf FROM v
  WINDOW a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN frame - pf <= 10 THEN CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (frame - pf) / (nf - pf) END END AS iv FROM n),
s AS (SELECT *, avg(iv) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sv FROM i)
SELECT event_id, round(coalesce(last_value(sv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(sv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS value_clean FROM s""")
def clean_series(spark, d):
    return r6(W.clean_series(frames(spark, d), S, "value", "p", 0.2).select("event_id", "value_clean"), "value_clean")


@register("smooth_trace", CTE + " SELECT event_id, round(sum(p) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM f")
def smooth_trace(spark, d):
    return r6(I.smooth_trace(frames(spark, d), S, "p").select("event_id", "smooth"), "smooth")


@register("trace_bouts", BOUTS + " SELECT user_id, start_frame, end_frame, round(mean_prob, 6) AS mean_prob FROM b")
def trace_bouts(spark, d):
    return r6(bouts(spark, d), "mean_prob")


@register("merged_bouts", BOUTS + """, m AS (SELECT *, CASE WHEN start_frame - max(end_frame) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 10 THEN 0 ELSE 1 END AS nw2 FROM b),
j AS (SELECT *, sum(nw2) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS k2 FROM m)
SELECT user_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM j GROUP BY user_id, k2 HAVING max(end_frame) - min(start_frame) + 1 >= 15""")
def merged_bouts(spark, d):
    return I.merge_intervals(bouts(spark, d).drop("mean_prob"), S, 10, 15)


@register("slice_bout_summary", BOUTS + """ SELECT user_id, round(min(start_frame) / 30.0, 6) AS latency_s, round(sum(end_frame - start_frame + 1) / 30.0, 6) AS time_s, count(*) AS n_bouts, round(avg(end_frame - start_frame + 1) / 30.0, 6) AS mean_bout_s,
round(count(*) / (max(end_frame) / 30.0 / 60), 6) AS per_minute FROM b GROUP BY user_id""")
def slice_bout_summary(spark, d):
    return r6(I.bout_metrics(bouts(spark, d), S, FPS), "latency_s", "time_s", "mean_bout_s", "per_minute")


#: b, padded by 5 frames and clamped to the session's own frames.
REGIONS = BOUTS + """, z AS (SELECT user_id, max(frame) AS last FROM f GROUP BY user_id),
g AS (SELECT b.user_id, greatest(0, start_frame - 5) AS start_frame, least(last, end_frame + 5) AS end_frame FROM b JOIN z ON b.user_id IS NOT DISTINCT FROM z.user_id)"""


@register("padded_regions", REGIONS + " SELECT * FROM g")
def padded_regions(spark, d):
    """Clamped to each session's own last frame."""
    f = frames(spark, d).withColumn("last", F.max("frame").over(Window.partitionBy(*S)))
    b = I.bouts_of_trace(f, [*S, "last"], "p", 0.5, 2, 3).drop("mean_prob")
    return I.pad_intervals(b, 5, F.col("last")).drop("last")


@register("observed_islands", BOUTS + """, c AS (SELECT *, CASE WHEN start_frame - lag(end_frame) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame) - 1 > 4 THEN 1 ELSE 0 END AS cut FROM b)
SELECT user_id, start_frame, end_frame, (sum(cut) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame))::BIGINT AS island FROM c""")
def observed_islands(spark, d):
    return I.observed_islands(bouts(spark, d).drop("mean_prob"), S, 4)


SEEDS = ", t AS (SELECT user_id, frame AS r_start, frame + 3 AS r_end FROM f WHERE event_type = 'purchase')"


def seeds(spark, d):
    return frames(spark, d).where("event_type = 'purchase'").select("user_id", F.col("frame").alias("r_start"), (F.col("frame") + 3).alias("r_end"))


@register("overlap_pairs", BOUTS + SEEDS + " SELECT b.user_id, start_frame, end_frame, r_start, r_end FROM b JOIN t ON b.user_id = t.user_id AND start_frame <= r_end AND end_frame >= r_start")
def overlap_pairs(spark, d):
    return I.overlap_join(bouts(spark, d).drop("mean_prob"), seeds(spark, d), S, width=16)


@register("overlap_semi", BOUTS + SEEDS + " SELECT user_id, start_frame, end_frame FROM b WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND start_frame <= r_end AND end_frame >= r_start)")
def overlap_semi(spark, d):
    return I.overlap_join(bouts(spark, d).drop("mean_prob"), seeds(spark, d), S, "left_semi", 16)


@register("overlap_anti", BOUTS + SEEDS + " SELECT user_id, start_frame, end_frame FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND start_frame <= r_end AND end_frame >= r_start)")
def overlap_anti(spark, d):
    return I.overlap_join(bouts(spark, d).drop("mean_prob"), seeds(spark, d), S, "left_anti", 16)


@register("best_iou", BOUTS + SEEDS + """, q AS (SELECT b.user_id, r_start, r_end, start_frame, end_frame, (least(end_frame, r_end) - greatest(start_frame, r_start) + 1)::DOUBLE / (greatest(end_frame, r_end) - least(start_frame, r_start) + 1) AS iou
FROM b JOIN t ON b.user_id = t.user_id AND start_frame <= r_end AND end_frame >= r_start), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, r_start, r_end ORDER BY iou DESC, start_frame) AS rn FROM q)
SELECT user_id, r_start, r_end, start_frame, end_frame, round(iou, 6) AS iou, abs(start_frame - r_start) AS onset_err, abs(end_frame - r_end) AS offset_err FROM k WHERE rn = 1""")
def best_iou(spark, d):
    return r6(I.best_iou(bouts(spark, d).drop("mean_prob"), seeds(spark, d), S), "iou")


@register("greedy_match")
def greedy_match(spark, d):
    return I.greedy_match(bouts(spark, d), seeds(spark, d), S)


@register("suppress_overlaps")
def suppress_overlaps(spark, d):
    w = W.window_stats(windows(spark, d), S, "value", 16).select("user_id", "start_frame", "end_frame", F.round("value_mean", 9).alias("score"), F.round("value_std", 6).alias("uncertainty"))
    return I.suppress_overlaps(w, S, ["score", "uncertainty"])


@register("transitions", CTE + """, t AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS dst FROM f), c AS (SELECT user_id, src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY user_id, src), 6) AS p FROM c""")
def transitions(spark, d):
    return r6(T.normalize_rows(T.transitions(frames(spark, d), S, "event_type", ["frame"]), S), "p")


E2 = CTE + ", e AS (SELECT user_id, event_id, event_type AS label, frame / 30.0::DOUBLE AS s, (frame + 5) / 30.0::DOUBLE AS z FROM f)"


@register("gap_transitions", E2 + """ SELECT user_id, src, dst, count(*) AS n FROM (SELECT DISTINCT a.user_id, a.event_id, a.label AS src, b.label AS dst FROM e a JOIN e b ON a.user_id = b.user_id AND a.label <> b.label AND b.s >= a.z - 0.1 AND b.s <= a.z + 0.45 AND b.s > a.s) GROUP BY user_id, src, dst""")
def gap_transitions(spark, d):
    e = frames(spark, d).select("user_id", F.col("event_type").alias("label"), (F.col("frame") / FPS).alias("start_s"), ((F.col("frame") + 5) / FPS).alias("end_s"))
    return T.gap_transitions(e, "user_id", 0.45, 0.1)


@register("ngrams", CTE + """, g AS (SELECT event_type AS a, lead(event_type) OVER u AS b, lead(event_type, 2) OVER u AS c FROM f WINDOW u AS (PARTITION BY user_id ORDER BY frame))
SELECT a || '>' || b || '>' || c AS motif, count(*) AS n FROM g WHERE c IS NOT NULL AND NOT (a = b AND b = c) GROUP BY ALL HAVING count(*) >= 2""")
def ngrams(spark, d):
    return T.ngrams(frames(spark, d), S, "event_type", ["frame"], 3).groupBy("motif").agg(F.sum("n").alias("n")).where("n >= 2")


@register("confusion_by_source", "WITH " + LABELLED + """, c AS (SELECT source, count(*) FILTER (y = 1 AND a = 1) AS tp, count(*) FILTER (y = 0 AND a = 1) AS fp, count(*) FILTER (y = 1 AND a = 0) AS fn, count(*) FILTER (y = 0 AND a = 0) AS tn FROM l GROUP BY source)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def confusion_by_source(spark, d):
    return r6(M.confusion(labelled(spark, d), ["source"], "y", "a"), "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")


@register("roc_auc", "WITH " + LABELLED + """, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2 AS r FROM l)
SELECT source, sum(y)::BIGINT AS n_pos, round(CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 6) AS auc FROM r GROUP BY source""")
def roc_auc(spark, d):
    return r6(M.roc_auc(labelled(spark, d), ["source"], "y", "p"), "auc")


@register("average_precision", "WITH " + LABELLED + """, g AS (SELECT p, sum(y) AS k, count(*) AS n FROM l GROUP BY p), c AS (SELECT k, sum(k) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM g)
SELECT round(sum(k * tp / m) / sum(k), 6) AS ap FROM c""")
def average_precision(spark, d):
    return r6(M.average_precision(labelled(spark, d), [], "y", "p"), "ap")


@register("calibration", "WITH " + LABELLED + """, g AS (SELECT greatest(ceil(p * 10) - 1, 0) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS sq FROM l GROUP BY 1)
SELECT round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM g""")
def calibration(spark, d):
    return r6(M.calibration(labelled(spark, d), [], "y", "p"), "ece", "mce", "brier")


@register("reliability", "WITH " + LABELLED + " SELECT floor(p * 10)::INT AS bin, count(*) AS n, round(avg(p), 6) AS conf, round(avg(y), 6) AS acc FROM l WHERE p < 1 GROUP BY 1")
def reliability(spark, d):
    return r6(M.reliability(labelled(spark, d), "p", "y"), "conf", "acc")


#: The 37 thresholds of the reference, 0.05 to 0.95.
GRID = np.linspace(0.05, 0.95, 37).tolist()


@register("best_threshold", "WITH " + LABELLED + ", t AS (SELECT unnest([" + ", ".join(f"'{x!r}'::DOUBLE" for x in GRID) + """]) AS threshold), c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn FROM l, t GROUP BY 1),
s AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c) SELECT threshold, round(f1, 6) AS f1 FROM s ORDER BY s.f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, d):
    return r6(M.best_threshold(labelled(spark, d), [], "y", "p", GRID), "f1")


@register("agreement", CTE + """, u AS (SELECT user_id, avg(value) AS a, avg(value) FILTER (frame % 2 = 0) AS b FROM f GROUP BY user_id)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2)), 6) AS ccc, round(pow(corr(a, b), 2), 6) AS r2, round(avg(abs(b - a)), 6) AS mae, round(avg(b - a), 6) AS bias, round(stddev_samp(b - a), 6) AS sd,
round(avg(b - a) - 1.96 * stddev_samp(b - a), 6) AS loa_low, round(avg(b - a) + 1.96 * stddev_samp(b - a), 6) AS loa_high FROM u""")
def agreement(spark, d):
    u = frames(spark, d).groupBy("user_id").agg(F.avg("value").alias("a"), F.avg(F.when(F.col("frame") % 2 == 0, F.col("value"))).alias("b"))
    return r6(M.agreement(u, [], "a", "b"), "pearson", "ccc", "r2", "mae", "bias", "sd", "loa_low", "loa_high")


@register("cohen_kappa", "WITH " + LABELLED + """, k AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, (sum(a)::DOUBLE * sum(b) + (count(*) - sum(a))::DOUBLE * (count(*) - sum(b))) / (count(*)::DOUBLE * count(*)) AS pe FROM l)
SELECT n, round(po, 6) AS po, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def cohen_kappa(spark, d):
    return r6(M.cohen_kappa(labelled(spark, d), [], "a", "b"), "po", "kappa")


@register("benjamini_hochberg", """WITH t AS (SELECT c_custkey, (c_custkey * 7919 % 1000 + 1) / 2000.0::DOUBLE AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS r, count(*) OVER () AS m FROM t), q AS (SELECT c_custkey, p, least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT c_custkey, round(min(q) OVER (PARTITION BY p), 4) AS q FROM q""")
def benjamini_hochberg(spark, d):
    t = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 1000 + 1) / 2000.0).alias("p"))
    return M.benjamini_hochberg(t, [], "p").select("c_custkey", F.round("q", 4).alias("q"))


@register("robust_z", CTE + """, m AS (SELECT user_id, median(value) AS med FROM f GROUP BY user_id), a AS (SELECT f.user_id, median(abs(value - med)) AS mad FROM f JOIN m USING (user_id) GROUP BY f.user_id)
SELECT event_id, round(CASE WHEN mad <= 1e-9 THEN 0 ELSE 0.6745 * (value - med) / mad END, 6) AS robust_z FROM f JOIN m USING (user_id) JOIN a USING (user_id)""")
def robust_z(spark, d):
    return r6(M.robust_z(frames(spark, d), S, "value").select("event_id", "robust_z"), "robust_z")


@register("zero_roster_bins", CTE + """, b AS (SELECT unnest(range(0, coalesce(max(frame), 0) + 1, 30)) AS bin FROM f), e AS (SELECT user_id, frame // 30 * 30 AS bin FROM f)
SELECT c_custkey AS subject, b.bin::BIGINT AS bin, count(e.user_id) AS n FROM customer CROSS JOIN b LEFT JOIN e ON e.user_id = c_custkey AND e.bin = b.bin GROUP BY ALL""")
def zero_roster_bins(spark, d):
    """Every customer and every bin up to the last frame of the data."""
    f = frames(spark, d).select("user_id", F.col("frame").cast("long").alias("frame"))
    last = F.broadcast(f.agg(F.coalesce(F.max("frame"), F.lit(0).cast("long")).alias("last")))
    roster = table(spark, d, "customer").select(F.col("c_custkey").alias("subject")).crossJoin(last).select("subject", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(30).cast("long"))).alias("bin"))
    n = f.groupBy(F.col("user_id").alias("subject"), (F.floor(F.col("frame") / 30) * 30).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return roster.join(n, ["subject", "bin"], "left").select("subject", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("group_mean_sem", """WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), j AS (SELECT c_mktsegment AS grp, coalesce(v, 0) AS v FROM customer LEFT JOIN o ON k = c_custkey)
SELECT grp, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v) / sqrt(count(*)), 4) AS sem, round(1.96 * stddev_samp(v) / sqrt(count(*)), 4) AS ci FROM j GROUP BY grp""")
def group_mean_sem(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    j = table(spark, d, "customer").join(o, "c_custkey", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    sem = F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))
    return j.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(sem, 4).alias("sem"), F.round(1.96 * sem, 4).alias("ci"))


@register("anova_f", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, sum(value * value) - sum(value) * sum(value) / count(*) AS w FROM events GROUP BY 1), t AS (SELECT avg(value) AS m FROM events)
SELECT round((sum(g.n * pow(g.m - t.m, 2)) / (count(*) - 1)) / (sum(w) / (sum(g.n) - count(*))), 6) AS f FROM g, t""")
def anova_f(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("w"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("ss"), F.sum("w").alias("w"))
    return s.select(F.round(((F.col("ss") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 6).alias("f"))


@register("feature_audit", """WITH v AS (SELECT 'discount' AS f, nullif(l_discount, 0.04) AS v FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'rare', CASE WHEN l_orderkey % 500 = 0 THEN l_tax END FROM lineitem UNION ALL SELECT 'flat', 3.0::DOUBLE FROM lineitem UNION ALL SELECT 'sparse', CASE WHEN l_orderkey % 40 = 0 THEN 1.0::DOUBLE ELSE 0.0 END FROM lineitem),
a AS (SELECT f AS feature, avg((v IS NULL)::INT) AS nan_fraction, coalesce(avg((v <> 0)::INT), 0) AS nonzero_fraction, coalesce(stddev_samp(v), 0) AS std FROM v GROUP BY f) SELECT feature, round(nan_fraction, 6) AS nan_fraction, round(nonzero_fraction, 6) AS nonzero_fraction, round(std, 6) AS std, std < 1e-12 OR nan_fraction > 0.99 AS dead, NOT (std < 1e-12 OR nan_fraction > 0.99) AND nonzero_fraction < 0.05 AS weak FROM a""")
def feature_audit(spark, d):
    """Shares are of the rows that have a value; dead: no spread or hardly a value; weak: not dead and hardly a value but 0."""
    k = F.col("l_orderkey")
    wide = table(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0.04)).alias("discount"), F.col("l_quantity").alias("quantity"), F.when(k % 500 == 0, F.col("l_tax")).alias("rare"), F.lit(3.0).alias("flat"), F.when(k % 40 == 0, 1.0).otherwise(0.0).alias("sparse"))
    long = wide.unpivot([], ["discount", "quantity", "rare", "flat", "sparse"], "feature", "v")
    a = long.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("nan_fraction"), F.coalesce(F.avg((F.col("v") != 0).cast("double")), F.lit(0.0)).alias("nonzero_fraction"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    dead = (F.col("std") < 1e-12) | (F.col("nan_fraction") > 0.99)
    return a.select("feature", *(F.round(c, 6).alias(c) for c in ("nan_fraction", "nonzero_fraction", "std")), dead.alias("dead"), (~dead & (F.col("nonzero_fraction") < 0.05)).alias("weak"))


@register("cap_per_session", CTE + " SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM f) WHERE rn <= 5")
def cap_per_session(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return frames(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id")


@register("reciprocal_rank", "WITH " + LABELLED + ", r AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS r FROM l) SELECT round(avg(1.0::DOUBLE / r), 6) AS mrr, count(*) FILTER (r <= 50) AS in_50, count(*) FILTER (r <= 100) AS in_100, count(*) FILTER (r <= 200) AS in_200, round(count(*) FILTER (r <= 50) / count(*), 6) AS recall_50, round(count(*) FILTER (r <= 100) / count(*), 6) AS recall_100, round(count(*) FILTER (r <= 200) / count(*), 6) AS recall_200 FROM r WHERE y = 1")
def reciprocal_rank(spark, d):
    return r6(M.reciprocal_rank(labelled(spark, d), "doc_id", "y", "p"), "mrr", "recall_50", "recall_100", "recall_200")


@register("state_occupancy", CTE + " SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM f GROUP BY user_id, event_type")
def state_occupancy(spark, d):
    n = frames(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


@register("probability_histogram", CTE + " SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n FROM f GROUP BY 1")
def probability_histogram(spark, d):
    return frames(spark, d).groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("review_gaps", CTE + ", g AS (SELECT epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM f) SELECT CASE WHEN gap > 120 THEN 'break' WHEN gap < 0.05 THEN 'batch' ELSE 'timed' END AS kind, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def review_gaps(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = frames(spark, d).withColumn("gap", us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("gap is not null")
    return g.groupBy(F.when(F.col("gap") > 120, "break").when(F.col("gap") < 0.05, "batch").otherwise("timed").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("upsert_labels", "SELECT doc_id, max_by(y, v) AS y FROM (SELECT doc_id, quality AS y, 0 AS v FROM labels UNION ALL SELECT doc_id, 1 - quality, 1 FROM labels WHERE doc_id % 5 = 0) GROUP BY doc_id")
def upsert_labels(spark, d):
    l = table(spark, d, "labels")
    both = l.select("doc_id", F.col("quality").alias("y"), F.lit(0).alias("v")).unionByName(l.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("y"), F.lit(1).alias("v")))
    return both.groupBy("doc_id").agg(F.max_by("y", "v").alias("y"))


@register("nearest_center", BOUTS + SEEDS + """, q AS (SELECT t.user_id, t.r_start, b.start_frame, row_number() OVER (PARTITION BY t.user_id, t.r_start ORDER BY abs((start_frame + end_frame) / 2.0 - (r_start + r_end) / 2.0), start_frame) AS rn FROM t JOIN b USING (user_id))
SELECT user_id, r_start, start_frame FROM q WHERE rn = 1""")
def nearest_center(spark, d):
    return I.nearest_center(seeds(spark, d), bouts(spark, d), S).select("user_id", "r_start", "start_frame")


@register("coactivity", WINDOWS + """, y AS (SELECT w.user_id, w.win, f.event_type, count(*) / 16.0 AS p FROM w JOIN f ON f.user_id = w.user_id AND f.frame BETWEEN w.win * 4 AND w.win * 4 + 15 GROUP BY ALL), t AS (SELECT count(DISTINCT (user_id, win)) AS t FROM y), a AS (SELECT * FROM y WHERE p >= 0.3)
SELECT a.event_type AS a, b.event_type AS b, round(count(*) / any_value(t), 4) AS rate FROM a JOIN a b ON a.user_id = b.user_id AND a.win = b.win AND a.event_type < b.event_type, t GROUP BY 1, 2""")
def coactivity(spark, d):
    """Share of all segments in which two behaviours are both at 0.3 or more; a behaviour without a row has 0."""
    y = W.hopping_windows(frames(spark, d).select("user_id", "frame", "event_type"), S, 16, 4).groupBy("user_id", "window", "event_type").agg((F.count(F.lit(1)) / 16.0).alias("p"))
    t = y.select("user_id", "window").distinct().agg(F.count(F.lit(1)).alias("t"))
    on = y.where("p >= 0.3").groupBy("user_id", "window").agg(F.collect_set("event_type").alias("s")).where(F.size("s") > 1)
    pairs = on.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(F.broadcast(t)).select("a", "b", F.round(F.col("n") / F.col("t"), 4).alias("rate"))


@register("confused_pairs", WINDOWS + """, y AS (SELECT w.user_id, w.win, f.event_type, count(*) AS n FROM w JOIN f ON f.user_id = w.user_id AND f.frame BETWEEN w.win * 4 AND w.win * 4 + 15 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY n DESC, event_type) AS r FROM y), p AS (SELECT user_id, win, max(n) FILTER (r = 1) AS n1, coalesce(max(n) FILTER (r = 2), 0) AS n2, max(event_type) FILTER (r = 1) AS e1, max(event_type) FILTER (r = 2) AS e2 FROM k GROUP BY ALL)
SELECT least(e1, e2) AS a, greatest(e1, e2) AS b, count(*) AS n FROM p WHERE (n1 - n2) / 16.0 < 0.2 GROUP BY 1, 2""")
def confused_pairs(spark, d):
    """Segments whose two likeliest behaviours are less than 0.2 apart, by pair."""
    y = W.hopping_windows(frames(spark, d).select("user_id", "frame", "event_type"), S, 16, 4).groupBy("user_id", "window", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = y.groupBy("user_id", "window").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))), 1, 2).alias("t"))
    first, second = (F.element_at("t", k) for k in (1, 2))
    two = top.where(F.size("t") > 1).select((second["m"] - first["m"]).alias("gap"), F.least(first["event_type"], second["event_type"]).alias("a"), F.greatest(first["event_type"], second["event_type"]).alias("b"))
    return two.where(F.col("gap") / 16 < 0.2).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@register("overlap_half_open", BOUTS + SEEDS + " SELECT user_id, start_frame, end_frame FROM b WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND start_frame < r_end AND end_frame > r_start)")
def overlap_half_open(spark, d):
    """Feature windows [start, end) that share a frame with a seed [start, end)."""
    return I.overlap_join(bouts(spark, d).drop("mean_prob"), seeds(spark, d), S, "left_semi", 16, half_open=True)


@register("region_membership", "WITH x AS (SELECT event_id, value AS x, (event_id % 100)::DOUBLE AS y FROM events) SELECT event_id, x BETWEEN 10 AND 60 AND y BETWEEN 20 AND 70 AS in_rect, sqrt(pow(x - 50, 2) + pow(y - 50, 2)) <= 30 AS in_circle, round(CASE WHEN least(x - 10, 60 - x, y - 20, 70 - y) >= 0 THEN least(x - 10, 60 - x, y - 20, 70 - y) ELSE -sqrt(pow(greatest(10 - x, 0, x - 60), 2) + pow(greatest(20 - y, 0, y - 70), 2)) END, 6) AS signed, round(least(sqrt(x * x + y * y), sqrt(pow(x - 100, 2) + y * y)), 6) AS corner FROM x")
def region_membership(spark, d):
    x, y = F.col("value"), (F.col("event_id") % 100).cast("double")
    return table(spark, d, "events").select("event_id", G.rect_contains(x, y, 10, 20, 50, 50).alias("in_rect"), G.circle_contains(x, y, 50, 50, 30).alias("in_circle"), F.round(G.rect_signed_distance(x, y, F.lit(10.0), F.lit(20.0), F.lit(50.0), F.lit(50.0)), 6).alias("signed"), F.round(G.corner_distance(x, y, [(0, 0), (100, 0)]), 6).alias("corner"))


@register("label_tokens", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM part")
def label_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", G.normalize_label(F.concat("p_name", F.lit(" - "), "p_type")).alias("token"))


@register("rollup_counts", "SELECT event_type, user_id % 3 AS grp, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def rollup_counts(spark, d):
    return table(spark, d, "events").withColumn("grp", F.col("user_id") % 3).rollup("event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@register("nearest_centroid", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label AS c, k, avg(x) AS m FROM e WHERE label <> 0 GROUP BY 1, 2),
q AS (SELECT vec_id, c, sum(pow(x - m, 2)) AS d FROM e JOIN c USING (k) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM q) SELECT vec_id, c AS centroid, round(sqrt(d), 5) AS dist FROM r WHERE rn = 1""")
def nearest_centroid(spark, d):
    """Label 0 stands for noise, which has no centroid."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return M.nearest(e, "vec_id", "v", M.centroids(e.where("label <> 0"), "label", "v").select("label", "c"), "label").withColumn("dist", F.round("dist", 5))
