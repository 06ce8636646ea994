"""Queries of dense inference, refinement, frame labels, window samples and bout evaluation.

Stand-ins as in `ranking`: segments are windows of 16 frames every 4; a behaviour's probability in one is its event type's share of the frames.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import dense as D, intervals as I, windows as W
from .behaviour import BOUTS, CTE, FPS, S, SEEDS, bouts, frames, seeds
from .ranking import SEGMENTS, competing, segments
from .registry import register

STEP, COOL, INHIBIT, WARMUP = 3, 1.5, 0.2, 2


def lengths(spark, d):
    return frames(spark, d).groupBy("user_id").agg((F.max("frame") + 1).alias("n_frames"))


def shares(spark, d):
    x = W.hopping_windows(frames(spark, d).select("user_id", "frame", "event_type"), S, 16, 4)
    return x.groupBy("user_id", "window", F.col("event_type").alias("behavior")).agg((F.count(F.lit(1)) / 16.0).alias("prob")).select("user_id", "behavior", (F.col("window") * 4).alias("start_frame"), (F.col("window") * 4 + 15).alias("end_frame"), "prob")


#: Windows with their shares; absent behaviours are not rows, so a chunk's mean is over the windows that show a behaviour.
CHUNKS = CTE + f""", len AS (SELECT user_id, max(frame) + 1 AS n FROM f GROUP BY user_id), w AS (SELECT len.user_id, k.k AS win FROM len, LATERAL (SELECT unnest(range(0, (len.n - 16) // 4 + 1)) AS k) k WHERE len.n >= 16),
sh AS (SELECT w.user_id, w.win, f.event_type AS behavior, count(*) / 16.0::DOUBLE AS prob FROM w JOIN f ON f.user_id = w.user_id AND f.frame BETWEEN w.win * 4 AND w.win * 4 + 15 GROUP BY ALL),
ch AS (SELECT sh.user_id, behavior, c.c AS chunk, avg(prob) AS raw FROM sh, LATERAL (SELECT unnest(range(sh.win * 4 // {STEP}, (sh.win * 4 + 15) // {STEP} + 1)) AS c) c GROUP BY ALL),
gr AS (SELECT len.user_id, b.behavior, c.c AS chunk FROM len CROSS JOIN (SELECT DISTINCT behavior FROM sh) b, LATERAL (SELECT unnest(range(0, (len.n + {STEP} - 1) // {STEP})) AS c) c),
rw AS (SELECT gr.*, greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, coalesce(raw, 0))) AS c FROM gr LEFT JOIN ch USING (user_id, behavior, chunk)), tm AS (SELECT user_id, behavior, chunk, 1 / (1 + exp(-ln(c / (1 - c)) / {COOL}::DOUBLE)) AS raw FROM rw),
of AS (SELECT DISTINCT user_id, c AS chunk FROM (SELECT user_id, unnest(range(r_start // {STEP}, r_end // {STEP} + 1)) AS c FROM (SELECT user_id, frame AS r_start, frame + 3 AS r_end FROM f WHERE event_type = 'error' AND value > 150))),
cp AS (SELECT user_id, behavior, chunk, CASE WHEN chunk < {WARMUP} OR of.chunk IS NOT NULL THEN 0 ELSE greatest(0, least(1, raw - {INHIBIT}::DOUBLE * (tot - raw))) END AS prob FROM (SELECT *, sum(raw) OVER (PARTITION BY user_id, chunk) AS tot FROM tm) t LEFT JOIN of USING (user_id, chunk)),
wn AS (SELECT *, first_value(behavior) OVER (PARTITION BY user_id, chunk ORDER BY round(prob, 9) DESC, behavior) AS winner FROM cp)"""


def chunk_trace(spark, d):
    c = D.chunks(shares(spark, d), S, lengths(spark, d), STEP).withColumn("raw", D.temper(F.col("raw"), COOL))
    wrong = frames(spark, d).where("event_type = 'error' and value > 150").select("user_id", F.floor(F.col("frame") / STEP).alias("c_lo"), F.floor((F.col("frame") + 3) / STEP).alias("c_hi"))
    # Nine digits, so that behaviours of equal shares tie here as in the SQL.
    out = D.compete(c, S, INHIBIT, WARMUP, wrong).withColumn("prob", F.round("prob", 9))
    w = Window.partitionBy("user_id", "chunk").orderBy(F.desc("prob"), "behavior").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("winner", F.first("behavior").over(w))


@register("dense_chunks", CHUNKS + " SELECT user_id, chunk, behavior, round(prob, 9) AS prob, winner FROM wn")
def dense_chunks(spark, d):
    return chunk_trace(spark, d).select("user_id", "chunk", "behavior", "prob", "winner")


@register("dense_winners", CHUNKS + f", e AS (SELECT wn.user_id, winner, least(chunk * {STEP} + {STEP}, len.n) - chunk * {STEP} AS k FROM wn JOIN len USING (user_id) WHERE behavior = winner) SELECT user_id, winner, sum(k)::BIGINT AS frames, round(sum(k) / sum(sum(k)) OVER (PARTITION BY user_id), 6) AS share FROM e GROUP BY user_id, winner")
def dense_winners(spark, d):
    """Share of frames won, from the trace expanded to frames."""
    f = D.expand(chunk_trace(spark, d).where("behavior = winner").select("user_id", "chunk", "winner"), S, lengths(spark, d), STEP)
    n = f.groupBy("user_id", "winner").agg(F.count(F.lit(1)).alias("frames"))
    return n.select("user_id", "winner", "frames", F.round(F.col("frames") / F.sum("frames").over(Window.partitionBy("user_id")), 6).alias("share"))


POST = CHUNKS + f""", ft AS (SELECT wn.user_id, behavior, fr.fr AS frame, round(prob, 9) AS p FROM wn JOIN len USING (user_id), LATERAL (SELECT unnest(range(chunk * {STEP}, least(chunk * {STEP} + {STEP}, len.n))) AS fr) fr),
sm AS (SELECT user_id, behavior, frame, round(sum(p) OVER (PARTITION BY user_id, behavior ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS s FROM ft), on1 AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id, behavior ORDER BY frame) - 1 <= 4 THEN 0 ELSE 1 END AS nw FROM sm WHERE s >= 0.14),
il AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, behavior ORDER BY frame) AS k FROM on1), pb AS (SELECT user_id, behavior, min(frame) AS a, max(frame) AS z FROM il GROUP BY user_id, behavior, k HAVING max(frame) - min(frame) + 1 >= 8)"""


def dense_bouts_of(spark, d):
    f = D.expand(chunk_trace(spark, d).select("user_id", "chunk", "behavior", "prob"), S, lengths(spark, d), STEP)
    sm = I.smooth_trace(f, ["user_id", "behavior"], "prob", 5).withColumn("smooth", F.round("smooth", 9))
    return I.bouts_of_trace(sm, ["user_id", "behavior"], "smooth", 0.14, 4, 8)


@register("dense_bouts", POST + " SELECT user_id, behavior, count(*) AS n_bouts, sum(z - a + 1)::BIGINT AS frames, round(sum(z - a + 1) / 30.0, 6) AS time_s, round(min(a) / 30.0, 6) AS latency_s, round(avg(z - a + 1) / 30.0, 6) AS mean_bout_s FROM pb GROUP BY user_id, behavior")
def dense_bouts(spark, d):
    """Each behaviour's trace smoothed, cut, merged and rid of short runs: count, frames, time and latency by session and behaviour."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    return dense_bouts_of(spark, d).groupBy("user_id", "behavior").agg(F.count(F.lit(1)).alias("n_bouts"), F.sum(n).alias("frames"), F.round(F.sum(n) / FPS, 6).alias("time_s"), F.round(F.min("start_frame") / FPS, 6).alias("latency_s"), F.round(F.avg(n) / FPS, 6).alias("mean_bout_s"))


@register("bout_prevalence", POST + """, cv AS (SELECT DISTINCT user_id FROM pb), bh AS (SELECT DISTINCT behavior FROM pb), ag AS (SELECT user_id, behavior, count(*) AS n, sum(z - a + 1) AS fr FROM pb GROUP BY ALL)
SELECT cv.user_id, bh.behavior, coalesce(ag.n, 0) AS n_bouts, round(coalesce(fr, 0) / len.n, 6) AS time_fraction, round(coalesce(ag.n, 0) / (len.n / 30.0 / 60), 6) AS bout_rate FROM cv CROSS JOIN bh JOIN len ON len.user_id = cv.user_id LEFT JOIN ag ON ag.user_id = cv.user_id AND ag.behavior = bh.behavior""")
def bout_prevalence(spark, d):
    """Dense over sessions in which anything was found and behaviours that were found anywhere; behaviours never found are left out, not ranked rarest."""
    b = dense_bouts_of(spark, d)
    ag = b.groupBy("user_id", "behavior").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("fr"))
    names = F.broadcast(ag.agg(F.collect_set("behavior").alias("names")))
    grid = ag.select("user_id").distinct().join(names).select("user_id", F.explode("names").alias("behavior")).join(lengths(spark, d), "user_id")
    n = F.coalesce("n", F.lit(0))
    return grid.join(ag, ["user_id", "behavior"], "left").select("user_id", "behavior", n.alias("n_bouts"), F.round(F.coalesce("fr", F.lit(0)) / F.col("n_frames"), 6).alias("time_fraction"), F.round(n / (F.col("n_frames") / FPS / 60), 6).alias("bout_rate"))


#: Every fourth window tiles the session; one in three of them is missing, as in a labelled subset.
TILES = SEGMENTS + ", t AS (SELECT c.id, c.user_id, c.win, c.start_frame, c.end_frame, round(c.prob, 9) AS target, round(c.omax, 9) AS peer, 0.35::DOUBLE AS rest, (c.m >= 50)::INT AS y FROM c WHERE c.win % 4 = 0 AND c.win % 12 <> 8)"
ISLANDS = TILES + ", ct AS (SELECT *, CASE WHEN start_frame - lag(end_frame) OVER (PARTITION BY user_id ORDER BY start_frame) - 1 > 4 THEN 1 ELSE 0 END AS cut FROM t), ti AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY start_frame) AS island FROM ct)"


def tiles(spark, d):
    c = competing(spark, d).where("win % 4 = 0 and win % 12 <> 8")
    return c.select("id", "user_id", "win", "start_frame", "end_frame", F.round("prediction_prob", 9).alias("target"), F.round("other_max", 9).alias("peer"), F.lit(0.35).alias("rest"), (F.col("m") >= 50).cast("int").alias("y"))


REFINED = ISLANDS + """, fr AS (SELECT user_id, island, frame.f AS frame, arg_max(target, start_frame) AS p FROM ti, LATERAL (SELECT unnest(range(ti.start_frame, ti.end_frame + 1)) AS f) frame GROUP BY ALL), sp AS (SELECT user_id, island, frame, sum(p) OVER (PARTITION BY user_id, island ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM fr),
oo AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id, island ORDER BY frame) - 1 <= 4 THEN 0 ELSE 1 END AS nw FROM sp WHERE round(s, 9) >= 0.42), oi AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, island ORDER BY frame) AS k FROM oo), ob AS (SELECT user_id, island, min(frame) AS a, max(frame) AS z FROM oi GROUP BY user_id, island, k HAVING max(frame) - min(frame) + 1 >= 10),
hs AS (SELECT ti.id, sum(least(z, end_frame) - greatest(a, start_frame) + 1) / 16.0 AS share FROM ti JOIN ob ON ob.user_id = ti.user_id AND ob.island = ti.island AND a <= end_frame AND z >= start_frame GROUP BY ti.id)"""


@register("refined_segments", REFINED + """ SELECT ti.id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 2 THEN CASE greatest(target, peer, rest) WHEN target THEN 'target' WHEN peer THEN 'peer' ELSE 'rest' END WHEN coalesce(share, 0) >= 0.5 THEN 'target' WHEN peer >= rest THEN 'peer' ELSE 'rest' END AS prediction FROM ti LEFT JOIN hs ON hs.id = ti.id""")
def refined_segments(spark, d):
    return D.refine(tiles(spark, d), S, "target", ["peer", "rest"], 0.42 - 5e-10, 10, 4).select("id", "prediction")


@register("refinement_evaluability", ISLANDS + ", ig AS (SELECT user_id, island, max(end_frame) - min(start_frame) + 1 AS span, sum(y) AS pos FROM ti GROUP BY ALL) SELECT round(coalesce(sum(pos) FILTER (span < 20), 0) / sum(pos), 6) AS unsupported, coalesce(sum(pos) FILTER (span < 20), 0) / sum(pos) <= 0.5 AS evaluable FROM ig")
def refinement_evaluability(spark, d):
    return D.evaluability(tiles(spark, d), S, "y", 20, 4).select(F.round("unsupported", 6).alias("unsupported"), "evaluable")


@register("bout_errors", BOUTS + SEEDS + """, q AS (SELECT b.user_id, b.start_frame, b.end_frame, t.r_start, t.r_end, greatest(0, least(end_frame, r_end) - greatest(start_frame, r_start) + 1)::DOUBLE / (end_frame - start_frame + 1 + r_end - r_start + 1 - greatest(0, least(end_frame, r_end) - greatest(start_frame, r_start) + 1)) AS iou FROM b LEFT JOIN t ON b.user_id = t.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_frame, end_frame ORDER BY round(coalesce(iou, 0), 12) DESC, r_start) AS rn FROM q), p AS (SELECT user_id, count(*) AS n, avg(coalesce(iou, 0)) AS iou, avg(abs(start_frame - r_start)) AS onset, avg(abs(end_frame - r_end)) AS offs, avg(abs((end_frame - start_frame) - (r_end - r_start))) AS dur FROM k WHERE rn = 1 GROUP BY user_id),
m AS (SELECT user_id, count(*) AS m FROM t GROUP BY user_id) SELECT coalesce(p.user_id, m.user_id) AS user_id, round(coalesce(iou, 0), 6) AS mean_iou, round(onset, 6) AS onset_error_frames, round(offs, 6) AS offset_error_frames, (coalesce(n, 0) - coalesce(m, 0))::DOUBLE AS bout_count_difference, round(dur, 6) AS mean_bout_duration_error_frames FROM p FULL JOIN m ON p.user_id = m.user_id""")
def bout_errors(spark, d):
    out = D.bout_errors(bouts(spark, d), seeds(spark, d), S)
    return out.select("user_id", "bout_count_difference", *(F.round(c, 6).alias(c) for c in ("mean_iou", "onset_error_frames", "offset_error_frames", "mean_bout_duration_error_frames")))


@register("suggested_settings")
def suggested_settings(spark, d):
    """A grid of settings ranked by matched bouts: greedy matching keeps state, so a loop holds it in the tests."""
    f = I.smooth_trace(frames(spark, d), S, "p").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return D.suggest_settings(f.select("user_id", "frame", "smooth", "y"), S, [0.35, 0.5], [1, 3], [0, 2])


LABELS = BOUTS + """, ln AS (SELECT user_id, max(frame) AS last FROM f GROUP BY user_id), un AS (SELECT user_id, frame AS a, frame + 2 AS z, CASE WHEN value > 100 THEN 'blur' ELSE 'uncertain' END AS reason FROM f WHERE event_type = 'error')"""


@register("frame_labels", LABELS + """, uf AS (SELECT user_id, frame, arg_min(reason, a) AS reason FROM (SELECT user_id, a, reason, unnest(range(a, z + 1)) AS frame FROM un) GROUP BY ALL),
l AS (SELECT f.user_id, f.frame, bool_or(coalesce(f.frame BETWEEN b.start_frame AND b.end_frame, false))::INT AS label, bool_or(coalesce(abs(f.frame - b.start_frame) <= 2 OR abs(f.frame - b.end_frame) <= 2, false)) AS edge FROM f LEFT JOIN b ON f.user_id = b.user_id GROUP BY ALL)
SELECT l.user_id, l.frame, label, edge OR uf.reason IS NOT NULL AS excluded, CASE WHEN edge THEN 'boundary' ELSE coalesce(uf.reason, '') END AS exclude_reason FROM l LEFT JOIN uf ON l.user_id = uf.user_id AND l.frame = uf.frame""")
def frame_labels(spark, d):
    f = frames(spark, d)
    unsure = f.where("event_type = 'error'").select("user_id", F.col("frame").alias("r_start"), (F.col("frame") + 2).alias("r_end"), F.when(F.col("value") > 100, "blur").alias("reason"))
    return D.frame_labels(lengths(spark, d), bouts(spark, d), S, 2, unsure)


@register("sample_centers", BOUTS + """, ins AS (SELECT DISTINCT user_id, unnest(range(start_frame, end_frame + 1)) AS frame FROM b) SELECT DISTINCT user_id, unnest(range(start_frame, end_frame + 1, 2)) AS center, 1 AS label FROM b UNION ALL SELECT f.user_id, f.frame, 0 FROM f LEFT JOIN ins ON ins.user_id = f.user_id AND ins.frame = f.frame WHERE f.frame % 2 = 0 AND ins.frame IS NULL""")
def sample_centers(spark, d):
    return D.sample_centers(lengths(spark, d), bouts(spark, d), S, 2)


@register("padded_window_means", BOUTS + """, n AS (SELECT user_id, max(frame) AS last FROM f GROUP BY user_id), c AS (SELECT DISTINCT b.user_id, unnest(range(start_frame, end_frame + 1, 4)) AS center FROM b), x AS (SELECT c.user_id, c.center, greatest(0, least(n.last, c.center - 4 + k.k)) AS frame FROM c JOIN n USING (user_id) CROSS JOIN (SELECT unnest(range(0, 9)) AS k) k)
SELECT x.user_id, x.center, count(*) AS n, round(avg(f.value), 6) AS mean, round(max(f.value), 6) AS top FROM x JOIN f ON f.user_id = x.user_id AND f.frame = x.frame GROUP BY ALL""")
def padded_window_means(spark, d):
    """Windows of 9 frames around centres in bouts, edges repeated, and their means."""
    b = bouts(spark, d)
    c = b.select("user_id", F.explode(F.sequence("start_frame", "end_frame", F.lit(4).cast("long"))).alias("center")).distinct()
    w = D.padded_windows(frames(spark, d).select("user_id", "frame", "value"), c, S, 9, lengths(spark, d))
    return w.groupBy("user_id", "center").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))


@register("review_tiles", BOUTS + """, s AS (SELECT user_id, CASE WHEN end_frame - start_frame + 1 <= 6 THEN [greatest(0, (start_frame + end_frame) // 2 - 3)] ELSE list_transform(range(start_frame, end_frame + 1, 6), lambda x: CASE WHEN x + 5 > end_frame THEN greatest(start_frame, end_frame - 5) ELSE x END) END AS l FROM b)
SELECT DISTINCT user_id, w_start, w_start + 5 AS w_end FROM (SELECT user_id, unnest(l) AS w_start FROM s)""")
def review_tiles(spark, d):
    return D.tile_bouts(bouts(spark, d).drop("mean_prob"), 6)


@register("session_extents", BOUTS + " SELECT user_id, max(end_frame) AS extent, round(max(end_frame) / 30.0 / 60, 6) AS minutes FROM b GROUP BY user_id")
def session_extents(spark, d):
    e = F.max("end_frame")
    return bouts(spark, d).groupBy("user_id").agg(e.alias("extent"), F.round(e / FPS / 60, 6).alias("minutes"))


@register("video_minutes", BOUTS + " SELECT round(sum(e) / 30.0 / 60, 6) AS minutes, count(*) AS sessions FROM (SELECT max(end_frame) AS e FROM b GROUP BY user_id)")
def video_minutes(spark, d):
    e = bouts(spark, d).groupBy("user_id").agg(F.max("end_frame").alias("e"))
    return e.agg(F.round(F.sum("e") / FPS / 60, 6).alias("minutes"), F.count(F.lit(1)).alias("sessions"))


@register("confidence_runs", CTE + """, r AS (SELECT *, p > 0.9 AS hi, p < 0.3 AS lo, frame - row_number() OVER (PARTITION BY user_id, p > 0.9 ORDER BY frame) AS gh, frame - row_number() OVER (PARTITION BY user_id, p < 0.3 ORDER BY frame) AS gl FROM f),
h AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, gh, count(*) AS n FROM r WHERE hi GROUP BY ALL) GROUP BY user_id), l AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, gl, count(*) AS n FROM r WHERE lo GROUP BY ALL) GROUP BY user_id)
SELECT r.user_id, round(avg(p), 6) AS mean_confidence, round(coalesce(any_value(h.n), 0) / 30.0, 6) AS longest_high_s, round(coalesce(any_value(l.n), 0) / 30.0, 6) AS longest_low_s FROM r LEFT JOIN h USING (user_id) LEFT JOIN l USING (user_id) GROUP BY r.user_id""")
def confidence_runs(spark, d):
    f = frames(spark, d).select("user_id", "frame", "p")
    high, low = (I.longest_run(f, S, on, out) for on, out in ((F.col("p") > 0.9, "h"), (F.col("p") < 0.3, "l")))
    out = f.groupBy("user_id").agg(F.round(F.avg("p"), 6).alias("mean_confidence")).join(high, "user_id").join(low, "user_id")
    return out.select("user_id", "mean_confidence", F.round(F.col("h") / FPS, 6).alias("longest_high_s"), F.round(F.col("l") / FPS, 6).alias("longest_low_s"))


@register("time_budget_units", SEGMENTS + """, t AS (SELECT user_id, start_frame, end_frame, (m >= 50)::INT AS y, (prob >= 0.45)::INT AS yp, start_frame - lag(end_frame) OVER w AS gap, lag((m >= 50)::INT) OVER w AS py, lag((prob >= 0.45)::INT) OVER w AS pyp FROM g WINDOW w AS (PARTITION BY user_id ORDER BY start_frame)),
u AS (SELECT user_id, count(*) AS n, avg((gap <= 1)::INT) AS cg, sum(16) / (max(end_frame) - min(start_frame) + 1) AS cov, sum(16 * y) / sum(16) AS tp, sum(16 * yp) / sum(16) AS pp, count(*) FILTER (y = 1 AND coalesce(py, 0) = 0) AS tb, count(*) FILTER (yp = 1 AND coalesce(pyp, 0) = 0) AS pb FROM t GROUP BY user_id)
SELECT user_id, n AS n_segments, round(cov, 6) AS coverage_frac, round(coalesce(cg, 1), 6) AS contiguity, round(tp, 6) AS true_prevalence, round(pp, 6) AS pred_prevalence, CASE WHEN coalesce(cg, 1) >= 0.9 THEN tb END AS true_bouts, CASE WHEN coalesce(cg, 1) >= 0.9 THEN pb END AS pred_bouts FROM u""")
def time_budget_units(spark, d):
    w = Window.partitionBy("user_id").orderBy("start_frame")
    span = F.col("end_frame") - F.col("start_frame") + 1
    g = segments(spark, d)[0].select("user_id", "start_frame", "end_frame", (F.col("m") >= 50).cast("int").alias("y"), (F.col("prediction_prob") >= 0.45).cast("int").alias("yp"))
    g = g.withColumns({"gap": F.col("start_frame") - F.lag("end_frame").over(w), "py": F.coalesce(F.lag("y").over(w), F.lit(0)), "pyp": F.coalesce(F.lag("yp").over(w), F.lit(0))})
    u = g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_segments"), (F.sum(span) / (F.max("end_frame") - F.min("start_frame") + 1)).alias("coverage_frac"), F.coalesce(F.avg((F.col("gap") <= 1).cast("int")), F.lit(1.0)).alias("contiguity"), (F.sum(span * F.col("y")) / F.sum(span)).alias("true_prevalence"), (F.sum(span * F.col("yp")) / F.sum(span)).alias("pred_prevalence"), F.count_if((F.col("y") == 1) & (F.col("py") == 0)).alias("tb"), F.count_if((F.col("yp") == 1) & (F.col("pyp") == 0)).alias("pb"))
    dense = F.col("contiguity") >= 0.9
    return u.select("user_id", "n_segments", *(F.round(c, 6).alias(c) for c in ("coverage_frac", "contiguity", "true_prevalence", "pred_prevalence")), F.when(dense, F.col("tb")).alias("true_bouts"), F.when(dense, F.col("pb")).alias("pred_bouts"))


@register("median_trace", CTE + " SELECT event_id, round(quantile_cont(p, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM f")
def median_trace(spark, d):
    return I.median_trace(frames(spark, d), S, "p").select("event_id", F.round("smooth", 6).alias("smooth"))


@register("late_events")
def late_events(spark, d):
    """Events less those that start over the tolerance before the last kept end; the fold keeps state, so a loop holds it in the tests."""
    e = frames(spark, d).select("user_id", "event_id", (F.col("frame") / FPS).alias("start_s"), ((F.col("frame") + F.col("event_id") % 7) / FPS).alias("end_s"))
    return I.drop_late_events(e, S, 0.05)


@register("event_sequences", BOUTS + " SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_frame, end_frame) AS place, round(start_frame / 30.0, 6) AS start_s, round(end_frame / 30.0, 6) AS end_s FROM b")
def event_sequences(spark, d):
    w = Window.partitionBy("user_id").orderBy("start_frame", "end_frame")
    return bouts(spark, d).select("user_id", F.row_number().over(w).alias("place"), F.round(F.col("start_frame") / FPS, 6).alias("start_s"), F.round(F.col("end_frame") / FPS, 6).alias("end_s"))


@register("clips_to_find", SEGMENTS + """, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(prob, 9) DESC, id) AS n, (m >= 50)::INT AS pos FROM g), y AS (SELECT user_id, n, sum(pos) OVER (PARTITION BY user_id ORDER BY n) AS y FROM r), qq AS (SELECT *, coalesce(lag(y) OVER w, 0) AS py, coalesce(lag(n) OVER w, 0) AS pn FROM y WINDOW w AS (PARTITION BY user_id ORDER BY n)),
a AS (SELECT user_id, arg_min(pn + CASE WHEN y <= py THEN 0 ELSE (3 - py) / (y - py) * (n - pn) END, n) FILTER (y >= 3) AS inside, max(n) AS lx, max(y) AS ly, arg_max(y - py, n) AS dy, arg_max(n - pn, n) AS dx, count(*) AS k FROM qq GROUP BY user_id)
SELECT user_id, round(CASE WHEN inside IS NOT NULL THEN inside WHEN ly <= 0 THEN NULL ELSE lx + (3 - ly) / CASE WHEN k >= 2 AND dy > 0 THEN dy / dx ELSE ly / lx END END, 6) AS clips, (SELECT min(n) FROM y WHERE y.user_id = a.user_id AND y.y >= 3) AS first_reach FROM a""")
def clips_to_find(spark, d):
    """Segments to review, most probable first, until three positives: read off the curve, or carried on at its last rate, else its mean rate."""
    g = segments(spark, d)[0].select("user_id", "id", F.round("prediction_prob", 9).alias("p"), (F.col("m") >= 50).cast("int").alias("pos"))
    o = Window.partitionBy("user_id").orderBy(F.desc("p"), "id")
    y = g.select("user_id", F.row_number().over(o).alias("x"), F.sum("pos").over(o).alias("y"))
    return I.clips_to_find(y, S, "x", "y", 3).select("user_id", F.round("clips", 6).alias("clips"), "first_reach")


@register("learning_knee", SEGMENTS + """, pt AS (SELECT user_id, win + 1 AS size, round(1 - 1 / (1 + 0.4 * win) + sd / 10000, 9) AS f1, win % 5 = 4 AS degenerate FROM g), us AS (SELECT *, bool_and(degenerate) OVER (PARTITION BY user_id) AS alldeg, count(*) OVER (PARTITION BY user_id) AS k FROM pt),
ok AS (SELECT * FROM us WHERE NOT degenerate OR alldeg), o AS (SELECT *, max(f1) OVER (PARTITION BY user_id) AS top, lead(f1) OVER w - f1 AS gain, max(size) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id) AS n FROM ok WINDOW w AS (PARTITION BY user_id ORDER BY size))
SELECT user_id, CASE WHEN any_value(n) >= 2 THEN coalesce(min(size) FILTER (f1 >= 0.98 * top AND coalesce(gain, 0) < 0.01), any_value(last)) END AS knee FROM o GROUP BY user_id""")
def learning_knee(spark, d):
    g = segments(spark, d)[0].select("user_id", (F.col("win") + 1).alias("size"), F.round(1 - 1 / (1 + 0.4 * F.col("win")) + F.col("sd") / 10000, 9).alias("f1"), (F.col("win") % 5 == 4).alias("degenerate"))
    return I.knee(g, S, "size", "f1", "degenerate")
