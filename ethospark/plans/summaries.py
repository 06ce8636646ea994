"""More summaries: the whole feature table, prevalence, curves, scores, calibration by group, matrices of importance and single rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry as G
from ..operators import intervals as I, labels as L, metrics as M, ranking as R, stats as T, windows as W
from .behaviour import BOUTS, CTE, FPS, LABELLED, S, bouts, frames, labelled, r6, table
from .ranking import SEGMENTS, competing, segments
from .registry import register
from .statistics import CELLS, LONG, cells

_SEG = CTE + """, nn AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1), wi AS (SELECT user_id, n, unnest(CASE WHEN n < 64 THEN [0::BIGINT] ELSE range(0, (n - 64) // 16 + 1) END) AS w FROM nn), xx AS (SELECT wi.user_id, wi.w, least(wi.n, 64) AS n, f.frame, f.frame - wi.w * 16 AS pos, f.value, f.p FROM wi JOIN f ON f.user_id = wi.user_id AND f.frame BETWEEN wi.w * 16 AND wi.w * 16 + 63),
bd AS (SELECT *, greatest(1, least(n // 2, round_even(0.25 * n, 0))) AS band FROM xx), cc AS (SELECT user_id, w, pos, n, value - avg(value) OVER (PARTITION BY user_id, w) AS c FROM xx), kk AS (SELECT user_id, w, k, sqrt(pow(sum(c * cos(2 * pi() * k * pos / n)), 2) + pow(sum(c * sin(2 * pi() * k * pos / n)), 2)) AS m FROM cc, (SELECT unnest(range(1, 33)) AS k) WHERE k <= n // 2 GROUP BY user_id, w, k), pk AS (SELECT user_id, w, max(m) AS m FROM kk GROUP BY user_id, w)"""


@register("segment_table", _SEG + """ SELECT 'seg_' || b.user_id || '_' || min(frame) || '_' || max(frame) AS segment_id, b.user_id, min(frame) AS start_frame, max(frame) AS end_frame, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(median(value), 6) AS value_median, round(max(value), 6) AS value_max, round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.9), 6) AS value_p90, round(avg(value * value), 5) AS value_energy, round(any_value(pk.m), 5) AS value_periodicity,
round(regr_slope(value, pos), 6) AS value_trend, round(avg(value) FILTER (pos >= n - band) - avg(value) FILTER (pos < band), 6) AS value_delta, round(avg(p), 11) AS p_mean FROM bd b JOIN pk ON pk.user_id = b.user_id AND pk.w = b.w GROUP BY b.user_id, b.w""")
def segment_table(spark, d):
    """Windows of 64 frames every 16; sessions with fewer are one segment."""
    out = W.segment_table(frames(spark, d).select("user_id", "frame", "value", "p"), S, ["value", "p"], 64, 16)
    digits = {"energy": 5, "periodicity": 5}
    return out.select("segment_id", "user_id", "start_frame", "end_frame", *(F.round(c, digits.get(c[6:], 6)).alias(c) for c in out.columns if c.startswith("value_")), F.round("p_mean", 11).alias("p_mean"))


@register("zscore_stats", CTE + " SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(nullif(stddev_samp(value), 0), 1), 6) AS sd, count(*) AS n FROM f GROUP BY user_id")
def zscore_stats(spark, d):
    """What the z-scores of a session were taken with."""
    return frames(spark, d).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(1.0)), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


@register("weighted_bouts", BOUTS + " SELECT f.user_id, count(DISTINCT b.start_frame) AS n_bouts, round(sum(CASE WHEN f.frame = b.start_frame THEN (b.end_frame - b.start_frame + 1) * f.value END) / sum(CASE WHEN f.frame = b.start_frame THEN b.end_frame - b.start_frame + 1 END), 6) AS mean_distance FROM f LEFT JOIN b ON b.user_id = f.user_id AND b.start_frame = f.frame GROUP BY f.user_id")
def weighted_bouts(spark, d):
    """Mean of a bout's distance (its first value) weighted by its length; every session has a row."""
    f = frames(spark, d).select("user_id", F.col("frame").alias("start_frame"), "value")
    n = F.col("end_frame") - F.col("start_frame") + 1
    j = f.join(bouts(spark, d).drop("mean_prob"), ["user_id", "start_frame"], "left")
    return j.groupBy("user_id").agg(F.count("end_frame").alias("n_bouts"), F.round(F.sum(n * F.col("value")) / F.sum(n), 6).alias("mean_distance"))


@register("label_time_shares", SEGMENTS + ", l AS (SELECT user_id, CASE WHEN m >= 60 THEN 'high' WHEN m < 40 THEN 'low' ELSE 'mid' END AS behavior, greatest(1, end_frame - start_frame) AS k FROM g WHERE win % 2 = 0), t AS (SELECT user_id, sum(k) AS t FROM l GROUP BY 1), b AS (SELECT DISTINCT behavior FROM l) SELECT t.user_id, b.behavior, round(coalesce(sum(l.k), 0) / any_value(t.t), 6) AS share FROM t CROSS JOIN b LEFT JOIN l ON l.user_id = t.user_id AND l.behavior = b.behavior GROUP BY t.user_id, b.behavior")
def label_time_shares(spark, d):
    """Share of a session's labelled frames by behaviour, dense; a label's frames leave out its last."""
    m = F.col("m")
    l = segments(spark, d)[0].where("win % 2 = 0").select("user_id", F.when(m >= 60, "high").when(m < 40, "low").otherwise("mid").alias("behavior"), F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame")).alias("k"))
    n = l.groupBy("user_id", "behavior").agg(F.sum("k").alias("k"))
    names = F.broadcast(l.select("behavior").distinct())
    t = n.groupBy("user_id").agg(F.sum("k").alias("t")).crossJoin(names)
    return t.join(n, ["user_id", "behavior"], "left").select("user_id", "behavior", F.round(F.coalesce("k", F.lit(0)) / F.col("t"), 6).alias("share"))


@register("pr_curve", "WITH " + LABELLED + ", g AS (SELECT p, sum(y) AS k, count(*) AS n FROM l GROUP BY p), c AS (SELECT p, sum(k) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM g) SELECT round(p, 6) AS threshold, round(tp / m, 6) AS precision, round(tp / (SELECT sum(k) FROM g), 6) AS recall FROM c")
def pr_curve(spark, d):
    return M.pr_curve(labelled(spark, d), "y", "p").select(F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("reliability_ece", "WITH " + LABELLED + ", g AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM l WHERE p < 1 GROUP BY 1) SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM l), 6) AS ece, count(*) AS bins FROM g")
def reliability_ece(spark, d):
    """Left-closed bins; a probability of 1 is in none but counts in the total."""
    l = labelled(spark, d)
    g = M.reliability(l, "p", "y")
    n = F.broadcast(l.agg(F.count(F.lit(1)).alias("t")))
    return g.join(n).groupBy("t").agg(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))).alias("s"), F.count(F.lit(1)).alias("bins")).select(F.round(F.col("s") / F.col("t"), 6).alias("ece"), "bins")


@register("calibration_by_source", "WITH " + LABELLED + ", g AS (SELECT source, greatest(ceil(p * 10) - 1, 0) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS sq FROM l GROUP BY 1, 2) SELECT source, round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM g GROUP BY source")
def calibration_by_source(spark, d):
    return r6(M.calibration(labelled(spark, d), ["source"], "y", "p"), "ece", "mce", "brier")


@register("queue_composition", SEGMENTS + ", k AS (SELECT id, CASE greatest(round(prob, 9), round(u, 9), round(1 - least(abs(prob - omax), 1), 9)) WHEN round(prob, 9) THEN 'candidate' WHEN round(u, 9) THEN 'uncertainty' ELSE 'disagreement' END AS reason FROM c) SELECT reason AS selection_reason, count(*) AS n FROM k GROUP BY 1")
def queue_composition(spark, d):
    c = competing(spark, d)
    parts = F.array(*(F.round(x, 9) for x in ("prediction_prob", "uncertainty_score", "exclusivity_uncertainty")))
    names = F.array(*map(F.lit, ("candidate", "uncertainty", "disagreement")))
    return c.groupBy(F.element_at(names, F.array_position(parts, F.array_max(parts)).cast("int")).alias("selection_reason")).agg(F.count(F.lit(1)).alias("n"))


@register("sampled_column_states", CTE + ", r AS (SELECT user_id, value, p, frame, count(*) OVER (PARTITION BY user_id) AS n FROM f), s AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN value END AS a, CASE WHEN user_id % 7 = 0 THEN 1.0::DOUBLE ELSE p END AS b FROM r WHERE frame % greatest(1, n // 20) = 0) SELECT user_id, count(*) AS sampled, count(a) = 0 AS a_missing, coalesce(stddev_pop(b), 0) < 1e-12 AS b_constant FROM s GROUP BY user_id")
def sampled_column_states(spark, d):
    """Whether a session's columns are all missing or constant, judged from evenly spaced rows: the sample is the operator."""
    u = F.col("user_id")
    r = frames(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    s = r.where(F.col("frame") % F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 20)) == 0).select("user_id", F.when(u % 5 != 0, F.col("value")).alias("a"), F.when(u % 7 == 0, 1.0).otherwise(F.col("p")).alias("b"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sampled"), (F.count("a") == 0).alias("a_missing"), (F.coalesce(F.stddev_pop("b"), F.lit(0.0)) < 1e-12).alias("b_constant"))


@register("merged_labelled", "WITH m AS (SELECT * FROM (VALUES ('click', 'tap'), ('view', 'look')) v(name, host)) SELECT e.event_id, m.host AS label, round(e.value, 6) AS value FROM events e JOIN m ON m.name = e.event_type")
def merged_labelled(spark, d):
    """Foreign labelled rows under the host's behaviours; others go."""
    m = spark.createDataFrame([("click", "tap"), ("view", "look")], "event_type string, label string")
    return table(spark, d, "events").join(F.broadcast(m), "event_type").select("event_id", "label", F.round("value", 6).alias("value"))


@register("subject_behavior_sums", CTE + ", b AS (SELECT user_id % 50 AS subject, event_type AS behavior, count(*) AS n, sum(value) AS t FROM f GROUP BY user_id, event_type) SELECT subject, behavior, sum(n)::BIGINT AS n, round(sum(t), 4) AS time, round(sum(t) / sum(n), 9) AS mean_bout FROM b GROUP BY ALL")
def subject_behavior_sums(spark, d):
    b = frames(spark, d).groupBy((F.col("user_id") % 50).alias("subject"), F.col("event_type").alias("behavior")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"))
    return b.select("subject", "behavior", "n", F.round("t", 4).alias("time"), F.round(F.col("t") / F.col("n"), 9).alias("mean_bout"))


@register("pooled_effort", CTE + ", g AS (SELECT epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id)) AS gap FROM f) SELECT count(*) AS n, round(median(gap), 5) AS median_s, round(quantile_cont(gap, 0.75), 5) AS p75_s, round(sum(gap) / 3600, 6) AS hours, round(3600 / median(gap), 4) AS clips_per_hour FROM g WHERE gap BETWEEN 0.05 AND 120")
def pooled_effort(spark, d):
    """The timed gaps of all projects as one."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    f = frames(spark, d).withColumn("project", F.col("user_id") % 4)
    g = f.select((t - F.lag(t).over(Window.partitionBy("project").orderBy("ts", "event_id"))).alias("gap")).where("gap between 0.05 and 120")
    k = g.agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", F.array(F.lit(0.5), F.lit(0.75))).alias("q"), F.sum("gap").alias("s"))
    return k.select("n", F.round(F.col("q")[0], 5).alias("median_s"), F.round(F.col("q")[1], 5).alias("p75_s"), F.round(F.col("s") / 3600, 6).alias("hours"), F.round(3600 / F.col("q")[0], 4).alias("clips_per_hour"))


@register("pair_gains", CELLS + ", p AS (SELECT a.project, a.behavior || '-' || b.behavior AS pair, avg(a.f1 - b.f1) AS gain FROM c a JOIN c b ON a.project = b.project AND a.seed = b.seed AND a.behavior < b.behavior GROUP BY ALL) SELECT pair, count(*) AS n_projects, round(avg(gain), 6) AS gain FROM p GROUP BY pair")
def pair_gains(spark, d):
    c = cells(spark, d).select("project", "seed", "behavior", "f1")
    o = c.select("project", "seed", F.col("behavior").alias("b"), F.col("f1").alias("g"))
    p = c.join(o, ["project", "seed"]).where("behavior < b").groupBy("project", F.concat_ws("-", "behavior", "b").alias("pair")).agg(F.avg(F.col("f1") - F.col("g")).alias("gain"))
    return p.groupBy("pair").agg(F.count(F.lit(1)).alias("n_projects"), F.round(F.avg("gain"), 6).alias("gain"))


@register("confusable_pairs", CELLS + ", p AS (SELECT a.behavior AS a, b.behavior AS b, avg(abs(a.f1 - b.f1)) AS gap FROM c a JOIN c b ON a.project = b.project AND a.seed = b.seed AND a.behavior < b.behavior GROUP BY 1, 2) SELECT a, b, round(gap, 6) AS gap, row_number() OVER (ORDER BY round(gap, 9), a, b) AS rank FROM p")
def confusable_pairs(spark, d):
    """Pairs by how alike they score, most alike first; a row a pair."""
    c = cells(spark, d).select("project", "seed", F.col("behavior").alias("a"), F.col("f1").alias("fa"))
    o = c.select("project", "seed", F.col("a").alias("b"), F.col("fa").alias("fb"))
    p = c.join(o, ["project", "seed"]).where("a < b").groupBy("a", "b").agg(F.avg(F.abs(F.col("fa") - F.col("fb"))).alias("gap"))
    return p.select("a", "b", F.round("gap", 6).alias("gap"), F.row_number().over(Window.orderBy(F.round("gap", 9), "a", "b")).alias("rank"))


@register("behaviorscape", LONG + ", i AS (SELECT session AS project, l_orderkey % 3 AS behavior, feature, abs(corr(v, ex::INT)) AS w FROM v GROUP BY ALL), n AS (SELECT project, behavior, feature, w / sum(w) OVER (PARTITION BY project, behavior) AS w FROM i), k AS (SELECT feature FROM n GROUP BY feature HAVING max(w) >= 0.3 AND sum(w) > 0) SELECT behavior, feature, round(avg(w), 6) AS importance FROM n WHERE feature IN (SELECT feature FROM k) GROUP BY ALL")
def behaviorscape(spark, d):
    """Mean normalised importance by behaviour over projects, of features that reach the threshold in one of them."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    l = table(spark, d, "lineitem").select(*cols, (F.col("l_returnflag") == "R").cast("int").alias("ex"), (F.col("l_suppkey") % 6).alias("project"), (F.col("l_orderkey") % 3).alias("behavior"))
    i = l.groupBy("project", "behavior").agg(*(F.abs(F.corr(c, "ex")).alias(c) for c in cols)).unpivot(["project", "behavior"], cols, "feature", "w")
    n = i.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("project", "behavior")))
    keep = n.groupBy("feature").agg(F.max("w").alias("m"), F.sum("w").alias("s")).where("m >= 0.3 and s > 0").select("feature")
    return n.join(F.broadcast(keep), "feature").groupBy("behavior", "feature").agg(F.round(F.avg("w"), 6).alias("importance"))


@register("hard_negative_centers", CTE + ", h AS (SELECT user_id, frame AS a, frame + 7 AS z FROM f WHERE event_type = 'error' AND value > 60) SELECT DISTINCT user_id, unnest(range(a, z + 1, 3)) AS center FROM h")
def hard_negative_centers(spark, d):
    h = frames(spark, d).where("event_type = 'error' and value > 60")
    return h.select("user_id", F.explode(F.sequence("frame", F.col("frame") + 7, F.lit(3).cast("long"))).alias("center")).distinct()


@register("timed_windows", CTE + ", w AS (SELECT user_id, k.k AS w FROM (SELECT user_id, count(*) AS n FROM f GROUP BY 1), LATERAL (SELECT unnest(range(0, (n - 20) // 10 + 1)) AS k) k WHERE n >= 20) SELECT w.user_id, w.w * 10 AS sf, w.w * 10 + 20 AS ef, round(avg(value), 6) AS mean_speed, round(stddev_pop(value), 6) AS std_speed, round(avg(cos(p * 6)), 6) AS mean_cos, round(avg(sin(p * 6)), 6) AS mean_sin FROM w JOIN f ON f.user_id = w.user_id AND f.frame >= w.w * 10 AND f.frame < w.w * 10 + 20 GROUP BY ALL")
def timed_windows(spark, d):
    """Windows of two thirds of a second every third, half-open, with the parts of the circular mean of an angle (p * 6)."""
    size, stride = int(2 / 3 * FPS), int(1 / 3 * FPS)
    x = W.hopping_windows(frames(spark, d).select("user_id", "frame", "value", "p"), S, size, stride)
    return x.groupBy("user_id", (F.col("window") * stride).alias("sf"), (F.col("window") * stride + size).alias("ef")).agg(F.round(F.avg("value"), 6).alias("mean_speed"), F.round(F.stddev_pop("value"), 6).alias("std_speed"), F.round(F.avg(F.cos(F.col("p") * 6)), 6).alias("mean_cos"), F.round(F.avg(F.sin(F.col("p") * 6)), 6).alias("mean_sin"))


@register("ranked_scores", "SELECT doc_id, row_number() OVER (ORDER BY s DESC NULLS LAST, doc_id) AS rank FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN least(n_chars / 20000.0::DOUBLE, 1) END AS s FROM documents) QUALIFY rank <= 100")
def ranked_scores(spark, d):
    """The first 100 by falling score, missing ones last: a sort with a limit, ranks on what is left."""
    s = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 3, F.least(F.col("n_chars") / 20000.0, F.lit(1.0))).alias("s"))
    top = s.orderBy(F.desc_nulls_last("s"), "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("s"), "doc_id")).alias("rank"))


@register("separation", LONG + ", r AS (SELECT feature, ex, row_number() OVER (PARTITION BY feature ORDER BY v, l_orderkey, l_linenumber, ex) AS r FROM v), a AS (SELECT feature, (sum(r) FILTER (ex) - count(*) FILTER (ex) * (count(*) FILTER (ex) + 1) / 2) / (count(*) FILTER (ex)::DOUBLE * count(*) FILTER (NOT ex)) AS auc FROM r GROUP BY feature) SELECT feature, round(abs(auc - 0.5), 6) AS separation FROM a")
def separation(spark, d):
    """Ordinal ranks: ties go by the rows' keys. Ranks are offsets of distinct values plus places among equals."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols, (F.col("l_returnflag") == "R").alias("ex")).unpivot(["l_orderkey", "l_linenumber", "ex"], cols, "feature", "v")
    by = v.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    by = by.withColumn("o", F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    r = v.join(by, ["feature", "v"]).withColumn("r", F.col("o") + F.row_number().over(Window.partitionBy("feature", "v").orderBy("l_orderkey", "l_linenumber", "ex")))
    n, m = F.count_if("ex").cast("double"), F.count_if(~F.col("ex"))
    return r.groupBy("feature").agg(F.round(F.abs((F.sum(F.when(F.col("ex"), F.col("r"))) - n * (n + 1) / 2) / (n * m) - 0.5), 6).alias("separation"))


@register("one_vs_rest_permanova", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label, vec_id % 5)), q AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM e), z AS (SELECT vec_id, sqrt(sum(x * x)) AS z FROM q GROUP BY 1),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, any_value(a.label) AS la, any_value(b.label) AS lb, pow(1 - sum(a.x * b.x) / (any_value(za.z) * any_value(zb.z)), 2) AS d2 FROM q a JOIN q b ON a.k = b.k AND a.vec_id < b.vec_id JOIN z za ON za.vec_id = a.vec_id JOIN z zb ON zb.vec_id = b.vec_id GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), t AS (SELECT sum(n) AS m FROM n),
o AS (SELECT n.label, n.n, t.m, sum(d2) / any_value(t.m) AS sst, sum(d2) FILTER (la = n.label AND lb = n.label) / any_value(n.n) + sum(d2) FILTER (la <> n.label AND lb <> n.label) / any_value(t.m - n.n) AS ssw FROM d CROSS JOIN n CROSS JOIN t GROUP BY n.label, n.n, t.m) SELECT label, round((sst - ssw) / (ssw / (m - 2)), 5) AS pseudo_f, round((sst - ssw) / sst, 6) AS r2 FROM o""")
def one_vs_rest_permanova(spark, d):
    """Each label against all others; a few dozen items, a pass a label."""
    from functools import reduce

    e = table(spark, d, "embeddings")
    some = e.groupBy("label", F.col("vec_id") % 5).agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    items = e.join(F.broadcast(some), "vec_id").select("label", "embedding")
    labels = sorted(r["label"] for r in e.select("label").distinct().collect())
    each = [T.pseudo_f(items.withColumn("one", F.col("label") == x), "one", "embedding").select(F.lit(x).alias("label"), F.round("pseudo_f", 5).alias("pseudo_f"), F.round("r2", 6).alias("r2")) for x in labels]
    return reduce(lambda a, b: a.unionByName(b), each)


@register("discovery_strategies", SEGMENTS + ", s AS (SELECT id, (m >= 60)::INT AS pos, round(prob, 9) AS a, round(u, 9) AS b, CAST('0x' || substr(md5('q:' || id), 1, 12) AS BIGINT) AS r FROM g), o AS (SELECT 'probability' AS strategy, pos, row_number() OVER (ORDER BY a DESC, id) AS k FROM s UNION ALL SELECT 'uncertainty', pos, row_number() OVER (ORDER BY b DESC, id) FROM s UNION ALL SELECT 'random', pos, row_number() OVER (ORDER BY r, id) FROM s) SELECT strategy, sum(pos) FILTER (k <= 25)::BIGINT AS in_25, sum(pos) FILTER (k <= 100)::BIGINT AS in_100 FROM o GROUP BY strategy")
def discovery_strategies(spark, d):
    """Positives among the first 25 and 100 of each order: sorts with a limit."""
    s = segments(spark, d)[0].select("id", (F.col("m") >= 60).cast("int").alias("pos"), F.round("prediction_prob", 9).alias("a"), F.round("uncertainty_score", 9).alias("b"), R.draw_of(F.col("id"), "q").alias("r"))
    out = None
    for name, order in (("probability", F.desc("a")), ("uncertainty", F.desc("b")), ("random", F.asc("r"))):
        top = s.orderBy(order, "id").limit(100).withColumn("k", F.row_number().over(Window.orderBy(order, "id")))
        one = top.agg(F.lit(name).alias("strategy"), F.sum(F.when(F.col("k") <= 25, F.col("pos"))).alias("in_25"), F.sum("pos").alias("in_100"))
        out = one if out is None else out.unionByName(one)
    return out


@register("adjusted_intervals", BOUTS + ", z AS (SELECT user_id, max(frame) AS last FROM f GROUP BY 1), m AS (SELECT b.user_id, greatest(0, start_frame + 2) AS a, least(last, end_frame - 2) AS e FROM b JOIN z ON z.user_id = b.user_id) SELECT user_id, a AS start_frame, e AS end_frame FROM m WHERE a <= e")
def adjusted_intervals(spark, d):
    """Training intervals shrunk by two frames on both sides, inverted ones gone."""
    f = frames(spark, d).groupBy("user_id").agg(F.max("frame").alias("last"))
    return I.pad_intervals(bouts(spark, d).drop("mean_prob").join(f, "user_id"), -2, F.col("last")).drop("last")


@register("merged_reversed", CTE + ", r AS (SELECT user_id, frame AS a, frame + event_id % 9 - 4 AS z FROM f WHERE event_type = 'signup'), s AS (SELECT user_id, least(a, z) AS s, greatest(a, z) AS e FROM r), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM s), j AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(s) AS start_frame, max(e) AS end_frame FROM j GROUP BY user_id, k")
def merged_reversed(spark, d):
    """Intervals whose ends may be swapped, as their union; what touches is one."""
    r = frames(spark, d).where("event_type = 'signup'").select("user_id", F.col("frame").alias("a"), (F.col("frame") + F.col("event_id") % 9 - 4).alias("z"))
    return I.merge_intervals(r.select("user_id", F.least("a", "z").alias("start_frame"), F.greatest("a", "z").alias("end_frame")), S, 1, 1)


@register("wrapped_angles", "SELECT event_id, round(abs(atan2(sin(value), cos(value))), 6) AS a FROM events")
def wrapped_angles(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.abs(G.wrap_angle(F.col("value"))), 6).alias("a"))


@register("sorted_config_hash", "SELECT p_partkey, substr(sha256('{\"a\":' || p_size || ',\"b\":\"' || p_brand || '\",\"c\":' || p_partkey || '}'), 1, 16) AS hash FROM part")
def sorted_config_hash(spark, d):
    """The hash of a map, its keys in order, as compact JSON: whatever order they came in."""
    m = F.create_map(F.lit("c"), F.col("p_partkey").cast("string"), F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.concat(F.lit('"'), "p_brand", F.lit('"')))
    return table(spark, d, "part").select("p_partkey", L.config_hash(m).alias("hash"))


@register("welch_p")
def welch_p(spark, d):
    """Welch's t with its p; the degrees of freedom are no whole number, so the tests hold the tail."""
    g = table(spark, d, "events").where("event_type in ('view', 'click')").groupBy("event_type").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    p = g.groupBy().pivot("event_type", ["view", "click"]).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("v").alias("v"))
    a, b = F.col("view_v") / F.col("view_n"), F.col("click_v") / F.col("click_n")
    t = (F.col("view_m") - F.col("click_m")) / F.sqrt(a + b)
    df = (a + b) ** 2 / (a**2 / (F.col("view_n") - 1) + b**2 / (F.col("click_n") - 1))
    return p.select(t.alias("t"), df.alias("df")).select("t", "df", T.tail(lambda x, k: T.t_tail(x, k))(F.abs("t"), F.col("df")).alias("p"))


@register("cube_counts", "SELECT event_type, user_id % 3 AS grp, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_counts(spark, d):
    return table(spark, d, "events").withColumn("grp", F.col("user_id") % 3).cube("event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@register("grouping_sets", "SELECT event_type, user_id % 3 AS grp, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3))")
def grouping_sets(spark, d):
    e = table(spark, d, "events").withColumn("grp", F.col("user_id") % 3)
    return e.groupingSets([[F.col("event_type")], [F.col("grp")]], F.col("event_type"), F.col("grp")).agg(F.count(F.lit(1)).alias("n"))
