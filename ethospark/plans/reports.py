"""More queries over the supplied tables: prevalence, profiles, competition, mining, selection, tests. Stand-ins as in `behaviour`."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import intervals as I
from .behaviour import BOUTS, CTE, FPS, LABELLED, REGIONS, S, bouts, frames, labelled, padded_regions, r6, table
from .registry import register

SHARES = CTE + """, k AS (SELECT DISTINCT event_type FROM f), u AS (SELECT user_id, count(*) AS t FROM f GROUP BY 1), c AS (SELECT user_id, event_type, count(*) AS n FROM f GROUP BY 1, 2),
s AS (SELECT u.user_id, k.event_type, coalesce(n, 0) / t AS share FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = k.event_type)"""


def shares(spark, d):
    """Dense (user_id, event_type, share): absent behaviours are 0. The behaviours are few labels, one small row each."""
    f = frames(spark, d).select("user_id", "event_type")
    n = f.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("user_id").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    kinds = F.broadcast(f.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("kinds")))
    dense = t.join(kinds).select("user_id", "t", "m", F.explode("kinds").alias("event_type"))
    return dense.select("user_id", "event_type", (F.coalesce(F.element_at("m", F.col("event_type")), F.lit(0)) / F.col("t")).alias("share"))


@register("label_prevalence", SHARES + " SELECT event_type, round(avg(share), 6) AS prevalence, count(*) AS n_sessions FROM s GROUP BY 1")
def label_prevalence(spark, d):
    return shares(spark, d).groupBy("event_type").agg(F.round(F.avg("share"), 6).alias("prevalence"), F.count(F.lit(1)).alias("n_sessions"))


@register("zero_inflation", SHARES + """, q AS (SELECT event_type, quantile_cont(share, 0.9) AS active FROM s GROUP BY 1)
SELECT event_type, round(any_value(active), 6) AS active, round(avg((share < 0.05 * active)::INT), 6) AS silent, round(avg(share), 6) AS mean_all, round(avg(share) FILTER (share >= 0.05 * active), 6) AS mean_active, avg((share < 0.05 * active)::INT) >= 0.3 AS gated FROM s JOIN q USING (event_type) GROUP BY 1""")
def zero_inflation(spark, d):
    s = shares(spark, d)
    q = s.groupBy("event_type").agg(F.percentile("share", 0.9).alias("active"))
    silent = F.col("share") < 0.05 * F.col("active")
    part = F.avg(silent.cast("double"))
    out = s.join(q, "event_type").groupBy("event_type").agg(F.first("active").alias("active"), part.alias("silent"), F.avg("share").alias("mean_all"), F.avg(F.when(~silent, F.col("share"))).alias("mean_active"), (part >= 0.3).alias("gated"))
    return r6(out, "active", "silent", "mean_all", "mean_active")


@register("profile_distance", SHARES + """, m AS (SELECT event_type, median(share) AS md FROM s GROUP BY 1), p AS (SELECT event_type, md / sum(md) OVER () AS base FROM m)
SELECT user_id, round(CASE WHEN sum(share * share) = 0 OR sum(base * base) = 0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - sum(share * base) / sqrt(sum(share * share) * sum(base * base))) END, 6) AS distance FROM s JOIN p USING (event_type) GROUP BY 1""")
def profile_distance(spark, d):
    s = shares(spark, d)
    m = s.groupBy("event_type").agg(F.median("share").alias("md"))
    p = m.join(F.broadcast(m.agg(F.sum("md").alias("t")))).select("event_type", F.try_divide("md", "t").alias("base"))
    a, b, ab = (F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("share") ** 2, F.col("base") ** 2, F.col("share") * F.col("base")))
    out = s.join(p, "event_type").groupBy("user_id").agg(a.alias("a"), b.alias("b"), ab.alias("ab"))
    return out.select("user_id", F.round(F.when((F.col("a") == 0) | (F.col("b") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("ab") / F.sqrt(F.col("a") * F.col("b")))), 6).alias("distance"))


@register("entropy_margin", SHARES + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, event_type) AS r FROM s)
SELECT user_id, round(-sum(greatest(share, 1e-9::DOUBLE) * ln(greatest(share, 1e-9::DOUBLE))), 6) AS entropy, round(max(share) FILTER (r = 1) - max(share) FILTER (r = 2), 6) AS margin FROM r GROUP BY 1""")
def entropy_margin(spark, d):
    p = F.greatest(F.col("share"), F.lit(1e-9))
    top = F.sort_array(F.collect_list("share"), asc=False)
    out = shares(spark, d).groupBy("user_id").agg((-F.sum(p * F.log(p))).alias("entropy"), top.alias("top"))
    return out.select("user_id", F.round("entropy", 6).alias("entropy"), F.round(F.col("top")[0] - F.col("top")[1], 6).alias("margin"))


@register("peer_competition", SHARES + """, pc AS (SELECT user_id, max(share) FILTER (event_type = 'purchase') AS own, max(share) FILTER (event_type <> 'purchase') AS peer, avg(share) FILTER (event_type <> 'purchase') AS mean_peer, count(*) FILTER (event_type <> 'purchase' AND share >= 0.5) AS support FROM s GROUP BY 1)
SELECT user_id, round(peer, 6) AS peer, round(mean_peer, 6) AS mean_peer, support, round(own - peer, 6) AS margin, round(1 - least(abs(own - peer), 1), 6) AS uncertainty FROM pc""")
def peer_competition(spark, d):
    mine, share = F.col("event_type") == "purchase", F.col("share")
    c = shares(spark, d).groupBy("user_id").agg(F.max(F.when(mine, share)).alias("own"), F.max(F.when(~mine, share)).alias("peer"), F.avg(F.when(~mine, share)).alias("mean_peer"), F.count_if(~mine & (share >= 0.5)).alias("support"))
    gap = F.col("own") - F.col("peer")
    return r6(c.select("user_id", "peer", "mean_peer", "support", gap.alias("margin"), (1 - F.least(F.abs(gap), F.lit(1.0))).alias("uncertainty")), "peer", "mean_peer", "margin", "uncertainty")


@register("merged_regions", REGIONS + """, m AS (SELECT *, CASE WHEN start_frame <= max(end_frame) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM g),
j AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM j GROUP BY user_id, k""")
def merged_regions(spark, d):
    return I.merge_intervals(padded_regions(spark, d), S, 1, 1)


@register("negative_runs", CTE + """, o AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM f WHERE p < 0.3)
SELECT user_id, min(frame) AS start_frame, max(frame) AS end_frame FROM o GROUP BY user_id, k HAVING count(*) >= 4""")
def negative_runs(spark, d):
    f = frames(spark, d).withColumn("low", (F.col("p") < 0.3).cast("double"))
    return I.bouts_of_trace(f, S, "low", 0.5, 0, 4).select("user_id", "start_frame", "end_frame")


@register("binned_bouts", BOUTS + " SELECT user_id, (floor(start_frame / 30.0) * 30)::INT AS bin, count(*) AS n_bouts, round(sum(end_frame - start_frame + 1) / 30.0, 6) AS duration_s FROM b GROUP BY 1, 2")
def binned_bouts(spark, d):
    b = bouts(spark, d).groupBy("user_id", (F.floor(F.col("start_frame") / 30) * 30).cast("int").alias("bin"))
    return b.agg(F.count(F.lit(1)).alias("n_bouts"), F.round(F.sum(F.col("end_frame") - F.col("start_frame") + 1) / FPS, 6).alias("duration_s"))


@register("dyads", CTE + """, x AS (SELECT user_id // 4 AS pen, user_id, frame, value FROM f)
SELECT a.pen, a.user_id, a.frame, round(min(abs(a.value - b.value)), 6) AS nearest, round(avg(abs(a.value - b.value)), 6) AS mean_distance, count(*) AS others FROM x a JOIN x b ON a.pen = b.pen AND a.frame = b.frame AND a.user_id <> b.user_id GROUP BY 1, 2, 3""")
def dyads(spark, d):
    x = frames(spark, d).select(F.floor(F.col("user_id") / 4).alias("pen"), "frame", "user_id", "value")
    o = x.withColumnsRenamed({"user_id": "other", "value": "v"})
    gap = F.abs(F.col("value") - F.col("v"))
    return x.join(o, ["pen", "frame"]).where("user_id <> other").groupBy("pen", "user_id", "frame").agg(F.round(F.min(gap), 6).alias("nearest"), F.round(F.avg(gap), 6).alias("mean_distance"), F.count(F.lit(1)).alias("others"))


@register("range_mining", "SELECT l_orderkey, l_linenumber, round(((l_quantity BETWEEN 10 AND 30)::INT + (l_discount BETWEEN 0.015 AND 0.065)::INT + (l_tax <= 0.045)::INT) / 3.0, 6) AS score FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 OR l_discount BETWEEN 0.015 AND 0.065 OR l_tax <= 0.045")
def range_mining(spark, d):
    passed = [F.col("l_quantity").between(10, 30), F.col("l_discount").between(0.015, 0.065), F.col("l_tax") <= 0.045]
    rows = table(spark, d, "lineitem").where(passed[0] | passed[1] | passed[2])
    return rows.select("l_orderkey", "l_linenumber", F.round(sum((F.coalesce(c.cast("int"), F.lit(0)) for c in passed), F.lit(0)) / 3.0, 6).alias("score"))


@register("even_by_group", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, c_acctbal FROM customer) ORDER BY r, c_acctbal DESC, c_custkey LIMIT 60")
def even_by_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    # Rounds over the groups until 60 are taken: no group gives more than 60.
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 60").orderBy("r", F.desc("c_acctbal"), "c_custkey").limit(60).select("c_custkey")


@register("spatial_heatmap", "SELECT floor(value / 5)::INT AS gx, floor((event_id % 100) / 5.0)::INT AS gy, count(*) AS n FROM events GROUP BY 1, 2")
def spatial_heatmap(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("value") / 5).cast("int").alias("gx"), F.floor((F.col("event_id") % 100) / 5).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("n"))


@register("welch_t", """WITH g AS (SELECT count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n0, avg(p) FILTER (y = 1) AS m1, avg(p) FILTER (y = 0) AS m0, var_samp(p) FILTER (y = 1) / count(*) FILTER (y = 1) AS v1, var_samp(p) FILTER (y = 0) / count(*) FILTER (y = 0) AS v0 FROM l)
SELECT round((m1 - m0) / sqrt(v1 + v0), 5) AS t, round(pow(v1 + v0, 2) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)), 3) AS df FROM g""".replace("WITH g", "WITH " + LABELLED + ", g"))
def welch_t(spark, d):
    y, p = F.col("y"), F.col("p")
    g = labelled(spark, d).agg(*(x for k in (0, 1) for x in (F.count_if(y == k).alias(f"n{k}"), F.avg(F.when(y == k, p)).alias(f"m{k}"), (F.var_samp(F.when(y == k, p)) / F.count_if(y == k)).alias(f"v{k}"))))
    v = F.col("v1") + F.col("v0")
    return g.select(F.round((F.col("m1") - F.col("m0")) / F.sqrt(v), 5).alias("t"), F.round(v**2 / (F.col("v1") ** 2 / (F.col("n1") - 1) + F.col("v0") ** 2 / (F.col("n0") - 1)), 3).alias("df"))


@register("discovery_curve", "WITH " + LABELLED + " SELECT doc_id, source, row_number() OVER w AS rank, (sum(y) OVER (PARTITION BY source ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS found FROM l WINDOW w AS (PARTITION BY source ORDER BY p DESC, doc_id)")
def discovery_curve(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("p"), "doc_id")
    return labelled(spark, d).select("doc_id", "source", F.row_number().over(w).cast("long").alias("rank"), F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("found"))


@register("segment_parts", "SELECT event_id, 'a_session_' || user_id || '_' || event_id || '_' || (event_id + 15) AS segment_id, 'session_' || user_id AS session, event_id::BIGINT AS start_frame, (event_id + 15)::BIGINT AS end_frame FROM events")
def segment_parts(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws("_", F.lit("a_session"), "user_id", "event_id", F.col("event_id") + 15).alias("segment_id"))
    ends = r"_(\d+)_(\d+)$"
    return e.select("event_id", "segment_id", F.regexp_extract("segment_id", r"_(session_[^_]+)_", 1).alias("session"), *(F.regexp_extract("segment_id", ends, i).cast("long").alias(c) for i, c in ((1, "start_frame"), (2, "end_frame"))))


@register("unreviewed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unreviewed(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("config_hash", "SELECT c_custkey, substr(sha256('{\"key\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}'), 1, 16) AS hash FROM customer")
def config_hash(spark, d):
    compact = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")))
    return table(spark, d, "customer").select("c_custkey", F.substring(F.sha2(compact, 256), 1, 16).alias("hash"))
