"""Queries of labels, joins, filters, set operations and exports. Stand-ins as in `ranking`."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry as G
from ..operators import intervals as I, labels as L, metrics as M, windows as W
from .behaviour import BOUTS, CTE, FPS, S, SEEDS, bouts, frames, r6, seeds, table
from .ranking import SEGMENTS, reviews, segments
from .registry import register


@register("resolved_labels", SEGMENTS + """, r AS (SELECT id, list(DISTINCT label) AS ls, string_agg(DISTINCT reviewer, ',' ORDER BY reviewer) AS src, avg(confidence) AS conf FROM fb GROUP BY id), k AS (SELECT *, list_filter(ls, lambda x: x NOT IN ('ambiguous', 'boundary_error', 'no_behavior') AND NOT starts_with(x, 'not_')) AS told, list_filter(ls, lambda x: starts_with(x, 'not_') OR x = 'no_behavior') AS neg FROM r)
SELECT k.id, CASE WHEN len(told) = 1 THEN told[1] WHEN len(told) = 0 AND len(neg) = 1 THEN neg[1] ELSE 'ambiguous' END AS label, src AS label_source, round(conf, 6) AS reviewer_confidence, len(told) > 1 AS overlap_allowed FROM k JOIN g USING (id)""")
def resolved_labels(spark, d):
    seg = segments(spark, d)[0]
    return seg.select("id").join(r6(L.resolve(reviews(seg), "id"), "reviewer_confidence"), "id")


#: Labels of clips of 24 frames that start every 10: two cuts of windows of 16 are not whole, so the clip takes one.
_CLIPS = ", cl AS (SELECT user_id, 'clip_' || user_id || '_' || frame AS id, frame AS s, frame + 23 + frame % 30 AS e FROM f WHERE frame % 10 = 3 UNION ALL SELECT user_id, id, start_frame, end_frame FROM g WHERE win % 6 = 1)"


@register("remapped_labels", SEGMENTS + _CLIPS + """, ex AS (SELECT id, id AS segment FROM cl WHERE id IN (SELECT id FROM g)), pt AS (SELECT user_id, id, s + i.i * 16 AS a, s + i.i * 16 + 15 AS z FROM cl, LATERAL (SELECT unnest(range(0, (e - s + 1) // 16)) AS i) i WHERE id NOT IN (SELECT id FROM g)),
h AS (SELECT pt.id, pt.a, g.id AS segment, row_number() OVER (PARTITION BY pt.id, pt.a ORDER BY (g.start_frame <> a)::INT, least(g.end_frame, z) - greatest(g.start_frame, a) DESC, abs((g.start_frame + g.end_frame) // 2 - (a + z) // 2), g.start_frame) AS r FROM pt JOIN g ON g.user_id = pt.user_id AND g.start_frame <= z AND g.end_frame >= a),
m AS (SELECT id, segment FROM h WHERE r = 1) SELECT * FROM ex UNION ALL SELECT * FROM m UNION ALL SELECT id, id FROM cl WHERE id NOT IN (SELECT id FROM g) AND id NOT IN (SELECT id FROM m)""")
def remapped_labels(spark, d):
    seg = segments(spark, d)[0]
    f = frames(spark, d).where("frame % 10 = 3")
    clips = f.select("user_id", F.concat_ws("_", F.lit("clip"), "user_id", "frame").alias("id"), F.col("frame").alias("start_frame"), (F.col("frame") + 23 + F.col("frame") % 30).alias("end_frame"))
    clips = clips.unionByName(seg.where("win % 6 = 1").select("user_id", "id", "start_frame", "end_frame"))
    return L.remap(clips, seg.withColumnRenamed("id", "segment"), S, "segment")


@register("binary_targets", SEGMENTS + ", l AS (SELECT *, CASE WHEN prob >= 0.6 THEN 'purchase' WHEN win % 9 = 0 THEN 'ambiguous' ELSE 'view' END AS label FROM g) SELECT id, 1 AS y FROM l WHERE label = 'purchase' UNION ALL SELECT id, 0 FROM l WHERE label = 'view' AND NOT EXISTS (SELECT 1 FROM l p WHERE p.label = 'purchase' AND p.user_id = l.user_id AND p.start_frame <= l.end_frame AND p.end_frame >= l.start_frame)")
def binary_targets(spark, d):
    l = segments(spark, d)[0].withColumn("label", F.when(F.col("prediction_prob") >= 0.6, "purchase").when(F.col("win") % 9 == 0, "ambiguous").otherwise("view"))
    return L.binary_target(l, S, "purchase").select("id", "y")


_RV = ", rv AS (SELECT user_id, frame AS r_start, frame + 5 AS r_end, event_type AS review FROM f WHERE frame % 7 = 0)"


def interval_reviews(spark, d):
    return frames(spark, d).where("frame % 7 = 0").select("user_id", F.col("frame").alias("r_start"), (F.col("frame") + 5).alias("r_end"), F.col("event_type").alias("review"))


@register("majority_labels", SEGMENTS + _RV + """, h AS (SELECT g.id, review, count(*) AS n FROM g JOIN rv ON rv.user_id = g.user_id AND g.start_frame <= r_end AND g.end_frame >= r_start GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, review) AS r FROM h) SELECT id, CASE review WHEN 'purchase' THEN '1' WHEN 'click' THEN 'confound' ELSE '0' END AS label FROM k WHERE r = 1""")
def majority_labels(spark, d):
    return L.majority(segments(spark, d)[0], interval_reviews(spark, d), S, "purchase", {"click": "confound"})


@register("relabelled_segments", SEGMENTS + _RV + " SELECT id, CASE WHEN EXISTS (SELECT 1 FROM rv WHERE review = 'error' AND rv.user_id = g.user_id AND (start_frame + end_frame) // 2 BETWEEN r_start AND r_end) THEN 'not_purchase' ELSE 'purchase' END AS label FROM g")
def relabelled_segments(spark, d):
    l = segments(spark, d)[0].withColumn("label", F.lit("purchase"))
    return L.relabel(l, interval_reviews(spark, d).where("review = 'error'").drop("review"), S, "purchase").select("id", "label")


@register("coactive_clips", SEGMENTS + _RV + " SELECT g.id, coalesce((SELECT string_agg(DISTINCT review, '|' ORDER BY review) FROM rv WHERE rv.user_id = g.user_id AND (start_frame + end_frame) // 2 BETWEEN r_start AND r_end), '') AS labels FROM g")
def coactive_clips(spark, d):
    return L.at_centers(segments(spark, d)[0], interval_reviews(spark, d), S, "review").select("id", F.array_join("labels", "|").alias("labels"))


@register("fanned_labels", CTE + """, l AS (SELECT event_type AS behavior, 'a' || user_id % 3 AS focal, CASE WHEN event_id % 2 = 0 THEN 'a' || (user_id + 1) % 3 END AS partner, user_id AS session, frame // 10 * 10 AS s FROM f), e AS (SELECT behavior, focal AS animal, session, s FROM l UNION ALL SELECT behavior, partner, session, s FROM l WHERE partner IS NOT NULL AND behavior IN ('click', 'view'))
SELECT 'seg_' || animal || '_' || session || '_' || s || '_' || s + 9 AS segment_id, string_agg(DISTINCT behavior, '|' ORDER BY behavior) AS review_label FROM e GROUP BY 1""")
def fanned_labels(spark, d):
    u = F.col("user_id")
    animal = lambda c: F.concat(F.lit("a"), c % 3)
    start = F.floor(F.col("frame") / 10) * 10
    l = frames(spark, d).select(F.col("event_type").alias("behavior"), animal(u).alias("focal"), F.when(F.col("event_id") % 2 == 0, animal(u + 1)).alias("partner"), u.alias("session"), start.alias("start_frame"), (start + 9).alias("end_frame"))
    return L.fan_out(l, spark.createDataFrame([("click",), ("view",)], "behavior string"))


@register("replaced_labels", "SELECT doc_id, quality AS y, 'old' AS src FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1 - quality, 'a' FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, quality, 'b' FROM labels WHERE doc_id % 8 = 0")
def replaced_labels(spark, d):
    """New rows, two of them for some keys, in place of all old rows of these keys."""
    l = table(spark, d, "labels")
    new = l.where("doc_id % 4 = 0").select("doc_id", (1 - F.col("quality")).alias("y"), F.lit("a").alias("src")).unionByName(l.where("doc_id % 8 = 0").select("doc_id", F.col("quality").alias("y"), F.lit("b").alias("src")))
    return L.replace_labels(l.select("doc_id", F.col("quality").alias("y"), F.lit("old").alias("src")), new, "doc_id")


@register("training_upsert", "WITH n AS (SELECT doc_id, quality + 10 AS y, toxic AS seq FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, quality + 20, toxic + 5 FROM labels WHERE doc_id % 6 = 0) SELECT doc_id, max_by(y, seq) AS y FROM n GROUP BY doc_id UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0")
def training_upsert(spark, d):
    """Last wins by sequence among new rows, new over old; the distance columns' spelling is `canonical_distances`."""
    l = table(spark, d, "labels")
    new = l.where("doc_id % 3 = 0").select("doc_id", (F.col("quality") + 10).alias("y"), F.col("toxic").alias("seq")).unionByName(l.where("doc_id % 6 = 0").select("doc_id", (F.col("quality") + 20).alias("y"), (F.col("toxic") + 5).alias("seq")))
    return L.upsert(l.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("seq")), new, "doc_id", "seq").select("doc_id", "y")


@register("deleted_decisions", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_decisions(spark, d):
    l = table(spark, d, "labels")
    return l.join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


@register("reviewed_ids", "SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL INTERSECT SELECT doc_id FROM documents")
def reviewed_ids(spark, d):
    return table(spark, d, "labels").where("quality is not null").select("doc_id").distinct().intersect(table(spark, d, "documents").select("doc_id"))


@register("unreviewed_queue", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unreviewed_queue(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id").distinct()).distinct()


@register("pruned_sessions", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pruned_sessions(spark, d):
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").select("event_id", "user_id").join(keep, "user_id", "left_semi").select("event_id", "user_id")


@register("imported_rows", "SELECT s_suppkey + 1000000 AS id, 'imported:lab' AS label_source, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, 'own', c_acctbal FROM customer")
def imported_rows(spark, d):
    """Own rows and those of another project, tagged, with the columns both have."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("own").alias("label_source"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("only_here"))
    other = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("imported:lab").alias("label_source"), F.col("s_acctbal").alias("balance"))
    shared = [c for c in own.columns if c in other.columns]
    return own.select(*shared).unionByName(other.select(*shared))


_SRC = "SELECT l_orderkey, l_linenumber, l_suppkey AS session, CASE l_linenumber % 4 WHEN 0 THEN 'imported:x' WHEN 1 THEN 'temporal_feedback' WHEN 2 THEN 'imported:y' ELSE 'r1' END AS label_source FROM lineitem"


def sourced(spark, d):
    n = F.col("l_linenumber") % 4
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("session"), F.when(n == 0, "imported:x").when(n == 1, "temporal_feedback").when(n == 2, "imported:y").otherwise("r1").alias("label_source"))


@register("scoped_training", f"WITH s AS ({_SRC}) SELECT l_orderkey, l_linenumber, label_source FROM s WHERE session <= 20 OR starts_with(label_source, 'imported:')")
def scoped_training(spark, d):
    s = sourced(spark, d)
    return L.scope(s, table(spark, d, "supplier").where("s_suppkey <= 20").select(F.col("s_suppkey").alias("session")), "session", True).select("l_orderkey", "l_linenumber", "label_source")


@register("removed_import", f"WITH s AS ({_SRC}) SELECT label_source, count(*) AS n, label_source = 'temporal_feedback' OR starts_with(label_source, 'imported:') AS refine_only FROM s WHERE label_source <> 'imported:x' GROUP BY label_source")
def removed_import(spark, d):
    """Without one import, by its exact tag; what is left by source, with whether it may only refine."""
    s = sourced(spark, d).where("label_source <> 'imported:x'")
    return s.groupBy("label_source").agg(F.count(F.lit(1)).alias("n")).withColumn("refine_only", F.col("label_source").isin("temporal_feedback") | F.col("label_source").startswith("imported:"))


@register("stripped_labels", "WITH d AS (SELECT min(split_part(p_name, ' ', 1)) AS dead FROM part), w AS (SELECT p_partkey, k.k, trim(string_split(p_name, ' ')[k.k]) AS w FROM part, LATERAL (SELECT unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS k) k) SELECT p.p_partkey, string_agg(w, '|' ORDER BY k) FILTER (w <> '' AND w <> dead) AS label FROM part p LEFT JOIN w ON w.p_partkey = p.p_partkey CROSS JOIN d GROUP BY p.p_partkey")
def stripped_labels(spark, d):
    p = table(spark, d, "part")
    dead = p.agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1)))).first()[0] or ""
    return p.select("p_partkey", L.strip_label(F.replace("p_name", F.lit(" "), F.lit(" | ")), dead).alias("label"))


@register("duplicate_sessions", "WITH g AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal, -3) AS size, min(c_custkey) AS keep, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1) SELECT c.c_custkey AS removed, g.keep, n FROM customer c JOIN g ON c.c_nationkey = g.c_nationkey AND c.c_mktsegment = g.c_mktsegment AND round(c.c_acctbal, -3) = g.size WHERE c.c_custkey <> g.keep")
def duplicate_sessions(spark, d):
    """Sessions of one recording: each is mapped to the first."""
    c = table(spark, d, "customer").withColumn("size", F.round("c_acctbal", -3))
    w = Window.partitionBy("c_nationkey", "c_mktsegment", "size")
    q = c.select(F.col("c_custkey").alias("removed"), F.min("c_custkey").over(w).alias("keep"), F.count(F.lit(1)).over(w).alias("n"))
    return q.where("n > 1 and removed <> keep")


@register("remapped_ids", "WITH m AS (SELECT c_custkey AS old, c_custkey + 7 AS new FROM customer WHERE c_custkey % 5 = 0) SELECT event_id, coalesce(new, user_id) AS user_id FROM events LEFT JOIN m ON old = user_id")
def remapped_ids(spark, d):
    m = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 7).alias("new"))
    return table(spark, d, "events").select("event_id", "user_id").join(m, "user_id", "left").select("event_id", F.coalesce("new", "user_id").alias("user_id"))


@register("label_counts", "WITH a AS (SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'no_behavior' ELSE event_type END AS label FROM events WHERE value >= 20 UNION ALL SELECT event_type FROM events WHERE user_id % 2 = 0 AND event_type NOT IN ('error', 'signup') UNION ALL SELECT 'no_behavior' FROM events WHERE user_id % 2 = 0 AND event_type IN ('error', 'signup')) SELECT label, count(*) AS n FROM a GROUP BY ROLLUP (label)")
def label_counts(spark, d):
    """Accepted decisions and segment labels together, spellings of no behaviour as one, with a grand total."""
    e = table(spark, d, "events").select("user_id", "value", F.when(F.col("event_type").isin("error", "signup"), "no_behavior").otherwise(F.col("event_type")).alias("label"))
    return e.where("value >= 20").select("label").unionByName(e.where("user_id % 2 = 0").select("label")).rollup("label").agg(F.count(F.lit(1)).alias("n"))


@register("essence_check", SEGMENTS + """, v AS (SELECT id, CASE WHEN win % 4 <> 1 THEN m END AS m, CASE WHEN win % 4 <> 2 AND win % 4 <> 1 THEN sd END AS sd FROM g), k AS (SELECT id, m BETWEEN 20 AND 70 AS a, sd BETWEEN 10 AND 60 AS b FROM v)
SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'no_data' WHEN coalesce(a, true) AND coalesce(b, true) THEN 'pass' ELSE 'fail' END AS verdict, (coalesce(a, false)::INT + coalesce(b, false)::INT) / 2 AS score, concat_ws(',', CASE WHEN NOT a THEN 'm' END, CASE WHEN NOT b THEN 'sd' END) AS violations FROM k""")
def essence_check(spark, d):
    w = F.col("win") % 4
    v = segments(spark, d)[0].select("id", F.when(w != 1, F.col("m")).alias("m"), F.when((w != 2) & (w != 1), F.col("sd")).alias("sd"))
    return L.check_ranges(v, {"m": (20, 70), "sd": (10, 60)}).select("id", "verdict", "score", "violations")


@register("mined_all", SEGMENTS + " SELECT id FROM g WHERE m BETWEEN 30 AND 60 AND sd BETWEEN 20 AND 50")
def mined_all(spark, d):
    return L.check_ranges(segments(spark, d)[0], {"m": (30, 60), "sd": (20, 50)}).where("score = 1").select("id")


@register("mined_ranked", SEGMENTS + " SELECT id, ((m BETWEEN 30 AND 60)::INT + (sd BETWEEN 20 AND 50)::INT) / 2 AS score FROM g ORDER BY score DESC, id LIMIT 50")
def mined_ranked(spark, d):
    """Everything by share of criteria passed: the report's first 50."""
    return L.check_ranges(segments(spark, d)[0], {"m": (30, 60), "sd": (20, 50)}).select("id", "score").orderBy(F.desc("score"), "id").limit(50)


@register("contrast_bounds")
def contrast_bounds(spark, d):
    """Greedy bounds that part exemplars from the rest; a loop holds them in the tests."""
    g = segments(spark, d)[0].withColumn("ex", F.col("mx") >= 150)
    rows = L.contrast(g.where("ex"), g.where("not ex"), ["m", "sd", "mx"])
    return spark.createDataFrame([(i, c, op, float(v)) for i, (c, op, v) in enumerate(rows)], "step int, column string, op string, value double")


_COVERAGE = "SELECT l_suppkey % 4 AS session, 'tax' AS feature, CASE WHEN l_suppkey % 4 <> 1 THEN l_tax END AS v FROM lineitem UNION ALL SELECT l_suppkey % 4, 'flat', CASE WHEN l_suppkey % 4 = 2 THEN 1.0 ELSE l_quantity END FROM lineitem UNION ALL SELECT l_suppkey % 4, 'quantity', l_quantity FROM lineitem"


@register("session_coverage", f"""WITH v AS ({_COVERAGE}), s AS (SELECT session, feature, CASE WHEN count(v) = 0 THEN 'missing' WHEN coalesce(stddev_pop(v), 0) < 1e-12 THEN 'constant' ELSE 'varies' END AS state FROM v GROUP BY ALL), a AS (SELECT feature, state, string_agg(session::VARCHAR, ',' ORDER BY session) AS sessions FROM s WHERE state <> 'varies' AND feature IN (SELECT feature FROM s WHERE state = 'varies') GROUP BY ALL) SELECT state AS reason, sessions, string_agg(feature, ',' ORDER BY feature) AS features FROM a GROUP BY ALL""")
def session_coverage(spark, d):
    """Columns that are all missing or constant in some sessions and vary in others, grouped by reason and sessions."""
    s = F.col("l_suppkey") % 4
    wide = table(spark, d, "lineitem").select(s.alias("session"), F.when(s != 1, F.col("l_tax")).alias("tax"), F.when(s == 2, 1.0).otherwise(F.col("l_quantity")).alias("flat"), F.col("l_quantity").alias("quantity"))
    v = wide.unpivot(["session"], ["tax", "flat", "quantity"], "feature", "v")
    st = v.groupBy("session", "feature").agg(F.when(F.count("v") == 0, "missing").when(F.coalesce(F.stddev_pop("v"), F.lit(0.0)) < 1e-12, "constant").otherwise("varies").alias("state"))
    varies = st.where("state = 'varies'").select("feature").distinct()
    a = st.where("state <> 'varies'").join(varies, "feature", "left_semi").groupBy("feature", F.col("state").alias("reason")).agg(F.array_join(F.array_sort(F.collect_list(F.col("session").cast("string"))), ",").alias("sessions"))
    return a.groupBy("reason", "sessions").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))


@register("pose_context_join", CTE + ", c AS (SELECT user_id, frame, value * 2 AS ctx FROM f WHERE frame % 3 <> 1) SELECT f.event_id, round(c.ctx, 6) AS ctx FROM f JOIN c ON c.user_id = f.user_id AND c.frame = f.frame")
def pose_context_join(spark, d):
    f = frames(spark, d)
    return f.join(f.where("frame % 3 <> 1").select("user_id", "frame", F.round(F.col("value") * 2, 6).alias("ctx")), ["user_id", "frame"]).select("event_id", "ctx")


@register("embedding_attach", "SELECT d.doc_id, len(e.embedding) AS dims, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_attach(spark, d):
    """Embeddings stay arrays; ids without one keep nulls."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dims"), "label")
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left")


@register("dense_embeddings", CTE + """, a AS (SELECT user_id, frame, value, p FROM f WHERE frame % 5 = 0), q AS (SELECT f.user_id, f.frame, f.frame // 5 * 5 AS lo, f.frame // 5 * 5 + 5 AS hi FROM f) SELECT q.user_id, q.frame, round(CASE WHEN h.value IS NULL THEN l.value ELSE l.value + (h.value - l.value) * (q.frame - lo) / 5 END, 6) AS e0, round(CASE WHEN h.p IS NULL THEN l.p ELSE l.p + (h.p - l.p) * (q.frame - lo) / 5 END, 6) AS e1 FROM q JOIN a l ON l.user_id = q.user_id AND l.frame = q.lo LEFT JOIN a h ON h.user_id = q.user_id AND h.frame = q.hi""")
def dense_embeddings(spark, d):
    """Vectors known at every fifth frame, blended between the anchors before and behind; past the last one it holds."""
    f = frames(spark, d)
    at = F.when(F.col("frame") % 5 == 0, F.struct("frame", F.array("value", "p").alias("v")))
    w = Window.partitionBy("user_id").orderBy("frame")
    q = f.withColumns({"a": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    t = F.when(F.col("b.frame") > F.col("a.frame"), (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))).otherwise(0.0)
    v = F.when(F.col("b").isNull(), F.col("a.v")).otherwise(F.zip_with("a.v", "b.v", lambda x, z: x + (z - x) * t))
    return q.withColumn("v", v).select("user_id", "frame", F.round(F.col("v")[0], 6).alias("e0"), F.round(F.col("v")[1], 6).alias("e1"))


@register("random_absent", SEGMENTS + SEEDS.replace("t AS", "tt AS") + " SELECT id FROM g WHERE NOT EXISTS (SELECT 1 FROM tt WHERE tt.user_id = g.user_id AND r_start <= end_frame AND r_end >= start_frame) ORDER BY md5('ra:' || id), id LIMIT 20")
def random_absent(spark, d):
    """Segments that overlap no accepted interval, 20 of them by a seeded draw."""
    free = I.overlap_join(segments(spark, d)[0], seeds(spark, d), S, "left_anti", 16)
    return free.select("id").orderBy(F.md5(F.concat(F.lit("ra:"), "id")), "id").limit(20)


@register("clip_dissimilarity", SEGMENTS + """, v AS (SELECT id, unnest(['m', 'sd', 'mx']) AS k, unnest([CASE WHEN win % 5 <> 2 THEN m END, sd, mx]) AS v FROM g), i AS (SELECT id, k, coalesce(v, median(v) OVER (PARTITION BY k)) AS v FROM v), z AS (SELECT id, coalesce((v - avg(v) OVER (PARTITION BY k)) / nullif(stddev_pop(v) OVER (PARTITION BY k), 0), 0) AS z FROM i), nn AS (SELECT id, sqrt(sum(z * z)) AS n FROM z GROUP BY id), s AS (SELECT id, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS s FROM nn)
SELECT id, round(s, 6) AS score, s >= (SELECT quantile_cont(s, 0.9) FROM s) - 1e-12 AS outlier FROM s""")
def clip_dissimilarity(spark, d):
    """Distance from the mean clip over standardised features, medians for what is missing, 0 to 1; the last tenth stands out."""
    cols = ["m", "sd", "mx"]
    g = segments(spark, d)[0].select("id", F.when(F.col("win") % 5 != 2, F.col("m")).alias("m"), "sd", "mx")
    g = g.join(F.broadcast(g.agg(*(F.median(c).alias(f"q_{c}") for c in cols)))).select("id", *(F.coalesce(c, f"q_{c}").alias(c) for c in cols))
    st = F.broadcast(g.agg(*(F.avg(c).alias(f"a_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)))
    z = [F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in cols]
    n = g.join(st).select("id", F.sqrt(z[0] * z[0] + z[1] * z[1] + z[2] * z[2]).alias("n"))
    lim = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.percentile("n", 0.9).alias("cut"))
    return n.join(F.broadcast(lim)).select("id", F.round((F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("score"), (F.col("n") >= F.col("cut") - 1e-12 * (F.col("hi") - F.col("lo"))).alias("outlier"))


@register("clip_metrics", SEGMENTS + """, pt AS (SELECT w.user_id, w.win, f.frame, f.value AS x, (f.event_id % 100)::DOUBLE AS y FROM w JOIN f ON f.user_id = w.user_id AND f.frame BETWEEN w.win * 4 AND w.win * 4 + 15), st AS (SELECT *, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS step, (x BETWEEN 20 AND 60)::INT AS inside, lag((x BETWEEN 20 AND 60)::INT) OVER o AS before FROM pt WINDOW o AS (PARTITION BY user_id, win ORDER BY frame)),
m AS (SELECT user_id, win, avg(step) * 30 AS mean_speed, max(step) * 30 AS max_speed, avg((step < 20)::INT) FILTER (step IS NOT NULL) AS immobile, sum(step) AS path, sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS disp, (max(x) - min(x)) * (max(y) - min(y)) AS area, avg(inside) AS roi, count(*) FILTER (inside = 1 AND before = 0) AS entries FROM st GROUP BY user_id, win)
SELECT 'seg_' || user_id || '_' || win * 4 || '_' || win * 4 + 15 AS id, round(mean_speed, 4) AS mean_speed, round(max_speed, 4) AS max_speed, round(immobile, 6) AS immobile_fraction, round(path, 4) AS path, round(disp, 4) AS displacement, round(path / nullif(disp, 0), 4) AS tortuosity, round(area, 3) AS area, round(roi, 6) AS roi_fraction, entries AS roi_entries FROM m""")
def clip_metrics(spark, d):
    """Speeds, path, displacement, tortuosity, area and region entries of each clip."""
    x = W.hopping_windows(frames(spark, d).select("user_id", "frame", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y")), S, 16, 4)
    w = Window.partitionBy("user_id", "window").orderBy("frame")
    inside = F.col("x").between(20, 60).cast("int")
    st = x.withColumns({"step": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), "inside": inside, "before": F.lag(inside).over(w)})
    m = st.groupBy("user_id", "window").agg((F.avg("step") * 30).alias("mean_speed"), (F.max("step") * 30).alias("max_speed"), F.avg((F.col("step") < 20).cast("int")).alias("immobile_fraction"), F.sum("step").alias("path"), F.hypot(F.max_by("x", "frame") - F.min_by("x", "frame"), F.max_by("y", "frame") - F.min_by("y", "frame")).alias("displacement"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"), F.avg("inside").alias("roi_fraction"), F.count_if((F.col("inside") == 1) & (F.col("before") == 0)).alias("roi_entries"))
    m = m.withColumn("tortuosity", F.col("path") / F.nullif("displacement", F.lit(0.0)))
    digits = {"mean_speed": 4, "max_speed": 4, "immobile_fraction": 6, "path": 4, "displacement": 4, "tortuosity": 4, "area": 3, "roi_fraction": 6}
    return m.select(F.concat_ws("_", F.lit("seg"), "user_id", F.col("window") * 4, F.col("window") * 4 + 15).alias("id"), "roi_entries", *(F.round(c, n).alias(c) for c, n in digits.items()))


# Exports.
@register("review_export", BOUTS + " SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) AS bout, start_frame, end_frame, end_frame - start_frame + 1 AS duration_frames, round(start_frame / 30.0, 4) AS start_s FROM b")
def review_export(spark, d):
    w = Window.partitionBy("user_id").orderBy("start_frame")
    return bouts(spark, d).select("user_id", F.row_number().over(w).alias("bout"), "start_frame", "end_frame", (F.col("end_frame") - F.col("start_frame") + 1).alias("duration_frames"), F.round(F.col("start_frame") / FPS, 4).alias("start_s"))


#: A bout belongs to the event type of its first frame.
TYPED = BOUTS + ", tb AS (SELECT b.*, f.event_type AS behavior FROM b JOIN f ON f.user_id = b.user_id AND f.frame = b.start_frame)"
TYPES = ("click", "error", "purchase", "signup", "view")


def typed(spark, d):
    f = frames(spark, d).select("user_id", F.col("frame").alias("start_frame"), F.col("event_type").alias("behavior"))
    return bouts(spark, d).join(f, ["user_id", "start_frame"])


@register("bout_counts", TYPED + " SELECT user_id, " + ", ".join(f"count(*) FILTER (behavior = '{t}') AS {t}" for t in TYPES) + ", count(*) AS total FROM tb GROUP BY user_id")
def bout_counts(spark, d):
    p = typed(spark, d).groupBy("user_id").pivot("behavior", list(TYPES)).count().fillna(0, list(TYPES))
    return p.select("user_id", *TYPES, sum((F.col(t) for t in TYPES[1:]), F.col(TYPES[0])).alias("total"))


@register("bout_frame_columns", TYPED + ", r AS (SELECT user_id, behavior, start_frame, row_number() OVER (PARTITION BY user_id, behavior ORDER BY start_frame) AS place FROM tb) SELECT user_id, place, " + ", ".join(f"max(start_frame) FILTER (behavior = '{t}') AS {t}" for t in TYPES) + " FROM r GROUP BY user_id, place")
def bout_frame_columns(spark, d):
    """Starts of each behaviour's bouts side by side, padded with nulls to the longest."""
    r = typed(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("user_id", "behavior").orderBy("start_frame")))
    return r.groupBy("user_id", "place").pivot("behavior", list(TYPES)).agg(F.max("start_frame"))


@register("frame_matrix", TYPED + ", m AS (SELECT user_id, max(end_frame) AS z FROM tb GROUP BY 1) SELECT m.user_id, g.g AS frame, " + ", ".join(f"coalesce(max((tb.behavior = '{t}')::INT), 0) AS {t}" for t in TYPES) + " FROM m, LATERAL (SELECT unnest(range(0, m.z + 1)) AS g) g LEFT JOIN tb ON tb.user_id = m.user_id AND g.g BETWEEN tb.start_frame AND tb.end_frame GROUP BY ALL")
def frame_matrix(spark, d):
    """0/1 by frame and behaviour up to the last end."""
    b = typed(spark, d)
    on = b.select("user_id", "behavior", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).groupBy("user_id", "frame").pivot("behavior", list(TYPES)).agg(F.lit(1))
    grid = b.groupBy("user_id").agg(F.max("end_frame").alias("z")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), "z")).alias("frame"))
    return grid.join(on, ["user_id", "frame"], "left").fillna(0, list(TYPES))


@register("behaviogram", BOUTS + " SELECT user_id, string_agg(start_frame || '-' || greatest(start_frame, end_frame), ';' ORDER BY start_frame) AS intervals, max(end_frame) AS max_end_frame FROM b GROUP BY user_id")
def behaviogram(spark, d):
    i = F.array_sort(F.collect_list(F.struct("start_frame", F.greatest("start_frame", "end_frame").alias("e"))))
    g = bouts(spark, d).groupBy("user_id").agg(i.alias("i"), F.max("end_frame").alias("max_end_frame"))
    return g.select("user_id", F.array_join(F.transform("i", lambda x: F.concat_ws("-", x["start_frame"], x["e"])), ";").alias("intervals"), "max_end_frame")


@register("session_behavior_summary", TYPED + ", ds AS (SELECT user_id, frame, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) AS s FROM f), k AS (SELECT tb.user_id, tb.behavior, tb.start_frame, tb.end_frame, coalesce(sum(ds.s), 0) AS dist FROM tb LEFT JOIN ds ON ds.user_id = tb.user_id AND ds.frame > tb.start_frame AND ds.frame <= tb.end_frame GROUP BY ALL) SELECT user_id, behavior, count(*) AS n_bouts, round(sum(end_frame - start_frame + 1) / 30.0, 6) AS time_spent_s, round(avg(end_frame - start_frame + 1) / 30.0, 6) AS mean_bout_s, round(min(start_frame) / 30.0, 6) AS latency_s, round(sum(dist) / 10, 6) AS distance_cm FROM k GROUP BY user_id, behavior")
def session_behavior_summary(spark, d):
    """Distance at ten pixels a centimetre, over the steps inside a bout: a difference of running sums at its ends."""
    w = Window.partitionBy("user_id").orderBy("frame")
    f = frames(spark, d).withColumn("s", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0))).select("user_id", "frame", F.sum("s").over(w).alias("run"))
    a, z = (f.select("user_id", F.col("frame").alias(c), F.col("run").alias(n)) for c, n in (("start_frame", "ra"), ("end_frame", "rz")))
    k = typed(spark, d).join(a, ["user_id", "start_frame"]).join(z, ["user_id", "end_frame"])
    n = F.col("end_frame") - F.col("start_frame") + 1
    return k.groupBy("user_id", "behavior").agg(F.count(F.lit(1)).alias("n_bouts"), F.round(F.sum(n) / FPS, 6).alias("time_spent_s"), F.round(F.avg(n) / FPS, 6).alias("mean_bout_s"), F.round(F.min("start_frame") / FPS, 6).alias("latency_s"), F.round(F.sum(F.col("rz") - F.col("ra")) / 10, 6).alias("distance_cm"))


@register("binned_bout_summary", TYPED + " SELECT user_id, behavior, (start_frame // 30) AS time_bin_s, count(*) AS n_bouts, round(sum(end_frame - start_frame + 1) / 30.0, 6) AS duration_s, round(avg(end_frame - start_frame + 1) / 30.0, 6) AS mean_bout_s FROM tb GROUP BY ALL")
def binned_bout_summary(spark, d):
    """A bout counts in the bin it starts in."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    return typed(spark, d).groupBy("user_id", "behavior", F.floor(F.col("start_frame") / 30).alias("time_bin_s")).agg(F.count(F.lit(1)).alias("n_bouts"), F.round(F.sum(n) / FPS, 6).alias("duration_s"), F.round(F.avg(n) / FPS, 6).alias("mean_bout_s"))


@register("roster_summary", BOUTS + ", s AS (SELECT user_id, count(*) AS n, sum(end_frame - start_frame + 1) / 30.0 AS t, avg(end_frame - start_frame + 1) / 30.0 AS m FROM b GROUP BY 1) SELECT c_custkey AS subject, coalesce(n, 0) AS n_bouts, round(coalesce(t, 0), 6) AS time_s, round(m, 6) AS mean_bout_s FROM customer LEFT JOIN s ON user_id = c_custkey")
def roster_summary(spark, d):
    """Every subject of the roster; without bouts counts and times are 0 and the mean is null."""
    s = I.bout_metrics(bouts(spark, d), S, FPS).select(F.col("user_id").alias("subject"), "n_bouts", "time_s", "mean_bout_s")
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("subject")).join(s, "subject", "left")
    return out.select("subject", F.coalesce("n_bouts", F.lit(0)).alias("n_bouts"), F.round(F.coalesce("time_s", F.lit(0.0)), 6).alias("time_s"), F.round("mean_bout_s", 6).alias("mean_bout_s"))


_BINS = (0, 30, 60, 90)


@register("roster_wide_bins", BOUTS + ", e AS (SELECT user_id, least(start_frame // 30 * 30, 90) AS bin FROM b) SELECT c_custkey AS subject, " + ", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in _BINS) + ", count(bin) AS total FROM customer LEFT JOIN e ON user_id = c_custkey GROUP BY c_custkey")
def roster_wide_bins(spark, d):
    """Bouts by the bin they start in, side by side, the last bin open, with a total; subjects without any have zeros."""
    e = bouts(spark, d).select(F.col("user_id").alias("subject"), F.least(F.floor(F.col("start_frame") / 30) * 30, F.lit(90)).alias("bin"))
    p = e.groupBy("subject").pivot("bin", list(_BINS)).count()
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("subject")).join(p, "subject", "left").fillna(0)
    return out.select("subject", *(F.col(str(k)).alias(f"b{k}") for k in _BINS), sum((F.col(str(k)) for k in _BINS[1:]), F.col("0")).alias("total"))


# Geometry and formats.
@register("box_ious", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax * 100 AS b, l_discount * 100 AS c FROM lineitem), i AS (SELECT *, greatest(0, least(a + 5, b + 12) - greatest(a, b)) * greatest(0, least(c + 6, 9) - greatest(c, 2)) AS inter FROM x) SELECT l_orderkey, l_linenumber, round(inter / (5 * 6 + 12 * 7 - inter), 6) AS iou FROM i")
def box_ious(spark, d):
    a, b, c = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(G.box_iou(a, c, a + 5, c + 6, b, F.lit(2.0), b + 12, F.lit(9.0)), 6).alias("iou"))


@register("significant_digits", "SELECT event_id, CASE WHEN abs(v) < 1e-9 THEN 0 ELSE round(v, (2 - floor(log10(abs(v))))::INT) END AS v FROM (SELECT event_id, (value - 50) / 7 AS v FROM events)")
def significant_digits(spark, d):
    return table(spark, d, "events").select("event_id", G.significant((F.col("value") - 50) / 7, 3).alias("v"))


@register("formatted_durations", "WITH v AS (SELECT event_id, greatest(0, CASE event_id % 4 WHEN 0 THEN value - 300 WHEN 1 THEN value / 400 WHEN 2 THEN value * 9 ELSE value * 120 END) AS s FROM events) SELECT event_id, CASE WHEN s < 1 THEN 'ms' WHEN s < 60 THEN 's' WHEN s < 3600 THEN floor(s / 60)::INT || 'm ' || lpad((floor(s)::INT % 60)::VARCHAR, 2, '0') || 's' ELSE floor(s / 3600)::INT || 'h ' || lpad((floor(s)::INT % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS t FROM v")
def formatted_durations(spark, d):
    """Under a minute only the unit is compared: printf rounds halves its own way."""
    k, v = F.col("event_id") % 4, F.col("value")
    s = F.when(k == 0, v - 300).when(k == 1, v / 400).when(k == 2, v * 9).otherwise(v * 120)
    t = G.format_duration(s)
    return table(spark, d, "events").select("event_id", F.when(t.endswith(" ms"), "ms").when(t.rlike(r"\. ?\d s$|\d s$"), "s").otherwise(t).alias("t"))


@register("scaled_coordinates", "SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN value ELSE value * 640.0 / CASE WHEN user_id % 3 = 1 THEN 640 ELSE 1280 END END, 6) AS x FROM events")
def scaled_coordinates(spark, d):
    u = F.col("user_id") % 3
    width = F.when(u == 1, F.lit(640.0)).when(u == 2, F.lit(1280.0))
    return table(spark, d, "events").select("event_id", F.round(G.scale_coordinate(F.col("value"), width, F.lit(640.0)), 6).alias("x"))


POLYGON = ((10.0, 10.0), (80.0, 20.0), (60.0, 70.0), (20.0, 60.0))
_EDGES = list(zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
_INSIDE = " + ".join(f"((({a[1]} > y) <> ({b[1]} > y)) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]})::INT" for a, b in _EDGES)


def _edge(a, b):
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = f"greatest(0, least(1, ((x - {a[0]}) * {b[0] - a[0]} + (y - {a[1]}) * {b[1] - a[1]}) / {n}::DOUBLE))"
    return f"sqrt(pow(x - ({a[0]} + {t} * {b[0] - a[0]}), 2) + pow(y - ({a[1]} + {t} * {b[1] - a[1]}), 2))"


@register("polygon_regions", f"WITH q AS (SELECT event_id, value AS x, (event_id % 100)::DOUBLE AS y FROM events) SELECT event_id, ({_INSIDE}) % 2 = 1 AS inside, round(least({', '.join(_edge(a, b) for a, b in _EDGES)}) * CASE WHEN ({_INSIDE}) % 2 = 1 THEN 1 ELSE -1 END, 5) AS signed, round(sqrt(pow(x - 42.5, 2) + pow(y - 40.0, 2)), 5) AS to_center, round(atan2(40.0 - y, 42.5 - x), 5) AS bearing FROM q")
def polygon_regions(spark, d):
    x, y = F.col("value"), (F.col("event_id") % 100).cast("double")
    inside = G.polygon_contains(x, y, POLYGON)
    cx, cy = G.polygon_center(POLYGON)
    return table(spark, d, "events").select("event_id", inside.alias("inside"), F.round(G.polygon_signed_distance(x, y, POLYGON), 5).alias("signed"), F.round(F.hypot(x - cx, y - cy), 5).alias("to_center"), F.round(F.atan2(cy - y, cx - x), 5).alias("bearing"))


@register("axial_lateral", "SELECT event_id, round((value - 35.0) / 25.0, 6) AS axial, round((event_id % 100 - 30.0) / 10.0, 6) AS lateral FROM events")
def axial_lateral(spark, d):
    """Place along and across a box of 50 by 20 at (10, 20), -1 to 1 inside."""
    axes = G.roi_axes({"shape": "rect", "x": 10.0, "y": 20.0, "w": 50.0, "h": 20.0})
    a, l = G.axial_lateral(F.col("value"), (F.col("event_id") % 100).cast("double"), axes)
    return table(spark, d, "events").select("event_id", F.round(a, 6).alias("axial"), F.round(l, 6).alias("lateral"))


@register("region_columns", f"WITH q AS (SELECT event_id, value AS x, (event_id % 100)::DOUBLE AS y FROM events) SELECT event_id, (sqrt(pow(x - 50, 2) + pow(y - 50, 2)) <= 30)::INT::DOUBLE AS roi1_inside, round(30 - sqrt(pow(x - 50, 2) + pow(y - 50, 2)), 5) AS roi1_signed, round((y - 50) / 30, 5) AS roi1_axial, round((x - 50) / 30, 5) AS roi1_lateral, round(abs(least({', '.join(_edge(a, b) for a, b in _EDGES)})), 5) AS roi2_edge, round(least({', '.join(f'sqrt(pow(x - {a}, 2) + pow(y - {b}, 2))' for a, b in POLYGON)}), 5) AS roi2_corner, 0.0::DOUBLE AS roi3_inside, NULL::DOUBLE AS roi3_signed FROM q")
def region_columns(spark, d):
    """A circle, a polygon and a region that is not there."""
    cols = G.region_columns(F.col("value"), (F.col("event_id") % 100).cast("double"), [{"shape": "circle", "cx": 50.0, "cy": 50.0, "r": 30.0}, {"shape": "polygon", "points": POLYGON}, None])
    return table(spark, d, "events").select("event_id", cols["roi1_inside"].alias("roi1_inside"), *(F.round(cols[c], 5).alias(c) for c in ("roi1_signed", "roi1_axial", "roi1_lateral", "roi2_edge", "roi2_corner")), cols["roi3_inside"].alias("roi3_inside"), cols["roi3_signed"].alias("roi3_signed"))


@register("parsed_timestamps", "WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events) SELECT event_id, epoch(try_strptime(s, '%Y-%m-%dT%H:%M:%S'))::BIGINT AS seconds FROM t WHERE try_strptime(s, '%Y-%m-%dT%H:%M:%S') IS NOT NULL")
def parsed_timestamps(spark, d):
    s = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.unix_seconds(F.try_to_timestamp(s)).alias("seconds")).where("seconds is not null")


@register("cosine_distances", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), n AS (SELECT label, CASE WHEN sqrt(sum(m * m)) > 0 THEN sqrt(sum(m * m)) ELSE 1 END AS n FROM c GROUP BY 1) SELECT a.label AS a, b.label AS b, round(1 - sum(a.m * b.m) / (any_value(na.n) * any_value(nb.n)), 6) AS distance FROM c a JOIN c b ON a.k = b.k JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label WHERE a.label < b.label GROUP BY 1, 2""")
def cosine_distances(spark, d):
    c = M.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", "c")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, z: x * z), F.lit(0.0), lambda s, e: s + e)
    norm = lambda v: F.when(dot(v, v) > 0, F.sqrt(dot(v, v))).otherwise(1.0)
    a, b = c.select(F.col("label").alias("a"), F.col("c").alias("u")), c.select(F.col("label").alias("b"), F.col("c").alias("v"))
    # One row a label.
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(1 - dot("u", "v") / (norm(F.col("u")) * norm(F.col("v"))), 6).alias("distance"))
