"""Queries of tests, intervals, raters, transfers, cells of results and feature reports.

Stand-ins: a cell of results is (project = user % 5, behaviour = event type, seed = event % 3) with truth value >= 50 and a noisy prediction;
reviewers are rules on `documents`, their clips the labelled ones.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M, stats as T
from .behaviour import BOUTS, CTE, FPS, S, bouts, frames, r6, table
from .registry import register

#: Multipliers for the SQL, from the same rule.
_T = ", ".join(f"({n}, {T.t_critical(n)!r}::DOUBLE)" for n in range(2, 130))
DELTAS = CTE + ", d AS (SELECT user_id, value - 50 AS v FROM f WHERE frame < 5)"


@register("paired_tests", DELTAS + ", g AS (SELECT user_id, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM d GROUP BY user_id) SELECT user_id, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(2.776::DOUBLE * sd / sqrt(n), 6) AS ci95, round(1 - sin(atan(abs(mean / (sd / sqrt(n))) / 2)) * (1 + pow(cos(atan(abs(mean / (sd / sqrt(n))) / 2)), 2) / 2), 6) AS p FROM g")
def paired_tests(spark, d):
    """The first five frames of a session against 50: with four degrees of freedom the tail has a closed form, which the SQL has."""
    v = frames(spark, d).where("frame < 5").select("user_id", (F.col("value") - 50).alias("v"))
    return r6(T.spread(v, S, "v"), "mean", "sd", "ci95", "p")


CELLS = """WITH e AS (SELECT user_id % 5 AS project, event_type AS behavior, event_id % 3 AS seed, (value >= 50)::INT AS y, (value + event_id % 40 >= 68)::INT AS p, value FROM events),
cells AS (SELECT project, behavior, seed, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn, sum(value) AS elapsed FROM e GROUP BY ALL),
c AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cells)"""


def cells(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("project"), F.col("event_type").alias("behavior"), (F.col("event_id") % 3).alias("seed"), (F.col("value") >= 50).cast("int").alias("y"), (F.col("value") + F.col("event_id") % 40 >= 68).cast("int").alias("p"), "value")
    m = e.groupBy("project", "behavior", "seed").agg(F.sum("value").alias("elapsed"))
    c = M.confusion(e, ["project", "behavior", "seed"], "y", "p").select("project", "behavior", "seed", "tp", "fp", "fn", "tn", "f1")
    return c.join(m, ["project", "behavior", "seed"])


@register("summarized_cells", CELLS + f", t(n, t) AS (VALUES {_T}), g AS (SELECT project, count(*) AS n, avg(f1) AS mean, stddev_samp(f1) AS sd FROM c GROUP BY project) SELECT project, g.n, round(mean, 6) AS mean, round(coalesce(t * sd / sqrt(g.n), 0), 6) AS ci95 FROM g LEFT JOIN t ON t.n = g.n")
def summarized_cells(spark, d):
    return r6(T.spread(cells(spark, d), ["project"], "f1"), "mean", "ci95").select("project", "n", "mean", "ci95")


@register("confusion_by_behavior", CELLS + ", m AS (SELECT behavior, avg(tp) AS tp, avg(fp) AS fp, avg(fn) AS fn, avg(tn) AS tn FROM c GROUP BY behavior) SELECT behavior, round_even(tp, 0)::BIGINT AS tp, round_even(fp, 0)::BIGINT AS fp, round_even(fn, 0)::BIGINT AS fn, round_even(tn, 0)::BIGINT AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM m")
def confusion_by_behavior(spark, d):
    m = cells(spark, d).groupBy("behavior").agg(*(F.avg(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    return m.select("behavior", *(F.bround(c, 0).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


_DEGENERATE = "(tp + fn > 0 AND tn + fp > 0 AND ((tp + fp)::DOUBLE * (tn + fn) = 0 OR tp::DOUBLE * tn - fp::DOUBLE * fn <= 0))"


def degenerate():
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return (tp + fn > 0) & (tn + fp > 0) & (((tp + fp) * (tn + fn) == 0) | (tp * tn - fp * fn <= 0))


@register("metrics_by_behavior", CELLS + f", k AS (SELECT *, {_DEGENERATE} AS deg, bool_and({_DEGENERATE}) OVER (PARTITION BY project, behavior) AS alldeg FROM c) SELECT project, behavior, count(*) AS n_seeds, round(avg(f1), 6) AS f1_mean, round(coalesce(stddev_samp(f1), 0), 6) AS f1_sd, bool_or(deg) AS degenerate FROM k WHERE NOT deg OR alldeg GROUP BY ALL")
def metrics_by_behavior(spark, d):
    """Degenerate fits go unless that leaves none."""
    k = cells(spark, d).withColumn("deg", degenerate()).withColumn("all", F.min("deg").over(Window.partitionBy("project", "behavior"))).where("not deg or all")
    return k.groupBy("project", "behavior").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("f1"), 6).alias("f1_mean"), F.round(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 6).alias("f1_sd"), F.max("deg").alias("degenerate"))


@register("speed_by_project", CELLS + " SELECT project, round(median(elapsed), 5) AS median_sec, round(avg(elapsed), 5) AS mean_sec, count(*) AS n FROM c GROUP BY project")
def speed_by_project(spark, d):
    return cells(spark, d).groupBy("project").agg(F.round(F.median("elapsed"), 5).alias("median_sec"), F.round(F.avg("elapsed"), 5).alias("mean_sec"), F.count(F.lit(1)).alias("n"))


@register("accuracy_by_project", CELLS + ", s AS (SELECT *, CASE WHEN project < 2 AND seed = 0 THEN 'generalization' WHEN project < 4 THEN 'ablation' ELSE 'other' END AS src FROM c), b AS (SELECT *, min(CASE src WHEN 'generalization' THEN 0 WHEN 'ablation' THEN 1 ELSE 2 END) OVER (PARTITION BY project) AS best FROM s) SELECT project, any_value(src) AS source, count(*) AS n, round(avg(f1), 6) AS f1 FROM b WHERE CASE src WHEN 'generalization' THEN 0 WHEN 'ablation' THEN 1 ELSE 2 END = best GROUP BY project")
def accuracy_by_project(spark, d):
    """Each project by its best source: generalization, else ablation, else whatever there is."""
    s = cells(spark, d).withColumn("source", F.when((F.col("project") < 2) & (F.col("seed") == 0), "generalization").when(F.col("project") < 4, "ablation").otherwise("other"))
    s = s.withColumn("o", F.when(F.col("source") == "generalization", 0).when(F.col("source") == "ablation", 1).otherwise(2)).withColumn("best", F.min("o").over(Window.partitionBy("project")))
    return s.where("o = best").groupBy("project").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


@register("unpivoted_cells", CELLS + " SELECT project, behavior, seed, 'f1' AS metric, round(f1, 6) AS value FROM c UNION ALL SELECT project, behavior, seed, 'tp', tp::DOUBLE FROM c UNION ALL SELECT project, behavior, seed, 'fp', fp::DOUBLE FROM c")
def unpivoted_cells(spark, d):
    return cells(spark, d).select("project", "behavior", "seed", F.round("f1", 6).alias("f1"), F.col("tp").cast("double").alias("tp"), F.col("fp").cast("double").alias("fp")).unpivot(["project", "behavior", "seed"], ["f1", "tp", "fp"], "metric", "value")


@register("replicate_columns", CELLS + " SELECT project, behavior, round(max(f1) FILTER (seed = 0), 6) AS f1_1, round(max(f1) FILTER (seed = 1), 6) AS f1_2, round(max(f1) FILTER (seed = 2), 6) AS f1_3 FROM c GROUP BY ALL")
def replicate_columns(spark, d):
    p = cells(spark, d).groupBy("project", "behavior").pivot("seed", [0, 1, 2]).agg(F.round(F.max("f1"), 6))
    return p.select("project", "behavior", *(F.col(str(k)).alias(f"f1_{k + 1}") for k in range(3)))


@register("mean_sd_n_columns", CELLS + f", t(n, t) AS (VALUES {_T}), g AS (SELECT project, behavior, count(*) AS n, avg(f1) AS m, stddev_samp(f1) AS sd FROM c GROUP BY ALL), q AS (SELECT project, behavior, g.n, m, t * sd / sqrt(g.n) AS ci, t FROM g JOIN t ON t.n = g.n)\nSELECT behavior, " + ", ".join(f"round(max(m) FILTER (project = {k}), 6) AS p{k}_mean, round(max(ci * sqrt(n) / t) FILTER (project = {k}), 6) AS p{k}_sd, max(n) FILTER (project = {k}) AS p{k}_n" for k in range(5)) + " FROM q GROUP BY behavior")
def mean_sd_n_columns(spark, d):
    """Mean, SD (got back from the interval) and N of each project, side by side."""
    q = T.spread(cells(spark, d), ["project", "behavior"], "f1")
    back = F.col("ci95") * F.sqrt("n") / T.tail(lambda n: T.t_critical(int(n)))(F.col("n"))
    p = q.where("n >= 2").withColumn("back", back).groupBy("behavior").pivot("project", list(range(5))).agg(F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("back"), 6).alias("sd"), F.max("n").alias("n"))
    return p.select("behavior", *(F.col(f"{k}_{c}").alias(f"p{k}_{c}") for k in range(5) for c in ("mean", "sd", "n")))


@register("deltas_to_baseline", CELLS + ", b AS (SELECT project, seed, f1 FROM c WHERE behavior = 'view'), q AS (SELECT c.project, c.behavior, c.seed, round(round(c.f1, 9) - round(b.f1, 9), 4) AS delta FROM c LEFT JOIN b ON b.project = c.project AND b.seed = c.seed) SELECT *, row_number() OVER (PARTITION BY project, seed ORDER BY delta, behavior) AS rank FROM q")
def deltas_to_baseline(spark, d):
    c = cells(spark, d).withColumn("f1", F.round("f1", 9))
    b = c.where("behavior = 'view'").select("project", "seed", F.col("f1").alias("base"))
    q = c.join(b, ["project", "seed"], "left").select("project", "behavior", "seed", F.round(F.col("f1") - F.col("base"), 4).alias("delta"))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("project", "seed").orderBy("delta", "behavior")))


@register("average_curve", CELLS + ", k AS (SELECT behavior, seed AS size, avg(f1) AS f1 FROM c WHERE NOT (behavior = 'click' AND seed = 2) GROUP BY ALL), n AS (SELECT behavior, max(size) AS top FROM k GROUP BY 1), s AS (SELECT max(size) AS size FROM (SELECT k.size FROM k JOIN n ON n.top >= k.size GROUP BY k.size HAVING count(DISTINCT k.behavior) >= 2)) SELECT k.size, round(avg(f1), 6) AS f1, count(*) AS n FROM k JOIN n USING (behavior), s WHERE n.top >= s.size AND k.size <= s.size GROUP BY k.size")
def average_curve(spark, d):
    """Mean curve over the behaviours that reach the largest size at least two reach."""
    k = cells(spark, d).where("not (behavior = 'click' and seed = 2)").groupBy("behavior", F.col("seed").alias("size")).agg(F.avg("f1").alias("f1"))
    n = k.groupBy("behavior").agg(F.max("size").alias("top"))
    s = k.groupBy("size").agg(F.countDistinct("behavior").alias("m")).where("m >= 2").agg(F.max("size").alias("s"))
    return k.join(n, "behavior").join(F.broadcast(s)).where("top >= s and size <= s").groupBy("size").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count(F.lit(1)).alias("n"))


@register("pooled_gain", CELLS + ", g AS (SELECT c.behavior, c.project, avg(c.f1 - b.f1) AS gain FROM c JOIN c b ON b.project = c.project AND b.seed = c.seed AND b.behavior = 'view' WHERE c.behavior <> 'view' GROUP BY ALL) SELECT behavior, count(*) AS n_projects, round(avg(gain), 6) AS gain FROM g GROUP BY behavior")
def pooled_gain(spark, d):
    """Mean over projects of the mean gain over seeds against the baseline."""
    c = cells(spark, d)
    b = c.where("behavior = 'view'").select("project", "seed", F.col("f1").alias("base"))
    g = c.where("behavior <> 'view'").join(b, ["project", "seed"]).groupBy("behavior", "project").agg(F.avg(F.col("f1") - F.col("base")).alias("gain"))
    return g.groupBy("behavior").agg(F.count(F.lit(1)).alias("n_projects"), F.round(F.avg("gain"), 6).alias("gain"))


BALANCED = CTE + ", q AS (SELECT user_id, frame // 10 AS j, avg(value) - 48 AS v FROM f WHERE frame < 40 GROUP BY ALL)"


@register("clustered_means", BALANCED + """, c AS (SELECT user_id % 3 AS grp, user_id, count(*) AS n, avg(v) AS m, sum(v * v) - sum(v) * sum(v) / count(*) AS w FROM q GROUP BY ALL), g AS (SELECT grp, count(*) AS k, avg(m) AS mu, 4 * sum(w) / 4 / (count(*) * 3) AS msw, 4 * var_samp(m) AS msb, sum(w) + 4 * var_samp(m) * (count(*) - 1) AS sst FROM c WHERE n = 4 GROUP BY grp)
SELECT grp, k AS n_clusters, round(mu, 8) AS estimate, round(CASE WHEN msb > msw THEN sqrt(msb / (4 * k)) ELSE sqrt(sst / (4 * k - 1) / (4 * k)) END, 5) AS se, round(CASE WHEN msb > msw THEN (msb - msw) / 4 / ((msb - msw) / 4 + msw) ELSE 0 END, 4) AS icc, (k - 1)::DOUBLE AS df FROM g""")
def clustered_means(spark, d):
    """Sessions of four tens of frames each: a balanced design, where REML is the analysis of variance, which the SQL has."""
    q = frames(spark, d).where("frame < 40").groupBy("user_id", F.floor(F.col("frame") / 10).alias("j")).agg((F.avg("value") - 48).alias("v"))
    q = q.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n = 4").withColumn("grp", F.col("user_id") % 3)
    out = T.clustered_mean(q, ["grp"], "v", "user_id")
    return out.select("grp", F.col("n_clusters").cast("long").alias("n_clusters"), F.round("estimate", 8).alias("estimate"), F.round("se", 5).alias("se"), F.round("icc", 4).alias("icc"), F.round("df", 4).alias("df"))


@register("sign_flips", """WITH m AS (SELECT n_regionkey AS r, avg(c_acctbal) - 4400 AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), f AS (SELECT k.k, CASE WHEN k.k & (1 << r) <> 0 THEN m ELSE -m END AS v FROM m CROSS JOIN (SELECT unnest(range(0, 32)) AS k) k), t AS (SELECT k, avg(v) / (stddev_samp(v) / sqrt(5)) AS t FROM f GROUP BY k)
SELECT count(*) AS flips, round(avg((abs(t) >= (SELECT abs(t) FROM t WHERE k = 31) - 1e-12)::INT), 6) AS p FROM t""")
def sign_flips(spark, d):
    m = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("v", F.col("c_acctbal") - 4400)
    p = T.clustered_mean(m.withColumn("g", F.lit(1)), ["g"], "v", "n_regionkey")
    return p.select(F.pow(F.lit(2), F.col("n_clusters")).cast("long").alias("flips"), F.round("p_sign_flip", 6).alias("p"))


@register("bh_threshold", """WITH t AS (SELECT (c_custkey * 7919 % 1000 + 1) / 20000.0::DOUBLE AS p FROM customer), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t) SELECT round(max(k / m * 0.04::DOUBLE) FILTER (p <= k / m * 0.04::DOUBLE), 9) AS threshold, count(*) FILTER (p <= k / m * 0.04::DOUBLE) > 0 AS passes FROM r""")
def bh_threshold(spark, d):
    t = table(spark, d, "customer").select(((F.col("c_custkey") * 7919 % 1000 + 1) / 20000.0).alias("p"))
    return M.bh_threshold(t, "p", 0.04).select(F.round("threshold", 9).alias("threshold"), F.col("threshold").isNotNull().alias("passes"))


@register("kruskal_wallis", """WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events), n AS (SELECT count(*)::DOUBLE AS n FROM events), c AS (SELECT sum(pow(t, 3) - t) AS c FROM (SELECT count(*) AS t FROM events GROUP BY value)), g AS (SELECT event_type, count(*) AS m, sum(r) AS s FROM r GROUP BY 1),
h AS (SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / (1 - any_value(c) / (pow(any_value(n), 3) - any_value(n))) AS h, count(*) AS k FROM g, n, c) SELECT round(h, 5) AS h, k AS groups, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h""")
def kruskal_wallis(spark, d):
    """Five groups: with four degrees of freedom the tail has a closed form, which the SQL has."""
    out = T.kruskal(table(spark, d, "events").withColumn("one", F.lit(1)), ["one"], "event_type", "value")
    return out.select(F.round("h", 5).alias("h"), "groups", F.round("p", 6).alias("p"))


@register("anova_p", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM events GROUP BY 1), t AS (SELECT avg(value) AS m FROM events), f AS (SELECT (sum(g.n * pow(g.m - t.m, 2)) / (count(*) - 1)) / (sum(w) / (sum(g.n) - count(*))) AS f, sum(g.n) - count(*) AS d FROM g, t),
x AS (SELECT f, d, d / (d + 4 * f) AS x FROM f) SELECT round(f, 5) AS f, d::BIGINT AS df, round(pow(x, d / 2) * (1 + d / 2 * (1 - x)), 6) AS p FROM x""")
def anova_p(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("w"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("b"), F.sum("w").alias("w"))
    f = s.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), (F.col("n") - F.col("k")).alias("df"), (F.col("k") - 1).alias("d1"))
    return f.select(F.round("f", 5).alias("f"), "df", F.round(T.tail(lambda x, a, b: T.f_tail(x, a, b))(F.col("f"), F.col("d1").cast("double"), F.col("df").cast("double")), 6).alias("p"))


@register("sidak", "SELECT c_custkey, round(1 - pow(1 - (c_custkey * 7919 % 1000 + 1) / 2000.0::DOUBLE, 5), 9) AS p FROM customer")
def sidak(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(1 - F.pow(1 - (F.col("c_custkey") * 7919 % 1000 + 1) / 2000.0, 5), 9).alias("p"))


_RND = "CAST('0x' || substr(md5('{}:' || {}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@register("transition_permutations", CTE + f""", t AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS dst FROM f), c AS (SELECT user_id, src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), m AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, src) AS v FROM c), u AS (SELECT DISTINCT user_id, user_id % 2 AS g FROM m),
na AS (SELECT count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM u), pr AS (SELECT r.r, user_id, row_number() OVER (PARTITION BY r.r ORDER BY {_RND.format('5', "r.r || ':' || user_id")}, user_id) <= (SELECT a FROM na) AS one FROM u CROSS JOIN (SELECT unnest(range(1, 41)) AS r) r UNION ALL SELECT 0, user_id, g = 0 FROM u),
s AS (SELECT src, dst, r, coalesce(sum(v) FILTER (one), 0) AS x, coalesce(sum(v) FILTER (NOT one), 0) AS y FROM m JOIN pr USING (user_id) GROUP BY ALL), d AS (SELECT src, dst, r, abs(x / (SELECT a FROM na) - y / (SELECT b FROM na)) AS d FROM s)
SELECT o.src, o.dst, round(any_value(o.d), 6) AS diff, round(count(*) FILTER (p.d >= o.d - 1e-12) / 40, 6) AS p FROM d o JOIN d p ON p.src = o.src AND p.dst = o.dst AND p.r > 0 WHERE o.r = 0 GROUP BY o.src, o.dst""")
def transition_permutations(spark, d):
    from ..operators import motifs

    m = motifs.normalize_rows(motifs.transitions(frames(spark, d), S, "event_type", ["frame"]), S)
    units = m.select("user_id", (F.col("user_id") % 2).alias("g")).distinct()
    return r6(T.permutation_test(m, units, "user_id", "g", ["src", "dst"], "p", 40, "5"), "diff", "p")


MOTIFS = CTE + ", w AS (SELECT user_id, event_type AS a, lead(event_type) OVER u AS b, lead(event_type, 2) OVER u AS c FROM f WINDOW u AS (PARTITION BY user_id ORDER BY frame)), mo AS (SELECT user_id, a || '>' || b || '>' || c AS motif, count(*) AS n FROM w WHERE c IS NOT NULL AND NOT (a = b AND b = c) GROUP BY ALL)"


def motif_counts(spark, d):
    from ..operators import motifs

    return motifs.ngrams(frames(spark, d), S, "event_type", ["frame"], 3)


@register("top_motifs", MOTIFS + " SELECT motif, sum(n)::BIGINT AS n FROM mo GROUP BY motif HAVING sum(n) >= 2 ORDER BY n DESC, motif LIMIT 15")
def top_motifs(spark, d):
    return motif_counts(spark, d).groupBy("motif").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "motif").limit(15)


@register("motif_group_comparison", MOTIFS + f""", tp AS (SELECT motif, sum(n) AS t FROM mo GROUP BY motif HAVING sum(n) >= 2 ORDER BY t DESC, motif LIMIT 100), m AS (SELECT user_id, motif, n::DOUBLE AS v FROM mo WHERE motif IN (SELECT motif FROM tp)), u AS (SELECT DISTINCT user_id, user_id % 2 AS g FROM f), na AS (SELECT count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM u),
pr AS (SELECT r.r, user_id, row_number() OVER (PARTITION BY r.r ORDER BY {_RND.format('9', "r.r || ':' || user_id")}, user_id) <= (SELECT a FROM na) AS one FROM u CROSS JOIN (SELECT unnest(range(1, 21)) AS r) r UNION ALL SELECT 0, user_id, g = 0 FROM u),
s AS (SELECT motif, r, coalesce(sum(v) FILTER (one), 0) / (SELECT a FROM na) - coalesce(sum(v) FILTER (NOT one), 0) / (SELECT b FROM na) AS d FROM m JOIN pr USING (user_id) GROUP BY ALL) SELECT o.motif, round(any_value(abs(o.d)), 6) AS diff, round(count(*) FILTER (abs(p.d) >= abs(o.d) - 1e-12) / 20, 6) AS p FROM s o JOIN s p ON p.motif = o.motif AND p.r > 0 WHERE o.r = 0 GROUP BY o.motif ORDER BY round(any_value(abs(o.d)), 9) DESC, o.motif LIMIT 15""")
def motif_group_comparison(spark, d):
    """The 15 motifs, of the 100 most frequent, whose group means differ most, with permutation p."""
    n = motif_counts(spark, d)
    top = n.groupBy("motif").agg(F.sum("n").alias("t")).where("t >= 2").orderBy(F.desc("t"), "motif").limit(100).select("motif")
    # Every session is a unit, also one without a candidate motif.
    m = n.join(F.broadcast(top), "motif").select("user_id", "motif", F.col("n").cast("double").alias("v"))
    units = frames(spark, d).select("user_id", (F.col("user_id") % 2).alias("g")).distinct()
    out = T.permutation_test(m, units, "user_id", "g", ["motif"], "v", 20, "9")
    return r6(out.orderBy(F.desc(F.round("diff", 9)), "motif").limit(15), "diff", "p")


@register("motif_vectors", MOTIFS + ", vo AS (SELECT motif FROM mo GROUP BY motif HAVING count(*) >= 2), v AS (SELECT user_id, motif, n FROM mo WHERE motif IN (SELECT motif FROM vo)) SELECT user_id, motif, round(ln(1 + n / sum(n) OVER (PARTITION BY user_id)), 6) AS weight FROM v")
def motif_vectors(spark, d):
    """Long form of the session vectors: motifs of two sessions or more, ln(1 + share)."""
    n = motif_counts(spark, d)
    vocabulary = n.groupBy("motif").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("motif")
    v = n.join(vocabulary, "motif")
    return v.select("user_id", "motif", F.round(F.log1p(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))), 6).alias("weight"))


@register("group_mean_transitions", CTE + """, t AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS dst FROM f), c AS (SELECT user_id, src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), m AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, src) AS v FROM c),
u AS (SELECT user_id % 3 AS grp, count(DISTINCT user_id) AS k FROM f GROUP BY 1), p AS (SELECT DISTINCT src, dst FROM m) SELECT u.grp, p.src, p.dst, round(coalesce(sum(v), 0) / any_value(k), 6) AS mean FROM u CROSS JOIN p LEFT JOIN m ON m.user_id % 3 = u.grp AND m.src = p.src AND m.dst = p.dst GROUP BY ALL""")
def group_mean_transitions(spark, d):
    """Means over a group's sessions, those without the transition counting 0."""
    from ..operators import motifs

    f = frames(spark, d)
    m = motifs.normalize_rows(motifs.transitions(f, S, "event_type", ["frame"]), S).groupBy((F.col("user_id") % 3).alias("grp"), "src", "dst").agg(F.sum("p").alias("s"))
    u = f.groupBy((F.col("user_id") % 3).alias("grp")).agg(F.countDistinct("user_id").alias("k"))
    pairs = F.broadcast(m.agg(F.collect_set(F.struct("src", "dst")).alias("ps")))
    grid = u.join(pairs).select("grp", "k", F.explode("ps").alias("x")).select("grp", "k", "x.src", "x.dst")
    return grid.join(m, ["grp", "src", "dst"], "left").select("grp", "src", "dst", F.round(F.coalesce("s", F.lit(0.0)) / F.col("k"), 6).alias("mean"))


@register("bootstrap_f1", """WITH e AS (SELECT user_id, (value >= 50)::INT AS y, (value + event_id % 40 >= 68)::INT AS p FROM events), c AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM e GROUP BY user_id), n AS (SELECT count(*) AS n FROM c),
k AS (SELECT r.r, floor(CAST('0x' || substr(md5('3:' || r.r || ':' || j.j), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * (SELECT n FROM n))::BIGINT AS i FROM (SELECT unnest(range(0, 60)) AS r) r CROSS JOIN (SELECT unnest(range(0, (SELECT n FROM n))) AS j) j), s AS (SELECT r, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM k JOIN c USING (i) GROUP BY r)
SELECT round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi, (SELECT n FROM n)::INT AS n_subjects FROM s""")
def bootstrap_f1(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("value") >= 50).cast("int").alias("y"), (F.col("value") + F.col("event_id") % 40 >= 68).cast("int").alias("p"))
    return r6(T.bootstrap_f1(M.confusion(e, ["user_id"], "y", "p"), "user_id", 60, "3"), "lo", "hi")


@register("permanova", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label, vec_id % 7)), q AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM e), z AS (SELECT vec_id, sqrt(sum(x * x)) AS z FROM q GROUP BY 1),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, any_value(a.label) AS g, any_value(a.label = b.label) AS same, sum(a.x * b.x) AS dot FROM q a JOIN q b ON a.k = b.k AND a.vec_id < b.vec_id GROUP BY 1, 2), d AS (SELECT g, same, pow(1 - dot / (za.z * zb.z), 2) AS d2 FROM p JOIN z za ON za.vec_id = i JOIN z zb ON zb.vec_id = j), n AS (SELECT label AS g, count(*) AS n FROM e GROUP BY 1),
w AS (SELECT sum(s / n) AS ssw FROM (SELECT g, sum(d2) AS s FROM d WHERE same GROUP BY g) JOIN n USING (g)), t AS (SELECT sum(d2) / (SELECT sum(n) FROM n) AS sst FROM d), o AS (SELECT sst, ssw, (SELECT count(*) FROM n) AS a, (SELECT sum(n) FROM n) AS m FROM t, w) SELECT round(((sst - ssw) / (a - 1)) / (ssw / (m - a)), 5) AS pseudo_f, round((sst - ssw) / sst, 6) AS r2, a AS groups, m::BIGINT AS items FROM o""")
def permanova(spark, d):
    """Items stand for behaviours: the first vector of each label and remainder."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    some = e.groupBy("label", F.col("vec_id") % 7).agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return T.pseudo_f(e.join(F.broadcast(some), "vec_id"), "label", "embedding").select(F.round("pseudo_f", 5).alias("pseudo_f"), F.round("r2", 6).alias("r2"), "groups", "items")


#: Reviewers' answers: machine and three reviewers call a document by its length, each with a cut of its own; some are unsure.
ANSWERS = """WITH cl AS (SELECT d.doc_id AS clip, CASE WHEN n_chars >= 1000 THEN 'long' WHEN n_chars >= 300 THEN 'mid' ELSE 'no_behavior' END AS machine, CASE WHEN l.quality = 1 THEN 'prior_accepted' ELSE 'fresh' END AS category, CASE WHEN d.doc_id % 3 = 0 THEN 'long' END AS reference, n_chars BETWEEN 900 AND 1100 AS fringe, d.doc_id % 11 = 0 AS coactive, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
an AS (SELECT clip, r.r AS reviewer, CASE WHEN n_chars >= 800 + 150 * r.r THEN 'long' WHEN n_chars >= 250 + 60 * r.r THEN 'mid' ELSE 'no_behavior' END AS label, (clip + r.r) % 13 = 0 AS unsure FROM cl CROSS JOIN (SELECT unnest([0, 1, 2]) AS r) r)"""


def clips(spark, d):
    n, k = F.col("n_chars"), F.col("doc_id")
    l = table(spark, d, "labels").select("doc_id", "quality")
    c = table(spark, d, "documents").select("doc_id", "n_chars").join(l, "doc_id")
    return c.select(k.alias("clip"), F.when(n >= 1000, "long").when(n >= 300, "mid").otherwise("no_behavior").alias("machine"), F.when(F.col("quality") == 1, "prior_accepted").otherwise("fresh").alias("category"), F.when(k % 3 == 0, "long").alias("reference"), n.between(900, 1100).alias("fringe"), (k % 11 == 0).alias("coactive"), "n_chars")


def answers(spark, d):
    a = clips(spark, d).withColumn("reviewer", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    n, r = F.col("n_chars"), F.col("reviewer")
    return a.withColumn("label", F.when(n >= 800 + 150 * r, "long").when(n >= 250 + 60 * r, "mid").otherwise("no_behavior")).withColumn("unsure", (F.col("clip") + r) % 13 == 0)


@register("reviewer_vs_machine", ANSWERS + """, s AS (SELECT * FROM an JOIN cl USING (clip)) SELECT reviewer, count(*) FILTER (NOT unsure AND NOT coactive) AS n_answered, count(*) FILTER (unsure) AS n_unsure, count(*) FILTER (NOT unsure AND coactive) AS n_overlap, round(count(*) FILTER (unsure) / nullif(count(*) FILTER (unsure OR NOT coactive), 0), 6) AS unsure_rate,
round(avg((label = machine)::INT) FILTER (NOT unsure AND NOT coactive), 6) AS agreement, round(avg((label = coalesce(reference, machine))::INT) FILTER (NOT unsure AND NOT coactive AND category = 'prior_accepted'), 6) AS accuracy_prior, round(avg((label = coalesce(reference, machine))::INT) FILTER (NOT unsure AND NOT coactive AND category = 'fresh'), 6) AS accuracy_fresh,
round(count(*) FILTER (NOT unsure AND NOT coactive AND label = 'long' AND machine = 'long') / nullif(count(*) FILTER (NOT unsure AND NOT coactive AND machine = 'long'), 0), 6) AS precision_long, round(count(*) FILTER (NOT unsure AND NOT coactive AND label = 'long' AND machine = 'long') / nullif(count(*) FILTER (NOT unsure AND NOT coactive AND label = 'long'), 0), 6) AS recall_long FROM s GROUP BY reviewer""")
def reviewer_vs_machine(spark, d):
    u = F.col("unsure")
    ok = ~u & ~F.col("coactive")
    right = (F.col("label") == F.coalesce("reference", "machine")).cast("int")
    both, m, h = (F.count_if(ok & c) for c in ((F.col("label") == "long") & (F.col("machine") == "long"), F.col("machine") == "long", F.col("label") == "long"))
    part = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return answers(spark, d).groupBy("reviewer").agg(F.count_if(ok).alias("n_answered"), F.count_if(u).alias("n_unsure"), F.count_if(~u & F.col("coactive")).alias("n_overlap"), part(F.count_if(u), F.count_if(u | ~F.col("coactive"))).alias("unsure_rate"), F.round(F.avg(F.when(ok, (F.col("label") == F.col("machine")).cast("int"))), 6).alias("agreement"),
        F.round(F.avg(F.when(ok & (F.col("category") == "prior_accepted"), right)), 6).alias("accuracy_prior"), F.round(F.avg(F.when(ok & (F.col("category") == "fresh"), right)), 6).alias("accuracy_fresh"), part(both, m).alias("precision_long"), part(both, h).alias("recall_long"))


@register("rater_confusions", ANSWERS + " SELECT machine, label, count(*) AS n, count(*) FILTER (fringe) AS n_fringe, machine <> label AS disagree FROM an JOIN cl USING (clip) WHERE NOT unsure AND NOT coactive GROUP BY machine, label")
def rater_confusions(spark, d):
    return answers(spark, d).where("not unsure and not coactive").groupBy("machine", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("fringe").alias("n_fringe")).withColumn("disagree", F.col("machine") != F.col("label"))


@register("inter_rater", ANSWERS + """, s AS (SELECT clip, list(label ORDER BY reviewer) AS ls FROM an WHERE NOT unsure GROUP BY clip HAVING count(*) = 3), c AS (SELECT clip, label, count(*) AS n FROM an WHERE clip IN (SELECT clip FROM s) GROUP BY ALL), q AS (SELECT clip, (sum(n * n) - 3) / 6 AS pi FROM c GROUP BY clip), e AS (SELECT sum(pow(t / (3 * (SELECT count(*) FROM s)), 2)) AS pe FROM (SELECT sum(n) AS t FROM c GROUP BY label))
SELECT (SELECT count(*) FROM s) AS shared_clips, round((SELECT avg((len(list_distinct(ls)) = 1)::INT) FROM s), 6) AS agreement, round(((SELECT avg(pi) FROM q) - pe) / (1 - pe), 6) AS kappa FROM e""")
def inter_rater(spark, d):
    return r6(M.fleiss(answers(spark, d).where("not unsure"), "clip", "reviewer", "label", 3), "agreement", "kappa")


@register("intra_rater", ANSWERS + """, p AS (SELECT reviewer, reference AS a, label AS b FROM an JOIN cl USING (clip) WHERE NOT unsure AND category = 'prior_accepted' AND reference IS NOT NULL), n AS (SELECT reviewer, count(*) AS n, avg((a = b)::INT) AS po FROM p GROUP BY 1), pa AS (SELECT reviewer, a AS l, count(*) AS na FROM p GROUP BY ALL), pb AS (SELECT reviewer, b AS l, count(*) AS nb FROM p GROUP BY ALL),
e AS (SELECT reviewer, sum(na * nb) AS s FROM pa JOIN pb USING (reviewer, l) GROUP BY 1) SELECT reviewer, n, round(po, 6) AS agreement, round(CASE WHEN coalesce(s, 0) / (n * n) < 1 THEN (po - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)) END, 6) AS kappa FROM n LEFT JOIN e USING (reviewer)""")
def intra_rater(spark, d):
    p = answers(spark, d).where("not unsure and category = 'prior_accepted' and reference is not null")
    k = M.cohen_kappa(p, ["reviewer"], "reference", "label")
    return k.select("reviewer", "n", F.round("po", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


#: Frames of three behaviours' bouts: the trace, its neighbour of one frame later, and its complement's.
ACTIVE = BOUTS + """, ac AS (SELECT user_id, 'a' AS b, unnest(range(start_frame, end_frame + 1)) AS frame FROM b UNION SELECT user_id, 'b', unnest(range(start_frame + 2, end_frame + 3)) FROM b UNION SELECT user_id, 'c', frame FROM f WHERE p < 0.1)"""


def active(spark, d):
    b = bouts(spark, d)
    spread = lambda k, n: b.select("user_id", F.lit(n).alias("b"), F.explode(F.sequence(F.col("start_frame") + k, F.col("end_frame") + k)).alias("frame"))
    return spread(0, "a").union(spread(2, "b")).union(frames(spark, d).where("p < 0.1").select("user_id", F.lit("c"), "frame")).distinct()


@register("behavior_overlap", ACTIVE + ", m AS (SELECT *, count(*) OVER (PARTITION BY user_id, frame) AS k FROM ac) SELECT b AS behavior, count(*) AS active_frames, count(*) FILTER (k > 1) AS overlap_frames, round(count(*) FILTER (k > 1) / count(*), 6) AS overlap_fraction, round((SELECT count(DISTINCT (user_id, frame)) FROM m WHERE k > 1) / (SELECT count(DISTINCT (user_id, frame)) FROM m), 6) AS overall_rate FROM m GROUP BY b")
def behavior_overlap(spark, d):
    m = active(spark, d).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("user_id", "frame")))
    # One frame counts once for the overall rate: 1 / k for each of its k behaviours.
    whole = m.agg((F.round(F.sum(F.when(F.col("k") > 1, 1 / F.col("k")))) / F.round(F.sum(1 / F.col("k")))).alias("overall_rate"))
    n = m.groupBy(F.col("b").alias("behavior")).agg(F.count(F.lit(1)).alias("active_frames"), F.count_if(F.col("k") > 1).alias("overlap_frames"))
    return n.join(F.broadcast(whole)).select("behavior", "active_frames", "overlap_frames", F.round(F.col("overlap_frames") / F.col("active_frames"), 6).alias("overlap_fraction"), F.round("overall_rate", 6).alias("overall_rate"))


@register("overlap_pairs_of_behaviors", ACTIVE + ", n AS (SELECT b, count(*) AS n FROM ac GROUP BY b) SELECT x.b AS a, y.b AS b, count(*) AS overlap_frames, round(count(*) / any_value(nx.n), 6) AS frac_a, round(count(*) / any_value(ny.n), 6) AS frac_b FROM ac x JOIN ac y ON x.user_id = y.user_id AND x.frame = y.frame AND x.b < y.b JOIN n nx ON nx.b = x.b JOIN n ny ON ny.b = y.b GROUP BY x.b, y.b")
def overlap_pairs_of_behaviors(spark, d):
    a = active(spark, d)
    n = a.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    sets = a.groupBy("user_id", "frame").agg(F.array_sort(F.collect_list("b")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap_frames"))
    na, nb = F.broadcast(n.select(F.col("b").alias("a"), F.col("n").alias("x"))), F.broadcast(n.select("b", F.col("n").alias("y")))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "overlap_frames", F.round(F.col("overlap_frames") / F.col("x"), 6).alias("frac_a"), F.round(F.col("overlap_frames") / F.col("y"), 6).alias("frac_b"))


@register("review_effort", CTE + """, g AS (SELECT user_id % 4 AS project, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id)) AS gap FROM f), k AS (SELECT project, gap, CASE WHEN gap > 120 THEN 'break' WHEN gap < 0.05 THEN 'batch' ELSE 'timed' END AS kind FROM g WHERE gap IS NOT NULL),
t AS (SELECT project, count(*) FILTER (kind = 'timed') AS n_timed, count(*) FILTER (kind = 'break') AS n_breaks, count(*) FILTER (kind = 'batch') AS n_batch, median(gap) FILTER (kind = 'timed') AS med, avg(gap) FILTER (kind = 'timed') AS mean, quantile_cont(gap, 0.25) FILTER (kind = 'timed') AS p25, quantile_cont(gap, 0.75) FILTER (kind = 'timed') AS p75, quantile_cont(gap, 0.9) FILTER (kind = 'timed') AS p90, sum(gap) FILTER (kind = 'timed') AS total FROM k GROUP BY project)
SELECT project, n_timed, n_breaks, n_batch, round(med, 5) AS median_s, round(mean, 5) AS mean_s, round(p25, 5) AS p25_s, round(p75, 5) AS p75_s, round(p90, 5) AS p90_s, round((total + (n_breaks + 1) * med) / 3600, 6) AS active_hours, round(3600 / med, 4) AS clips_per_hour FROM t""")
def review_effort(spark, d):
    """Gaps between decisions: over 120 s a break, under 0.05 s a batch; each sitting adds one median."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    f = frames(spark, d).withColumn("project", F.col("user_id") % 4)
    g = f.withColumn("gap", t - F.lag(t).over(Window.partitionBy("project").orderBy("ts", "event_id"))).where("gap is not null")
    timed = F.when((F.col("gap") <= 120) & (F.col("gap") >= 0.05), F.col("gap"))
    k = g.groupBy("project").agg(F.count(timed).alias("n_timed"), F.count_if(F.col("gap") > 120).alias("n_breaks"), F.count_if(F.col("gap") < 0.05).alias("n_batch"), F.percentile(timed, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9)))).alias("q"), F.avg(timed).alias("mean"), F.sum(timed).alias("total"))
    med = F.col("q")[1]
    return k.select("project", "n_timed", "n_breaks", "n_batch", F.round(med, 5).alias("median_s"), F.round("mean", 5).alias("mean_s"), F.round(F.col("q")[0], 5).alias("p25_s"), F.round(F.col("q")[2], 5).alias("p75_s"), F.round(F.col("q")[3], 5).alias("p90_s"), F.round((F.col("total") + (F.col("n_breaks") + 1) * med) / 3600, 6).alias("active_hours"), F.round(3600 / med, 4).alias("clips_per_hour"))


#: Columns of lineitem as features, long.
_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LONG = "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, l_returnflag = 'R' AS ex, l_linestatus AS side, l_suppkey % 6 AS session, l_orderkey, l_linenumber FROM lineitem" for c in _FEATURES) + ")"


def features(spark, d):
    l = table(spark, d, "lineitem").select(*_FEATURES, (F.col("l_returnflag") == "R").alias("ex"), F.col("l_linestatus").alias("side"), (F.col("l_suppkey") % 6).alias("session"))
    return l.unpivot(["ex", "side", "session"], list(_FEATURES), "feature", "v")


@register("column_shifts", LONG + ", q AS (SELECT feature, side, median(v) AS m, count(*) AS n FROM v GROUP BY ALL), i AS (SELECT feature, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v GROUP BY feature) SELECT feature, round(CASE WHEN min(n) >= 30 AND any_value(iqr) > 0 THEN (max(m) - min(m)) / any_value(iqr) END, 6) AS shift FROM q JOIN i USING (feature) GROUP BY feature")
def column_shifts(spark, d):
    v = features(spark, d)
    q = v.groupBy("feature", "side").agg(F.percentile("v", 0.5).alias("m"), F.count("v").alias("n"))
    i = v.groupBy("feature").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("feature", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return q.join(F.broadcast(i), "feature").groupBy("feature").agg(F.round(F.when((F.min("n") >= 30) & (F.first("iqr") > 0), (F.max("m") - F.min("m")) / F.first("iqr")), 6).alias("shift"))


@register("essence_ranges", LONG + ", q AS (SELECT feature, min(v) FILTER (ex) AS lo, max(v) FILTER (ex) AS hi, quantile_cont(v, 0.1) FILTER (ex) AS p10, quantile_cont(v, 0.9) FILTER (ex) AS p90 FROM v GROUP BY feature) SELECT feature, round(lo - CASE WHEN hi > lo THEN 0.1 * (hi - lo) ELSE 0.1 * abs(hi) + 1e-6 END, 3) AS lo, round(hi + CASE WHEN hi > lo THEN 0.1 * (hi - lo) ELSE 0.1 * abs(hi) + 1e-6 END, 3) AS hi, round(p10, 3) AS p10, round(p90, 3) AS p90 FROM q")
def essence_ranges(spark, d):
    e = F.when(F.col("ex"), F.col("v"))
    q = features(spark, d).groupBy("feature").agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.percentile(e, F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    pad = F.when(F.col("hi") > F.col("lo"), 0.1 * (F.col("hi") - F.col("lo"))).otherwise(0.1 * F.abs("hi") + 1e-6)
    return q.select("feature", F.round(F.col("lo") - pad, 3).alias("lo"), F.round(F.col("hi") + pad, 3).alias("hi"), F.round(F.col("q")[0], 3).alias("p10"), F.round(F.col("q")[1], 3).alias("p90"))


@register("shared_features", LONG + ", q AS (SELECT feature, quantile_cont(v, 0.9) FILTER (ex) - quantile_cont(v, 0.1) FILTER (ex) AS e, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS p, abs(median(v)) AS m FROM v GROUP BY feature) SELECT feature, round(e / CASE WHEN p > 0 THEN p ELSE nullif(m, 0) END, 6) AS tightness FROM q")
def shared_features(spark, d):
    """Spread of the exemplars over that of all; the least are what exemplars share."""
    e = F.when(F.col("ex"), F.col("v"))
    ten = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    q = features(spark, d).groupBy("feature").agg(F.percentile(e, ten).alias("e"), F.percentile("v", ten).alias("p"))
    wide, mid = F.col("p")[2] - F.col("p")[0], F.abs(F.col("p")[1])
    return q.select("feature", F.round((F.col("e")[2] - F.col("e")[0]) / F.when(wide > 0, wide).when(mid > 0, mid), 6).alias("tightness"))


@register("essence_scorer", LONG + ", b AS (SELECT feature, median(v) FILTER (NOT ex) AS m, stddev_pop(v) FILTER (NOT ex) AS sd, median(v) FILTER (ex) AS e FROM v GROUP BY feature), a AS (SELECT feature, median(abs(v - m)) FILTER (NOT ex) * 1.4826 AS mad FROM v JOIN b USING (feature) GROUP BY feature), r AS (SELECT feature, ex, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r FROM v), u AS (SELECT feature, (sum(r) FILTER (ex) - count(*) FILTER (ex) * (count(*) FILTER (ex) + 1) / 2) / (count(*) FILTER (ex)::DOUBLE * count(*) FILTER (NOT ex)) AS auc FROM r GROUP BY feature)\nSELECT feature, round(m, 6) AS center, round(CASE WHEN mad > 1e-9 THEN mad ELSE sd END, 5) AS scale, CASE WHEN e >= m THEN 1 ELSE -1 END AS direction, round(abs(auc - 0.5), 6) AS weight FROM b JOIN a USING (feature) JOIN u USING (feature)")
def essence_scorer(spark, d):
    """Center and robust scale of the background, direction of the exemplars, and how well a feature parts them (ties averaged)."""
    v = features(spark, d)
    o, e = F.when(~F.col("ex"), F.col("v")), F.when(F.col("ex"), F.col("v"))
    b = v.groupBy("feature").agg(F.median(o).alias("m"), F.stddev_pop(o).alias("sd"), F.median(e).alias("e"))
    a = v.join(F.broadcast(b), "feature").groupBy("feature").agg((F.median(F.when(~F.col("ex"), F.abs(F.col("v") - F.col("m")))) * 1.4826).alias("mad"))
    u = M.roc_auc(v.withColumn("y", F.col("ex").cast("int")), ["feature"], "y", "v").select("feature", "auc")
    return b.join(a, "feature").join(u, "feature").select("feature", F.round("m", 6).alias("center"), F.round(F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.col("sd")), 5).alias("scale"), F.when(F.col("e") >= F.col("m"), 1).otherwise(-1).alias("direction"), F.round(F.abs(F.col("auc") - 0.5), 6).alias("weight"))


@register("mean_importance", LONG + ", i AS (SELECT session AS model, feature, corr(v, ex::INT) AS w FROM v GROUP BY ALL) SELECT feature, round(avg(abs(w)), 6) AS importance, count(*) AS models FROM i WHERE w IS NOT NULL GROUP BY feature")
def mean_importance(spark, d):
    i = features(spark, d).groupBy("session", "feature").agg(F.abs(F.corr("v", F.col("ex").cast("int"))).alias("w")).where("w is not null")
    return i.groupBy("feature").agg(F.round(F.avg("w"), 6).alias("importance"), F.count(F.lit(1)).alias("models"))


@register("reliance_matrix", LONG + ", i AS (SELECT session, feature, abs(corr(v, ex::INT)) AS w FROM v GROUP BY ALL), s AS (SELECT session, sum(w) AS t FROM i GROUP BY session) SELECT i.session, " + ", ".join(f"round(coalesce(max(w) FILTER (feature = '{c}') / nullif(any_value(t), 0), 0), 6) AS {c}" for c in _FEATURES) + " FROM i JOIN s USING (session) GROUP BY i.session")
def reliance_matrix(spark, d):
    """Importances side by side, rows summing to 1; rows of zeros stay."""
    i = features(spark, d).groupBy("session", "feature").agg(F.abs(F.corr("v", F.col("ex").cast("int"))).alias("w"))
    p = i.groupBy("session").pivot("feature", list(_FEATURES)).agg(F.first("w")).fillna(0.0)
    total = sum((F.col(c) for c in _FEATURES[1:]), F.col(_FEATURES[0]))
    return p.select("session", *(F.round(F.when(total > 0, F.col(c) / total).otherwise(0.0), 6).alias(c) for c in _FEATURES))


@register("transfer_health", BOUTS + """, m AS (SELECT user_id, count(*) AS n, sum(end_frame - start_frame + 1) / 30.0 AS t FROM b GROUP BY 1), s AS (SELECT DISTINCT f.user_id, coalesce(n, 0) AS n, coalesce(t, 0)::DOUBLE AS t FROM f LEFT JOIN m USING (user_id)), c AS (SELECT median(t) AS med FROM s), d AS (SELECT median(abs(t - med)) AS mad FROM s, c), z AS (SELECT user_id, n, t, CASE WHEN mad <= 1e-9 THEN 0 ELSE 0.6745 * (t - med) / mad END AS z FROM s, c, d),
h AS (SELECT *, greatest(0, 100 - 30 * (n <= 1)::INT - 25 * (abs(z) >= 3.5)::INT) AS health FROM z) SELECT user_id, n AS n_bouts, round(t, 6) AS time_s, round(z, 6) AS z, n <= 1 AS few_bouts, abs(z) >= 3.5 AS outlier, health, CASE WHEN health >= 80 THEN 'Good' WHEN health >= 55 THEN 'Warning' ELSE 'Poor' END AS grade FROM h""")
def transfer_health(spark, d):
    """Subjects with few bouts or with a robust z of 3.5 or more lose points; 80 is good, 55 a warning."""
    m = bouts(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("end_frame") - F.col("start_frame") + 1) / FPS).alias("t"))
    s = frames(spark, d).select("user_id").distinct().join(m, "user_id", "left").fillna(0, ["n"]).fillna(0.0, ["t"])
    z = M.robust_z(s.withColumn("one", F.lit(1)), ["one"], "t").withColumnRenamed("robust_z", "z")
    few, odd = F.col("n") <= 1, F.abs("z") >= 3.5
    health = F.greatest(F.lit(0), 100 - F.when(few, 30).otherwise(0) - F.when(odd, 25).otherwise(0))
    return z.select("user_id", F.col("n").alias("n_bouts"), F.round("t", 6).alias("time_s"), F.round("z", 6).alias("z"), few.alias("few_bouts"), odd.alias("outlier"), health.alias("health"), F.when(health >= 80, "Good").when(health >= 55, "Warning").otherwise("Poor").alias("grade"))


@register("cluster_confidence", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.vec_id, e.label, sqrt(sum(pow(x - m, 2))) AS d FROM e JOIN c ON c.label = e.label AND c.k = e.k GROUP BY 1, 2) SELECT vec_id, round(1 - d / nullif(max(d) OVER (PARTITION BY label), 0), 5) AS confidence FROM d""")
def cluster_confidence(spark, d):
    """1 less the distance to the own centroid over the largest of the cluster; vectors stay arrays, centroids are one row a label."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = M.centroids(e, "label", "v")
    dist = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    q = e.join(F.broadcast(c), "label").withColumn("d", dist)
    return q.select("vec_id", F.round(1 - F.col("d") / F.nullif(F.max("d").over(Window.partitionBy("label")), F.lit(0.0)), 5).alias("confidence"))


@register("sample_weights", "WITH n AS (SELECT sum(quality) AS pos, count(*) - sum(quality) AS neg FROM labels) SELECT doc_id, round(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE least(3.0::DOUBLE, greatest(0.33::DOUBLE, pos / neg)) END, 6) AS weight FROM labels, n")
def sample_weights(spark, d):
    l = table(spark, d, "labels")
    n = F.broadcast(l.agg(F.sum("quality").alias("pos"), (F.count(F.lit(1)) - F.sum("quality")).alias("neg")))
    return l.join(n).select("doc_id", F.round(F.when(F.col("quality") == 1, 1.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.33), F.col("pos") / F.col("neg")))), 6).alias("weight"))


@register("target_prf", CELLS + " SELECT project, behavior, seed, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(f1, 6) AS f1, " + _DEGENERATE + " AS degenerate FROM c")
def target_prf(spark, d):
    c = cells(spark, d)
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return c.select("project", "behavior", "seed", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.round("f1", 6).alias("f1"), degenerate().alias("degenerate"))


@register("feature_entropy", CTE + ", r AS (SELECT user_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi, count(*) OVER (PARTITION BY user_id) AS n FROM f), b AS (SELECT user_id, any_value(n) AS n, any_value((hi - lo) / 16) AS w, least(15, floor((value - lo) / ((hi - lo) / 16))) AS b, count(*) AS k FROM r WHERE hi > lo GROUP BY user_id, b) SELECT user_id, round(-sum(k / (n * w) * ln(k / (n * w))), 6) AS entropy FROM b GROUP BY user_id")
def feature_entropy(spark, d):
    """Entropy of a 16-bin density histogram of the session's own range: of densities, not of probabilities."""
    w = Window.partitionBy("user_id")
    r = frames(spark, d).select("user_id", "value", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.count(F.lit(1)).over(w).alias("n")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / 16
    b = r.groupBy("user_id", "n", width.alias("w"), F.least(F.lit(15), F.floor((F.col("value") - F.col("lo")) / width)).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    h = F.col("k") / (F.col("n") * F.col("w"))
    return b.groupBy("user_id").agg(F.round(-F.sum(h * F.log(h)), 6).alias("entropy"))
