"""Queries of clusters, hidden states, classifiers and their sweeps. Fits have no SQL; tests hold them against enumeration, planted states and held-out rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from .behaviour import frames, table
from .ranking import segments
from .registry import register

COLS = ["m", "sd", "mx"]


def rows(spark, d):
    """Segments with y: whether the likeliest frame is high."""
    g = segments(spark, d)[0]
    return g.select("id", "user_id", "win", *COLS, "uncertainty_score", (F.col("prediction_prob") >= 0.5).cast("int").alias("y"))


@register("motif_clusters")
def motif_clusters(spark, d):
    return M.discover(rows(spark, d), COLS, 4, F.col("win") % 2 == 0).select("id", "motif")


@register("behavior_hmm")
def behavior_hmm(spark, d):
    """Hidden states of each session's event types."""
    f = frames(spark, d)
    code = f.select("event_type").distinct().orderBy("event_type")
    names = [r["event_type"] for r in code.collect()]
    o = f.withColumn("c", F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).cast("int") - 1).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "c"))), lambda x: x["c"]).alias("o"))
    p, _ = M.fit_hmm(o, "user_id", "o", 2, len(names), iterations=5)
    return M.decode(o, "user_id", "o", p)


@register("feature_hmm")
def feature_hmm(spark, d):
    """Hidden states of each session's segments, normal in two features."""
    g = rows(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "m", "sd"))), lambda x: F.array(x["m"], x["sd"])).alias("o"))
    p, _ = M.fit_hmm(g, "user_id", "o", 2, iterations=5)
    return M.decode(g, "user_id", "o", p)


@register("learning_curve")
def learning_curve(spark, d):
    return M.learning_curve(rows(spark, d), COLS, "y", "user_id", "id", [10, 30], 1)


@register("feature_ablation")
def feature_ablation(spark, d):
    return M.ablation(rows(spark, d), {"pose": ["sd"], "speed": ["mx"], "level": ["m"]}, "pose", "y", "user_id")


@register("active_learning")
def active_learning(spark, d):
    return M.active_learning(rows(spark, d), COLS, "y", "user_id", "id", 20, 20, 1, "uncertainty")


@register("embedding_map")
def embedding_map(spark, d):
    return M.embed(rows(spark, d), COLS, "id").select("id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@register("upsampled_labels", "WITH l AS (SELECT doc_id, toxic AS y FROM labels), n AS (SELECT count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM l) SELECT y, CASE WHEN a = 0 OR b = 0 THEN a + b ELSE greatest(a, b) END AS n FROM n, (SELECT DISTINCT y FROM l)")
def upsampled_labels(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"))
    return M.upsample(l, "y", "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("standardized_features", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) FILTER (l_linestatus = 'F') OVER ()) / stddev_pop(l_quantity) FILTER (l_linestatus = 'F') OVER (), 6) AS z FROM lineitem")
def standardized_features(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", F.col("l_quantity").alias("z"))
    return M.standardize(l, ["z"], F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))
