"""Ordered behaviour sequences: transitions, n-grams and their group means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def transitions(df: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """Counts of label followed at once by another label: (keys, src, dst, n)."""
    nxt = F.lead(label).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, F.col(label).alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def gap_transitions(events: DataFrame, key: str, max_gap: float, tolerance: float, include_self: bool = False) -> DataFrame:
    """B follows A if B starts from tolerance before A's end to max_gap after it; each label counts once for an A. events: start_s, end_s, label."""
    width = max_gap + tolerance
    a = events.select(key, F.monotonically_increasing_id().alias("__id"), F.col("label").alias("src"), "start_s", F.col("end_s").alias("__e"))
    a = a.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__e") - tolerance) / width), F.floor((F.col("__e") + max_gap) / width))))
    b = events.select(key, F.col("label").alias("dst"), F.col("start_s").alias("__b")).withColumn("__bin", F.floor(F.col("__b") / width))
    hit = a.join(b, [key, "__bin"]).where((F.col("__b") >= F.col("__e") - tolerance) & (F.col("__b") <= F.col("__e") + max_gap) & (F.col("__b") > F.col("start_s")))
    if not include_self:
        hit = hit.where("src <> dst")
    return hit.select(key, "__id", "src", "dst").distinct().groupBy(key, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def normalize_rows(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "src")))


def ngrams(df: DataFrame, keys: list[str], label: str, order: list[str], n: int, uniform: bool = False) -> DataFrame:
    """Counts of n consecutive labels; grams of one repeated label go unless uniform."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gram = F.array(F.col(label), *(F.lead(label, k).over(w) for k in range(1, n)))
    out = df.select(*keys, gram.alias("g")).where(F.col("g")[n - 1].isNotNull())
    if not uniform:
        out = out.where(F.size(F.array_distinct("g")) > 1)
    return out.select(*keys, F.array_join("g", ">").alias("motif")).groupBy(*keys, "motif").agg(F.count(F.lit(1)).alias("n"))
