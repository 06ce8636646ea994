"""Agreement, discrimination and calibration as aggregates; each takes optional grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def counts(y: F.Column, p: F.Column) -> dict[str, F.Column]:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return {"tp": n((y == 1) & (p == 1)), "fp": n((y == 0) & (p == 1)), "fn": n((y == 1) & (p == 0)), "tn": n((y == 0) & (p == 0))}


def confusion(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (zero for empty denominators), specificity, balanced accuracy (null without both classes) and MCC."""
    c = df.groupBy(*keys).agg(*(v.alias(k) for k, v in counts(F.col(y), F.col(p)).items()))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    under = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": F.when(tn + fp > 0, tn / (tn + fp)), "balanced_accuracy": F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2), "mcc": F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(0.0)})


def roc_auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Rank AUC with averaged ties; null unless both classes occur. Ties are counted first, so ranks run over distinct scores."""
    by = df.groupBy(*keys, score).agg(F.sum(y).cast("long").alias("__p"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("__r", F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2)
    a = by.groupBy(*keys).agg(F.sum(F.col("__r") * F.col("__p")).alias("__s"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("__t"))
    neg = F.col("__t") - F.col("n_pos")
    return a.select(*keys, "n_pos", F.when((F.col("n_pos") > 0) & (neg > 0), (F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg)).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Sum of precision times gain in recall over falling distinct scores in [0, 1]."""
    by = df.groupBy(*keys, score).agg(F.sum(y).alias("__p"), F.count(F.lit(1)).alias("__n"))
    n = ranked(by, keys, score, "__n").select(*keys, score, "__p", "__n", (F.col("__m") - F.col("__below")).alias("__k"))
    p = ranked(by, keys, score, "__p").select(*keys, score, (F.col("__m") - F.col("__below")).alias("__tp"))
    return n.join(p, [*keys, score]).groupBy(*keys).agg((F.sum(F.col("__p") * F.col("__tp") / F.col("__k")) / F.nullif(F.sum("__p"), F.lit(0))).alias("ap"))


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, precision and recall at each distinct score in [0, 1]."""
    by = df.groupBy(score).agg(F.sum(y).alias("__p"), F.count(F.lit(1)).alias("__n"))
    n = ranked(by, [], score, "__n").select(score, (F.col("__m") - F.col("__below")).alias("__k"))
    p = ranked(by, [], score, "__p").select(score, (F.col("__m") - F.col("__below")).alias("__tp"), F.col("__m").alias("__all"))
    return n.join(p, score).select(F.col(score).alias("threshold"), (F.col("__tp") / F.col("__k")).alias("precision"), (F.col("__tp") / F.nullif("__all", F.lit(0))).alias("recall"))


def calibration(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Right-closed bins; expected and maximum calibration error and Brier score."""
    b = df.withColumn("__b", F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)))
    g = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    return g.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("sq") / F.sum("n")).alias("brier"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Left-closed bins; p = 1 falls in none."""
    return df.where(F.col(p) < 1).groupBy(F.floor(F.col(p) * bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"))


def best_threshold(df: DataFrame, keys: list[str], y: str, p: str, grid: list[float]) -> DataFrame:
    """The first threshold of largest F1."""
    t = df.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    t = t.withColumn("__pred", (F.col(p) >= F.col("threshold")).cast("int"))
    c = confusion(t, [*keys, "threshold"], y, "__pred")
    return c.groupBy(*keys).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select(*keys, "b.threshold", "b.f1")


def agreement(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson r, concordance, r squared, MAE, bias and limits of agreement over finite pairs; correlations need three pairs."""
    a, b = F.col(x), F.col(y)
    d = b - a
    g = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("__r"), F.covar_pop(a, b).alias("__c"), F.var_pop(a).alias("__va"), F.var_pop(b).alias("__vb"), (F.avg(a) - F.avg(b)).alias("__d"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    ok = F.col("n") >= 3
    return g.select(*keys, "n", F.when(ok, F.col("__r")).alias("pearson"), F.when(ok, 2 * F.col("__c") / F.nullif(F.col("__va") + F.col("__vb") + F.col("__d") ** 2, F.lit(0.0))).alias("ccc"), F.when(ok, F.col("__r") ** 2).alias("r2"), "mae", "bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("loa_low"), (F.col("bias") + 1.96 * F.col("sd")).alias("loa_high"))


def cohen_kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two raters; null when chance agreement is complete."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    pa, pb = df.groupBy(*keys, F.col(a).alias("l")).agg(F.count(F.lit(1)).alias("na")), df.groupBy(*keys, F.col(b).alias("l")).agg(F.count(F.lit(1)).alias("nb"))
    pe = pa.join(pb, [*keys, "l"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    out = (n.join(pe, keys, "left") if keys else n.crossJoin(F.broadcast(pe))).withColumn("pe", F.coalesce(F.col("s"), F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select(*keys, "n", "po", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def ranked(df: DataFrame, keys: list[str], value: str, n: str, buckets: int = 1024) -> DataFrame:
    """df, one row a distinct value of [0, 1] with its count n, with __bucket, __below (count of smaller values) and __m (count of all).

    Values fall into buckets, and offsets come from sums of buckets; no window holds more than a bucket's distinct values or all buckets.
    """
    b = df.withColumn("__bucket", F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)))
    sums = b.groupBy(*keys, "__bucket").agg(F.sum(n).alias("__s"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__s").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__s").over(w).alias("__m"))
    own = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(sums, [*keys, "__bucket"]).withColumn("__below", F.col("__o") + F.coalesce(F.sum(n).over(own), F.lit(0))).drop("__o")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """q = smallest p * m / rank from here to the largest p; nulls stay out of m. Equal p have equal q, that of the last of them.

    Works on distinct p: the last rank of each is its cumulated count. The least to the right is taken within a bucket and over the buckets behind.
    """
    by = ranked(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n")), keys, p, "__n")
    raw = by.withColumn("__q", F.col(p) * F.col("__m") / (F.col("__below") + F.col("__n")))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    behind = raw.groupBy(*keys, "__bucket").agg(F.min("__q").alias("__l")).select(*keys, "__bucket", F.min("__l").over(w.orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)).alias("__l"))
    own = F.min("__q").over(Window.partitionBy(*keys, "__bucket").orderBy(p).rowsBetween(0, Window.unboundedFollowing))
    q = raw.join(behind, [*keys, "__bucket"]).select(*keys, p, F.least(F.lit(1.0), own, "__l").alias("q"))
    return df.join(q, [*keys, p], "left")


def bh_threshold(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """threshold: alpha * k / m of the largest rank k whose p is at most that; null where none is."""
    by = ranked(df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("__n")), [], p, "__n")
    line = (F.col("__below") + F.col("__n")) / F.col("__m") * alpha
    return by.agg(F.max(F.when(F.col(p) <= line, line)).alias("threshold"))


def reciprocal_rank(df: DataFrame, key: str, y: str, score: str, budgets: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Mean of 1 / rank over positives, by falling score in [0, 1], ties by key; positives in the first of each budget, and their share.

    A row's rank is the count of larger scores and its place among equal ones; only equal scores meet.
    """
    by = ranked(df.groupBy(score).agg(F.count(F.lit(1)).alias("__n")), [], score, "__n").select(score, (F.col("__m") - F.col("__below") - F.col("__n")).alias("__above"))
    r = df.join(by, score).withColumn("__r", F.col("__above") + F.row_number().over(Window.partitionBy(score).orderBy(key))).where(F.col(y) == 1)
    n = [F.count_if(F.col("__r") <= b) for b in budgets]
    return r.agg(F.avg(1.0 / F.col("__r")).alias("mrr"), *(c.alias(f"in_{b}") for b, c in zip(budgets, n)), *((c / F.count(F.lit(1))).alias(f"recall_{b}") for b, c in zip(budgets, n)))


def robust_z(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """0.6745 (x - median) / MAD within keys; 0 where MAD vanishes.

    Medians are taken over distinct values with their counts, so a key's buffer holds its distinct values; both come in two aggregates and one join.
    """
    by = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    med = by.groupBy(*keys).agg(F.percentile(col, 0.5, F.col("__n")).alias("__med"))
    mad = by.join(med, keys).groupBy(*keys).agg(F.first("__med").alias("__med"), F.percentile(F.abs(F.col(col) - F.col("__med")), 0.5, F.col("__n")).alias("__mad"))
    return df.join(mad, keys).withColumn("robust_z", F.when(F.col("__mad") <= 1e-9, 0.0).otherwise(0.6745 * (F.col(col) - F.col("__med")) / F.col("__mad"))).drop("__med", "__mad")


def fleiss(df: DataFrame, item: str, rater: str, label: str, raters: int) -> DataFrame:
    """Items that all raters labelled: shared_clips, share of full agreement and Fleiss' kappa, null where one label is all there is."""
    c = df.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    whole = c.groupBy(item).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("k")).where(F.col("t") == raters)
    s = whole.agg(F.count(F.lit(1)).alias("shared_clips"), F.avg((F.col("k") == 1).cast("int")).alias("agreement"), F.avg((F.col("q") - raters) / (raters * (raters - 1))).alias("p"))
    share = c.join(whole.select(item), item).groupBy(label).agg(F.sum("n").alias("n"))
    e = share.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("pe"))
    return s.crossJoin(F.broadcast(e)).select("shared_clips", "agreement", F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, c, n): mean vector of each label; vectors are summed place by place, so only sums are shuffled."""
    each = df.select(label, F.posexplode(vector).alias("__k", "__x")).groupBy(label, "__k").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__m"))), lambda e: e["__m"]).alias("c"), F.max("n").alias("n"))


def nearest(df: DataFrame, key: str, vector: str, labels: DataFrame, label: str) -> DataFrame:
    """(key, centroid, dist): the nearest of labels(label, c), the first of equals. The centroids are one array in one row, so vectors are not shuffled."""
    one = labels.agg(F.array_sort(F.collect_list(F.struct(label, "c"))).alias("__cs"))
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    all_ = F.transform("__cs", lambda e: F.struct(dist(e["c"]).alias("d"), e[label].alias("l")))
    return df.join(F.broadcast(one)).select(key, F.array_min(all_).alias("__b")).select(key, F.col("__b.l").alias("centroid"), F.col("__b.d").alias("dist"))
