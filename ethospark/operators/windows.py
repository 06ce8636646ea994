"""Row-count hopping windows, group standardisation and framewise differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def frame_index(df: DataFrame, keys: list[str], order: list[str], out: str = "frame") -> DataFrame:
    """Number the rows of each key from 0."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def hopping_windows(df: DataFrame, keys: list[str], size: int, stride: int, frame: str = "frame") -> DataFrame:
    """Each row once for every full window of `size` rows, starting every `stride` rows, that holds it: window, pos.

    frame must number the rows of a key from 0. Row r is in windows ceil((r - size + 1) / stride) to floor(r / stride).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    r = F.col(frame)
    lo = F.greatest(F.lit(0), F.ceil((r - (size - 1)) / stride))
    hi = F.least(F.floor(r / stride), F.floor((F.col("__n") - size) / stride))
    df = df.withColumn("__n", n).where(F.col("__n") >= size).withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi")
    return df.withColumn("window", F.explode(F.sequence("__lo", "__hi"))).withColumn("pos", r - F.col("window") * stride).drop("__n", "__lo", "__hi")


def window_stats(windows: DataFrame, keys: list[str], col: str, size: int, edge: float = 0.25) -> DataFrame:
    """Mean, population std, median, max, p10, p90, energy, trend and edge-band delta of col per window; a missing value makes the window's statistics null."""
    band = max(1, min(size // 2, round(edge * size)))
    x = F.col(col)
    whole = F.count(x) == F.count(F.lit(1))
    # One aggregate, and so one buffer, for all three.
    q = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    stats = {
        "mean": F.avg(x), "std": F.stddev_pop(x), "median": q[1], "max": F.max(x), "p10": q[0], "p90": q[2], "energy": F.avg(x * x), "trend": F.regr_slope(x, F.col("pos")),
        "delta": F.avg(F.when(F.col("pos") >= size - band, x)) - F.avg(F.when(F.col("pos") < band, x)),
    }
    return windows.groupBy(*keys, "window").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), *(F.when(whole, v).alias(f"{col}_{k}") for k, v in stats.items()))


def zscore(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(x - mean) / sample std within keys; a std of zero or of one row counts as 1."""
    w = Window.partitionBy(*keys)
    sd = lambda c: F.coalesce(F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / sd(c) for c in cols})


def finite_difference(df: DataFrame, keys: list[str], col: str, fps: float, out: str, order: str = "frame") -> DataFrame:
    """(x - previous x) * fps, 0 in the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, (F.col(col) - F.lag(col, 1).over(w)) * fps).withColumn(out, F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col(out)))


def speed(df: DataFrame, keys: list[str], x: str, y: str, fps: float, order: str = "frame") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) * fps
    return df.withColumn("speed", F.coalesce(d, F.lit(0.0)))


def clean_series(df: DataFrame, keys: list[str], col: str, likelihood: str, threshold: float, max_gap: int = 10, smooth: int = 5, order: str = "frame") -> DataFrame:
    """Drop values of low likelihood, interpolate up to max_gap rows into each gap, smooth by a centred truncated mean, fill forward, backward, with 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__v", F.when(F.col(likelihood) >= threshold, F.col(col)))
    at = F.when(F.col("__v").isNotNull(), F.col(order))
    df = df.withColumns({"__p": F.last("__v", True).over(back), "__n": F.first("__v", True).over(ahead), "__pf": F.last(at, True).over(back), "__nf": F.first(at, True).over(ahead)})
    gap = F.col(order) - F.col("__pf")
    line = F.when(F.col("__v").isNotNull(), F.col("__v")).when(gap <= max_gap, F.when(F.col("__n").isNotNull(), F.col("__p") + (F.col("__n") - F.col("__p")) * gap / (F.col("__nf") - F.col("__pf"))).otherwise(F.col("__p")))
    half = smooth // 2
    df = df.withColumn("__i", line).withColumn("__s", F.avg("__i").over(w.rowsBetween(-half, half)))
    filled = F.coalesce(F.last("__s", True).over(back), F.first("__s", True).over(ahead), F.lit(0.0))
    return df.withColumn(f"{col}_clean", filled).drop("__v", "__p", "__n", "__pf", "__nf", "__i", "__s")


def run_length_seconds(df: DataFrame, keys: list[str], mask: F.Column, fps: float, out: str, order: str = "frame") -> DataFrame:
    """Seconds since mask was last false; a run from the first row is one frame short."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    reset = F.coalesce(F.max(F.when(~mask, F.col(order))).over(w), F.lit(0))
    return df.withColumn(out, F.when(mask, (F.col(order) - reset) / fps).otherwise(0.0))


def segment_table(df: DataFrame, keys: list[str], cols: list[str], size: int, stride: int, edge: float = 0.25) -> DataFrame:
    """The feature table of windows: segment_id, keys, start_frame, end_frame and, of each column, mean, std, median, max, p10, p90, energy, periodicity, trend and delta.

    Rows without a frame go. Windows are full runs of `size` rows in order of frame, every `stride` rows; a key with fewer rows is one segment.
    A missing value makes a column's statistics of that window null. All columns come from one shuffle of windows; three percentiles share a buffer.
    """
    rows = df.where(F.col("frame").isNotNull())
    own = Window.partitionBy(*keys)
    rows = rows.withColumns({"__i": F.row_number().over(own.orderBy("frame")) - 1, "__n": F.count(F.lit(1)).over(own)})
    lo = F.greatest(F.lit(0), F.ceil((F.col("__i") - (size - 1)) / stride))
    hi = F.least(F.floor(F.col("__i") / stride), F.floor((F.col("__n") - size) / stride))
    at = F.when(F.col("__n") < size, F.array(F.lit(0).cast("long"))).otherwise(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))))
    w = rows.withColumn("__w", F.explode(at)).withColumn("__pos", F.col("__i") - F.col("__w") * stride)
    n = F.least(F.col("__n"), F.lit(size))
    band = F.greatest(F.lit(1), F.least(F.floor(n / 2), F.bround(edge * n)))
    w = w.withColumns({"__head": F.col("__pos") < band, "__tail": F.col("__pos") >= n - band})
    stats: list = []
    for c in cols:
        x = F.col(c).cast("double")
        stats += [
            (F.count(x) == F.count(F.lit(1))).alias(f"__ok_{c}"), F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.max(x).alias(f"{c}_max"), F.avg(x * x).alias(f"{c}_energy"), F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(f"__q_{c}"),
            F.regr_slope(x, F.col("__pos")).alias(f"{c}_trend"), (F.avg(F.when(F.col("__tail"), x)) - F.avg(F.when(F.col("__head"), x))).alias(f"{c}_delta"), F.transform(F.array_sort(F.collect_list(F.struct("__pos", x.alias("x")))), lambda e: e["x"]).alias(f"__v_{c}"),
        ]
    g = w.groupBy(*keys, "__w").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), *stats)
    out = {}
    for c in cols:
        q = F.col(f"__q_{c}")
        values = {"mean": F.col(f"{c}_mean"), "std": F.col(f"{c}_std"), "median": q[1], "max": F.col(f"{c}_max"), "p10": q[0], "p90": q[2], "energy": F.col(f"{c}_energy"), "periodicity": periodicity(F.col(f"__v_{c}")), "trend": F.col(f"{c}_trend"), "delta": F.col(f"{c}_delta")}
        out |= {f"{c}_{k}": F.when(F.col(f"__ok_{c}"), v) for k, v in values.items()}
    ids = F.concat_ws("_", F.lit("seg"), *keys, "start_frame", "end_frame")
    return g.select(ids.alias("segment_id"), *keys, "start_frame", "end_frame", *(v.alias(k) for k, v in out.items()))


def periodicity(values: Column) -> Column:
    """Largest non-constant Fourier magnitude of an array; 0 under 8 values or for a variance of 1e-10 at most."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, e: s + e) / n
    c = F.transform(values, lambda e: e - mean)
    part = lambda k, f: F.aggregate(F.transform(c, lambda e, i: e * f(2 * math.pi * k * i / n)), F.lit(0.0), lambda s, e: s + e)
    size = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), lambda k: F.hypot(part(k, F.cos), part(k, F.sin)))
    var = F.aggregate(c, F.lit(0.0), lambda s, e: s + e * e) / n
    return F.when((n < 8) | (var <= 1e-10), 0.0).otherwise(F.array_max(size))
