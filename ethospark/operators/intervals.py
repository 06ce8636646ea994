"""Traces to bouts, merging rules, and joins of intervals."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def median_trace(df: DataFrame, keys: list[str], col: str, window: int = 5, out: str = "smooth", order: str = "frame") -> DataFrame:
    """Moving median; a window is cut at the ends of its key."""
    half = window // 2
    return df.withColumn(out, F.percentile(col, 0.5).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))


def smooth_trace(df: DataFrame, keys: list[str], col: str, window: int = 5, out: str = "smooth", order: str = "frame") -> DataFrame:
    """Zero-padded moving sum over a constant window."""
    half = window // 2
    return df.withColumn(out, F.sum(col).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)) / window)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bouts_of_trace(df: DataFrame, keys: list[str], col: str, threshold, merge_gap, min_frames, order: str = "frame") -> DataFrame:
    """Inclusive runs of col >= threshold; runs at most merge_gap frames apart are merged first, then those under min_frames are dropped.

    The three settings are numbers or columns among keys.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    on = df.where(F.col(col) >= _c(threshold))
    on = on.withColumn("__new", (F.coalesce(F.col(order) - F.lag(order).over(w) - 1, _c(merge_gap) + 1) > _c(merge_gap)).cast("int"))
    on = on.withColumn("__island", F.sum("__new").over(w))
    out = on.groupBy(*keys, "__island").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.avg(col).alias("mean_prob")).drop("__island")
    return out.where(F.col("end_frame") - F.col("start_frame") + 1 >= F.greatest(F.lit(1), _c(min_frames)))


def merge_intervals(df: DataFrame, keys: list[str], max_gap: int, min_duration: int = 1) -> DataFrame:
    """Union of inclusive intervals whose start is at most max_gap after the furthest end so far; short results are dropped."""
    w = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    far = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col("start_frame") - far > max_gap).cast("int"), F.lit(1)))
    df = df.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*keys, "__island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("__island")
    return out.where(F.col("end_frame") - F.col("start_frame") + 1 >= min_duration)


def pad_intervals(df: DataFrame, pad: int, last: F.Column) -> DataFrame:
    """Widen by pad on both sides, clamped to 0..last; inverted ones go."""
    return df.withColumns({"start_frame": F.greatest(F.lit(0), F.col("start_frame") - pad), "end_frame": F.least(last, F.col("end_frame") + pad)}).where("start_frame <= end_frame")


def observed_islands(df: DataFrame, keys: list[str], merge_gap: int) -> DataFrame:
    """Island number of each interval, cut where the next start lies more than merge_gap beyond the previous row's end."""
    w = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    new = F.coalesce((F.col("start_frame") - F.lag("end_frame").over(w) - 1 > merge_gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def _binned(df: DataFrame, width: int, start: str, end: str) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", width: int = 64, half_open: bool = False) -> DataFrame:
    """Overlap of left(start_frame, end_frame) and right(r_start, r_end); how: inner, left_semi or left_anti. Ends are inclusive, or not if half_open.

    Both sides are cut into bins of `width` frames, so the join is by equality; a pair is kept in the first bin that both have. For left_semi
    and left_anti the left side is read as distinct rows of its keys and interval, and comes back whole by these.
    """
    meets = (F.col("start_frame") < F.col("r_end")) & (F.col("end_frame") > F.col("r_start")) if half_open else (F.col("start_frame") <= F.col("r_end")) & (F.col("end_frame") >= F.col("r_start"))
    b = _binned(right, width, "r_start", "r_end")
    if how == "inner":
        hit = _binned(left, width, "start_frame", "end_frame").join(b, [*keys, "__bin"]).where(meets)
        return hit.where(F.col("__bin") == F.greatest(F.floor(F.col("start_frame") / width), F.floor(F.col("r_start") / width))).drop("__bin")
    own = [*keys, "start_frame", "end_frame"]
    met = _binned(left.select(*own).distinct(), width, "start_frame", "end_frame").join(b.select(*keys, "__bin", "r_start", "r_end"), [*keys, "__bin"]).where(meets).select(*own).distinct()
    return left.join(met, own, how)


def nearest_center(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """points(r_start, r_end) with the interval of nearest centre in its keys (start_frame, end_frame), the first of equals; those of keys without one go.

    Two looks along the centres of both, one back and one ahead: no pair but two for each point.
    """
    mid = lambda a, z: (F.col(a) + F.col(z)) / 2
    rest = [c for c in points.columns if c not in keys]
    p = points.select(*keys, mid("r_start", "r_end").alias("__c"), F.struct(*rest).alias("__p"), F.lit(None).cast("struct<start_frame:bigint,end_frame:bigint>").alias("__i"))
    i = intervals.select(*keys, mid("start_frame", "end_frame").alias("__c"), F.struct(F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame")).alias("__i")).groupBy(*keys, "__c").agg(F.min("__i").alias("__i"))
    i = i.withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType))
    both = p.unionByName(i)
    at = F.when(F.col("__i").isNotNull(), F.struct("__c", "__i"))
    w = Window.partitionBy(*keys).orderBy("__c", F.col("__i").isNull().cast("int"))
    back, ahead = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    n = both.withColumns({"__b": back, "__a": ahead}).where("__p is not null")
    db, da = F.col("__c") - F.col("__b.__c"), F.col("__a.__c") - F.col("__c")
    first = F.when(F.col("__a").isNull() | (db < da) | ((db == da) & (F.col("__b.__i.start_frame") <= F.col("__a.__i.start_frame"))), F.col("__b.__i")).otherwise(F.col("__a.__i"))
    return n.withColumn("__m", first).where("__m is not null").select(*keys, "__p.*", "__m.start_frame", "__m.end_frame")


def temporal_iou(start: F.Column, end: F.Column, r_start: F.Column, r_end: F.Column) -> F.Column:
    common = F.greatest(F.lit(0), F.least(end, r_end) - F.greatest(start, r_start) + 1)
    return common / (F.greatest(end, r_end) - F.least(start, r_start) + 1)


def best_iou(pred: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """For each true interval (r_start, r_end) its best overlapping prediction, onset and offset errors."""
    pairs = overlap_join(pred, true, keys).withColumn("iou", temporal_iou(F.col("start_frame"), F.col("end_frame"), F.col("r_start"), F.col("r_end")))
    top = pairs.groupBy(*keys, "r_start", "r_end").agg(F.max_by(F.struct("start_frame", "end_frame", "iou"), F.struct("iou", -F.col("start_frame"))).alias("m"))
    return top.select(*keys, "r_start", "r_end", "m.*", F.abs(F.col("m.start_frame") - F.col("r_start")).alias("onset_err"), F.abs(F.col("m.end_frame") - F.col("r_end")).alias("offset_err"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, out: str, touch: bool = True) -> DataFrame:
    """df with the number of the run of intervals that no gap cuts: what lies in two islands shares no frame. touch: ends are inclusive."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | ((F.col(start) > far) if touch else (F.col(start) >= far)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def greedy_match(pred: DataFrame, true: DataFrame, keys: list[str], threshold: float = 0.2, order: str = "start_frame") -> DataFrame:
    """tp, fp, fn per keys: predictions in the given order take the free true interval of best IoU at threshold or more, the latest of equals.

    Only overlapping pairs are candidates; they fall into islands that share no interval, and an island's pairs, sorted once, are dealt out.
    """
    pairs = overlap_join(pred.select(*keys, "start_frame", "end_frame", F.col(order).alias("__o")), true.select(*keys, "r_start", "r_end").distinct(), keys)
    pairs = pairs.withColumn("__iou", temporal_iou(F.col("start_frame"), F.col("end_frame"), F.col("r_start"), F.col("r_end"))).where(F.col("__iou") >= threshold)
    pairs = pairs.withColumns({"__a": F.least("start_frame", "r_start"), "__z": F.greatest("end_frame", "r_end")})
    pairs = islands(pairs, keys, "__a", "__z", "__island")

    def deal(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["__o", "start_frame", "end_frame", "__iou", "r_start", "r_end"], ascending=[True, True, True, False, False, False], kind="stable")
        given, taken = set(), set()
        for p, t in zip(zip(g["__o"], g.start_frame, g.end_frame), zip(g.r_start, g.r_end), strict=True):
            if p not in given and t not in taken:
                given.add(p)
                taken.add(t)
        return g.head(1)[keys].assign(tp=len(given))

    kinds = dict(pred.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    tp = pairs.groupBy(*keys, "__island").applyInPandas(deal, f"{schema}, tp long").groupBy(*keys).agg(F.sum("tp").alias("tp"))
    n, m = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), true.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    out = n.join(m, keys, "full").join(tp, keys, "left").fillna(0, ["__n", "__m", "tp"])
    return out.select(*keys, "tp", (F.col("__n") - F.col("tp")).alias("fp"), (F.col("__m") - F.col("tp")).alias("fn"))


def suppress_overlaps(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Greedy non-maximum suppression within keys: by falling `by`, keep what shares no frame (ends exclusive) with what is kept; ties go by start.

    Intervals of different islands share no frame, so a task holds one island; what is kept is disjoint, so one look to each side will do.
    """
    cut = islands(df, keys, "start_frame", "end_frame", "__island", touch=False)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*by, "start_frame", "end_frame"], ascending=[False] * len(by) + [True, True], kind="stable")
        starts, ends, keep = [], [], []
        for a, b in zip(g.start_frame, g.end_frame, strict=True):
            i = bisect_left(starts, b)
            keep.append(i == 0 or ends[i - 1] <= a)
            if keep[-1]:
                starts.insert(i, a)
                ends.insert(i, b)
        return g[keep]

    return cut.groupBy(*keys, "__island").applyInPandas(run, cut.schema).drop("__island")


def drop_late_events(df: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Drop events that start more than tolerance before the end of the last kept event."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start_s", "end_s"], kind="stable")
        last, keep = float("-inf"), []
        for a, b in zip(g.start_s, g.end_s, strict=True):
            keep.append(a >= last - tolerance)
            if keep[-1]:
                last = b
        return g[keep]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def bout_metrics(bouts: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """latency, time, count, mean duration and rate per minute of inclusive bouts."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    return bouts.groupBy(*keys).agg((F.min("start_frame") / fps).alias("latency_s"), (F.sum(n) / fps).alias("time_s"), F.count(F.lit(1)).alias("n_bouts"), (F.avg(n) / fps).alias("mean_bout_s"), (F.count(F.lit(1)) / (F.max("end_frame") / fps / 60)).alias("per_minute"))


def longest_run(df: DataFrame, keys: list[str], on: Column, out: str, order: str = "frame") -> DataFrame:
    """(keys, out): rows of the longest run of successive rows for which `on` holds, 0 where there is none."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.select(*keys, on.alias("__on"), F.row_number().over(w).alias("__i"))
    r = r.withColumn("__g", F.col("__i") - F.row_number().over(Window.partitionBy(*keys, "__on").orderBy("__i")))
    return r.groupBy(*keys, "__on", "__g").agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__on"), F.col("__n"))), F.lit(0)).alias(out))


def clips_to_find(curve: DataFrame, keys: list[str], x: str, y: str, target: float) -> DataFrame:
    """(keys, clips, first_reach): where a discovery curve reaches target, by straight lines from (0, 0); past its end at the last rate, else the mean one; null where nothing is found."""
    w = Window.partitionBy(*keys).orderBy(x)
    q = curve.withColumns({"__px": F.coalesce(F.lag(x).over(w), F.lit(0)), "__py": F.coalesce(F.lag(y).over(w), F.lit(0))})
    rise, run = F.col(y) - F.col("__py"), F.col(x) - F.col("__px")
    at = F.col("__px") + F.when(rise <= 0, 0.0).otherwise((target - F.col("__py")) / rise) * run
    a = q.groupBy(*keys).agg(F.min_by(at, F.when(F.col(y) >= target, F.col(x))).alias("__in"), F.min(F.when(F.col(y) >= target, F.col(x))).alias("first_reach"), F.max(x).alias("__x"), F.max(y).alias("__y"), F.max_by(rise, x).alias("__dy"), F.max_by(run, x).alias("__dx"), F.count(F.lit(1)).alias("__k"))
    rate = F.when((F.col("__k") >= 2) & (F.col("__dx") > 0) & (F.col("__dy") > 0), F.col("__dy") / F.col("__dx")).otherwise(F.col("__y") / F.col("__x"))
    clips = F.when(F.col("first_reach").isNotNull(), F.col("__in")).when(F.col("__y") > 0, F.col("__x") + (target - F.col("__y")) / rate)
    return a.select(*keys, clips.alias("clips"), "first_reach")


def knee(points: DataFrame, keys: list[str], size: str, f1: str, degenerate: str, eps: float = 0.02, delta: float = 0.01) -> DataFrame:
    """(keys, knee): the least size of at least (1 - eps) of the best f1 whose next gain is under delta, else the largest; degenerate points go unless all are; null for fewer than two points or no positive f1."""
    whole = Window.partitionBy(*keys)
    ok = points.where(F.col(f1).isNotNull()).withColumn("__all", F.min(degenerate).over(whole)).where(~F.col(degenerate) | F.col("__all"))
    o = ok.withColumns({"__top": F.max(f1).over(whole), "__gain": F.coalesce(F.lead(f1).over(whole.orderBy(size)) - F.col(f1), F.lit(0.0))})
    a = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first("__top").alias("__top"), F.min(F.when((F.col(f1) >= (1 - eps) * F.col("__top")) & (F.col("__gain") < delta), F.col(size))).alias("__k"), F.max(size).alias("__last"))
    return a.select(*keys, F.when((F.col("__n") >= 2) & (F.col("__top") > 0), F.coalesce("__k", "__last")).alias("knee"))
