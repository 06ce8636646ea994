"""Review labels: fan-out, resolution, remapping to current windows, guards, relabelling, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import intervals as I

#: Labels that say nothing of a behaviour.
UNSURE = ("ambiguous", "boundary_error")


def fan_out(labels: DataFrame, mutual: DataFrame) -> DataFrame:
    """labels(behavior, focal, partner, session, start_frame, end_frame) as one row a segment: mutual(behavior) labels both animals; a segment's labels, sorted, joined by pipes."""
    m = labels.join(F.broadcast(mutual.select("behavior", F.lit(True).alias("__both")).distinct()), "behavior", "left").where("behavior <> '' and focal is not null")
    animals = F.when(F.col("__both") & F.col("partner").isNotNull(), F.array("focal", "partner")).otherwise(F.array("focal"))
    each = m.select("behavior", "session", "start_frame", "end_frame", F.explode(animals).alias("animal"))
    seg = F.concat_ws("_", F.lit("seg"), "animal", "session", "start_frame", "end_frame")
    return each.groupBy(seg.alias("segment_id")).agg(F.array_join(F.array_sort(F.collect_set("behavior")), "|").alias("review_label"))


def resolve(labels: DataFrame, key: str) -> DataFrame:
    """(key, label, label_source, reviewer_confidence, overlap_allowed): the one informative label; ambiguous and overlapping for several; else the one negative; else ambiguous."""
    l = F.filter(F.array_distinct(F.collect_list("review_label")), lambda x: x != "")
    names = F.array(*map(F.lit, (*UNSURE, "no_behavior")))
    g = labels.groupBy(key).agg(l.alias("__l"), F.array_join(F.array_sort(F.collect_set(F.nullif("reviewer_id", F.lit("")))), ",").alias("label_source"), F.avg("confidence").alias("reviewer_confidence"))
    told = F.filter("__l", lambda x: ~F.array_contains(names, x) & ~x.startswith("not_"))
    neg = F.filter("__l", lambda x: x.startswith("not_") | (x == "no_behavior"))
    label = F.when(F.size(told) == 1, told[0]).when((F.size(told) == 0) & (F.size(neg) == 1), neg[0]).otherwise("ambiguous")
    return g.select(key, label.alias("label"), "label_source", "reviewer_confidence", (F.size(told) > 1).alias("overlap_allowed"))


def remap(labels: DataFrame, segments: DataFrame, keys: list[str], key: str) -> DataFrame:
    """labels(id, keys, start_frame, end_frame, ..) with `key` of current segments.

    A label whose id is a segment's keeps it. Others are cut into whole windows of the segments' median length, and each takes the segment of
    its very interval, else that of most overlap, then of nearest centre, then the first; a label shorter than a window is taken whole. What
    meets no segment keeps its id.
    """
    cols = labels.columns
    rest = [c for c in cols if c not in (*keys, "start_frame", "end_frame")]
    there = segments.select(F.col(key).alias("id"), F.lit(True).alias("__there"))
    size = F.broadcast(segments.agg(F.floor(F.percentile(F.col("end_frame") - F.col("start_frame") + 1, 0.5)).cast("long").alias("__w")))
    l = labels.join(there, "id", "left")
    exact = l.where("__there").select(*rest, F.col("id").alias(key))
    # A label is known by its own values, equal ones by their count: numbers given in passing change where a plan is run twice.
    free = l.where("__there is null").groupBy(*cols).agg(F.count(F.lit(1)).cast("int").alias("__c")).withColumn("__l", F.struct(*cols, "__c")).select(*cols, "__l").join(size)
    lo, hi = F.least("start_frame", "end_frame"), F.greatest("start_frame", "end_frame")
    n = F.floor((hi - lo + 1) / F.col("__w")).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct((lo + i * F.col("__w")).alias("a"), (lo + i * F.col("__w") + F.col("__w") - 1).alias("z")))).otherwise(F.array(F.struct(lo.alias("a"), hi.alias("z"))))
    each = free.withColumn("__p", F.explode(parts)).select("__l", *keys, F.col("__p.a").alias("r_start"), F.col("__p.z").alias("r_end"))
    hit = I.overlap_join(segments.select(key, *keys, "start_frame", "end_frame"), each, keys)
    meet = F.least("end_frame", "r_end") - F.greatest("start_frame", "r_start") + 1
    gap = F.abs(F.floor((F.col("start_frame") + F.col("end_frame")) / 2) - F.floor((F.col("r_start") + F.col("r_end")) / 2))
    same = (F.col("start_frame") != F.col("r_start")) | (F.col("end_frame") != F.col("r_end"))
    best = hit.groupBy("__l", "r_start", "r_end").agg(F.min_by(key, F.struct(same, -meet, gap, "start_frame", key)).alias("__k"))
    lost = free.select("__l").join(best.select("__l").distinct(), "__l", "left_anti").select("__l", F.col("__l")["id"].alias("__k"))
    # Equal labels have a row each again.
    own = best.select("__l", "__k").unionByName(lost).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__l")["__c"])))
    return exact.unionByName(own.select(*(F.col("__l")[c].alias(c) for c in rest), F.col("__k").alias(key)))


def binary_target(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """df with y: 1 for target; 0 for other labels, unless unsure or overlapping a target of the same session, which go."""
    pos = df.where(F.col("label") == target).select(*keys, F.col("start_frame").alias("r_start"), F.col("end_frame").alias("r_end"))
    neg = I.overlap_join(df.where((F.col("label") != target) & ~F.col("label").isin(*UNSURE)), pos, keys, "left_anti")
    return df.where(F.col("label") == target).withColumn("y", F.lit(1)).unionByName(neg.withColumn("y", F.lit(0)))


def majority(segments: DataFrame, reviews: DataFrame, keys: list[str], target: str, confounds: dict[str, str]) -> DataFrame:
    """segments(id) with label: that of most overlapping reviews (r_start, r_end, review), the first by name of equals; 1 for target, a confound's class, 0 for others; ambiguous ones and segments without a review go."""
    hit = I.overlap_join(segments.select("id", *keys, "start_frame", "end_frame"), reviews, keys).where(~F.col("review").isin(*UNSURE))
    top = hit.groupBy("id", "review").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.min_by("review", F.struct(-F.col("n"), "review")).alias("review"))
    out = F.when(F.col("review") == target, "1")
    for name, kind in confounds.items():
        out = out.when(F.col("review") == name, kind)
    return top.select("id", out.otherwise("0").alias("label"))


def relabel(df: DataFrame, wrong: DataFrame, keys: list[str], target: str) -> DataFrame:
    """df with label not_<target> where the segment's middle lies in wrong (keys, r_start, r_end)."""
    mid = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    point = df.select("id", *keys, mid.alias("start_frame"), mid.alias("end_frame"))
    hit = I.overlap_join(point, wrong, keys).select("id").distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, "id", "left").withColumn("label", F.when(F.col("__hit"), "not_" + target).otherwise(F.col("label"))).drop("__hit")


def at_centers(points: DataFrame, bouts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(id, labels): the sorted labels of all bouts (keys, label, r_start, r_end) that a clip's middle lies in."""
    mid = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    hit = I.overlap_join(points.select("id", *keys, mid.alias("start_frame"), mid.alias("end_frame")), bouts, keys).groupBy("id").agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return points.select("id").join(hit, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old and new rows, the last of a key by (new before old, order)."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__v"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__v")


def replace_labels(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All new rows and the old ones of other keys; several rows of a key may stand side by side."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_enriched(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """df and rows of extra with df's columns, missing ones 0.0; of equal keys df's row, then the first."""
    fill = extra.select(*(F.col(c) if c in extra.columns else F.lit(0.0).alias(c) for c in df.columns))
    both = df.withColumn("__v", F.lit(0)).unionByName(fill.withColumn("__v", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__v"))).where("__r = 1").drop("__r", "__v")


def strip_label(label: Column, dead: str) -> Column:
    """A pipe-joined label without `dead`, null where nothing is left."""
    kept = F.filter(F.transform(F.split(label, r"\|"), lambda x: F.trim(x)), lambda x: (x != "") & (x != dead))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|"))


def scope(df: DataFrame, sessions: DataFrame | None, key: str, imported: bool) -> DataFrame:
    """Rows of the sessions, and imported rows whatever their session; then without imported rows unless wanted."""
    mark = F.coalesce(F.col("label_source").startswith("imported:"), F.lit(False))
    out = df
    if sessions is not None:
        out = df.join(sessions.select(key, F.lit(True).alias("__in")).distinct(), key, "left").where(mark | F.col("__in")).drop("__in")
    return out if imported else out.where(~mark)


def check_ranges(df: DataFrame, criteria: dict[str, tuple[float, float]], match_all: bool = True) -> DataFrame:
    """df with verdict (pass, fail, no_data), score (share of criteria passed, nulls fail) and violations; the verdict looks at what is known only."""
    parts = [F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c).between(lo, hi)) for c, (lo, hi) in criteria.items()]
    known = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    passed = sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts[1:]), F.coalesce(parts[0], F.lit(False)).cast("int"))
    bad = F.filter(F.array(*(F.when(~p, F.lit(c)) for c, p in zip(criteria, parts))), lambda x: x.isNotNull())
    fine = passed == known if match_all else passed > 0
    return df.withColumns({"verdict": F.when(known == 0, "no_data").when(fine, "pass").otherwise("fail"), "score": passed / len(parts), "violations": F.array_join(bad, ",")})


def contrast(exemplars: DataFrame, background: DataFrame, cols: list[str], k: int = 5, recall: float = 0.8, leak: float = 0.02, gain: float = 0.005) -> list[tuple[str, str, float]]:
    """At most k bounds (column, "ge" or "le", value), chosen one by one: the one that removes most of the background that is left while at least
    `recall` of all exemplars stay; stops at `leak` of the background or a gain under `gain`. One aggregate a step over each table; candidates are
    the 5th and 10th percentiles from either end of the exemplars.
    """
    q = exemplars.agg(*(F.percentile(c, F.array(*map(F.lit, (0.05, 0.1, 0.9, 0.95)))).alias(c) for c in cols)).first()
    tests = [(c, op, q[c][i]) for c in cols if q[c] is not None for op, i in (("ge", 0), ("ge", 1), ("le", 2), ("le", 3))]
    cond = lambda t: F.coalesce(F.col(t[0]) >= t[2] if t[1] == "ge" else F.col(t[0]) <= t[2], F.lit(False))
    chosen: list[tuple[str, str, float]] = []
    n_ex, n_bg = exemplars.count(), background.count()
    left = n_bg
    while tests and len(chosen) < k and n_bg and left > leak * n_bg:
        both = lambda t: cond(t) if not chosen else cond(t) & _all(cond, chosen)
        e, b = (d.agg(*(F.count_if(both(t)).alias(f"t{i}") for i, t in enumerate(tests))).first() for d in (exemplars, background))
        best = max((i for i in range(len(tests)) if e[i] >= recall * n_ex), key=lambda i: (left - b[i], -i), default=None)
        if best is None or left - b[best] < gain * n_bg:
            break
        left = b[best]
        chosen.append(tests.pop(best))
    return chosen


def _all(cond, tests: list) -> Column:
    out = cond(tests[0])
    for t in tests[1:]:
        out = out & cond(t)
    return out


def config_hash(settings: Column) -> Column:
    """16 hex digits of the SHA-256 of a map of names to JSON values, written compactly with its names in order."""
    pairs = F.array_sort(F.map_entries(settings))
    body = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16)
