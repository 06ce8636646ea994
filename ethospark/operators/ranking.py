"""Scores, queues, batches, samples and splits of segments."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of the queue score, in the order in which a tie names the reason.
QUEUE = (("candidate_score", 0.35, "candidate"), ("behavior_aware_uncertainty", 0.20, "uncertainty"), ("disagreement_score", 0.15, "disagreement"), ("diversity_score", 0.10, "diversity"), ("confound_margin_score", 0.10, "confound_boundary"), ("hard_negative_priority", 0.07, "hard_negative"), ("exploration_bonus", 0.0, "exploration"))
MARGIN, HARD_BONUS, LOW, ABSENT, MIN_REJECTED = 0.05, 0.3, 0.25, 0.35, 8
MODES = ("uncertainty", "prototype", "novelty", "low_probability", "random_absent")
#: Numbers of a reference set that go to the tasks at once: 32 MB.
REFERENCE = 4_000_000
#: Rows that a task searches such a set for at once, more by a batch at most.
SEARCHED = 200_000


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def draw_of(key: Column, seed: str = "0") -> Column:
    """A number in [0, 1) from a key: 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 12), 16, 10).cast("double") / 2.0**48


def compete(own: DataFrame, peers: DataFrame, key: str | list[str], prob: str, n_peers: Column) -> DataFrame:
    """own with the max, mean and support (0.5 or more) of its peers' probabilities (key, prob), absent ones 0; margin and its uncertainty."""
    p = peers.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max(prob).alias("other_max"), F.sum(prob).alias("__s"), F.count_if(F.col(prob) >= 0.5).alias("other_support"))
    out = own.join(p, key, "left").withColumns({"other_max": F.coalesce("other_max", F.lit(0.0)), "other_mean": F.coalesce(F.col("__s") / n_peers, F.lit(0.0)), "other_support": F.coalesce("other_support", F.lit(0))}).drop("__s")
    margin = F.col("prediction_prob") - F.col("other_max")
    return out.withColumns({"exclusivity_margin": margin, "exclusivity_uncertainty": 1 - clip(F.abs(margin))})


def feedback(labels: DataFrame, key: str) -> DataFrame:
    """feedback_score of each reviewed segment: (positive - negative) / labels; rejected: whether a label says not_."""
    l = F.col("review_label")
    neg, amb = l.startswith("not_"), l.isin("ambiguous", "boundary_error")
    return labels.groupBy(key).agg((F.sum(F.when(neg, -1).when(amb, 0).otherwise(1)) / F.count(F.lit(1))).alias("feedback_score"), F.max(neg).alias("rejected"))


def rank(df: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """Scores of all MODES, the weighted queue score and its reason.

    df has prediction_prob, uncertainty_score, the columns of `compete`, feedback_score and rejected (nulls: not reviewed) and diversity_score.
    """
    p, u, fb = F.col("prediction_prob"), F.col("behavior_aware_uncertainty"), F.col("feedback_score")
    out = df.withColumns({"feedback_score": F.coalesce(fb, F.lit(0.0)), "rejected": F.coalesce("rejected", F.lit(False)), "behavior_aware_uncertainty": F.greatest("uncertainty_score", clip(F.col("exclusivity_uncertainty") + MARGIN))})
    whole = out.agg(F.count_if("rejected").alias("__rejected"), F.coalesce(F.max(p <= ABSENT), F.lit(False)).alias("__absent"))
    out = out.join(F.broadcast(whole))
    priority = F.when(F.col("__rejected") >= MIN_REJECTED, F.when(F.col("rejected"), clip(p)).otherwise(clip(-fb))).otherwise(0.0)
    out = out.withColumns({"candidate_score": clip(p), "disagreement_score": clip(F.col("exclusivity_uncertainty")), "confound_margin_score": clip(1 - F.abs("exclusivity_margin")), "hard_negative_priority": priority, "exploration_bonus": F.lit(0.0)})
    bonus = F.when((p > 0.6) & (fb < 0), HARD_BONUS).otherwise(0.0)
    scores = {
        "uncertainty": u + 0.5 * p + 0.2 * fb + 0.2 * F.col("exclusivity_uncertainty") + bonus, "prototype": p + 0.1 * fb + 0.2 * F.col("exclusivity_uncertainty") + bonus, "novelty": 1 - p + u + bonus,
        "low_probability": clip(1 - p) + 0.35 * clip(1 - u) + 0.25 * clip(-fb) + 0.4 * (p <= LOW).cast("double") + 0.2 * clip(F.col("other_max") - p), "random_absent": F.when((p <= ABSENT) | ~F.col("__absent"), draw_of(F.col(key), seed)).otherwise(-1.0),
    }
    total = sum(w for _, w, _ in QUEUE)
    queue = reduce(lambda a, b: a + b, (w * F.col(c) for c, w, _ in QUEUE)) / total
    parts = F.array(*(F.col(c) for c, *_ in QUEUE))
    reason = F.element_at(F.array(*(F.lit(r) for *_, r in QUEUE)), F.array_position(parts, F.array_max(parts)).cast("int"))
    return out.withColumns({f"rank_{m}": s for m, s in scores.items()} | {"priority": queue, "selection_reason": reason}).drop("__rejected", "__absent")


def _nearest(reference: np.ndarray, k: int):
    """A pandas UDF: mean distance of a point to its k nearest of reference; points are taken a few at a time, so memory is bounded."""
    step = max(1, 4_000_000 // max(1, len(reference)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for points in batches:
            x, out = np.array(points.tolist(), float), np.empty(len(points))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                d = np.sqrt(sum((part[:, None, c] - reference[None, :, c]) ** 2 for c in range(reference.shape[1])))
                near = min(k, d.shape[1])
                out[at : at + step] = np.sort(np.partition(d, near - 1, axis=1)[:, :near], axis=1).mean(axis=1)
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def _tree(points: np.ndarray, leaf: int = 64) -> tuple[np.ndarray, list[tuple]]:
    """(points in order of a tree, its nodes): a node has its first and last place, its box and its two children, -1 for a leaf."""
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), -1, 0)]
    while todo:
        lo, hi, up, side = todo.pop()
        own = points[order[lo:hi]]
        low, high = own.min(0), own.max(0)
        if up >= 0:
            nodes[up][4 + side] = len(nodes)
        nodes.append([lo, hi, low, high, -1, -1])
        if hi - lo > leaf and (high > low).any():
            with np.errstate(invalid="ignore"):
                by = own[:, int(np.nanargmax(high - low))]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(by, mid)]
            todo += [(lo, lo + mid, len(nodes) - 1, 0), (lo + mid, hi, len(nodes) - 1, 1)]
    return points[order], [tuple(n) for n in nodes]


def _nearest_one(reference: np.ndarray):
    """A pandas UDF of a point's columns: distance to the nearest of reference, by a tree of boxes: a box no nearer than what is found is left out.

    Rows of many batches go through the tree at once, and a search comes to a node at most twice: first with the rows that are nearest to its box,
    for a distance to start from, then with those that may have a nearer point in it.
    """
    ordered, nodes = _tree(np.unique(reference, axis=0))

    def squared(gaps: Iterator[np.ndarray]) -> np.ndarray:
        return sum(g * g for g in gaps)

    def search(x: np.ndarray) -> np.ndarray:
        best, own = np.full(x.shape[1], np.inf), np.full(x.shape[1], -1)

        def box(node: int, rows: np.ndarray) -> np.ndarray:
            # Differences as of points, so no box is further than a point in it.
            low, high = nodes[node][2:4]
            return squared(np.maximum(np.maximum(low[c] - v, v - high[c]), 0.0) for c, v in enumerate(x[:, rows]))

        def measure(node: int, rows: np.ndarray) -> None:
            # 2 million distances at once; a leaf of more points holds one value only.
            lo, hi = nodes[node][:2]
            at = ordered[lo : min(hi, lo + 64)].T
            for i in range(0, len(rows), 2_000_000 // at.shape[1]):
                some = rows[i : i + 2_000_000 // at.shape[1]]
                best[some] = np.fmin(best[some], np.fmin.reduce(squared(v[:, None] - a for v, a in zip(x[:, some], at)), axis=1))

        known = np.flatnonzero(~np.isnan(x).any(0))
        todo = [(0, known)]
        while todo:
            node, rows = todo.pop()
            left, right = nodes[node][4:]
            if left < 0:
                own[rows] = node
                measure(node, rows)
                continue
            first = box(left, rows) <= box(right, rows)
            todo += [(n, r) for n, r in ((left, rows[first]), (right, rows[~first])) if len(r)]
        todo = [(0, known)]
        while todo:
            node, rows = todo.pop()
            left, right = nodes[node][4:]
            rows = rows[box(node, rows) < best[rows]]
            if left < 0:
                rows = rows[own[rows] != node]
            if not len(rows):
                continue
            if left < 0:
                measure(node, rows)
            else:
                todo += [(left, rows), (right, rows)]
        return np.where(np.isnan(x).any(0), np.nan, np.sqrt(best))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held, n = [], 0
        for columns in batches:
            held.append(np.array([c.to_numpy(float) for c in columns]))
            n += held[-1].shape[1]
            if n >= SEARCHED:
                yield pd.Series(search(np.hstack(held)))
                held, n = [], 0
        if held:
            yield pd.Series(search(np.hstack(held)))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def once(df: DataFrame) -> DataFrame:
    """df worked out now, for plans that read it more than once: a Parquet table in the folder that spark.checkpoint.dir names.

    Where none is named, a session of one machine keeps the rows itself, and any other works them out again at each reading.
    """
    conf = df.sparkSession.conf
    path = conf.get("spark.checkpoint.dir", None)
    if not path:
        return df.localCheckpoint() if re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")) else df
    path = f"{path.rstrip('/')}/tables/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def min_distance(df: DataFrame, key: str, cols: list[str], reference: DataFrame) -> DataFrame:
    """(key, distance): Euclidean distance to the nearest point of reference, the reviewed rows; null where there are none.

    The reference, equal points once, goes to the tasks in parts of at most about REFERENCE numbers, each one pass over df by a tree of its points.
    """
    own = [f"__p{i}" for i in range(len(cols))]
    point = [F.col(c).cast("double").alias(o) for c, o in zip(cols, own)]
    # A point with a missing number is near nothing.
    rows = reference.select(*point).where(reduce(lambda a, b: a & b, (F.col(o).isNotNull() & ~F.isnan(o) for o in own))).distinct().persist()
    parts = max(1, -(-rows.count() * len(cols) // REFERENCE))
    numbered = rows.withColumn("b", F.pmod(F.xxhash64(*own), F.lit(parts)))
    out = df.select(key, *point)
    found = []
    for b in range(parts):
        some = numbered.where(F.col("b") == b).drop("b").toArrow()
        if len(some):
            found.append(f"d{b}")
            out = out.withColumn(f"d{b}", _nearest_one(np.column_stack([c.to_numpy() for c in some.columns]))(*own))
    rows.unpersist()
    near = F.least(*found) if len(found) > 1 else F.col(found[0]) if found else F.lit(None).cast("double")
    return out.select(key, near.alias("distance"))


def density(df: DataFrame, key: str, cols: list[str], k: int = 10, sample: int = 5000) -> DataFrame:
    """(key, density): mean distance to the k nearest of a reference of at most `sample` rows, first by hash; a row that is in it counts itself. Nulls are the column's mean."""
    means = df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"__{c}") for c in cols))
    full = df.join(F.broadcast(means)).select(key, F.array(*(F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in cols)).alias("p"))
    reference = np.array([r["p"] for r in full.orderBy(F.md5(F.col(key).cast("string"))).limit(sample).collect()], float)
    return full.select(key, (_nearest(reference, k)("p") if len(reference) else F.lit(None).cast("double")).alias("density"))


def min_max(c: Column, w=None, eps: float = 1e-9) -> Column:
    w = w or Window.partitionBy()
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + eps)


def focus_weights(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(behavior, weight): 1 / (1 + reviewed) + relabelled / reviewed, over the largest. decisions: (key, behavior_label)."""
    n = decisions.join(candidates.select(key, "behavior"), key).groupBy("behavior").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.trim("behavior_label") != "") & (F.trim("behavior_label") != F.col("behavior"))).alias("c"))
    raw = candidates.select("behavior").where("behavior <> ''").distinct().join(n, "behavior", "left").fillna(0, ["n", "c"])
    raw = raw.withColumn("w", 1 / (1 + F.col("n")) + F.col("c") / F.greatest(F.lit(1), F.col("n")))
    # One row a behaviour: the window over all of them is short.
    return raw.select("behavior", (F.col("w") / F.max("w").over(Window.partitionBy())).alias("weight"))


def next_batch(candidates: DataFrame, decisions: DataFrame, key: str, size: int, share: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """(key, score, kind): the uncertain, the unlike and the hard negatives of a batch, each by its own order; a candidate chosen twice has its first kind."""
    n_uncertain, n_diverse, n_hard = int(size * share[0]), int(size * share[1]), int(size * (1 - share[0] - share[1]))
    weight = focus_weights(candidates, decisions, key)
    told = decisions.groupBy(key).agg(F.max_by("status", "at").alias("status"))
    c = candidates.join(F.broadcast(weight), "behavior", "left").join(told, key, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    stats = c.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg(F.when(F.col("status").isNotNull(), F.col("score"))).alias("mean"), F.avg(F.when(F.col("status") == "rejected", F.col("score"))).alias("bad"))
    relabel = F.broadcast(decisions.where("relabel").agg(F.collect_set(F.trim("behavior_label")).alias("names")))
    c = c.join(F.broadcast(stats)).join(relabel)
    s = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    c = c.withColumns({"u": clip(1 - 2 * F.abs(s - 0.5)) + 0.25 * F.col("weight"), "v": F.coalesce(F.abs(F.col("score") - F.col("mean")), F.lit(0.0)) + 0.2 * F.col("weight"), "h": F.abs(F.col("score") - F.col("bad")) - 0.2 * F.col("weight")})
    free = c.where("status is null")
    hard = free.where((F.abs(F.col("score") - F.col("bad")) < 0.2) | F.array_contains("names", F.col("behavior")))
    parts = [free.orderBy(F.desc("u"), F.desc("score"), key).limit(n_uncertain), free.orderBy(F.desc("v"), F.desc("score"), key).limit(n_diverse), hard.orderBy("h", F.desc("score"), key).limit(n_hard)]
    names = ("uncertainty", "diversity", "hard_negative")
    both = reduce(DataFrame.unionByName, (p.select(key, "score", F.lit(i).alias("i")) for i, p in enumerate(parts)))
    return both.groupBy(key, "score").agg(F.min("i").alias("i")).select(key, "score", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("kind"))


def round_robin(df: DataFrame, group: str, order: list, want: int) -> DataFrame:
    """`want` rows: the first of each group, then the second, groups in order. Ranks within a group are cut at want before groups meet."""
    own = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= want).orderBy("__r", group).limit(want).drop("__r")


def quota(total: int, groups: int) -> list[int]:
    """total in groups parts, the first ones one larger."""
    return [total // groups + (i < total % groups) for i in range(groups)] if groups > 0 and total > 0 else [0] * max(0, groups)


def take_by_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows: whole groups in an order drawn by seed, the last in part."""
    return df.orderBy(draw_of(F.col(group), seed), group, draw_of(F.col(key), seed), key).limit(n)


def holdout_groups(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """The groups held out: round(share * groups), one at least and all but one at most, drawn by seed; none of fewer than two."""
    g = df.select(group).where(F.col(group).isNotNull()).distinct()
    n = g.count()
    k = 0 if n < 2 else min(n - 1, max(1, round(share * n)))
    return g.orderBy(draw_of(F.col(group), seed), group).limit(k)


def split(df: DataFrame, group: str, held: DataFrame, least: float = 1.0) -> DataFrame:
    """df with part: train, holdout or dropped. Of held groups nothing trains, and feedback, imported and unsure rows are not scored; imported rows do not train."""
    imported = F.col("label_source").startswith("imported:")
    refine = imported | F.col("label_source").startswith("temporal_feedback")
    out = df.join(held.select(group, F.lit(True).alias("__held")), group, "left")
    inside = F.coalesce("__held", F.lit(False))
    sure = F.coalesce("reviewer_confidence", F.lit(0.0)) >= least
    src = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumn("part", F.when(inside, F.when(src(refine) | ~sure, "dropped").otherwise("holdout")).otherwise(F.when(src(imported), "dropped").otherwise("train"))).drop("__held")
