"""Tests and intervals: t, F and chi-square tails, clustered means, sign flips, permutations, bootstraps, ranks.

Tails are evaluated in Arrow batches, on rows that are already one a test. What depends on chance is drawn from MD5 of (seed, draw, unit), so
every engine and every rerun draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Two-sided 95 % multipliers by degrees of freedom, as printed in tables.
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042}


def beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + step * d) or tiny), (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * out / a


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_part(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_part(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-square: series of the incomplete gamma function, or its continued fraction where that is shorter."""
    a, h = df / 2, x / 2
    if h <= 0:
        return 1.0
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = h + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 500):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * out


def t_critical(n: int) -> float:
    """Multiplier of a 95 % interval of n values: from the table, else by halving; null-like (nan) for fewer than two."""
    df = n - 1
    if df < 1:
        return math.nan
    if df in T_975:
        return T_975[df]
    lo, hi = 0.0, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 0.05 else (lo, mid)
    return (lo + hi) / 2


def tail(f: Callable[..., float]):
    """f of one or two or three numbers as a column function; null where an argument is."""

    def rows(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")

    def one(a: pd.Series) -> pd.Series:
        return rows(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return rows(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return rows(a, b, c)

    run = {1: one, 2: two, 3: three}[f.__code__.co_argcount]
    n = f.__code__.co_argcount
    run.__annotations__ = {**{x: pd.Series for x in "abc"[:n]}, "return": pd.Series}
    return F.pandas_udf(run, "double")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, ci95 (0 for one value) and the p of a mean of 0 (null for one value or without variance) of finite values."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(F.abs(v)).alias("__top"))
    sem = F.col("sd") / F.sqrt("n")
    crit, tail_t = tail(lambda n: t_critical(int(n))), tail(lambda t, d: t_tail(t, d))
    fine = (F.col("n") >= 2) & (F.col("sd") > 1e-12 * F.greatest(F.lit(1.0), F.col("__top")))
    return g.withColumns({"ci95": F.when(F.col("n") >= 2, crit(F.col("n")) * sem).otherwise(0.0), "p": tail_t(F.when(fine, F.abs(F.col("mean") / sem)), F.col("n") - 1)}).drop("__top")


def sign_flip(means: np.ndarray) -> float:
    """Exact two-sided p of a mean of 0 over all sign changes of 2 to 22 cluster means; nan else, and without variance."""
    k = len(means)
    if not 2 <= k <= 22 or np.std(means, ddof=1) <= 1e-12 * max(1.0, np.abs(means).max()):
        return math.nan

    def t(v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return v.mean(-1) / (v.std(-1, ddof=1) / math.sqrt(k))

    own, hit, count = abs(t(means)), 0, 0
    for at in range(0, 1 << k, 1 << 16):
        mask = np.arange(at, min(1 << k, at + (1 << 16)))
        all_t = t(np.where(mask[:, None] >> np.arange(k) & 1, means, -means))
        good = np.isfinite(all_t)
        hit, count = hit + int((np.abs(all_t[good]) >= own - 1e-12).sum()), count + int(good.sum())
    return hit / count if count else math.nan


def clustered(moments: list[tuple[float, float, float]]) -> dict[str, float]:
    """Random-intercept mean by REML from each cluster's (n, sum, sum of squares); Satterthwaite's degrees of freedom from the information matrix."""
    n, s, ss = (np.array(x, float) for x in zip(*moments, strict=True))
    total, k = n.sum(), len(n)
    means = s / n
    out = {"estimate": s.sum() / total, "n_obs": total, "n_clusters": k, "n_clusters_positive": float((means > 0).sum()), "p_sign_flip": sign_flip(means)}
    if k < 2 or total <= k or ss.sum() - s.sum() ** 2 / total <= 1e-20 * max(1.0, ss.sum()):
        return out | {c: math.nan for c in ("se", "icc", "design_effect", "n_effective", "df", "t_stat", "p_value")}

    def parts(lam: float) -> tuple[float, float, float]:
        u = 1 + n * lam
        weight = (n / u).sum()
        mu = (s / u).sum() / weight
        return weight, mu, ss.sum() - (lam * s * s / u).sum() - mu * mu * weight

    def loss(x: float) -> float:
        lam = math.expm1(x)
        weight, _, q = parts(lam)
        return (total - 1) * math.log(max(q, 1e-300) / (total - 1)) + np.log1p(n * lam).sum() + math.log(weight)

    # The profile has one minimum; it is bracketed on a grid and closed in by the golden section.
    grid = np.linspace(0, 20, 401)
    i = int(np.argmin([loss(x) for x in grid]))
    lo, hi, g = grid[max(0, i - 1)], grid[min(400, i + 1)], (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-11:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    lam = math.expm1((lo + hi) / 2)
    lam = 0.0 if lam < 1e-9 else lam
    _, mu, q = parts(lam)
    sigma, tau = q / (total - 1), lam * q / (total - 1)
    u = 1 / (sigma + n * tau)
    w = (n * u).sum()
    se, icc = math.sqrt(1 / w), tau / (tau + sigma)
    df = k - 1.0
    if tau > 0:
        d = np.stack([n, np.ones(k)])
        info = np.einsum("aj,bj,j->ab", d, d, u**2) + np.array([[0, 0], [0, ((n - 1) / sigma**2).sum()]]) - 2 * np.einsum("aj,bj,j->ab", d, d, n * u**3) / w
        one = (d * n * u**2).sum(1)
        info = (info + np.outer(one, one) / w**2) / 2
        grad = one / w**2
        # The variance of the estimate is 1 / w; its gradient is one / w ** 2.
        if abs(np.linalg.det(info)) > 0:
            satt = 2 / w**2 / float(grad @ np.linalg.inv(info) @ grad)
            if math.isfinite(satt) and satt > 0:
                df = min(satt, total - 1)
    deff = 1 + (total / k - 1) * icc
    return out | {"estimate": mu, "se": se, "icc": icc, "design_effect": deff, "n_effective": total / deff, "df": df, "t_stat": mu / se, "p_value": t_tail(abs(mu / se), df)}


def clustered_mean(df: DataFrame, keys: list[str], value: str, cluster: str) -> DataFrame:
    """clustered() of each keys; a group's clusters, one row each, meet in a task."""
    names = ("estimate", "se", "icc", "design_effect", "n_effective", "df", "t_stat", "p_value", "p_sign_flip", "n_obs", "n_clusters", "n_clusters_positive")
    m = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = clustered(list(zip(g.n, g.s, g.ss, strict=True)))
        return pd.DataFrame({**{k: [g[k].iat[0]] for k in keys}, **{c: [x[c]] for c in names}})

    kinds = dict(df.dtypes)
    return m.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in names)]))


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) from MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / 2.0**48


def permutation_test(df: DataFrame, units: DataFrame, unit: str, group: str, cell: list[str], value: str, draws: int, seed: str) -> DataFrame:
    """(cell, diff, p) of two groups' units: |mean of one - mean of the other| with every unit of units(unit, group) in every cell (absent: 0), p the share of draws at least as far.

    A draw puts units in order of a hash; the first n of them are the first group. Cells do not meet: a draw's sums are by cell.
    """
    n = units.groupBy(group).count().orderBy(group).collect()
    if len(n) != 2:
        raise ValueError("two groups are needed")
    (first, a), (_, b) = ((r[group], r["count"]) for r in n)
    order = Window.partitionBy("__r").orderBy(drawn(F.lit(seed), F.col("__r"), F.col(unit)), unit)
    perms = units.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__one", F.row_number().over(order) <= a)
    every = units.select(unit, F.lit(0).alias("__r"), (F.col(group) == first).alias("__one")).unionByName(perms.select(unit, "__r", "__one"))
    sums = df.groupBy(unit, *cell).agg(F.sum(value).alias("__v")).join(every, unit).groupBy(*cell, "__r").agg(F.coalesce(F.sum(F.when(F.col("__one"), F.col("__v"))), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.when(~F.col("__one"), F.col("__v"))), F.lit(0.0)).alias("y"))
    d = sums.withColumn("d", F.abs(F.col("x") / a - F.col("y") / b))
    own = d.where("__r = 0").select(*cell, F.col("d").alias("diff"))
    return d.where("__r > 0").join(own, cell).groupBy(*cell, "diff").agg((F.count_if(F.col("d") >= F.col("diff") - 1e-12) / draws).alias("p"))


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """H with ties corrected, groups and p. Ties are counted first, so ranks run over distinct values."""
    by = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy(*keys)
    r = by.withColumn("r", F.coalesce(F.sum("t").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("t") + 1) / 2)
    ties = by.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("c"))
    g = df.join(r.drop("t"), [*keys, value]).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("m"), F.sum("r").alias("s"))
    s = g.groupBy(*keys).agg(F.sum(F.col("s") ** 2 / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k"))
    j = s.join(ties, keys) if keys else s.crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("c") / (n**3 - n))
    return j.select(*keys, h.alias("h"), F.col("k").alias("groups")).withColumn("p", tail(lambda x, d: chi2_tail(x, d))(F.col("h"), (F.col("groups") - 1).cast("double")))


def bootstrap_f1(counts: DataFrame, unit: str, draws: int, seed: str) -> DataFrame:
    """2.5 and 97.5 percentiles of F1 over draws of as many units as there are, with replacement. counts: one row a unit with tp, fp, fn."""
    order = Window.orderBy(unit)
    # One row a unit: units are subjects.
    own = counts.withColumn("i", F.row_number().over(order) - 1)
    n = own.count()
    picks = counts.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("r"), F.floor(drawn(F.lit(seed), F.floor(F.col("id") / n), F.col("id") % n) * n).alias("i"))
    f = picks.join(F.broadcast(own), "i").groupBy("r").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return f.agg(F.percentile(f1, 0.025).alias("lo"), F.percentile(f1, 0.975).alias("hi"), F.lit(n).alias("n_subjects"))


def pseudo_f(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Permutational analysis of variance of cosine distances: pseudo-F, R2 and groups. Items are behaviours, a few hundred at most: pairs of them."""
    e = df.select(F.monotonically_increasing_id().alias("i"), label, vector)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.when(F.sqrt(dot(v, v)) > 0, F.sqrt(dot(v, v))).otherwise(1.0)
    e = e.withColumn("z", norm(F.col(vector)))
    a, b = (e.select(*(F.col(c).alias(f"{k}_{c}") for c in e.columns)) for k in "ab")
    p = a.join(b, F.col("a_i") < F.col("b_i")).select(F.col(f"a_{label}").alias("g"), (F.col(f"a_{label}") == F.col(f"b_{label}")).alias("same"), (1 - dot(F.col(f"a_{vector}"), F.col(f"b_{vector}")) / (F.col("a_z") * F.col("b_z"))).alias("d"))
    size = e.groupBy(F.col(label).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    within = p.where("same").groupBy("g").agg(F.sum(F.col("d") ** 2).alias("s")).join(size, "g").agg(F.coalesce(F.sum(F.col("s") / F.col("n")), F.lit(0.0)).alias("ssw"))
    all_ = p.agg(F.sum(F.col("d") ** 2).alias("s")).join(F.broadcast(size.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("a"))))
    j = all_.join(F.broadcast(within)).withColumn("sst", F.col("s") / F.col("n"))
    return j.select((((F.col("sst") - F.col("ssw")) / (F.col("a") - 1)) / (F.col("ssw") / (F.col("n") - F.col("a")))).alias("pseudo_f"), ((F.col("sst") - F.col("ssw")) / F.col("sst")).alias("r2"), F.col("a").alias("groups"), F.col("n").alias("items"))


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Ward's clustering of at most a few thousand points in k clusters, numbered by first member."""
    centers, size, members = [p.astype(float) for p in points], [1] * len(points), [[i] for i in range(len(points))]
    while len(centers) > max(1, k):
        c, n = np.array(centers), np.array(size, float)
        cost = ((c[:, None] - c[None]) ** 2).sum(-1) * (n[:, None] * n[None] / (n[:, None] + n[None]))
        cost[np.tril_indices(len(c))] = np.inf
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        centers[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        size[i] += size[j]
        members[i] += members[j]
        del centers[j], size[j], members[j]
    out = np.zeros(len(points), int)
    for label, m in enumerate(sorted(members, key=min)):
        out[m] = label
    return out
