"""Fits and their sweeps: k-means, hidden Markov models, classifiers and the curves made of them.

Loops over settings run on the driver and hand back one row a fit; every pass over data is a DataFrame job. Draws come from hashes of ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import metrics as M
from .ranking import draw_of, holdout_groups, take_by_group
from .stats import drawn


# Clusters.
def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> tuple[DataFrame, list[np.ndarray]]:
    """df with cluster and confidence (1 less the distance over the largest of the cluster), and the centres."""
    v = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", maxIter=50).fit(v)
    centers = [np.asarray(c) for c in model.clusterCenters()]
    out = model.transform(v).drop("__v")
    c = F.element_at(F.array(*(F.array(*map(F.lit, map(float, x))) for x in centers)), F.col("cluster") + 1)
    out = out.withColumn("__d", F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    far = F.max("__d").over(Window.partitionBy("cluster"))
    return out.withColumn("confidence", F.when(far > 0, 1 - F.col("__d") / far).otherwise(1.0)).drop("__d"), centers


def standardize(df: DataFrame, cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """cols less mean over standard deviation (population, 1 where it vanishes) of the rows fit_on; nulls become 0."""
    st = (df if fit_on is None else df.where(fit_on)).agg(*(F.avg(c).alias(f"__a{i}") for i, c in enumerate(cols)), *(F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(cols)))
    z = {c: F.coalesce((F.col(c) - F.col(f"__a{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0), F.lit(0.0)) for i, c in enumerate(cols)}
    return df.join(F.broadcast(st)).withColumns(z).select(*df.columns)


def discover(df: DataFrame, cols: list[str], k: int, seeds: Column) -> DataFrame:
    """Motifs: standardised on the seed rows, clustered there, every row given the nearest centre."""
    z = standardize(df, cols, seeds).withColumn("__x", F.array(*(F.col(c).cast("double") for c in cols)))
    _, centers = kmeans(z.where(seeds), "__x", k)
    arrays = F.array(*(F.struct(F.aggregate(F.zip_with("__x", F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)))
    return z.withColumn("motif", F.array_min(arrays)["i"]).drop("__x")


# Hidden Markov models.
def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _emission(x: np.ndarray, p: dict) -> np.ndarray:
    """(steps, states) log probabilities; x holds codes, or rows of numbers for normal emissions."""
    if "emit" in p:
        return np.log(p["emit"])[:, x].T
    return -0.5 * (((x[:, None] - p["mean"]) ** 2 / p["var"]) + np.log(2 * np.pi * p["var"])).sum(-1)


def forward_backward(x: np.ndarray, p: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, state shares by step, expected transitions)."""
    e, t = _emission(x, p), np.log(p["trans"])
    a = np.empty_like(e)
    a[0] = np.log(p["start"]) + e[0]
    for i in range(1, len(e)):
        a[i] = _log_sum(a[i - 1][:, None] + t, 0) + e[i]
    b = np.zeros_like(e)
    for i in range(len(e) - 2, -1, -1):
        b[i] = _log_sum(t + (e[i + 1] + b[i + 1])[None], 1)
    ll = float(_log_sum(a[-1], 0))
    pairs = np.exp(a[:-1, :, None] + t[None] + (e[1:] + b[1:])[:, None] - ll).sum(0) if len(e) > 1 else np.zeros_like(t)
    return ll, np.exp(a + b - ll), pairs


def viterbi(x: np.ndarray, p: dict) -> np.ndarray:
    e, t = _emission(x, p), np.log(p["trans"])
    best, back = np.log(p["start"]) + e[0], np.zeros(e.shape, int)
    for i in range(1, len(e)):
        step = best[:, None] + t
        back[i] = step.argmax(0)
        best = step.max(0) + e[i]
    out = np.empty(len(e), int)
    out[-1] = best.argmax()
    for i in range(len(e) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def fit_hmm(df: DataFrame, session: str, observed: str, states: int, codes: int = 0, iterations: int = 20, seed: int = 0, tiny: float = 1e-3) -> tuple[dict, list[float]]:
    """(parameters, log likelihoods): expectation-maximisation, a session a task.

    df has one row a session: observed is an array of codes below `codes`, or, for codes = 0, of arrays of numbers (normal emissions, one
    variance a feature). Tasks send expected counts, of a size that depends on states alone; the driver holds the parameters.
    """
    rng = np.random.default_rng(seed)
    p: dict = {"start": np.full(states, 1 / states), "trans": rng.dirichlet(np.full(states, 2.0), states)}
    p["trans"] = 0.5 * p["trans"] + 0.5 * np.eye(states)
    dims = 0
    if codes:
        p["emit"] = rng.dirichlet(np.full(codes, 2.0), states)
    else:
        some = np.array([x for r in df.select(F.slice(observed, 1, 50).alias("o")).orderBy(F.xxhash64("o")).limit(50).collect() for x in r["o"]], float)
        dims = some.shape[1]
        p["mean"], p["var"] = some[rng.choice(len(some), states, replace=len(some) < states)], np.tile(some.var(0) + tiny, (states, 1))
    told: list[float] = []
    for _ in range(iterations):
        now = dict(p)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for o in b[observed]:
                    x = np.array(list(o), int) if codes else np.array([list(v) for v in o], float)
                    if not len(x):
                        continue
                    ll, share, pairs = forward_backward(x, now)
                    if codes:
                        out = np.zeros((states, codes))
                        np.add.at(out.T, x, share)
                        parts = [out.ravel()]
                    else:
                        parts = [(share.T @ x).ravel(), (share.T @ (x * x)).ravel(), share.sum(0)]
                    one = np.concatenate([[ll], share[0], pairs.ravel(), *parts])
                    total = one if total is None else total + one
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        sums = df.select(observed).mapInPandas(expect, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not sums:
            break
        v = np.array([r["v"] for r in sums])
        told.append(float(v[0]))
        start, pairs, rest = v[1 : 1 + states], v[1 + states : 1 + states + states**2].reshape(states, states), v[1 + states + states**2 :]
        p["start"] = (start + tiny) / (start + tiny).sum()
        p["trans"] = (pairs + tiny) / (pairs + tiny).sum(1, keepdims=True)
        if codes:
            out = rest.reshape(states, codes) + tiny
            p["emit"] = out / out.sum(1, keepdims=True)
        else:
            s, ss, n = rest[: states * dims].reshape(states, dims), rest[states * dims : 2 * states * dims].reshape(states, dims), rest[2 * states * dims :, None] + 1e-9
            p["mean"] = s / n
            p["var"] = np.maximum(ss / n - p["mean"] ** 2, 0) + tiny
        if len(told) > 1 and told[-1] - told[-2] < 1e-6 * abs(told[-1]):
            break
    return p, told


def select_hmm(df: DataFrame, session: str, observed: str, sizes: Iterable[int], codes: int, restarts: int = 2, criterion: str = "bic") -> tuple[dict, pd.DataFrame]:
    """The parameters of least AIC or BIC over sizes, each the best of some starts, and all criteria."""
    total = df.agg(F.sum(F.size(observed))).first()[0] or 0
    rows, best = [], (math.inf, {})
    for n in sizes:
        p, told = max((fit_hmm(df, session, observed, n, codes, seed=s) for s in range(restarts)), key=lambda x: x[1][-1])
        free = n * (n - 1) + n * (codes - 1) + n - 1
        row = {"n_states": n, "log_likelihood": told[-1], "aic": -2 * told[-1] + 2 * free, "bic": -2 * told[-1] + free * math.log(max(total, 1))}
        rows.append(row)
        best = min(best, (row[criterion], p), key=lambda x: x[0])
    return best[1], pd.DataFrame(rows)


def decode(df: DataFrame, session: str, observed: str, p: dict) -> DataFrame:
    """(session, states): the likeliest path of each session."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [viterbi(np.array(list(o), int) if "emit" in p else np.array([list(v) for v in o], float), p).tolist() if len(o) else [] for o in b[observed]]
            yield pd.DataFrame({session: b[session], "states": paths})

    return df.select(session, observed).mapInPandas(run, f"{session} {dict(df.dtypes)[session]}, states array<int>")


# Classifiers.
def features(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with __x, the columns as a vector; nulls are 0."""
    return VectorAssembler(inputCols=[f"__{c}" for c in cols], outputCol="__x").transform(df.withColumns({f"__{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols})).drop(*(f"__{c}" for c in cols))


def weights(df: DataFrame, y: str) -> DataFrame:
    """df with weight: 1 for positives, positives / negatives between 0.33 and 3 for others."""
    n = F.broadcast(df.agg(F.sum(y).alias("__p"), (F.count(F.lit(1)) - F.sum(y)).alias("__n")))
    return df.join(n).withColumn("weight", F.when(F.col(y) == 1, 1.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.33), F.coalesce(F.col("__p") / F.nullif("__n", F.lit(0)), F.lit(1.0)))))).drop("__p", "__n")


def augment(df: DataFrame, cols: list[str], y: str, key: str, copies: int = 3, sigma: float = 0.05, drop: float = 0.1) -> DataFrame:
    """df and copies of its positives, each column moved by sigma of its spread times a normal draw, or put to 0 with probability drop."""
    sd = F.broadcast(df.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"__s_{c}") for c in cols)))
    more = df.where(F.col(y) == 1).join(sd).withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    normal = lambda c: F.sqrt(-2 * F.log(1 - drawn(F.lit(c), F.lit("r"), F.col(key), F.col("__k")))) * F.cos(2 * math.pi * drawn(F.lit(c), F.lit("a"), F.col(key), F.col("__k")))
    moved = {c: F.when(drawn(F.lit(c), F.lit("d"), F.col(key), F.col("__k")) < drop, 0.0).otherwise(F.col(c) + sigma * F.col(f"__s_{c}") * normal(c)) for c in cols}
    return df.unionByName(more.withColumns(moved).select(*df.columns))


def upsample(df: DataFrame, y: str, key: str, seed: str = "0") -> DataFrame:
    """df with rows of the rarer class drawn again until both are as many."""
    n = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    if len(n) < 2:
        return df
    (few, a), (_, b) = sorted(n.items(), key=lambda x: x[1])
    whole, rest = divmod(b - a, a)
    rare = df.where(F.col(y) == few)
    extra = rare.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("__k") if whole else rare.limit(0)
    return df.unionByName(extra).unionByName(rare.orderBy(draw_of(F.col(key), seed), key).limit(rest))


def train(df: DataFrame, cols: list[str], y: str, family: str = "logistic", seed: int = 42):
    """A fitted classifier: logistic regression, or boosted trees."""
    rows = features(weights(df, y).withColumn("__y", F.col(y).cast("double")), cols)
    if family == "trees":
        return GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=20, maxDepth=4, seed=seed).fit(rows)
    return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=40, regParam=0.01).fit(rows)


def predict(model, df: DataFrame, cols: list[str]) -> DataFrame:
    """df with p, the positive class's probability, and prediction_prob, the largest of the classes'."""
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        # As an expression of the columns: no model and no vector goes with the plan.
        x = (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols)
        margin = reduce(lambda s, t: s + t, (F.lit(float(w)) * v for w, v in zip(model.coefficients, x)), F.lit(0.0)) + F.lit(float(model.intercept))
        out = df.withColumn("p", 1 / (1 + F.exp(-margin)))
        return out.withColumn("prediction_prob", F.greatest("p", 1 - F.col("p"))).select(*df.columns, "p", "prediction_prob")
    out = model.transform(features(df, cols)).withColumn("__p", vector_to_array("probability"))
    return out.withColumns({"p": F.col("__p")[1], "prediction_prob": F.array_max("__p")}).select(*df.columns, "p", "prediction_prob")


def evaluate(pool: DataFrame, held: DataFrame, cols: list[str], y: str, family: str = "logistic") -> dict[str, float]:
    """One fit on pool, scored on held: precision, recall, F1, AUC, average precision and counts; null-like where a side has one class."""
    n_pos, n = (pool.agg(F.sum(y), F.count(F.lit(1))).first()[i] or 0 for i in (0, 1))
    out: dict[str, float] = {"n_train": float(n), "n_pos_train": float(n_pos)}
    if not 0 < n_pos < n:
        return out | {c: math.nan for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "auc", "ap")}
    s = predict(train(pool, cols, y, family), held, cols).select(F.col(y).alias("y"), F.round("p", 12).alias("p"), (F.col("p") >= 0.5).cast("int").alias("d"))
    c = M.confusion(s, [], "y", "d").first()
    a, ap = M.roc_auc(s.withColumn("one", F.lit(1)), ["one"], "y", "p").first(), M.average_precision(s, [], "y", "p").first()
    return out | {k: float(c[k]) for k in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")} | {"auc": math.nan if a is None or a["auc"] is None else a["auc"], "ap": math.nan if ap is None or ap["ap"] is None else ap["ap"]}


def _rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Results as a table; nan becomes null."""
    names = list(rows[0])
    kind = {n: "string" if isinstance(rows[0][n], str) else "int" if isinstance(rows[0][n], int) else "double" for n in names}
    clean = [tuple(None if isinstance(r[n], float) and math.isnan(r[n]) else r[n] for n in names) for r in rows]
    return df.sparkSession.createDataFrame(clean, ", ".join(f"{n} {kind[n]}" for n in names))


def hold_out(df: DataFrame, group: str, share: float = 0.25, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    held = holdout_groups(df, group, share, seed)
    return df.join(held, group, "left_anti"), df.join(held, group, "left_semi")


def learning_curve(df: DataFrame, cols: list[str], y: str, group: str, key: str, sizes: list[int], seeds: int) -> DataFrame:
    """Fits on `size` positives, drawn by whole groups, and all negatives of the pool; scored on the groups held out."""
    pool, held = hold_out(df, group)
    rows = []
    for size in sizes:
        for s in range(seeds):
            some = take_by_group(pool.where(F.col(y) == 1), group, key, size, str(s))
            rows.append({"size": size, "seed": s} | evaluate(some.unionByName(pool.where(F.col(y) == 0)), held, cols, y))
    return _rows(df, rows)


def ablation(df: DataFrame, families: dict[str, list[str]], base: str, y: str, group: str) -> DataFrame:
    """The base family, the base with each other one, and all."""
    pool, held = hold_out(df, group)
    sets = {base: families[base]} | {f"+{k}": families[base] + v for k, v in families.items() if k != base} | {"all": [c for v in families.values() for c in v]}
    return _rows(df, [{"config": name, "n_features": len(cols)} | evaluate(pool, held, cols, y) for name, cols in sets.items()])


def active_learning(df: DataFrame, cols: list[str], y: str, group: str, key: str, start: int, batch: int, rounds: int, strategy: str, seed: str = "0") -> DataFrame:
    """Rounds of labelling: `start` rows by draw, then each round `batch` more, the likeliest ("probability"), the least sure ("uncertainty") or drawn ones ("random")."""
    pool, held = hold_out(df, group)
    chosen = pool.orderBy(draw_of(F.col(key), seed), key).limit(start).select(key)
    rows = []
    for r in range(rounds + 1):
        ids = [x[key] for x in chosen.collect()]
        # As many ids as were labelled by hand so far.
        own = pool.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {dict(df.dtypes)[key]}")), key, "left_semi")
        found = own.where(F.col(y) == 1).count()
        rows.append({"strategy": strategy, "round": r, "n_found": found} | evaluate(own, held, cols, y))
        if r == rounds:
            break
        rest = pool.join(own.select(key), key, "left_anti")
        if strategy == "random" or not 0 < found < len(ids):
            order: list = [draw_of(F.col(key), f"{seed}-{r}"), key]
        else:
            rest = predict(train(own, cols, y), rest, cols)
            order = [F.desc("p") if strategy == "probability" else F.abs(F.col("p") - 0.5), key]
        more = [x[key] for x in rest.orderBy(*order).limit(batch).select(key).collect()]
        chosen = df.sparkSession.createDataFrame([(i,) for i in ids + more], f"{key} {dict(df.dtypes)[key]}")
    return _rows(df, rows)


def effort(curve: DataFrame, by: str, n: str, metric: str, target: float) -> DataFrame:
    """(by, clips): the least n at which the metric reaches target; null where it never does."""
    return curve.groupBy(by).agg(F.min(F.when(F.col(metric) >= target, F.col(n))).alias("clips"))


def discrimination(df: DataFrame, label: str, a: str, b: str, families: dict[str, list[str]], group: str) -> DataFrame:
    """a against b under each family of features."""
    two = df.where(F.col(label).isin(a, b)).withColumn("__a", (F.col(label) == a).cast("int"))
    pool, held = hold_out(two, group)
    return _rows(df, [{"family": f} | evaluate(pool, held, cols, "__a") for f, cols in families.items()])


def leave_out(df: DataFrame, cols: list[str], y: str, subject: str, folds: int) -> DataFrame:
    """Folds of whole subjects, each scored by a fit on the others."""
    fold = F.floor(draw_of(F.col(subject), "fold") * folds).cast("int")
    own = df.withColumn("__f", fold)
    return _rows(df, [{"fold": f} | evaluate(own.where(F.col("__f") != f), own.where(F.col("__f") == f), cols, y) for f in range(folds)])


def embed(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(key, u, v): the two directions in which standardised columns spread most."""
    z = features(standardize(df, cols), cols)
    out = PCA(k=2, inputCol="__x", outputCol="__u").fit(z).transform(z).withColumn("__u", vector_to_array("__u"))
    return out.select(key, F.col("__u")[0].alias("u"), F.col("__u")[1].alias("v"))


def fit_scaler(windows: DataFrame, cols: list[str]):
    """A scaler over all rows of all windows, whatever window they are of."""
    rows = features(windows, cols)
    return StandardScaler(inputCol="__x", outputCol="scaled", withMean=True, withStd=True).fit(rows)
