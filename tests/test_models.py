"""Fits against enumeration, planted states, closed forms and held-out rows; tests of the statistics' tails."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.operators import labels as L, models as M, stats as T


def test_forward_backward_equals_enumeration():
    p = {"start": np.array([0.6, 0.4]), "trans": np.array([[0.7, 0.3], [0.2, 0.8]]), "emit": np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])}
    x = np.array([0, 2, 1, 2, 0])
    weight = {s: p["start"][s[0]] * math.prod(p["trans"][a, b] for a, b in zip(s, s[1:])) * math.prod(p["emit"][a, c] for a, c in zip(s, x)) for s in itertools.product((0, 1), repeat=5)}
    total = sum(weight.values())
    ll, share, pairs = M.forward_backward(x, p)
    assert abs(ll - math.log(total)) < 1e-12
    for i in range(5):
        assert abs(share[i, 1] - sum(w for s, w in weight.items() if s[i] == 1) / total) < 1e-12
    assert abs(pairs[0, 1] - sum(w * sum(a == 0 and b == 1 for a, b in zip(s, s[1:])) for s, w in weight.items()) / total) < 1e-12
    assert tuple(M.viterbi(x, p)) == max(weight, key=weight.get)


def planted(rng, steps):
    s = [0]
    for _ in range(steps - 1):
        s.append(s[-1] if rng.random() < 0.95 else 1 - s[-1])
    return s


def test_hmm_finds_planted_states(spark):
    rng = np.random.default_rng(1)
    paths = {i: planted(rng, 80) for i in range(12)}
    rows = [(i, [int(rng.choice(4, p=[0.45, 0.45, 0.05, 0.05] if s == 0 else [0.05, 0.05, 0.45, 0.45])) for s in path]) for i, path in paths.items()]
    df = spark.createDataFrame(rows, "k long, o array<int>")
    p, told = M.fit_hmm(df, "k", "o", 2, 4, iterations=15)
    assert all(b >= a - 0.5 for a, b in zip(told, told[1:])) and told[-1] > told[0]
    got = {r.k: r.states for r in M.decode(df, "k", "o", p).collect()}
    same = np.mean([a == b for k in paths for a, b in zip(got[k], paths[k])])
    assert max(same, 1 - same) > 0.9
    num = [(i, [[float(rng.normal(4 * s, 1)), float(rng.normal(-3 * s, 1))] for s in path]) for i, path in paths.items()]
    df = spark.createDataFrame(num, "k long, o array<array<double>>")
    p, told = M.fit_hmm(df, "k", "o", 2, iterations=10)
    same = np.mean([a == b for r in M.decode(df, "k", "o", p).collect() for a, b in zip(r.states, paths[r.k])])
    assert max(same, 1 - same) > 0.95


def points(spark, n=240):
    rng = np.random.default_rng(2)
    rows = [(i, i % 8, float(rng.normal(3 * (i % 2), 1)), float(rng.normal(0, 1)), i % 2, "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g long, u double, v double, y int, label string")


def test_clusters_and_weights(spark):
    df = points(spark).withColumn("x", F.array("u", "v"))
    out, centers = M.kmeans(df, "x", 2)
    got = out.collect()
    for r in got:
        d = [math.dist(r.x, c) for c in centers]
        assert r.cluster == d.index(min(d)) and 0 <= r.confidence <= 1
    motif = M.discover(points(spark), ["u", "v"], 2, F.col("g") < 4).groupBy("motif").count().collect()
    assert len(motif) == 2
    w = {r.y: r.weight for r in M.weights(points(spark).where("y = 1 or id % 10 = 0"), "y").select("y", "weight").distinct().collect()}
    assert w == {1: 1.0, 0: 3.0}
    up = {r.y: r["count"] for r in M.upsample(points(spark).where("y = 1 or id % 10 = 0"), "y", "id").groupBy("y").count().collect()}
    assert up == {0: 120, 1: 120}
    more = M.augment(points(spark), ["u", "v"], "y", "id", copies=2, drop=0.5)
    assert more.count() == 240 + 240 and 150 < more.where("u = 0").count() + more.where("v = 0").count() < 330


def test_classifier_sweeps(spark):
    df = points(spark).cache()
    for family in ("logistic", "trees"):
        pool, held = M.hold_out(df, "g")
        assert {r.g for r in pool.select("g").distinct().collect()}.isdisjoint({r.g for r in held.select("g").distinct().collect()}) and held.select("g").distinct().count() == 2
        assert M.evaluate(pool, held, ["u", "v"], "y", family)["auc"] > 0.9
    curve = M.learning_curve(df, ["u", "v"], "y", "g", "id", [5, 40], 1)
    assert [r.n_pos_train for r in curve.orderBy("size").collect()] == [5.0, 40.0]
    assert {r.seed: r.clips for r in M.effort(curve, "seed", "size", "auc", 0.5).collect()} == {0: 5}
    abl = {r.config: r.auc for r in M.ablation(df, {"a": ["v"], "b": ["u"]}, "a", "y", "g").collect()}
    assert set(abl) == {"a", "+b", "all"} and abl["+b"] > abl["a"]
    al = M.active_learning(df, ["u", "v"], "y", "g", "id", 10, 10, 1, "probability").orderBy("round").collect()
    assert [r.n_train for r in al] == [10.0, 20.0] and al[1].n_found > al[0].n_found
    assert M.discrimination(df, "label", "a", "b", {"u": ["u"]}, "g").first().auc > 0.9
    loso = M.leave_out(df, ["u", "v"], "y", "g", 2).collect()
    assert len(loso) == 2
    model = M.train(df, ["u", "v"], "y")
    r = M.predict(model, df, ["u", "v"]).first()
    assert abs(r.prediction_prob - max(r.p, 1 - r.p)) < 1e-12


def test_logistic_scores_carry_no_model(spark):
    """The plan of a score is of plain expressions, so there is no model to serialize, and gives what the model does."""
    df = points(spark).unionByName(points(spark).limit(1).withColumn("u", F.lit(None).cast("double")))
    model = M.train(df, ["u", "v"], "y")
    out = M.predict(model, df, ["u", "v"])
    assert "UDF" not in out._jdf.queryExecution().analyzed().toString()
    want = model.transform(M.features(df, ["u", "v"])).select("id", "u", M.vector_to_array("probability")[1].alias("q"))
    both = out.select("id", "u", "p").join(want, (out.id == want.id) & out.u.eqNullSafe(want.u)).select("p", "q").collect()
    assert len(both) == 241 and all(abs(r.p - r.q) < 1e-12 for r in both)


def test_tails():
    for n, t in T.T_975.items():
        assert abs(T.t_tail(t, n) - 0.05) < 2e-4
    assert abs(T.t_critical(12) - 2.201) < 1e-3 and abs(T.t_critical(101) - 1.984) < 1e-3 and math.isnan(T.t_critical(1))
    assert abs(T.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(T.chi2_tail(30, 4) - math.exp(-15) * 16) < 1e-12 and abs(T.chi2_tail(1.2, 4) - math.exp(-0.6) * 1.6) < 1e-12
    assert abs(T.f_tail(4.0, 1, 10) - T.t_tail(2.0, 10)) < 1e-12
    m = np.array([0.3, 0.5, 0.1, 0.4, -0.1])
    want = [abs(v.mean() / (v.std(ddof=1) / math.sqrt(5))) for s in itertools.product((1, -1), repeat=5) for v in [m * s]]
    assert abs(T.sign_flip(m) - np.mean([w >= want[0] - 1e-12 for w in want])) < 1e-12 and math.isnan(T.sign_flip(np.array([1.0, 1.0])))


def test_unbalanced_clusters_have_the_least_loss():
    """The estimate beats a fine grid of variance ratios; without spread between clusters it is the plain mean."""
    rng = np.random.default_rng(3)
    groups = [rng.normal(rng.normal(0, 1.5), 1, n) + 0.5 for n in (3, 8, 5, 12, 4, 9)]
    out = T.clustered([(len(g), g.sum(), (g * g).sum()) for g in groups])
    y, x = np.concatenate(groups), np.repeat(np.arange(6), [len(g) for g in groups])

    def loss(lam):
        h = np.eye(len(y)) + lam * (x[:, None] == x[None])
        i = np.linalg.inv(h)
        s = i.sum()
        mu = (i @ y).sum() / s
        q = (y - mu) @ i @ (y - mu)
        return (len(y) - 1) * math.log(q / (len(y) - 1)) + np.linalg.slogdet(h)[1] + math.log(s), mu, q

    lam = out["icc"] / (1 - out["icc"])
    best = loss(lam)
    assert all(best[0] <= loss(v)[0] + 1e-7 for v in np.linspace(0, 10, 300)) and abs(best[1] - out["estimate"]) < 1e-9
    assert 1 < out["df"] < len(y) and 0 < out["p_value"] < 1
    flat = [(4, 4 * 2.0, 4 * 4.0 + s) for s in (1.0, 2.0, 3.0)]
    assert T.clustered(flat)["icc"] == 0 and abs(T.clustered(flat)["estimate"] - 2.0) < 1e-12 and T.clustered(flat)["df"] == 2.0


def test_ward_equals_merging_by_hand():
    x = np.array([[0.0], [1.0], [10.0], [11.0], [30.0]])
    assert T.ward(x, 3).tolist() == [0, 0, 1, 1, 2] and T.ward(x, 2).tolist() == [0, 0, 0, 0, 1] and T.ward(x, 9).tolist() == [0, 1, 2, 3, 4]


def test_contrast_takes_the_best_bound_each_step(spark):
    ex = spark.createDataFrame([(5.0 + i / 10, 1.0) for i in range(11)], "a double, b double")
    bg = spark.createDataFrame([(float(i % 12), float(i % 4)) for i in range(240)], "a double, b double")
    got = L.contrast(ex, bg, ["a", "b"])
    assert got and got[0][0] in ("a", "b")
    cond = lambda t: (lambda v: v >= t[2]) if t[1] == "ge" else (lambda v: v <= t[2])
    rows = [(float(i % 12), float(i % 4)) for i in range(240)]
    q = {"a": np.percentile([5.0 + i / 10 for i in range(11)], [5, 10, 90, 95]), "b": np.ones(4)}
    tests = [(c, op, q[c][i]) for c in "ab" for op, i in (("ge", 0), ("ge", 1), ("le", 2), ("le", 3))]
    e = [(5.0 + i / 10, 1.0) for i in range(11)]
    fine = [t for t in tests if sum(cond(t)(r["ab".index(t[0])]) for r in e) >= 0.8 * 11]
    left = [sum(cond(t)(r["ab".index(t[0])]) for r in rows) for t in fine]
    assert (got[0][0], got[0][1]) == fine[left.index(min(left))][:2]


def test_two_groups_are_needed(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0)], "u long, g string, c string, v double")
    with pytest.raises(ValueError):
        T.permutation_test(df, df.select("u", "g"), "u", "g", ["c"], "v", 5, "1")
