"""Quantiles, frames, models, uncertainty and networks against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learners, models, quantiles, reconcile, scenarios, splits
from tidemark.plans.features import Features


@pytest.mark.parametrize("cells", [500_000, 40])
def test_quantiles_by_counting(spark, monkeypatch, cells):
    rng = np.random.default_rng(0)
    rows = [("ab"[i % 2] if i % 7 else None, float(v)) for i, v in enumerate(np.concatenate([rng.normal(size=900), np.full(400, 3.0), rng.lognormal(8, 4, 200), [-1e300, 1e300]]))]
    rows += [("a", None), ("c", None), ("d", 5.0), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    alphas = [0.0, 0.1, 0.5, 0.77, 1.0]
    frame = pd.DataFrame(rows, columns=["g", "v"])
    for few in (0, 10**9):
        monkeypatch.setattr(quantiles, "FEW", few)
        monkeypatch.setattr(quantiles, "CELLS", cells)
        got = {r.g: r["_q"] for r in quantiles.exact_quantiles(df, "v", alphas, by=["g"]).collect()}
        want = {(None if isinstance(g, float) else g): v.dropna().quantile(alphas).tolist() for g, v in frame.groupby("g", dropna=False).v}
        assert set(got) == {k for k, v in want.items() if v[0] == v[0]}
        assert all(np.allclose(got[g], want[g], rtol=1e-12) for g in got)
        assert np.allclose(quantiles.exact_quantiles(df, "v", alphas).first()["_q"], frame.v.dropna().quantile(alphas), rtol=1e-12)
    monkeypatch.setattr(quantiles, "FEW", -1)
    assert quantiles.exact_quantiles(df.limit(0), "v", alphas, by=["g"]).count() == 0


def test_frames_of_time_in_buckets(spark):
    """All functions over irregular rows with equal times and nulls: in buckets as without."""
    rng = np.random.default_rng(1)
    rows = [("ab"[int(rng.integers(2))], int(t) // 7 * 7, None if rng.random() < 0.1 else float(rng.normal() + 100)) for t in rng.integers(0, 40_000, 1500)]
    df = spark.createDataFrame(rows, "name string, s long, y double").select("name", F.timestamp_seconds("s").alias("ts"), "y")
    functions = ["mean", "sum", "count", "std", "var", "min", "max", "median"]
    plain, cut = (Features("1m", ["name"], bucket=b).add(["y"], functions, "10m") for b in (None, "1h"))
    a, b = (p.transform(df, drop_nulls=False).toPandas().sort_values(["name", "ts", "y"], na_position="first")[p.feature_names()].to_numpy("f8") for p in (plain, cut))
    assert a.shape == b.shape and np.isfinite(a).any() and np.allclose(a, b, rtol=1e-9, atol=1e-7, equal_nan=True)


def test_rows_with_nulls_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b) if i % 9 else None, float(i % 2), float(2 * a + b), float(a - b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, on double, t1 double, t2 double")
    x, n = ["a", "b", "on"], 300
    lost = len(range(0, 300, 9))
    for out, col in (
        (learners.fit_boosted(df, x, ["t1"], trees=2).predict(df), "t1_hat"),
        (learners.fit_energy_aware(df, x, ["t1", "t2"], ["on"], trees=2).predict(df), "t2_hat"),
    ):
        assert out.count() == n and out.filter(F.col(col).isNull()).count() == lost
    forest = learners.fit_quantile_forest(df, x, "t1", trees=2).predict(df, [0.1, 0.9], ["id"])
    assert forest.count() == 2 * n and forest.filter("q is null").count() == 2 * lost


def test_energy_aware_knows_its_own_controls(spark):
    rows = [(i, float(i % 5), float(i % 2), float(i % 5 + 3 * (i % 2)), float(i % 5 + 3 * (i % 2))) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "id long, a double, on double, t1 double, t2 double")  # repeated rows stay
    out = learners.fit_energy_aware(df, ["a", "on"], ["t1", "t2"], ["on"], trees=20, rate=0.5).predict(df)
    assert out.count() == 220 and out.agg(F.max(F.abs(F.col("t2_hat") - F.col("t2")))).first()[0] < 0.5


@pytest.mark.parametrize("loss", ["squares", "normal", "crps", "lognormal"])
def test_network_gradients_and_fit(spark, loss):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = np.exp(0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.05 * rng.normal(size=40))
    target = np.log(y) if loss == "lognormal" else y
    net = learners.Network([rng.normal(size=(2, 5)), rng.normal(size=5), 0.1 * rng.normal(size=(5, 2 if loss != "squares" else 1)), np.zeros(2 if loss != "squares" else 1)], x.mean(0), x.std(0), float(target.mean()), float(target.std()), loss)
    _, slopes = learners._slopes(net, loss, x, target)
    for p, g in zip(net.params, slopes, strict=True):
        for at in [(0,) * p.ndim, (-1,) * p.ndim]:
            old, e, around = p[at], 1e-6, []
            for value in (old - e, old + e):
                p[at] = value
                around.append(learners._slopes(net, loss, x, target)[0])
            p[at] = old
            assert abs((around[1] - around[0]) / (2 * e) - g[at]) < 1e-4 * max(1, abs(g[at]))
    many = rng.normal(size=(2000, 2))
    rows = [(*map(float, v), float(np.exp(0.5 * v[0] - 0.4 * v[1]))) for v in many]
    df = spark.createDataFrame(rows + [(None, 1.0, 2.0)], "a double, b double, y double").repartition(3)
    out = learners.fit_network(df.dropna(), ["a", "b"], "y", epochs=25, loss=loss).predict(df.dropna(), ["a", "b"])
    error, spread = out.agg(F.avg((F.col("f") - F.col("y")) ** 2), F.var_pop("y")).first()
    assert error < 0.3 * spread


def test_bootstrap_of_means(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(5, 2, 4000))] + [(9999, "a", None), (10_000, "c", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.g: r for r in learners.bootstrap_mean(df, "v", 700, by=["g"], keys=["id"]).collect()}
    again = {r.g: r for r in learners.bootstrap_mean(df.repartition(7), "v", 700, by=["g"], keys=["id"]).collect()}
    frame = pd.DataFrame(rows, columns=["id", "g", "v"]).dropna()
    for g in "ab":
        v = frame[frame.g == g].v
        assert abs(got[g]["mean"] - v.mean()) < 0.01 and abs(got[g]["std"] / (v.std() / np.sqrt(len(v))) - 1) < 0.12 and got[g]["n"] == len(v)
        assert np.isclose(got[g]["mean"], again[g]["mean"]) and np.isclose(got[g]["std"], again[g]["std"])
    assert learners.resamples(4000) == 3600 and learners.resamples(200) == 100 and got["c"]["std"] == 0
    assert abs(learners.qq(rng.normal(size=50_000)).away).max() < 0.1


def test_sparse_inverse():
    """A chain's precision: the neighbours but one are independent, given the ones between."""
    precision = np.eye(5) * 2 + np.diag(np.full(4, -0.9), 1) + np.diag(np.full(4, -0.9), -1)
    cov = np.linalg.inv(precision)
    assert np.allclose(scenarios.glasso(cov, 0.0), cov, atol=1e-6)
    found = np.linalg.inv(scenarios.glasso(cov, 0.02))
    assert abs(found[0, 2:]).max() < 0.05 < abs(found[0, 1])
    # the conditions of the optimum: |cov - estimate| is alpha where the precision isn't zero, and at most alpha elsewhere
    gap = scenarios.glasso(cov, 0.05) - cov
    assert np.abs(gap - np.diag(np.diag(gap))).max() < 0.05 + 1e-5 and np.abs(np.diag(gap)).max() < 1e-5
    rng = np.random.default_rng(5)
    x = rng.multivariate_normal(np.zeros(5), cov, 60)
    assert scenarios.glasso_alpha([(20, np.cov(x[i::3], rowvar=False, ddof=0)) for i in range(3)]) > 0


def test_models_of_a_hierarchy_add_up(spark):
    rng, rows = np.random.default_rng(6), []
    for t in range(200):
        a, b = np.sin(t / 5) * 10 + rng.normal(), np.cos(t / 7) * 10 + rng.normal()
        rows += [("a", t, float(a)), ("b", t, float(b)), ("all", t, float(a + b))]
    df = spark.createDataFrame(rows, "name string, h long, y double").select("name", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "y")
    h = reconcile.Hierarchy({"all": ["a", "b"]})
    own = Features("1h", ["name"]).add(["y"], lags=[0, 1]).add_target(["y"], lags=[-1, -2]).transform(df).withColumnsRenamed({"y_lag_-001": "t1", "y_lag_-002": "t2"}).cache()
    fitted = models.fit_tree(own, h, ["y_lag_000", "y_lag_001"], ["t1", "t2"])
    f = fitted.predict(own)
    assert set(fitted.models) == {"all", "bottom"} and f.count() == 2 * own.count()
    for method in ("ols", "mint", "mint_glasso", "bayes"):
        cov = reconcile.error_moments(f.withColumn("e", F.col("y") - F.col("f")), h)
        out = reconcile.reconcile(f, h, {k: reconcile.projection(h, method, c) for k, c in cov.items()})
        gap = out.groupBy("ts", "step").pivot("name", ["a", "b", "all"]).agg(F.first("f")).agg(F.max(F.abs(F.col("a") + F.col("b") - F.col("all")))).first()[0]
        assert gap < 1e-8
    fitted = models.fit_uncertain(own.filter("name <> 'all'"), ["y_lag_000", "y_lag_001"], ["t1", "t2"], alphas=[0.1, 0.5, 0.9])
    q = fitted.quantiles(own.filter("name = 'a'"))
    inside = q.join(fitted.predict(own).select("name", "ts", "step", "y"), ["name", "ts", "step"]).groupBy("alpha").agg(F.avg((F.col("y") <= F.col("q")).cast("double")).alias("share")).collect()
    assert all(abs(r.share - r.alpha) < 0.15 for r in inside)
    hourly = fitted.hourly_trees([1, 2], 30)
    assert hourly.select("hour").distinct().count() == 24
    few = own.filter("name = 'a'").limit(10)
    for trees in (fitted.trees(few, [1, 2], 12), fitted.trees(few, [1, 2], 12, hourly=hourly)):
        p = trees.groupBy("name", "ts", "step").agg(F.sum("p").alias("p")).collect()
        assert len(p) == 20 and all(abs(r.p - 1) < 1e-9 for r in p)


def test_orders_spaces_and_samples(spark):
    df = spark.createDataFrame([(float(i), float(-i), None, float(i % 3)) for i in range(20)], "y double, a double, b double, c double")
    order = models.correlation_order(df, ["a", "b", "c"], "y")
    assert order == ["c", "a", "b"]
    assert models.reorder(df, ["a", "b", "c"], order).first() == (0.0, 0.0, 0.0, None)
    drawn = [models.draw(models.SPACES["boosted"] | models.SPACES["linear"], np.random.default_rng(i)) for i in range(20)]
    assert all(50 <= d["trees"] <= 300 and isinstance(d["trees"], int) and 0.005 <= d["rate"] <= 0.2 for d in drawn) and {d["kind"] for d in drawn} == {"linear", "ridge"}
    best = models.trial_summary(spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0), (1, 0, 1.0), (1, 1, 1.0)], "trial int, fold int, score double")).collect()
    assert {(r.trial, r.score, r["rank"], r.best) for r in best} == {(0, 3.0, 2, False), (1, 1.0, 1, True)}
    assert splits.sample_rows(spark.range(50), 7, keys=["id"]).count() == 7
