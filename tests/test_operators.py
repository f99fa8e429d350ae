import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import aggregates as agg
from tidemark.operators import forecasts, learners, metrics, reconcile, scenarios, splits, stateful
from tidemark.sources import storage
from tidemark.streaming import streams


def test_normal_functions():
    from statistics import NormalDist

    x = np.linspace(-5, 5, 41)
    assert np.allclose(agg.norm_cdf(x), [NormalDist().cdf(v) for v in x], atol=1e-12)
    p = np.linspace(0.001, 0.999, 37)
    assert np.allclose(agg.norm_ppf(p), [NormalDist().inv_cdf(v) for v in p], atol=1e-8)


def test_crps_closed_forms_by_quadrature():
    grid = np.linspace(-60, 60, 200_001)
    f = agg.norm_cdf((grid - 1) / 2)
    assert abs(np.trapezoid((f - (grid >= 2.5)) ** 2, grid) - agg.normal_crps(2.5, 1.0, 2.0)) < 1e-4
    pos = np.linspace(1e-9, 300, 400_001)
    s2 = np.log1p(4 / 9)
    g = agg.norm_cdf((np.log(pos) - np.log(9 / np.sqrt(13))) / np.sqrt(s2))
    assert abs(np.trapezoid((g - (pos >= 2.0)) ** 2, pos) - agg.lognormal_crps(2.0, 3.0, 4.0)) < 1e-3
    assert np.isclose(agg.lognormal_crps(-2.0, -3.0, -4.0), agg.lognormal_crps(2.0, 3.0, 4.0))


@given(st.dictionaries(st.integers(0, 23), st.integers(1, 50), min_size=1), st.integers(1, 400))
@settings(max_examples=200, deadline=None)
def test_allocation(counts, rows):
    if rows < len(counts):
        return
    share = splits.allocate(counts, rows)
    assert sum(share.values()) == min(rows, sum(counts.values()))
    assert all(1 <= share[k] <= counts[k] for k in counts)


def test_samples(spark):
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), "id")
    a, b = (splits.sample_by_hour(df, 60, seed=3).collect() for _ in range(2))
    assert len(a) == 60 and sorted(a) == sorted(b) and len({r.ts.hour for r in a}) == 24
    assert splits.sample_rows(df, 17).count() == 17
    for bad, error in ((0, ValueError), ("9", TypeError), (True, TypeError)):
        with pytest.raises(error):
            splits.sample_rows(df, bad)


def test_folds_leave_a_dead_band(spark):
    folds = splits.time_folds(0, 100, 4, dead=5)
    assert [(f.start, f.end) for f in folds] == [(0, 33), (22, 55), (44, 77), (67, 100)]
    with pytest.raises(ValueError):
        splits.time_folds(0, 100, 4, dead=40)
    df = spark.range(101).select(F.timestamp_micros("id").alias("ts"), "id")
    out = splits.assign_folds(df, folds).groupBy("fold").pivot("role").count().orderBy("fold").collect()
    assert all(r.train + r.test < 101 for r in out)


def test_linear_and_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [[1.0, 2.0], [0.5, 0.0], [-1.0, 3.0]] + 4
    df = spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=["a", "b", "c", "s", "t"]))
    ols = forecasts.fit_linear(df, ["a", "b", "c"], ["s", "t"])
    assert np.allclose(ols.coef, [[1, 2], [0.5, 0], [-1, 3], [4, 4]], atol=1e-8)
    ridge = forecasts.fit_ridge(df, ["a", "b", "c"], ["s"], [2.0])
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y[:, 0] - y[:, 0].mean()))
    assert np.allclose(ridge.coef[:3, 0], want)


def test_linear_and_ridge_far_from_zero(spark):
    """Means large beside what varies, units far apart, a column that is constant; and no rows at all."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 2))
    a, b = 1e9 + 100 * z[:, 0], 1e-6 * z[:, 1]
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": np.full(300, 0.1), "s": 3e8 + 2 * (a - 1e9) + 5e6 * b}))
    ols = forecasts.fit_linear(df, ["a", "b", "c"], ["s"])
    assert np.allclose(ols.coef[:3, 0], [2, 5e6, 0], rtol=1e-8, atol=0)
    got = ols.predict(df).select("s", "s_hat").toPandas()
    assert np.allclose(got.s, got.s_hat, rtol=0, atol=1e-5)
    x = np.c_[a - a.mean(), b - b.mean()]
    y = got.s.to_numpy() - got.s.mean()
    ridge = forecasts.fit_ridge(df, ["a", "b"], ["s"], [2.0])
    assert np.allclose(ridge.coef[:2, 0], np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ y), rtol=1e-6)
    assert not forecasts.fit_linear(df.limit(0), ["a", "b"], ["s"]).coef.any()


def test_reconciliation_is_coherent():
    h = reconcile.Hierarchy({"s0": ["s1", "s2"], "s1": ["a", "b"], "s2": ["c", "d"]})
    rng = np.random.default_rng(1)
    cov = reconcile.shrunk_covariance(rng.normal(size=(50, 7)))
    f = rng.normal(size=7)
    for m in ("ols", "mint", "bayes"):
        p = reconcile.projection(h, m, cov)
        g = p @ f
        assert np.allclose(g[:3], [g[3:].sum(), g[3] + g[4], g[5] + g[6]])
        assert np.allclose(p @ g, g)
    assert h.levels() == {"s0": 0, "s1": 1, "s2": 1, "a": 2, "b": 2, "c": 2, "d": 2}


def test_trees():
    paths = np.cumsum(np.random.default_rng(0).normal(size=(30, 5)), 1)
    nodes = [1, 2, 4, 4, 8]
    for name, build in scenarios.TREES.items():
        tree = build(paths, nodes)
        assert (tree.parent == -1).sum() == 1, name
        assert np.allclose(tree.groupby("step").p.sum(), 1), name
        assert (tree.groupby("step").size().to_numpy() <= nodes).all(), name
        assert (tree.set_index("node").step.reindex(tree.parent[tree.parent >= 0]).to_numpy() + 1 == tree.step[tree.parent >= 0]).all()
    better = scenarios.refine(paths, scenarios.quantile_tree(paths, nodes))
    assert len(better) == len(scenarios.quantile_tree(paths, nodes))


def test_interpolation_extrapolates():
    q, a = np.array([1.0, 2.0, 4.0]), np.array([0.1, 0.5, 0.9])
    assert np.allclose(scenarios.interpolate(np.array([0.0, 0.3, 0.9, 1.0]), a, q), [0.75, 1.5, 4.0, 4.5])


def test_holt_winters_by_hand():
    m = stateful.HoltWinters((2, 3), 2, alpha=0.5, beta=0.0, gammas=(0.2, 0.1))
    f, state = stateful.walk(m, np.array([1.0]))
    a = 0.5 * (1 - 1 - 1)
    assert np.isclose(state["a"], a) and np.isclose(state["s1"][-1], 0.2 * (1 - a - 1) + 0.8) and np.isclose(f[0, 0], a + 1 + 1)
    gap, _ = stateful.walk(m, np.array([1.0, np.nan, 2.0]))
    assert np.isfinite(gap).all()


@pytest.mark.parametrize("model", [stateful.HoltWinters((24, 48), 6), stateful.FourierSmoothing(48, 4, 6), stateful.FourierKalman(48, 3, 6), stateful.FourierKalmanMix(2, 48, 6, 2), stateful.SimpleSmoothing(6)])
def test_stateful_models_continue(model):
    y = 5 + np.sin(np.arange(200) * 2 * np.pi / 24)
    whole, _ = stateful.walk(model, y)
    first, state = stateful.walk(model, y[:120])
    rest, _ = stateful.walk(model, y[120:], state)
    assert np.allclose(whole, np.vstack([first, rest])) and np.isfinite(whole).all()


def test_stream_equals_batch(spark, data):
    events = streams.read_events(spark, data).select(F.col("event_type").alias("name"), "ts", F.col("value").alias("y"))
    model = stateful.HoltWinters((24, 48), 1)
    out = streams.run_to_table(streams.stateful_forecast(events, model), "t").groupBy("name").agg(F.sum("f1").alias("s")).collect()
    batch = spark.read.parquet(f"{data}/events.parquet").toPandas()
    for r in out:
        y = batch[batch.event_type == r.name].sort_values("ts")["value"].to_numpy()
        assert np.isclose(stateful.walk(model, y)[0][:, 0].sum(), r.s)


def test_learners_beat_the_mean(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(400, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    df = storage.written(spark.createDataFrame(pd.DataFrame({"i": range(400), "a": x[:, 0], "b": x[:, 1], "y": y})), "t")
    mse = lambda d, c: d.agg(F.avg((F.col(c) - F.col("y")) ** 2)).first()[0]
    var = float(y.var())
    assert mse(learners.fit_boosted(df, ["a", "b"], ["y"], trees=10).predict(df), "y_hat") < 0.5 * var
    assert mse(learners.fit_random_features(df, ["a", "b"], ["y"], n=40).predict(df), "y_hat") < 0.5 * var
    assert mse(learners.fit_binned(df, ["a", "b"], "y", rounds=8).predict(df, "f"), "f") < 0.5 * var
    assert mse(learners.fit_network(df, ["a", "b"], "y").predict(df, ["a", "b"]), "f") < 0.5 * var
    q = learners.fit_quantile_forest(df, ["a", "b"], "y", trees=10).predict(df, [0.1, 0.9], ["i"]).groupBy("i").pivot("alpha").agg(F.first("q")).toDF("i", "lo", "hi")
    inside = q.join(df, "i").agg(F.avg(F.when((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi")), 1.0).otherwise(0.0)), F.min(F.col("hi") - F.col("lo"))).first()
    assert inside[0] > 0.7 and inside[1] >= 0


def test_labels_and_empty_tables(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(((r.c, r.k) for r in metrics.encode_labels(df, "c", "k").collect()), key=str) == [("a", 0), ("b", 1), (None, None)]
    with pytest.raises(Exception, match="unseen"):
        metrics.encode_labels(df, "c", "k", seen=df.filter("c = 'a'")).collect()
    none = df.filter("c = 'z'")
    assert metrics.categorical_columns(df) == ["c"] and metrics.shrunk_types(none) == {}


def test_parameters_round_trip(spark, tmp_path):
    storage.save_parameters(spark, f"file://{tmp_path}/m", {"a": [1, 2.5]})
    assert storage.load_parameters(spark, f"file://{tmp_path}/m") == {"a": [1, 2.5]}


def test_scenarios_of_all_series(spark):
    from tidemark import queries

    data = "/root/testdata/sf0.01"

    names = {r[0] for r in queries.panel(spark, data).select("name").distinct().collect()}
    rows = queries.QUERIES["copula_scenarios"](spark, data).collect()
    assert {r.name for r in rows} == names and len(names) > 1
    assert len({(r.name, r.ts, r.scenario) for r in rows}) == len(rows)
    leaves = queries.QUERIES["tree_leaf_paths"](spark, data).collect()
    assert {(r.name, r.ts) for r in leaves} == {(r.name, r.ts) for r in rows}
    assert len({(r.name, r.ts, r.leaf, r.step) for r in leaves}) == len(leaves)


def test_reduction_by_tolerance_and_of_several_variables():
    rng = np.random.default_rng(3)
    paths = rng.normal(size=(30, 5)).cumsum(1)
    levels = lambda t: t.groupby("step").node.count().tolist()
    coarse, fine = scenarios.reduce_scenarios(paths, tolerance=50.0), scenarios.reduce_scenarios(paths, tolerance=1e-9)
    assert levels(coarse)[0] == levels(fine)[0] == 1 and sum(levels(coarse)) < sum(levels(fine))
    assert levels(fine)[1:] == [26, 27, 28, 29]  # every step joins two branches at least
    two = scenarios.reduce_scenarios(np.stack([paths, -paths], 2), [1, 2, 4, 6, 8])
    one = scenarios.reduce_scenarios(paths, [1, 2, 4, 6, 8])
    assert np.allclose(two.v0, -two.v1) and np.allclose(two.v0, one.v) and (two.parent == one.parent).all()
    assert levels(one) == [1, 2, 4, 6, 8] and np.allclose(one.groupby("step").p.sum(), 1)
    assert levels(scenarios.reduce_scenarios(np.ones((4, 3)))) == [1, 1, 1]


def test_kalman_with_motion_and_observation():
    f, h, q, r = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]]), 1e-6 * np.eye(2), np.array([[1e-4]])
    x, p = np.zeros(2), 100 * np.eye(2)
    for t in range(1, 60):
        x, p = stateful.kalman(x, p, np.array([3.0 + 0.5 * t]), q, r, f, h)
    assert np.allclose(x, [3.0 + 0.5 * 59, 0.5], atol=1e-2)
    a, b = np.array([1.0, 2.0]), np.array([[2.0, 0.3], [0.3, 1.0]])
    plain = stateful.kalman(a, b, np.zeros(2), np.eye(2), np.eye(2))
    same = stateful.kalman(a, b, np.zeros(2), np.eye(2), np.eye(2), np.eye(2), np.eye(2))
    assert all(np.allclose(u, v) for u, v in zip(plain, same, strict=True))


def test_holt_winters_learns_from_covariates(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=n)
    y = 5 + np.sin(np.arange(n) * 2 * np.pi / 24) + np.r_[0, 3 * x[:-1]]
    pdf = pd.DataFrame({"name": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": y, "x": x, "old": np.arange(n) < 300})
    pdf.loc[350, "x"] = None
    df = spark.createDataFrame(pd.concat([pdf, pdf.assign(name="untrained", old=False).head(30), pdf.assign(name="trained", old=True).head(60)]))
    model, truth = stateful.HoltWinters((24, 48), 3), y[300:]
    first, cold = stateful.walk(model, y[:300])
    fix = pdf.x[300:].fillna(0).to_numpy()[:, None] @ stateful.residual_coefficients(first, y[:300], x[:300, None])
    error = lambda g: float(np.mean((g[:-1, 0] - truth[1:]) ** 2))
    for repeats in (0, 20):
        out = stateful.forecast_corrected(df, model, ["x"], "old", repeats=repeats).toPandas().sort_values(["name", "ts"])
        assert out.groupby("name").size().to_dict() == {"a": 100, "untrained": 30}
        f, state = np.array(out[out.name == "a"].f.tolist()), cold
        for _ in range(repeats):
            state = stateful.walk(model, y[252:300], state)[1]
        plain = stateful.walk(model, truth, state)[0]
        assert np.allclose(f, plain + fix) and error(f) < (0.3 if repeats == 0 else 0.6) * error(plain)


def test_coefficients_equal_least_squares():
    rng = np.random.default_rng(1)
    y, x, f = rng.normal(size=50), rng.normal(size=(50, 2)), rng.normal(size=(50, 3))
    got = stateful.residual_coefficients(f, y, x)
    for h in range(3):
        rest = y[1 + h : 48 + h] - f[:47, h]
        assert np.allclose(got[:, h], np.linalg.lstsq(x[:47], rest, rcond=None)[0])
