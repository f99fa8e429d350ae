"""Models over series and hierarchies, their uncertainty, and what chooses among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from . import forecasts, learners, metrics, reconcile, scenarios


@dataclass
class Identity:
    """The forecast is what the features say."""

    features: Sequence[str]
    targets: Sequence[str]

    def predict(self, df: DataFrame, suffix: str = "_hat") -> DataFrame:
        return df.withColumns({t + suffix: F.col(f) for f, t in zip(self.features, self.targets, strict=False)})


#: Ways to fit by name: (frame, features, targets) to a model whose predict adds a column <target>_hat.
MODELS: dict[str, Callable] = {
    "linear": forecasts.fit_linear, "ridge": forecasts.fit_ridge, "boosted": learners.fit_boosted, "random_features": learners.fit_random_features,
    "identity": lambda df, features, targets: Identity(list(features), list(targets)),
}
#: What a search draws from, by model: bounds of numbers, or choices. Fixed values.
SPACES: dict[str, dict] = {"linear": {"kind": ("linear", "ridge")}, "boosted": {"trees": (50, 300), "rate": (0.005, 0.2)}}


def draw(space: dict, rng: np.random.Generator) -> dict:
    """One point of a space: whole numbers between whole bounds, numbers between others, one of several names."""
    out = {}
    for k, v in space.items():
        if isinstance(v[0], str):
            out[k] = v[int(rng.integers(len(v)))]
        elif all(isinstance(x, int) for x in v):
            out[k] = int(rng.integers(v[0], v[1] + 1))
        else:
            out[k] = float(rng.uniform(*v))
    return out


def long(df: DataFrame, targets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, step, f, y) of a frame with a column <target>_hat, and perhaps the target, for each step."""
    cells = [F.struct(F.lit(i + 1).alias("step"), F.col(f"{t}_hat").cast("double").alias("f"), (F.col(t) if t in df.columns else F.lit(None)).cast("double").alias("y")) for i, t in enumerate(targets)]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def scorer(metric: Column, targets: Sequence[str]) -> Callable[[object, DataFrame], float]:
    """(model, frame) to one number, the lower the better: the metric over the rows of each step, averaged over the steps."""

    def score(model, df: DataFrame) -> float:
        each = metrics.score(long(model.predict(df), targets, []), metric, ["step"], "score")
        return float(each.agg(F.avg("score")).first()[0])

    return score


def trial_summary(scores: DataFrame) -> DataFrame:
    """(trial, score, std, rank, best) from (trial, fold, score): the mean and sample deviation over folds, dense ranks, and the one trial to take."""
    out = scores.groupBy("trial").agg(F.avg("score").alias("score"), F.stddev_samp("score").alias("std"))
    best = out.agg(F.min_by("trial", F.struct("score", "trial")).alias("_best"))
    return metrics.dense_rank(out, "score").crossJoin(F.broadcast(best)).select("trial", "score", "std", F.col("rank").cast("int").alias("rank"), (F.col("trial") == F.col("_best")).alias("best"))  # one row


# -- uncertainty of any model ------------------------------------------------------------------------


@dataclass
class Uncertain:
    """A model with the quantiles of its errors by hour and step, and their correlation over the steps."""

    model: object
    targets: list[str]
    keys: list[str]
    alphas: list[float]
    errors: DataFrame
    correlation: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        return long(self.model.predict(df), self.targets, self.keys)

    def quantiles(self, df: DataFrame) -> DataFrame:
        """(keys, step, alpha, q)"""
        return forecasts.with_quantiles(self.predict(df).filter("f is not null"), self.errors).select(*self.keys, "step", "alpha", "q")

    def _rows(self, q: DataFrame, keys: Sequence[str]) -> DataFrame:
        by_step = q.groupBy(*keys, "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("alpha", "q"))), lambda x: x["q"]).alias("qs"))  # levels
        rows = by_step.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "qs"))), lambda x: x["qs"]).alias("q"))  # steps
        return rows.filter(F.size("q") == len(self.targets))

    def scenarios(self, df: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
        """(keys, scenario, path)"""
        return scenarios.sample(self._rows(self.quantiles(df), self.keys), self.correlation, self.alphas, n, seed=seed, by=self.keys)

    def hourly_trees(self, nodes: Sequence[int], n: int, *, kind: str = "scenred", seed: int = 0) -> DataFrame:
        """(hour, node, parent, step, p, v): a tree of the errors of each hour, made once; 24 of them."""
        q = self.errors.select(F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "step", "alpha", F.col("e").alias("q"))
        drawn = scenarios.sample(self._rows(q, ["ts"]), self.correlation, self.alphas, n, seed=seed, by=["ts"])
        return written(scenarios.trees(drawn, nodes, kind=kind, by=["ts"]).withColumn("hour", F.hour("ts")).drop("ts"), "hourly-trees")

    def trees(self, df: DataFrame, nodes: Sequence[int], n: int, *, kind: str = "scenred", hourly: DataFrame | None = None, seed: int = 0) -> DataFrame:
        """(keys, node, parent, step, p, v): a tree of each row's own scenarios, or, with ``hourly``, its hour's tree with the forecast added."""
        if hourly is None:
            return scenarios.trees(self.scenarios(df, n, seed=seed), nodes, kind=kind, by=self.keys)
        f = self.predict(df).filter("f is not null").select(*self.keys, F.hour("ts").alias("hour"), (F.col("step") - 1).alias("step"), "f")
        return scenarios.superimpose(hourly, f, on=("hour", "step")).select(*self.keys, "node", "parent", "step", "p", "v")


def fit_uncertain(df: DataFrame, features: Sequence[str], targets: Sequence[str], *, fit: Callable | str = "linear", keys: Sequence[str] = ("name", "ts"), alphas: Sequence[float] = forecasts.QUANTILES, validation: DataFrame | None = None, method: str = "shrunk") -> Uncertain:
    """keys include ts. Errors come from ``validation``, or where there is none from the rows that the model was fitted on. Quantiles are by hour where all 24
    occur, else of all rows."""
    model = (MODELS[fit] if isinstance(fit, str) else fit)(df, features, targets)
    e = written(long(model.predict(df if validation is None else validation), targets, keys).filter("f is not null and y is not null"), "errors")
    errors = written(forecasts.residual_quantiles(e, alphas), "error-quantiles")
    wide = e.withColumn("e", F.col("y") - F.col("f")).groupBy(*keys).pivot("step", list(range(1, len(targets) + 1))).agg(F.first("e")).toDF(*keys, *[f"_e{i}" for i in range(len(targets))])
    return Uncertain(model, list(targets), list(keys), list(alphas), errors, written(scenarios.hourly_correlation(wide, [f"_e{i}" for i in range(len(targets))], method=method), "correlation"))


# -- hierarchies -------------------------------------------------------------------------------------


@dataclass
class TreeModels:
    """A model for each aggregate and one, over all of them, for the bottom series."""

    hierarchy: reconcile.Hierarchy
    models: dict[str, object]
    targets: list[str]

    def predict(self, df: DataFrame, keys: Sequence[str] = ("name", "ts")) -> DataFrame:
        """(keys, step, f, y) of all nodes."""
        up = list(self.models)[:-1]
        parts = [self.models[n].predict(df.filter(F.col("name") == n)) for n in up]
        parts.append(self.models["bottom"].predict(df.filter(~F.col("name").isin(up))))
        out = long(parts[0], self.targets, keys)
        for p in parts[1:]:
            out = out.unionByName(long(p, self.targets, keys))
        return out


def fit_tree(df: DataFrame, h: reconcile.Hierarchy, features: Sequence[str], targets: Sequence[str], *, fit: Callable | str = "linear") -> TreeModels:
    make = MODELS[fit] if isinstance(fit, str) else fit
    up = list(h.children)
    models = {n: make(df.filter(F.col("name") == n), features, targets) for n in up}
    models["bottom"] = make(df.filter(~F.col("name").isin(up)), features, targets)
    return TreeModels(h, models, list(targets))


# -- columns -----------------------------------------------------------------------------------------


def correlation_order(df: DataFrame, columns: Sequence[str], target: str) -> list[str]:
    """The columns by falling correlation with the target, ones without any last: one aggregate."""
    r = df.agg(*[F.corr(c, target).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    value = lambda i: -np.inf if r[i] is None or np.isnan(r[i]) else r[i]
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-value(i), i))]


def reorder(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The values of ``order`` under the names of ``columns``; an order found in training serves prediction."""
    return df.withColumns({c: F.col(o) for c, o in zip(columns, order, strict=True)})


def above_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each value is above its column's mean, null where it is null."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) > F.col(f"_m_{c}") for c in columns}).select(*df.columns)  # one row


def time_of_day_lookup(df: DataFrame, table: DataFrame, columns: Sequence[str], *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """What a table by time of day (seconds, in ``tod``) says of each row's time; null where it says nothing."""
    tod = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return df.withColumn("tod", tod).join(table.select(*by, "tod", *columns), [*by, "tod"], "left").drop("tod")
