"""Baselines, linear models, and uncertainty from residuals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

QUANTILES = (0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)


def persistent(df: DataFrame, col: str, steps: int) -> DataFrame:
    """(.., step, f): the value itself for each step ahead."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("f", F.col(col))


def seasonal_persistent(df: DataFrame, col: str, season: int, steps: int, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Step j ahead has the last value a whole number of seasons before it."""
    w = Window.partitionBy(*by).orderBy(ts)
    values = F.array(*[F.lag(col, -j % season).over(w) for j in range(1, steps + 1)])
    return df.withColumn("_v", values).select("*", F.posexplode("_v").alias("step", "f")).drop("_v").withColumn("step", F.col("step") + 1)


def truth_ahead(df: DataFrame, col: str, steps: int, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, step, y): the value so many rows later."""
    w = Window.partitionBy(*by).orderBy(ts)
    values = F.array(*[F.lead(col, j).over(w) for j in range(1, steps + 1)])
    return df.withColumn("_v", values).select(*by, ts, F.posexplode("_v").alias("step", "y")).withColumn("step", F.col("step") + 1)


def discrete_distribution(df: DataFrame, col: str, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """(by, tod, value, p): how often each value occurs at a time of day (seconds)."""
    tod = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    counts = df.groupBy(*by, tod.alias("tod"), F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "tod"))
    return counts.select(*by, "tod", "value", (F.col("n") / (total + 1e-12)).alias("p"))


def expected_value(p: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return p.groupBy(*by, "tod").agg(F.sum(F.col("value") * F.col("p")).alias("expected"))


def residual_quantiles(df: DataFrame, alphas: Sequence[float] = QUANTILES, *, by_hour: bool = True, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hour, step, alpha, e): exact quantiles of y - f. Unless all 24 hours occur, those of all rows stand for each hour."""
    e = df.withColumn("e", F.col("y") - F.col("f")).filter("e is not null")
    levels = F.array(*map(F.lit, alphas))
    pick = lambda d: d.select(*keys, "hour", "step", F.posexplode("_q").alias("_i", "e")).withColumn("alpha", F.element_at(levels, F.col("_i") + 1)).drop("_i")
    if by_hour and e.select(F.hour(ts)).distinct().count() == 24:
        return pick(exact_quantiles(e.withColumn("hour", F.hour(ts)), "e", alphas, by=[*keys, "hour", "step"]))
    whole = exact_quantiles(e, "e", alphas, by=[*keys, "step"])
    return pick(whole.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))


def with_quantiles(forecast: DataFrame, errors: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(.., step, alpha, q): the forecast and the error's quantile at its hour. The errors are 24 hours by steps by levels."""
    return forecast.withColumn("hour", F.hour(ts)).join(F.broadcast(errors) if not keys else errors, [*keys, "hour", "step"]).withColumn("q", F.col("f") + F.col("e"))


def pmf(quantiles: DataFrame, edges: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, bin, p): the share of a row's quantiles in each bin; the last is closed."""
    hit = F.sum(F.when((F.col("q") >= F.col("lo")) & ((F.col("q") < F.col("hi")) | ((F.col("bin") == len(edges) - 2) & (F.col("q") == F.col("hi")))), 1).otherwise(0))
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    return quantiles.withColumn("_b", F.explode(bins)).select("*", "_b.*").groupBy(*keys, "bin").agg((hit / F.count("*")).alias("p"))


def interpolate_quantiles(df: DataFrame, at: str, alphas: Sequence[float], qs: str, out: str) -> DataFrame:
    """The inverse distribution function at ``at``: linear between a row's quantiles (array ``qs``) and beyond the outer two."""
    x = F.array(*map(F.lit, alphas))
    k = F.least(F.greatest(F.size(F.filter(x, lambda a: a <= F.col(at))), F.lit(1)), F.lit(len(alphas) - 1))
    x0, x1, y0, y1 = F.element_at(x, k), F.element_at(x, k + 1), F.element_at(qs, k), F.element_at(qs, k + 1)
    return df.withColumn(out, y0 + (F.col(at) - x0) * (y1 - y0) / (x1 - x0))


@dataclass
class Linear:
    """coef[feature or 1][target]"""

    features: list[str]
    targets: list[str]
    coef: np.ndarray

    def predict(self, df: DataFrame, suffix: str = "_hat") -> DataFrame:
        """A projection; no join, no Python."""
        terms = [*map(F.col, self.features), F.lit(1.0)]
        return df.withColumns({t + suffix: sum((c * float(w) for c, w in zip(terms, self.coef[:, j], strict=True)), F.lit(0.0)) for j, t in enumerate(self.targets)})


def gram(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'Y and Y'Y's diagonal about the means, X's and Y's means, and the rows. One aggregate for the means, one for the sums of what is left of them, both
    with map-side sums: sums of the values themselves would lose what varies where the means are large. The means' own rounding is taken out at the end."""
    rows = df.dropna(subset=[*features, *targets])
    at = [v or 0.0 for v in rows.agg(*[F.avg(c) for c in [*features, *targets]]).first()]
    left = [F.col(c) - F.lit(float(m)) for c, m in zip([*features, *targets], at, strict=True)]
    x, y = left[: len(features)], left[len(features) :]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    r = [v or 0.0 for v in rows.agg(*[F.sum(c) for c in left], *[F.sum(x[i] * x[j]) for i, j in pairs], *[F.sum(a * b) for a in x for b in y], *[F.sum(b * b) for b in y], F.count("*")).first()]
    n = int(r[-1])
    off, sums = np.array(r[: len(left)]) / max(n, 1), r[len(left) : -1]
    xx = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, sums, strict=False):
        xx[i, j] = xx[j, i] = v
    rest = np.array(sums[len(pairs) :])
    xy, yy = rest[: len(x) * len(y)].reshape(len(x), len(y)), rest[len(x) * len(y) :]
    dx, dy = off[: len(x)], off[len(x) :]
    means = np.array(at) + off
    return xx - n * np.outer(dx, dx), xy - n * np.outer(dx, dy), yy - n * dy**2, means[: len(x)], means[len(x) :], n


def fit_linear(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> Linear:
    """Least squares on centred features, each in units of its own deviation; one that doesn't vary beyond its mean's rounding has no weight."""
    xx, xy, _, mx, my, n = gram(df, features, targets)
    left = np.diag(xx)
    unit = np.where(left > n * (1e-14 * mx) ** 2, np.sqrt(np.maximum(left, 0)), np.inf)
    w = np.linalg.lstsq(xx / unit[:, None] / unit, xy / unit[:, None], rcond=1e-12)[0] / unit[:, None]
    return Linear(list(features), list(targets), np.vstack([w, my - mx @ w]))


def fit_ridge(df: DataFrame, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float] = tuple(10.0 ** np.linspace(-2, 8, 9))) -> Linear:
    """Ridge on centred data; the penalty is that of the least generalised cross-validation error, over all targets."""
    a, b, c, mx, my, n = gram(df, features, targets)
    values, vectors = np.linalg.eigh(a)
    values, turned = np.maximum(values, 0), vectors.T @ b
    best = None
    for alpha in alphas:
        w = turned / (values + alpha)[:, None]
        left = (c - 2 * (turned * w).sum(0) + (values[:, None] * w**2).sum(0)).clip(0).sum()
        gcv = left / max(1e-12, (n - 1 - (values / (values + alpha)).sum())) ** 2
        if best is None or gcv < best[0]:
            best = (gcv, vectors @ w)
    w = best[1]
    return Linear(list(features), list(targets), np.vstack([w, my - mx @ w]))
