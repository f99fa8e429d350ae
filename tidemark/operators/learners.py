"""Trees, forests, boosting, random features and small networks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import norm_cdf, norm_ppf
from ..sources.storage import written
from .forecasts import Linear, fit_linear
from .quantiles import exact_quantiles


def _vector(df: DataFrame, features: Sequence[str | Column], label: str | None = None) -> DataFrame:
    """Column _x of the features, and _ok: whether none of them is null; where one is, _x has a 0 in its place. With a label, the rows to
    learn from: those without nulls."""
    cols = [F.col(f) if isinstance(f, str) else f for f in features]
    ok = reduce(and_, [c.isNotNull() for c in cols], F.lit(True))
    out = df.withColumn("_ok", ok).withColumn("_x", array_to_vector(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])))
    return out if label is None else out.filter("_ok").filter(F.col(label).isNotNull())


def _predicted(model, df: DataFrame, features: Sequence[str | Column], out: str) -> DataFrame:
    """The frame and the model's prediction; null, in a row that stays, where a feature is."""
    made = model.setPredictionCol("_p").setFeaturesCol("_x").transform(_vector(df, features))
    return made.withColumn(out, F.when(F.col("_ok"), F.col("_p"))).drop("_x", "_ok", "_p")


@dataclass
class Boosted:
    """One boosted model a target."""

    features: dict[str, list[str]]
    models: dict[str, object]

    def predict(self, df: DataFrame, suffix: str = "_hat", instead: dict[str, Column] | None = None) -> DataFrame:
        """Each target's column with the suffix; ``instead`` gives features other values than the frame's."""
        for t, m in self.models.items():
            df = _predicted(m, df, [(instead or {}).get(f, f) for f in self.features[t]], t + suffix)
        return df


def fit_boosted(df: DataFrame, features: Sequence[str] | dict[str, Sequence[str]], targets: Sequence[str], *, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 0) -> Boosted:
    """features may differ by target, as pruned features do."""
    own = {t: list(features[t] if isinstance(features, dict) else features) for t in targets}
    models = {t: GBTRegressor(featuresCol="_x", labelCol=t, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(_vector(df, own[t], t)) for t in targets}
    return Boosted(own, models)


@dataclass
class Hybrid:
    """The first steps have a model each; one model with the step as a feature serves all others."""

    near: Boosted
    far: object
    features: list[str]
    targets: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """The frame and step, f: a row for each step."""
        keys = df.columns
        n = len(self.near.models)
        wide = self.near.predict(df)
        near = wide.select(*keys, F.posexplode(F.array(*[F.col(f"{t}_hat") for t in self.near.models])).alias("step", "f")) if n else None
        far = df.withColumn("step", F.explode(F.sequence(F.lit(n), F.lit(len(self.targets) - 1))))
        out = _predicted(self.far, far, [*self.features, "step"], "f").select(*keys, "step", "f")
        return (near.unionByName(out) if near is not None else out).withColumn("step", (F.col("step") + 1).cast("int"))


def fit_hybrid(df: DataFrame, features: Sequence[str], targets: Sequence[str], n_single: int, *, pruned: dict[str, Sequence[str]] | None = None, share: float = 1.0, seed: int = 0, **kw) -> Hybrid:
    near = fit_boosted(df, pruned or features, targets[:n_single], seed=seed, **kw)
    stacked = df.select(*features, F.posexplode(F.array(*map(F.col, targets))).alias("step", "_y")).filter(F.col("step") >= n_single).dropna(subset=["_y"])
    if share < 1:
        stacked = stacked.sample(withReplacement=True, fraction=share, seed=seed)
    far = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=kw.get("trees", 20), maxDepth=kw.get("depth", 4), stepSize=kw.get("rate", 0.1), seed=seed).fit(_vector(stacked, [*features, "step"], "_y"))
    return Hybrid(near, far, list(features), list(targets))


@dataclass
class EnergyAware:
    """Sequential boosted steps; each knows the cumulated difference between the prediction so far and the one with the control columns at zero."""

    steps: list[tuple[str, Boosted]]
    controls: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """A step's two predictions are of one row, with its own controls and with none: no join, and no row is lost."""
        out = df.withColumn("_energy", F.lit(0.0))
        for t, m in self.steps:
            out = self._step(out, t, m)
        return out.select(*df.columns, *[f"{t}_hat" for t, _ in self.steps])

    def _step(self, df: DataFrame, t: str, m: Boosted) -> DataFrame:
        out = m.predict(m.predict(df), "_free", {c: F.lit(0.0) for c in self.controls})
        return out.withColumn("_energy", F.col("_energy") + F.col(f"{t}_hat") - F.col(f"{t}_free")).drop(f"{t}_free")


def fit_energy_aware(df: DataFrame, features: Sequence[str], targets: Sequence[str], controls: Sequence[str], **kw) -> EnergyAware:
    model, now = EnergyAware([], list(controls)), df.withColumn("_energy", F.lit(0.0))
    for t in targets:
        model.steps.append((t, fit_boosted(now, [*features, "_energy"], [t], **kw)))
        now = written(model._step(now, *model.steps[-1]).select(*df.columns, "_energy"), "energy")
    return model


@dataclass
class QuantileForest:
    """A forest whose prediction is a distribution: training rows weigh in by the leaves they share with a row."""

    model: object
    features: list[str]
    leaves: DataFrame

    def predict(self, df: DataFrame, alphas: Sequence[float] | None, keys: Sequence[str]) -> DataFrame:
        """(keys, alpha, q), or (keys, f) without levels: the mean. Rows with a null feature have null quantiles."""
        lost = _vector(df, self.features).filter("not _ok").select(*keys)
        at = _leaves(self.model, df, self.features, keys)
        n_trees = self.model.getNumTrees
        w = at.join(self.leaves, ["tree", "leaf"]).groupBy(*keys, "y").agg(F.sum(F.col("w") / n_trees).alias("w"))
        if alphas is None:
            return w.groupBy(*keys).agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("f")).unionByName(lost.withColumn("f", F.lit(None).cast("double")))
        c = w.withColumn("c", F.sum("w").over(Window.partitionBy(*keys).orderBy("y")))
        levels = F.array(*[F.struct(F.lit(i).alias("i"), F.min(F.when(F.col("c") >= a - 1e-9, F.col("y"))).alias("q")) for i, a in enumerate(alphas)])
        out = c.groupBy(*keys).agg(levels.alias("_q")).select(*keys, F.explode("_q").alias("_q"))
        made = out.select(*keys, F.element_at(F.array(*map(F.lit, alphas)), F.col("_q.i") + 1).alias("alpha"), F.col("_q.q").alias("q"))
        return made.unionByName(lost.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("q", F.lit(None).cast("double")))


def _leaves(model, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.setFeaturesCol("_x").setLeafCol("_leaf").setPredictionCol("_p").transform(_vector(df, features).filter("_ok"))
    return out.select(*keys, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))


def fit_quantile_forest(df: DataFrame, features: Sequence[str], target: str, *, trees: int = 20, depth: int = 6, least: int = 5, seed: int = 0) -> QuantileForest:
    rows = df.dropna(subset=[*features, target])
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(_vector(rows, features, target))
    members = _leaves(model, rows, features, [target]).groupBy("tree", "leaf", F.col(target).alias("y")).agg(F.count("*").alias("n"))
    leaves = written(members.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("tree", "leaf"))).select("tree", "leaf", "y", "w"), "leaves")
    return QuantileForest(model, list(features), leaves)


@dataclass
class RandomFeatures:
    """Linear regression on cos(x W + b), x standardised; orthogonal blocks on demand."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    linear: Linear | None = None

    def project(self, df: DataFrame) -> DataFrame:
        """JVM expressions: each feature is one cosine of a linear form."""
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return df.withColumns({f"_rff{j}": F.cos(sum((x * float(self.w[i, j]) for i, x in enumerate(z)), F.lit(float(self.b[j])))) for j in range(self.w.shape[1])})

    def predict(self, df: DataFrame, suffix: str = "_hat") -> DataFrame:
        out = self.linear.predict(self.project(df), suffix)
        return out.select(*df.columns, *[t + suffix for t in self.linear.targets])


def fit_random_features(df: DataFrame, features: Sequence[str], targets: Sequence[str], *, n: int = 24, std: float = 1.0, kind: str = "rff", seed: int = 0) -> RandomFeatures:
    r = df.agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array([x or 0.0 for x in r[::2]]), np.array([x or 1.0 for x in r[1::2]])
    rng, d = np.random.default_rng(seed), len(features)
    if kind == "orf":
        blocks = [np.linalg.qr(rng.standard_normal((d, d)))[0] * np.sqrt(rng.chisquare(d, d)) for _ in range(-(-n // d))]
        w = std * np.hstack(blocks)[:, :n]
    else:
        w = std * rng.standard_normal((d, n))
    model = RandomFeatures(list(features), mean, scale, w, rng.uniform(0, 2 * math.pi, n))
    model.linear = fit_linear(model.project(df), [f"_rff{j}" for j in range(n)], targets)
    return model


def fit_additive(df: DataFrame, features: Sequence[str], target: str, *, rounds: int = 3, rate: float = 0.7, **kw) -> list[RandomFeatures]:
    """Boosting: each round learns what the ones before left over."""
    out, left = [], df.withColumn("_left", F.col(target))
    for k in range(rounds):
        m = fit_random_features(left, features, ["_left"], seed=k, **kw)
        out.append(m)
        left = m.predict(left).withColumn("_left", F.col("_left") - rate * F.col("_left_hat")).drop("_left_hat")
    return out


def predict_additive(df: DataFrame, models: Sequence[RandomFeatures], out: str, *, rate: float = 0.7) -> DataFrame:
    now = df.withColumn(out, F.lit(0.0))
    for m in models:
        now = m.predict(now).withColumn(out, F.col(out) + rate * F.col("_left_hat")).drop("_left_hat")
    return now


@dataclass
class Binned:
    """Boosted step functions of one feature each: (feature, cuts, means)."""

    rate: float
    start: float
    steps: list[tuple[str, list[float], list[float]]] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        f = F.lit(self.start)
        for c, cuts, means in self.steps:
            f = f + self.rate * F.element_at(F.array(*map(F.lit, means)), _bin(c, cuts) + 1)
        return df.withColumn(out, f)


def _bin(col: str, cuts: Sequence[float]):
    return sum((F.when(F.col(col) > c, 1).otherwise(0) for c in cuts), F.lit(0))


def fit_binned(df: DataFrame, features: Sequence[str], target: str, *, rounds: int = 5, bins: int = 10, rate: float = 0.5) -> Binned:
    """Every round takes the feature whose binned means of the residual explain most; one aggregate a round, for all features."""
    rows = df.select(*features, target).dropna()
    rows = written(rows, "binned")
    cuts = {c: sorted(set(exact_quantiles(rows, c, [i / bins for i in range(1, bins)]).first()["_q"] or [])) for c in features}
    model = Binned(rate, float(rows.agg(F.avg(target)).first()[0] or 0.0))
    for _ in range(rounds):
        r = model.predict(rows, "_f").withColumn("_r", F.col(target) - F.col("_f"))
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _bin(c, cuts[c]).alias("b")) for c in features]))
        sums = r.select("_r", cells.alias("x")).groupBy("x.c", "x.b").agg(F.sum("_r").alias("s"), F.count("*").alias("n")).collect()  # features by bins
        gain = {c: sum(x.s**2 / x.n for x in sums if x.c == c) for c in features}
        best = max(features, key=lambda c: gain[c])
        mean = {x.b: x.s / x.n for x in sums if x.c == best}
        model.steps.append((best, cuts[best], [float(mean.get(b, 0.0)) for b in range(len(cuts[best]) + 1)]))
    return model


def bootstrap(df: DataFrame, col: str, statistic: Callable[[np.ndarray], float], n: int, *, by: Sequence[str], seed: int = 0) -> DataFrame:
    """(by, mean, std) of a statistic over n resamples with replacement; a group's seed is its own."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", mean double, std double, n long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[col].dropna().to_numpy("f8"))
        rng = np.random.default_rng([seed, len(x)])
        s = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)]) if len(x) else np.array([np.nan])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), float(s.mean()), float(s.std()), len(x)]], columns=[*by, "mean", "std", "n"])

    return df.select(*by, col).groupBy(*by).applyInPandas(run, schema)


def resamples(n: int) -> int:
    """The largest checkpoint of 100, 600, 1100, ... below n: as many resamples count."""
    return 100 + 500 * max(0, (n - 101) // 500)


def bootstrap_mean(df: DataFrame, col: str, n: int, *, by: Sequence[str], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """(by, mean, std, n): of the mean over ``resamples(n)`` Poisson resamples, in which a row counts as often as a hash of its keys says. Each partition sums
    weights and weighted values of all resamples, so that a group may be of any size; rows of null value take no part."""
    b = resamples(n)
    own = df.filter(F.col(col).isNotNull()).select(*by, F.xxhash64(*keys, F.lit(seed)).alias("_h"), F.col(col).cast("double").alias("_v"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    salts = np.arange(1, b + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", w array<double>, s array<double>, n long"

    def sums(frames):
        held: dict = {}
        for pdf in frames:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = part["_h"].to_numpy("i8").view("u8")[:, None] ^ salts
                for shift, prime in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(prime)
                w = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right").astype("f8")
                v = part["_v"].to_numpy("f8")
                for g, rows in part.groupby(list(by), dropna=False).indices.items():
                    total = held.setdefault(g if isinstance(g, tuple) else (g,), [np.zeros(b), np.zeros(b), 0])
                    total[0] += w[rows].sum(0)
                    total[1] += v[rows] @ w[rows]
                    total[2] += len(rows)
        yield pd.DataFrame([[*g, w.tolist(), s.tolist(), m] for g, (w, s, m) in held.items()], columns=[*by, "w", "s", "n"])

    parts = own.mapInPandas(sums, schema)
    each = parts.select(*by, "n", F.posexplode(F.arrays_zip("w", "s")).alias("_i", "_x"))
    total = each.groupBy(*by, "_i").agg(F.sum("_x.w").alias("w"), F.sum("_x.s").alias("s"), F.sum("n").alias("n"))
    means = total.withColumn("_m", F.try_divide("s", "w"))  # of the resamples that hold a row of the group
    return means.groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"), F.max("n").alias("n"))


def qq(x: np.ndarray, n: int = 30) -> pd.DataFrame:
    """(alpha, normal, away): how far quantiles of x are from the standard normal's."""
    alphas = np.linspace(0.01, 0.99, n)
    normal = norm_ppf(alphas)
    return pd.DataFrame({"alpha": alphas, "normal": normal, "away": np.quantile(x, alphas) - normal})


def top_frequencies(df: DataFrame, col: str, n: int, *, ts: str = "ts", by: Sequence[str] = ("name",)) -> DataFrame:
    """(by, rank, frequency): the n bins of largest FFT magnitude in the first half of the spectrum, the mean's too, counted from 1, in ascending order."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", rank int, frequency int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[col].fillna(0).to_numpy("f8")
        mag = np.abs(np.fft.fft(x))[: max(1, len(x) // 2)]
        top = np.sort(np.argsort(-mag, kind="stable")[:n]) + 1
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(top) for c in by}, "rank": np.arange(1, len(top) + 1, dtype="i4"), "frequency": top.astype("i4")})

    return df.select(*by, ts, col).groupBy(*by).applyInPandas(run, schema)


@dataclass
class Network:
    """A feed-forward network of one hidden layer; with any loss but squares it gives mean and spread, lognormal those of the logarithm."""

    params: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    y_mean: float
    y_scale: float
    loss: str = "squares"

    def forward(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def predict(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """f, and sigma where the network was learned by likelihood."""

        @F.pandas_udf("struct<f: double, sigma: double>")
        def apply(*cols: pd.Series) -> pd.DataFrame:
            o = self.forward(np.column_stack([c.to_numpy("f8") for c in cols]))
            sigma = np.exp(np.clip(o[:, 1], -6, 6)) * self.y_scale if o.shape[1] > 1 else np.zeros(len(o))
            f = o[:, 0] * self.y_scale + self.y_mean
            return pd.DataFrame({"f": np.exp(f + sigma**2 / 2) if self.loss == "lognormal" else f, "sigma": sigma})

        return df.withColumn("_o", apply(*features)).select(*df.columns, "_o.*")


def _slopes(net: Network, loss: str, xb: np.ndarray, yb: np.ndarray):
    """(mean loss, its gradients). squares; normal: likelihood of a mean and a log spread; crps: the normal's; lognormal: the normal's likelihood of log y."""
    w1, b1, w2, b2 = net.params
    z = (yb - net.y_mean) / net.y_scale
    a = (xb - net.mean) / net.scale
    h = np.maximum(a @ w1 + b1, 0)
    o = h @ w2 + b2
    if loss == "squares":
        e = o[:, 0] - z
        value, go = float((e**2).mean()), 2 * e[:, None] / len(xb)
    else:
        s = np.exp(np.clip(o[:, 1], -6, 6))
        e = (o[:, 0] - z) / s
        if loss == "crps":
            cdf, pdf = norm_cdf(-e), np.exp(-(e**2) / 2) / math.sqrt(2 * math.pi)
            value = float((s * (-e * (2 * cdf - 1) + 2 * pdf - 1 / math.sqrt(math.pi))).mean())
            go = np.stack([1 - 2 * cdf, s * (2 * pdf - 1 / math.sqrt(math.pi))], 1) / len(xb)
        else:
            value, go = float((0.5 * e**2 + np.log(s)).mean()), np.stack([e / s, 1 - e**2], 1) / len(xb)
    gh = (go @ w2.T) * (h > 0)
    return value, [a.T @ gh, gh.sum(0), h.T @ go, go.sum(0)]


def fit_network(df: DataFrame, features: Sequence[str], target: str, *, hidden: int = 16, epochs: int = 60, rate: float = 0.01, loss: str = "squares", patience: int = 8, seed: int = 0) -> Network:
    """All rows take part: in each epoch every partition walks its rows in mini-batches by AdamW from the same parameters, and the parameters it
    comes to are averaged, weighed by rows. Early stopping on the tenth of the rows that a hash keeps out. A job an epoch; a partition sends its
    parameters, never rows."""
    y = F.log(F.greatest(F.col(target), F.lit(1e-6))) if loss == "lognormal" else F.col(target).cast("double")
    rows = df.select(*features, y.alias("_y")).dropna()
    rows = written(rows.withColumn("_held", F.pmod(F.xxhash64(*features, "_y"), F.lit(10)) == 0), "rows")
    moments = rows.agg(*[f(c) for c in (*features, "_y") for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([v or 0.0 for v in moments[k::2]]) for k in (0, 1))
    rng, outs = np.random.default_rng(seed), 1 if loss == "squares" else 2
    d = len(features)
    net = Network([rng.normal(size=(d, hidden)) * math.sqrt(2 / max(1, d)), np.zeros(hidden), rng.normal(size=(hidden, outs)) * math.sqrt(1 / hidden), np.zeros(outs)], mean[:-1], scale[:-1] + 1e-9, float(mean[-1]), float(scale[-1]) + 1e-9, loss)
    best, since = (np.inf, net.params), 0
    for epoch in range(epochs):
        own, made = net, []

        def walk(frames, own=own, epoch=epoch):
            """One partition's epoch, a batch of rows in memory at a time."""
            at = Network([p.copy() for p in own.params], own.mean, own.scale, own.y_mean, own.y_scale, own.loss)
            m1, m2, t, seen, held, total = [np.zeros_like(p) for p in at.params], [np.zeros_like(p) for p in at.params], 0, 0, 0, 0.0
            for pdf in frames:
                x, y, out = pdf[list(features)].to_numpy("f8"), pdf["_y"].to_numpy("f8"), pdf["_held"].to_numpy(bool)
                if out.any():  # of the parameters that the epoch began with
                    total, held = total + _slopes(own, own.loss, x[out], y[out])[0] * out.sum(), held + int(out.sum())
                order = np.random.default_rng([seed, epoch, seen]).permutation(np.flatnonzero(~out))
                seen += len(order)
                for k in range(0, len(order), 256):
                    _, g = _slopes(at, own.loss, x[order[k : k + 256]], y[order[k : k + 256]])
                    t += 1
                    for i, gi in enumerate(g):
                        m1[i], m2[i] = 0.9 * m1[i] + 0.1 * gi, 0.999 * m2[i] + 0.001 * gi**2
                        at.params[i] = at.params[i] * (1 - rate * 1e-4) - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
            yield pd.DataFrame({"p": [np.concatenate([p.ravel() for p in at.params]).tolist()], "n": [seen], "held": [held], "loss": [total]})

        made = rows.mapInPandas(walk, "p array<double>, n long, held long, loss double").collect()  # a row of parameters a partition
        held = sum(r.held for r in made)
        value = sum(r.loss for r in made) / held if held else -float(epoch)  # without held rows the last epoch counts
        if value < best[0] - 1e-5 or best[0] == np.inf:
            best, since = (value, net.params), 0
        elif (since := since + 1) >= patience:
            break
        flat = sum(np.array(r.p) * r.n for r in made) / max(1, sum(r.n for r in made))
        params, at = [], 0
        for p in net.params:
            params.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        net = Network(params, net.mean, net.scale, net.y_mean, net.y_scale, loss)
    net.params = best[1]
    return net


def optimize_inputs(net: Network, x: np.ndarray, free: Sequence[int], *, steps: int = 100, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Inputs at positions ``free`` moved down the network's output, from x; (inputs, output there)."""
    x = x.astype("f8").copy()
    w1, b1, w2, _ = net.params
    for _ in range(steps):
        h = (x - net.mean) / net.scale @ w1 + b1
        g = ((h > 0) * w2[:, 0]) @ w1.T / net.scale
        x[:, free] -= rate * net.scale[free] * g[:, free] * net.scale[free]
    return x, net.forward(x)[:, 0] * net.y_scale + net.y_mean


def search(df: DataFrame, fit: Callable[[DataFrame, dict], object], loss: Callable[[object, DataFrame], float], space: dict[str, tuple[float, float]], folds: Sequence, *, trials: int = 5, seed: int = 0, workers: int = 4) -> pd.DataFrame:
    """One row a trial and fold: parameters drawn at random, fitted on train, scored on test. Trials are Spark jobs side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from .splits import assign_folds

    rng = np.random.default_rng(seed)
    drawn = [{k: float(rng.uniform(*v)) for k, v in space.items()} for _ in range(trials)]
    dealt = written(assign_folds(df, folds), "folds")

    def run(job):
        i, f = job
        own = dealt.filter(F.col("fold") == f.fold)
        model = fit(own.filter("role = 'train'"), drawn[i])
        return {"trial": i, "fold": f.fold, "score": loss(model, own.filter("role = 'test'")), **drawn[i]}

    with ThreadPoolExecutor(workers) as pool:
        return pd.DataFrame(list(pool.map(run, [(i, f) for i in range(trials) for f in folds])))


def summarize_trials(trials: pd.DataFrame) -> pd.DataFrame:
    """(trial, score, std, rank): dense ranks, best first."""
    out = trials.groupby("trial").score.agg(["mean", "std"]).rename(columns={"mean": "score"}).reset_index()
    out["rank"] = out.score.rank(method="dense").astype(int)
    return out
