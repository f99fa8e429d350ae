"""Models that walk along a series: numpy kernels with an explicit state, applied by series or fed by a stream.

Every kernel is a pair: ``start(first value)`` gives a state, ``step(state, y)`` the next state and the forecasts from there. States are plain
lists, so that they go into a group state or a table as they are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _basis(period: int, harmonics: int, length: int) -> np.ndarray:
    t = np.arange(length)[:, None]
    k = np.arange(1, min(harmonics, period // 2) + 1)[None]
    waves = np.stack([np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)], 2).reshape(length, -1)
    return np.sqrt(2 / period) * np.hstack([np.full((length, 1), np.sqrt(0.5)), waves])


class HoltWinters:
    """Level, trend and two additive seasonalities. A missing value is replaced by the last one-step forecast."""

    def __init__(self, periods: Sequence[int] = (24, 168), steps: int = 24, alpha: float = 0.1, beta: float = 0.0, gammas: Sequence[float] = (0.1, 0.1), bounds: tuple[float, float] | None = None):
        self.periods, self.steps, self.alpha, self.beta, self.gammas, self.bounds = tuple(periods), steps, alpha, beta, tuple(gammas), bounds

    def start(self, y: float) -> dict:
        return {"a": 0.0, "b": 0.0, "s1": [y] * self.periods[0], "s2": [y] * self.periods[1], "f": y}

    def step(self, state: dict, y: float) -> tuple[dict, np.ndarray]:
        if not np.isfinite(y):
            y = state["f"]
        s1, s2, a0, b0 = state["s1"], state["s2"], state["a"], state["b"]
        a = self.alpha * (y - s1[0] - s2[0]) + (1 - self.alpha) * (a0 + b0)
        n1 = self.gammas[0] * (y - a - s2[0]) + (1 - self.gammas[0]) * s1[0]
        n2 = self.gammas[1] * (y - a - s1[0]) + (1 - self.gammas[1]) * s2[0]
        if self.bounds:
            n1, n2 = (min(max(v, self.bounds[0]), self.bounds[1]) for v in (n1, n2))
        b = self.beta * (a - a0) + (1 - self.beta) * b0
        s1, s2 = [*s1[1:], n1], [*s2[1:], n2]
        h = np.arange(self.steps)
        f = a + (h + 1) * b + np.array(s1)[h % len(s1)] + np.array(s2)[h % len(s2)]
        return {"a": a, "b": b, "s1": s1, "s2": s2, "f": float(f[0])}, f


class FourierSmoothing:
    """Exponentially smoothed Fourier coefficients of the last ``window`` values, and an error term that fades over the horizon."""

    def __init__(self, window: int = 48, harmonics: int = 8, steps: int = 24, alpha: float = 0.8, omega: float = 0.9, period: int = 24):
        self.m, self.steps, self.alpha, self.omega, self.period = window, steps, alpha, omega, period
        self.basis = _basis(window, harmonics, 2 * window + max(steps, period) + 1)

    def start(self, y: float) -> dict:
        x = np.zeros(self.basis.shape[1])
        x[0] = y * np.sqrt(self.m)
        return {"i": 0, "w": [0.0] * self.m, "x": x.tolist(), "eps": 0.0, "f": y}

    def smooth(self, state: dict, c: np.ndarray) -> tuple[np.ndarray, dict]:
        return self.alpha * c + (1 - self.alpha) * np.array(state["x"]), {}

    def step(self, state: dict, y: float) -> tuple[dict, np.ndarray]:
        if not np.isfinite(y):
            y = state["f"]
        i, w = state["i"], [*state["w"][1:], y]
        place = i % self.m
        c = self.basis[place : place + self.m].T @ np.array(w)
        x, more = self.smooth(state, c)
        at = place + self.m - self.period
        base = self.basis[at : at + self.steps] @ x
        eps = self.omega * (y - state["f"]) + (1 - self.omega) * state["eps"]
        f = base + eps * ((self.steps - np.arange(self.steps)) / self.steps) ** 2
        return {"i": i + 1, "w": w, "x": x.tolist(), "eps": eps, "f": float(f[0]), **more}, f


def kalman(x: np.ndarray, p: np.ndarray, z: np.ndarray, q: np.ndarray, r: np.ndarray, f: np.ndarray | None = None, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One predict and update step of a state that moves by f and is observed through h, both the identity unless given; the covariance in Joseph's form."""
    if f is not None:
        x, p = f @ x, f @ p @ f.T
    h = np.eye(len(x)) if h is None else h
    p = p + q
    k = p @ h.T @ np.linalg.pinv(h @ p @ h.T + r)
    keep = np.eye(len(x)) - k @ h
    return x + k @ (z - h @ x), keep @ p @ keep.T + k @ r @ k.T


class FourierKalman(FourierSmoothing):
    """Coefficients by a Kalman filter; every window the noise follows the correlation of the coefficients so far."""

    def __init__(self, *args, q: float = 0.1, r: float = 0.1, **kwargs):
        super().__init__(*args, **kwargs)
        self.q, self.r = q, r

    def start(self, y: float) -> dict:
        n = self.basis.shape[1]
        return super().start(y) | {"p": (1000.0 * np.eye(n)).tolist(), "q": (self.q * np.eye(n)).tolist(), "r": (self.r * np.eye(n)).tolist(), "n": 0, "sum": [0.0] * n, "sq": np.zeros((n, n)).tolist()}

    def smooth(self, state: dict, c: np.ndarray) -> tuple[np.ndarray, dict]:
        q, r = np.array(state["q"]), np.array(state["r"])
        x, p = kalman(np.array(state["x"]), np.array(state["p"]), c, q, r)
        n, total, square = state["n"] + 1, np.array(state["sum"]) + x, np.array(state["sq"]) + np.outer(x, x)
        if state["i"] >= self.m and state["i"] % self.m == 0:
            cov = square / n - np.outer(total, total) / n**2
            d = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            q = cov / np.outer(d, d)
            r = 0.01 * q
        return x, {"p": p.tolist(), "q": q.tolist(), "r": r.tolist(), "n": n, "sum": total.tolist(), "sq": square.tolist()}


class FourierKalmanMix:
    """Experts of growing windows; weights are the Kalman-tracked softmax of their normalised recent errors."""

    def __init__(self, experts: int = 3, window: int = 72, steps: int = 24, harmonics: int = 6, period: int = 24):
        self.steps = steps
        sizes = [max(int(s), steps, period) for s in np.linspace(1, window, experts)]
        self.experts = [FourierKalman(s, harmonics, steps, period=period) for s in sizes]

    def start(self, y: float) -> dict:
        n = len(self.experts)
        return {"e": [e.start(y) for e in self.experts], "past": [], "w": [1.0 / n] * n, "p": np.eye(n).tolist()}

    def step(self, state: dict, y: float) -> tuple[dict, np.ndarray]:
        states, fs = zip(*[e.step(s, y) for e, s in zip(self.experts, state["e"], strict=True)], strict=True)
        w, p, past, n = np.array(state["w"]), np.array(state["p"]), state["past"], len(self.experts)
        if len(past) >= self.steps and np.isfinite(y):
            err = np.array([np.mean([abs(past[-1 - s][e][s] - y) for s in range(self.steps)]) for e in range(n)])
            z = np.exp(-err / max(err.mean(), 1e-12))
            w, p = kalman(w, p, z / z.sum(), 0.01 * np.eye(n), 0.1 * np.eye(n))
            w = np.abs(w) / np.abs(w).sum()
        past = [*past[-self.steps + 1 :], [f.tolist() for f in fs]]
        return {"e": list(states), "past": past, "w": w.tolist(), "p": p.tolist()}, w @ np.array(fs)


class SimpleSmoothing:
    """Exponential smoothing with a damped additive trend."""

    def __init__(self, steps: int = 24, alpha: float = 0.3, beta: float = 0.05, phi: float = 0.95):
        self.steps, self.alpha, self.beta, self.phi = steps, alpha, beta, phi

    def start(self, y: float) -> dict:
        return {"l": y, "b": 0.0}

    def step(self, state: dict, y: float) -> tuple[dict, np.ndarray]:
        ahead = state["l"] + self.phi * state["b"]
        y = y if np.isfinite(y) else ahead
        level = self.alpha * y + (1 - self.alpha) * ahead
        b = self.beta * (level - state["l"]) + (1 - self.beta) * self.phi * state["b"]
        damp = np.cumsum(self.phi ** np.arange(1, self.steps + 1))
        return {"l": level, "b": b}, level + damp * b


def bands(models: Sequence, limits: Sequence[int]):
    """One model whose forecast steps up to limits[0] come from models[0], further ones from models[1] and so on."""

    class Banded:
        def start(self, y):
            return {"m": [m.start(y) for m in models]}

        def step(self, state, y):
            states, fs = zip(*[m.step(s, y) for m, s in zip(models, state["m"], strict=True)], strict=True)
            out, lo = [], 0
            for f, hi in zip(fs, limits, strict=True):
                out.append(f[lo:hi])
                lo = hi
            return {"m": list(states)}, np.concatenate(out)

    return Banded()


def walk(model, y: np.ndarray, state: dict | None = None) -> tuple[np.ndarray, dict]:
    """(forecasts of each row, last state)."""
    out = []
    for v in y:
        if state is None:
            state = model.start(float(v) if np.isfinite(v) else 0.0)
        state, f = model.step(state, float(v))
        out.append(f)
    return np.array(out), state


def forecast(df: DataFrame, model, *, y: str = "y", ts: str = "ts", by: Sequence[str] = ("name",)) -> DataFrame:
    """(by, ts, y, f array): every series walks in its own task; within one the steps depend on each other."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + f", {ts} timestamp, {y} double, f array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        f, _ = walk(model, pdf[y].to_numpy("f8"))
        return pdf[[*by, ts, y]].assign(f=list(f))

    return df.select(*by, ts, y).groupBy(*by).applyInPandas(run, schema)


def warmed(model: HoltWinters, y: np.ndarray, state: dict, *, repeats: int = 20) -> dict:
    """The state after the last long period has been walked again and again, so that what the start left in it has faded."""
    for _ in range(repeats):
        _, state = walk(model, y[-max(model.periods) :], state)
    return state


def residual_coefficients(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(covariates, steps): least squares of what the forecasts left over, each step by itself; rows without a whole truth or covariate take no part."""
    steps = f.shape[1]
    n = max(0, len(y) - steps)
    rest = np.stack([y[1 + h : 1 + h + n] for h in range(steps)], 1) - f[:n]
    use = np.isfinite(rest).all(1) & np.isfinite(x[:n]).all(1)
    return np.linalg.pinv(x[:n][use].T @ x[:n][use]) @ (x[:n][use].T @ rest[use])


def forecast_corrected(df: DataFrame, model: HoltWinters, features: Sequence[str], train: str, *, repeats: int = 20, y: str = "y", ts: str = "ts", by: Sequence[str] = ("name",)) -> DataFrame:
    """(by, ts, y, f array) of the rows whose boolean column ``train`` isn't true: Holt-Winters, and a regression of its residuals on the features.

    Every series fits on its own training rows in time's order, is warmed up with their last long period, and walks on with a steady trend. What is
    noise in that period is learned as its season: series of much noise forecast better with few repeats or none. A row with a null feature has the
    uncorrected forecast; a series without training rows starts at its first value and isn't corrected.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + f", `{ts}` timestamp, `{y}` double, f array<double>"
    steady = HoltWinters(model.periods, model.steps, model.alpha, 0.0, model.gammas, model.bounds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        old = pdf["_train"].fillna(False).to_numpy(bool)
        v, x = pdf[y].to_numpy("f8"), pdf[list(features)].to_numpy("f8")
        state, more = None, np.zeros((len(features), model.steps))
        if old.any():
            f, state = walk(model, v[old])
            more = residual_coefficients(f, v[old], x[old])
            state = warmed(model, v[old], state, repeats=repeats)
        if old.all():
            return pd.DataFrame(columns=[*by, ts, y, "f"])
        f, _ = walk(steady, v[~old], state)
        fix = x[~old] @ more
        f = f + np.where(np.isfinite(fix), fix, 0.0)
        return pdf.loc[~old, [*by, ts, y]].assign(f=list(f))

    own = list(dict.fromkeys([*by, ts, y, *features]))
    return df.select(*own, df[train].alias("_train")).groupBy(*by).applyInPandas(run, schema)


def tune(df: DataFrame, make, space: dict[str, tuple[float, float]], trials: int, *, y: str = "y", ts: str = "ts", by: Sequence[str] = ("name",), seed: int = 0) -> DataFrame:
    """(trial, parameters, mse): seeded uniform search; a trial's score is the squared one-step error on the last 30 % of each series, averaged
    over series. Trials and series are the parallelism."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(seed)
    drawn = [(i, json.dumps({k: float(rng.uniform(*v)) for k, v in space.items()})) for i in range(trials)]
    table = df.sparkSession.createDataFrame(drawn, "trial int, parameters string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        v = pdf[y].to_numpy("f8")
        f, _ = walk(make(**json.loads(pdf.parameters.iloc[0])), v)
        held = np.arange(len(v) - 1) >= int(0.7 * len(v))
        e = (f[:-1, 0] - v[1:])[held]
        return pd.DataFrame({"trial": [pdf.trial.iloc[0]], "parameters": [pdf.parameters.iloc[0]], "mse": [float(np.nanmean(e**2)) if np.isfinite(e).any() else np.nan]})

    each = df.crossJoin(F.broadcast(table)).groupBy("trial", *by).applyInPandas(run, "trial int, parameters string, mse double")  # a row for each trial, of a given number
    return each.groupBy("trial", "parameters").agg(F.avg("mse").alias("mse"))


def best(trials: DataFrame) -> dict[str, float]:
    """The parameters of the trial of least error."""
    from pyspark.sql import functions as F

    return json.loads(trials.agg(F.min_by("parameters", F.struct("mse", "trial"))).first()[0])
