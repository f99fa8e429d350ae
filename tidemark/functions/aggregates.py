"""Aggregates by name, and scalar functions that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)), "first": F.first, "last": F.last, "skew": F.skewness, "kurt": F.kurtosis,
}


def over(fn: str | Callable[[Column], Column], col: Column, window) -> Column:
    """A named aggregate over a window, or a function from the array of the frame's values to a column."""
    if isinstance(fn, str):
        return NAMED[fn](col).over(window)
    return fn(F.collect_list(col).over(window))


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by its Taylor series near 0 and the continued fraction of erfc beyond; within 1e-14."""
    x = np.asarray(x, "f8")
    a = np.abs(x)
    near = np.minimum(a, 3.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 90):
        term = -term * near**2 / n
        total = total + term / (2 * n + 1)
    far = np.maximum(a, 3.0)
    f = np.zeros_like(far)
    for k in range(60, 0, -1):
        f = (k / 2) / (far + f)
    tail = np.exp(-(far**2)) / (np.sqrt(np.pi) * (far + f))
    return np.sign(x) * np.where(a < 3.0, np.clip(total * 2 / np.sqrt(np.pi), 0, 1), 1 - tail)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x) / np.sqrt(2)))


def norm_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.asarray(x) ** 2 / 2) / np.sqrt(2 * np.pi)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Normal quantiles by bisection, then Newton; 0 and 1 give infinities."""
    p = np.asarray(p, "f8")
    lo, hi = np.full_like(p, -9.0), np.full_like(p, 9.0)
    for _ in range(40):
        mid = (lo + hi) / 2
        below = norm_cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    x = (lo + hi) / 2
    x = x - np.where(norm_pdf(x) > 1e-12, (norm_cdf(x) - p) / np.maximum(norm_pdf(x), 1e-12), 0)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def normal_crps(y, mu, sigma) -> np.ndarray:
    u = (y - mu) / sigma
    return sigma * (u * (2 * norm_cdf(u) - 1) + 2 * norm_pdf(u) - 1 / np.sqrt(np.pi))


def normal_nll(y, mu, sigma) -> np.ndarray:
    return 0.5 * np.log(2 * np.pi * sigma**2) + (y - mu) ** 2 / (2 * sigma**2)


def lognormal_crps(y, mean, var) -> np.ndarray:
    """From mean and variance of the variable itself; a negative variance means the distribution mirrored at 0."""
    y, mean, var = (np.asarray(v, "f8") for v in (y, mean, var))
    y, mean, v = np.where(var < 0, -y, y), np.where(var < 0, -mean, mean), np.abs(var)
    s2 = np.log1p(v / mean**2)
    mu, s = np.log(mean**2 / np.sqrt(v + mean**2)), np.sqrt(s2)
    w = (np.log(np.maximum(y, 1e-300)) - mu) / s
    return y * (2 * norm_cdf(w) - 1) - 2 * np.exp(mu + s2 / 2) * (norm_cdf(w - s) + norm_cdf(s / np.sqrt(2)) - 1)
