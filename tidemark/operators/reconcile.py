"""Hierarchical reconciliation: forecasts of all nodes of a tree made to add up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scenarios import glasso
from .splits import place


@dataclass
class Hierarchy:
    """``children``: of each aggregate; names that are no key are bottom series."""

    children: dict[str, Sequence[str]]

    def leaves(self, node: str) -> list[str]:
        if node not in self.children:
            return [node]
        return list(dict.fromkeys(x for c in self.children[node] for x in self.leaves(c)))

    @property
    def bottoms(self) -> list[str]:
        return sorted({x for n in self.children for x in self.leaves(n)})

    @property
    def nodes(self) -> list[str]:
        return [*self.children, *self.bottoms]

    def levels(self) -> dict[str, int]:
        """Breadth first from the node of most leaves."""
        root = max(self.children, key=lambda n: len(self.leaves(n)))
        out, queue = {root: 0}, [root]
        for n in queue:
            for c in self.children.get(n, ()):
                if c not in out:
                    out[c] = out[n] + 1
                    queue.append(c)
        return out

    def summing(self) -> np.ndarray:
        """Rows: all nodes; columns: bottoms; 1 where the bottom is under the node."""
        column = {b: j for j, b in enumerate(self.bottoms)}
        s = np.zeros((len(self.nodes), len(column)))
        for i, n in enumerate(self.nodes):
            s[i, [column[b] for b in self.leaves(n)]] = 1
        return s


def shrunk(s: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    return (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))


def shrunk_covariance(e: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    return shrunk(np.atleast_2d(np.cov(e, rowvar=False, ddof=0)), shrinkage)


def projection(h: Hierarchy, method: str = "ols", covariance: np.ndarray | None = None) -> np.ndarray:
    """The matrix that takes the nodes' forecasts to reconciled ones, S P, from the errors' covariance. ols; mint: weighted by the precision of the shrunk
    covariance, mint_glasso: of the sparse one; bayes: the bottoms conditioned on what is known of the aggregates, each with a shrunk covariance
    of its own; a single aggregate is known as well as its errors' deviation says."""
    s = h.summing()
    n_up = len(h.children)
    if method == "bayes":
        a = s[:n_up]
        low = shrunk(covariance[n_up:, n_up:])
        top = np.sqrt(covariance[:1, :1]) if n_up < 2 else shrunk(covariance[:n_up, :n_up])
        g = low @ a.T @ np.linalg.pinv(top + a @ low @ a.T)
        return s @ np.hstack([g, np.eye(s.shape[1]) - g @ a])
    w = np.eye(len(s)) if method == "ols" else np.linalg.pinv(glasso(covariance, 0.1 * float(np.abs(covariance - np.diag(np.diag(covariance))).max())) if method == "mint_glasso" else shrunk(covariance))
    return s @ np.linalg.solve(s.T @ w @ s, s.T @ w)


def error_moments(errors: DataFrame, h: Hierarchy, *, step: str = "step") -> dict[int, np.ndarray]:
    """Covariance of the nodes' errors at each step, from sums: nodes squared numbers a step reach the driver."""
    wide = errors.groupBy("ts", step).pivot("name", h.nodes).agg(F.first("e"))
    cols = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in h.nodes]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = {}
    for r in wide.groupBy(step).agg(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).collect():
        c = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, r[1:], strict=True):
            c[i, j] = c[j, i] = v or 0.0
        out[r[0]] = c
    return out


def reconcile(forecasts: DataFrame, h: Hierarchy, matrices: np.ndarray | dict[int, np.ndarray], *, keys: Sequence[str] = ("ts", "step"), step: str = "step") -> DataFrame:
    """(keys, name, f) made coherent: a pivot and a linear combination of columns; steps may have matrices of their own."""
    wide = forecasts.groupBy(*keys).pivot("name", h.nodes).agg(F.first("f"))
    cols = [F.col(f"`{n}`") for n in h.nodes]
    combine = lambda m, i: sum((c * float(m[i, j]) for j, c in enumerate(cols) if m[i, j]), F.lit(0.0))
    made = {}
    for i, n in enumerate(h.nodes):
        if isinstance(matrices, dict):
            c = None
            for k, m in matrices.items():
                c = F.when(F.col(step) == k, combine(m, i)) if c is None else c.when(F.col(step) == k, combine(m, i))
        else:
            c = combine(matrices, i)
        made[n] = c
    return wide.select(*keys, *[c.alias(n) for n, c in made.items()]).unpivot(list(keys), h.nodes, "name", "f")


def bootstrap_scenarios(forecasts: DataFrame, errors: DataFrame, n: int, *, seed: int = 0, ts: str = "ts") -> DataFrame:
    """(.., scenario, f): forecasts plus whole rows of training errors of the same hour, drawn by the digest of (ts, scenario, seed).

    errors: (ts, name, step, e). A row's errors stay together over names and steps. The rank of an error row within its hour is the join key."""
    from pyspark.sql import Window

    hours = errors.select(ts).distinct().withColumn("hour", F.hour(ts))
    ranked = hours.select("hour", F.col(ts).alias("_from"), F.row_number().over(Window.partitionBy("hour").orderBy(ts)).alias("_k"))
    counts = hours.groupBy("hour").agg(F.count("*").alias("_n"))
    times = forecasts.select(ts).distinct().withColumn("hour", F.hour(ts)).join(F.broadcast(counts), "hour")  # 24 rows
    drawn = times.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_k", (F.pmod(place(F.unix_micros(ts), F.col("scenario"), F.lit(seed)), F.col("_n")) + 1).cast("int"))
    rows = drawn.join(ranked, ["hour", "_k"]).select(ts, "scenario", "_from")
    e = errors.select(F.col(ts).alias("_from"), "name", "step", "e")
    return forecasts.join(rows, ts).join(e, ["_from", "name", "step"]).withColumn("f", F.col("f") + F.col("e")).drop("_from", "e")


def scenario_quantiles(scenarios: DataFrame, alphas: Sequence[float], keys: Sequence[str] = ("ts", "name", "step")) -> DataFrame:
    levels = F.array(*map(F.lit, alphas))
    return scenarios.groupBy(*keys).agg(F.percentile("f", levels).alias("_q")).select(*keys, F.posexplode("_q").alias("_i", "q")).withColumn("alpha", F.element_at(levels, F.col("_i") + 1)).drop("_i")
