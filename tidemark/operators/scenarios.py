"""Scenarios from quantiles by a Gaussian copula, and their reduction to trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import norm_cdf


def glasso(cov: np.ndarray, alpha: float, *, rounds: int = 300, rho: float = 1.0) -> np.ndarray:
    """The covariance whose inverse is sparse: minimises tr(S X) - log det X + alpha |off-diagonal X|, by the alternating direction method of multipliers."""
    scale = float(np.trace(cov)) / len(cov) or 1.0  # steps are of the size of a unit variance
    s, alpha = cov / scale, alpha / scale
    z, u = np.eye(len(s)), np.zeros_like(s)
    for _ in range(rounds):
        values, vectors = np.linalg.eigh(rho * (z - u) - s)
        x = (vectors * ((values + np.sqrt(values**2 + 4 * rho)) / (2 * rho))) @ vectors.T
        was, z = z, x + u
        z = np.sign(z) * np.maximum(np.abs(z) - alpha / rho, 0)
        np.fill_diagonal(z, np.diag(x + u))
        u = u + x - z
        if np.abs(z - was).max() < 1e-9 and np.abs(x - z).max() < 1e-9:
            break
    return np.linalg.inv(x) * scale


def glasso_alpha(folds: Sequence[tuple[int, np.ndarray]], alphas: Sequence[float] = tuple(10.0 ** np.linspace(-2, 0, 7))) -> float:
    """The penalty, in units of the largest covariance off the diagonal, under which folds that were kept out are likeliest. folds: (rows, covariance)."""
    total = sum(n for n, _ in folds)
    whole = sum(n * c for n, c in folds) / total
    most = float(np.abs(whole - np.diag(np.diag(whole))).max()) or 1.0

    def loss(a: float) -> float:
        out = 0.0
        for n, c in folds:
            if total > n:
                p = np.linalg.inv(glasso((whole * total - n * c) / (total - n), a * most))
                out += n * (np.trace(c @ p) - np.linalg.slogdet(p)[1])
        return out

    return min(alphas, key=loss) * most


def hourly_correlation(df: DataFrame, cols: Sequence[str], *, ts: str = "ts", method: str = "vanilla", alpha: float = 0.01) -> DataFrame:
    """(hour, i, j, r) by the errors' sums; the matrices are as many as the hours. A constant column correlates with nothing.

    vanilla: Pearson's, 1e-6 added to the diagonal; shrunk: 0.9 cov + 0.1 mean variance I over the outer product of deviations; glasso: the sparse inverse's
    covariance over the same, with penalty ``alpha``; glasso_cv: with the one that cross-validation finds in the hour of most rows.
    """
    n = len(cols)
    if method in ("glasso", "glasso_cv"):
        return _sparse(df, cols, ts, alpha, method == "glasso_cv")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    aggs = [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]
    wide = df.groupBy(F.hour(ts).alias("hour")).agg(*aggs)
    mean_var = sum((F.col(f"c{i}_{i}") for i in range(n)), F.lit(0.0)) / n
    c = lambda i, j: F.col(f"c{i}_{j}") if method == "vanilla" else 0.9 * F.col(f"c{i}_{j}") + (0.1 * mean_var if i == j else F.lit(0.0))
    r = lambda i, j: F.try_divide(c(i, j), F.sqrt(F.col(f"c{i}_{i}")) * F.sqrt(F.col(f"c{j}_{j}"))) + (1e-6 if method == "vanilla" and i == j else 0.0)
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), r(i, j).alias("r")) for i, j in pairs for a, b in {(i, j), (j, i)}])
    return wide.select("hour", F.explode(cells).alias("x")).select("hour", "x.i", "x.j", "x.r")


def _sparse(df: DataFrame, cols: Sequence[str], ts: str, alpha: float, search: bool) -> DataFrame:
    """Moments of each hour and of five folds of it reach the driver: 24 by 5 by columns squared numbers."""
    n, full = len(cols), df.dropna(subset=list(cols))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    fold = F.pmod(F.xxhash64(ts, *cols), F.lit(5)) if search else F.lit(0)
    rows = full.groupBy(F.hour(ts).alias("hour"), fold.alias("fold")).agg(F.count("*").alias("n"), *[F.sum(c) for c in cols], *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).collect()
    hours: dict[int, list] = {}
    for r in rows:
        mean, square = np.array(r[3 : 3 + n]) / r.n, np.zeros((n, n))
        for (i, j), v in zip(pairs, r[3 + n :], strict=True):
            square[i, j] = square[j, i] = v / r.n
        hours.setdefault(r.hour, []).append((r.n, mean, square))
    out = []
    if search and hours:
        most = max(hours.values(), key=lambda x: sum(f[0] for f in x))
        alpha = glasso_alpha([(m, s - np.outer(mu, mu)) for m, mu, s in most])
    for hour, folds in hours.items():
        total = sum(f[0] for f in folds)
        mean, square = (sum(f[0] * f[k] for f in folds) / total for k in (1, 2))
        cov = square - np.outer(mean, mean)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        r = glasso(cov, alpha) / np.outer(d, d)
        out += [(hour, i, j, float(r[i, j])) for i in range(n) for j in range(n)]
    return df.sparkSession.createDataFrame(out, "hour int, i int, j int, r double")


def _matrix(cells: pd.DataFrame) -> np.ndarray:
    n = int(cells.i.max()) + 1
    m = np.eye(n)
    m[cells.i.to_numpy(), cells.j.to_numpy()] = cells.r.fillna(0).to_numpy()
    np.fill_diagonal(m, 1.0)
    return m


def _normal(matrix: np.ndarray, key: int, seed: int, n: int) -> np.ndarray:
    """n draws from N(0, matrix); they depend on the key and the seed alone."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 0))
    return np.random.default_rng([seed, key & 0x7FFFFFFF, (key >> 31) & 0x7FFFFFFF]).standard_normal((n, len(matrix))) @ root.T


def interpolate(at: np.ndarray, alphas: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inverse distribution function, linear between quantiles and beyond the outer two."""
    k = np.clip(np.searchsorted(alphas, at, "right") - 1, 0, len(alphas) - 2)
    return q[k] + (at - alphas[k]) * (q[k + 1] - q[k]) / (alphas[k + 1] - alphas[k])


def sample(quantiles: DataFrame, correlation: DataFrame, alphas: Sequence[float], n: int, *, seed: int = 0, by: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, scenario, path) from (by, q array<array<double>>: a row of quantiles for each step).

    The correlation of the hour of the row's ts, which is in by, is the copula's; every row draws from a seed of its own, so the result doesn't depend on partitions.
    """
    levels = np.array(alphas)
    matrices = correlation.groupBy("hour").agg(F.collect_list(F.struct("i", "j", "r")).alias("cells"))
    both = quantiles.withColumn("hour", F.hour("ts")).join(F.broadcast(matrices), "hour")  # 24 rows
    key = F.unix_micros("ts") if list(by) == ["ts"] else F.xxhash64(*by)
    both = both.select(*by, key.alias("key"), "q", "cells")

    def run(frames):
        for pdf in frames:
            out = []
            for *row, key, q, cells in zip(*(pdf[c] for c in by), pdf.key, pdf.q, pdf.cells, strict=True):
                m = _matrix(pd.DataFrame([(c["i"], c["j"], c["r"]) for c in cells], columns=["i", "j", "r"]).astype({"r": "f8"}))
                u = norm_cdf(_normal(m, int(key), seed, n))
                rng = np.random.default_rng([seed + 1, int(key) & 0x7FFFFFFF])
                paths = np.stack([interpolate(u[:, s], levels, np.array(q[s], "f8")) for s in range(len(q))], 1)
                paths = paths + 1e-9 * rng.standard_normal(paths.shape)  # no two alike
                out += [(*row, k, p.tolist()) for k, p in enumerate(paths)]
            yield pd.DataFrame(out, columns=[*by, "scenario", "path"])

    schema = ", ".join(f"{c} {quantiles.schema[c].dataType.simpleString()}" for c in by)
    return both.mapInPandas(run, f"{schema}, scenario int, path array<double>")


# -- trees: rows (node, parent, step, p, v); the root's parent is -1 ---------------------------------


def default_nodes(steps: int, most: int) -> list[int]:
    """1 at the root, then doubling from 2 towards ``most``."""
    return [min(most, 2**k) for k in range(steps)]


def reduce_scenarios(paths: np.ndarray, nodes: Sequence[int] | None = None, *, tolerance: float = 10.0) -> pd.DataFrame:
    """Backward reduction of (scenarios, steps) or (scenarios, steps, variables) to at most nodes[t] branches at step t.

    Distances are city-block ones over the whole horizon and all variables, steps scaled by their spread. From the last step to the first, the
    branch whose probability times distance to its nearest other one is least joins that one, and takes its path up to there. Without nodes a step
    joins branches until what that cost reaches tolerance / 1.5^(t + 2) of the least sum of distances up to there; one is left at the root.
    Of several variables the tree has columns v0, v1 and so on.
    """
    s = np.atleast_3d(paths).swapaxes(0, 1).copy()  # steps, scenarios, variables
    steps, n, kinds = s.shape
    z = (s - s.mean(1, keepdims=True)) / (s.std(1, keepdims=True) + 1e-6)
    upto = np.cumsum(np.abs(z[:, :, None] - z[:, None, :]).sum(3), 0) if nodes is None else None
    d = np.abs(z[:, :, None] - z[:, None, :]).sum((0, 3)) if upto is None else upto[-1].copy()
    np.fill_diagonal(d, np.inf)
    p, alive, into = np.full(n, 1.0 / n), np.ones(n, bool), np.arange(n)
    for t in range(steps - 1, -1, -1):
        most = np.inf if upto is None or t == 0 else tolerance / 1.5 ** (t + 2) * upto[t][np.ix_(alive, alive)].sum(0).min()
        cost, left = 0.0, 1 if nodes is None else max(1, nodes[t])
        while alive.sum() > left and (cost < most or cost == 0):
            near = np.where(alive[:, None] & alive[None, :], d, np.inf)
            joins = np.where(alive, np.where(alive, near.min(1), 0) * p, np.inf)
            r = int(np.argmin(joins))
            k = int(near[r].argmin())
            cost += float(joins[r])
            p[k], p[r], alive[r] = p[k] + p[r], 0.0, False
            moved = into == r
            into[moved] = k
            s[: t + 1, moved] = s[: t + 1, k, None]
    rows, parent = [], {}
    leaves = np.full(n, 1.0 / n)
    for t in range(steps):
        now: dict = {}
        for j in range(n):
            above = parent.get(j, -1)
            key = (above, *map(float, s[t, j]))
            if key not in now:
                now[key] = len(rows)
                rows.append([len(rows), above, t, 0.0, *key[1:]])
            rows[now[key]][3] += leaves[j]
            parent[j] = now[key]
    return pd.DataFrame(rows, columns=["node", "parent", "step", "p", *(["v"] if kinds == 1 else [f"v{k}" for k in range(kinds)])])


def _assign(paths: np.ndarray, tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(scenario's leaf path, node of each leaf path and step)."""
    kids: dict[int, list[int]] = {}
    for node, parent in zip(tree.node, tree.parent, strict=True):
        kids.setdefault(parent, []).append(node)
    leaf_paths, stack = [], [[r] for r in kids[-1]]
    while stack:
        path = stack.pop()
        if path[-1] in kids:
            stack += [[*path, c] for c in kids[path[-1]]]
        else:
            leaf_paths.append(path)
    index = np.array(leaf_paths)
    v = tree.v.to_numpy()[index]
    return ((paths[:, None, :] - v[None]) ** 2).sum(2).argmin(1), index


def quantile_tree(paths: np.ndarray, nodes: Sequence[int]) -> pd.DataFrame:
    """Nested quantiles: a node's scenarios are cut at the next step into its children's shares; a child's value is the mean quantile of its share."""
    rows = [[0, -1, 0, 1.0, float(np.median(paths[:, 0]))]]
    level = [(0, np.arange(len(paths)))]
    for t in range(1, paths.shape[1]):
        n, below = max(1, nodes[t] // max(1, nodes[t - 1])), []
        for node, members in level:
            own = members if len(members) else np.arange(len(paths))
            cuts = np.quantile(paths[own, t], np.linspace(0, 1, n + 1))
            values = np.quantile(paths[own, t], np.linspace(0, 1, n + 2)[1:-1])
            for c in range(n):
                lo = cuts[c] - (1e-6 if c == 0 else 0)
                share = own[(paths[own, t] > lo) & (paths[own, t] <= cuts[c + 1])]
                rows.append([len(rows), node, t, 0.0, float(values[c])])
                below.append((rows[-1][0], share if len(share) else own))
        level = below
    tree = pd.DataFrame(rows, columns=["node", "parent", "step", "p", "v"])
    return _weighted(paths, tree)


def _weighted(paths: np.ndarray, tree: pd.DataFrame) -> pd.DataFrame:
    """A node's probability: the share of scenarios whose nearest leaf path runs through it."""
    near, index = _assign(paths, tree)
    p = np.zeros(len(tree))
    for j, path in enumerate(index):
        p[path] += (near == j).mean()
    return tree.assign(p=p)


def neural_gas_tree(paths: np.ndarray, nodes: Sequence[int], *, rounds: int = 80, seed: int = 0) -> pd.DataFrame:
    """From the quantile tree: a random scenario pulls all leaf paths, the nearer in rank the stronger; shared nodes are averaged."""
    tree, rng = quantile_tree(paths, nodes), np.random.default_rng(seed)
    v = tree.v.to_numpy().copy()
    _, index = _assign(paths, tree)
    for k in range(rounds):
        share = k / rounds
        rate, reach = 0.5 * (0.05 / 0.5) ** share, 10 * (0.01 / 10) ** share
        x, leaf = paths[rng.integers(len(paths))], v[index]
        rank = np.argsort(np.argsort(((leaf - x) ** 2).sum(1)))
        leaf = leaf + np.minimum(rate * np.exp(-rank / reach), 1)[:, None] * (x - leaf)
        total, n = np.zeros(len(v)), np.zeros(len(v))
        np.add.at(total, index, leaf)
        np.add.at(n, index, 1)
        v = total / n
    return _weighted(paths, tree.assign(v=v))


def gradient_tree(paths: np.ndarray, nodes: Sequence[int], *, rounds: int = 30, tolerance: float = 1e-6) -> pd.DataFrame:
    """From the quantile tree: gradient descent on the scenarios' mean squared distance to their nearest leaf path; in closed form, as only that path moves."""
    tree = quantile_tree(paths, nodes)
    v, past = tree.v.to_numpy().copy(), np.inf
    for _ in range(rounds):
        near, index = _assign(paths, tree.assign(v=v))
        away = v[index[near]] - paths
        loss = float((away**2).mean(1).sum())
        if loss > past - tolerance:
            break
        past, grad = loss, np.zeros(len(v))
        np.add.at(grad, index[near], 2 * away / paths.shape[1])
        v = v - max(1 / len(paths), 0.1) * grad / max(1.0, len(paths) / len(index))
    return _weighted(paths, tree.assign(v=v))


TREES = {"scenred": reduce_scenarios, "quantiles": quantile_tree, "neural_gas": neural_gas_tree, "gradient": gradient_tree}


def refine(paths: np.ndarray, tree: pd.DataFrame, *, rounds: int = 50, seed: int = 0) -> pd.DataFrame:
    """Stochastic local search of the nodes' values; a step is kept if the scenarios come nearer."""
    rng, v = np.random.default_rng(seed), tree.v.to_numpy().copy()
    cost = lambda u: float((lambda a: ((paths - u[a[1]][a[0]]) ** 2).mean())(_assign(paths, tree.assign(v=u))))
    best = cost(v)
    for _ in range(rounds):
        u = v + rng.normal(scale=0.05 * (paths.std() + 1e-12), size=len(v))
        if (c := cost(u)) < best:
            v, best = u, c
    return _weighted(paths, tree.assign(v=v))


def trees(scenarios: DataFrame, nodes: Sequence[int], *, kind: str = "scenred", by: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, node, parent, step, p, v) from (by, scenario, path): one small tree a group."""
    schema = ", ".join(f"{c} {scenarios.schema[c].dataType.simpleString()}" for c in by) + ", node int, parent int, step int, p double, v double"
    build = TREES[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scenario")
        tree = build(np.array(pdf.path.tolist(), "f8"), list(nodes))
        return tree.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "node", "parent", "step", "p", "v"]].astype({"node": "int32", "parent": "int32", "step": "int32"})

    return scenarios.groupBy(*by).applyInPandas(run, schema)


def leaf_paths(tree: DataFrame, steps: int, *, by: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, leaf, step, node): each leaf's nodes, by walking to the parents one step at a time."""
    up = tree.select(*by, F.col("node").alias("at"), F.col("parent").alias("above"))
    now = tree.filter(F.col("step") == steps - 1).select(*by, F.col("node").alias("leaf"), F.col("node").alias("at"))
    out = now.withColumn("step", F.lit(steps - 1))
    for t in range(steps - 2, -1, -1):
        now = now.join(up, [*by, "at"]).select(*by, "leaf", F.col("above").alias("at"))
        out = out.unionByName(now.withColumn("step", F.lit(t)))
    return out.withColumnRenamed("at", "node")


def superimpose(tree: DataFrame, signal: DataFrame, *, on: Sequence[str] = ("ts", "step")) -> DataFrame:
    """The signal's value at a step added to all nodes of that depth."""
    return tree.join(signal, list(on)).withColumn("v", F.col("v") + F.col("f")).drop("f")
