"""Exact quantiles of columns of any size: ranks are found by counting, in rounds; no task holds the distinct values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Up to so many values in all, one aggregate that holds them is cheaper; the result is the same.
FEW = 2_000_000
#: Cells that a round counts, over all groups and ranks; groups beyond GROUPS are many and so small, and each is aggregated by itself.
CELLS, GROUPS = 500_000, 10_000
_MOST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, col: str, alphas: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """(by, _q): for each group an array of the quantiles, linear between ranks; null where a group has no value.

    A round cuts the interval in which a rank is known to lie into cells and counts them map-side; the rank's cell, between the least and the
    greatest value in it, is the next interval. Each round narrows an interval by the number of cells, so a few are enough. Nulls and
    NaN don't count; infinite values count as the largest doubles. Runs jobs while it is called, on the written column.
    """
    v = F.col(col).cast("double")
    there = df.filter(v.isNotNull() & ~F.isnan(v))
    own = written(there.select(*by, F.greatest(F.least(v, F.lit(_MOST)), F.lit(-_MOST)).alias("_v")), "values")
    if own.count() <= FEW or own.select(*by).distinct().count() > GROUPS:
        return own.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(a)) for a in alphas])).alias("_q"))
    spans = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()  # GROUPS rows at most
    n = {tuple(r[c] for c in by): r.n for r in spans}
    ranks = {g: sorted({min(int(a * (m - 1)) + k, m - 1) for a in alphas for k in (0, 1)}) for g, m in n.items()}
    # of each group and rank: the interval that holds it, and how many values are below
    where = {(tuple(r[c] for c in by), k): (r.lo, r.hi, 0) for r in spans for k in ranks[tuple(r[c] for c in by)]}
    while True:
        todo: dict[tuple, list] = {}
        for (g, _), (lo, hi, below) in where.items():
            if lo < hi and (lo, hi, below) not in todo.setdefault(g, []):
                todo[g].append((lo, hi, below))
        todo = {g: x for g, x in todo.items() if x}
        if not todo:
            break
        cells = max(8, CELLS // sum(map(len, todo.values())))
        found = _counted(own, by, todo, cells)
        for (g, k), (lo, hi, below) in where.items():
            if lo < hi:
                at = below
                for count, a, b in found[g, todo[g].index((lo, hi, below))]:
                    if k < at + count:
                        where[g, k] = (a, b, at)
                        break
                    at += count

    def value(g, a):
        at = a * (n[g] - 1)
        low, high = (where[g, min(int(at) + k, n[g] - 1)][0] for k in (0, 1))
        return low if low == high else low + (high - low) * (at - math.floor(at))

    fields = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by)
    return df.sparkSession.createDataFrame([(*g, [value(g, a) for a in alphas]) for g in n], f"{fields}{', ' if by else ''}_q array<double>")


def _counted(own: DataFrame, by: Sequence[str], todo: dict[tuple, list], cells: int) -> dict:
    """Of each group and interval: (count, least, greatest) of its cells that hold anything, in order."""
    fields = "".join(f"`_g{i}` {own.schema[c].dataType.simpleString()}, " for i, c in enumerate(by))
    rows = [(*g, [(i, lo, hi) for i, (lo, hi, _) in enumerate(x)]) for g, x in todo.items()]
    state = F.broadcast(own.sparkSession.createDataFrame(rows, f"{fields}_s array<struct<i: int, lo: double, hi: double>>"))  # GROUPS rows at most
    joined = own.join(state, [own[c].eqNullSafe(state[f"_g{i}"]) for i, c in enumerate(by)]) if by else own.crossJoin(state)
    hit = F.filter("_s", lambda s: (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))
    inside = joined.withColumn("_h", F.get(hit, F.lit(0))).filter("_h is not null")
    place = (F.col("_v") / 2 - F.col("_h.lo") / 2) / (F.col("_h.hi") / 2 - F.col("_h.lo") / 2) * cells
    counted = inside.groupBy(*by, F.col("_h.i").alias("_i"), F.least(F.floor(place), F.lit(cells - 1)).alias("_c")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    out: dict = {}
    for r in sorted(counted.collect(), key=lambda r: r["_c"]):  # CELLS rows or so
        out.setdefault((tuple(r[c] for c in by), r["_i"]), []).append((r.n, r.lo, r.hi))
    return out
