"""Windows over positions: embeddings and bases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hankel(df: DataFrame, col: str, n: int, *, ts: str = "ts", by: Sequence[str] = (), prefix: str = "h") -> DataFrame:
    """Columns prefix0 ... prefix(n-1): the value and its n - 1 successors; rows without all of them go."""
    w = Window.partitionBy(*by).orderBy(ts)
    out = df.withColumns({f"{prefix}{i}": F.lead(col, i).over(w) if i else F.col(col) for i in range(n)}).withColumn("_n", F.count("*").over(w.rowsBetween(0, n - 1)))
    return out.filter(F.col("_n") == n).drop("_n")


def sliding(df: DataFrame, col: str, history: int, horizon: int, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Arrays ``past`` of the last ``history`` values and ``future`` of the next ``horizon``; incomplete rows go."""
    w = Window.partitionBy(*by).orderBy(ts)
    out = df.withColumns({"past": F.collect_list(col).over(w.rowsBetween(-history + 1, 0)), "future": F.collect_list(col).over(w.rowsBetween(1, horizon))})
    return out.filter((F.size("past") == history) & (F.size("future") == horizon))


def fourier_basis(t: Column, period: int, harmonics: int) -> list[Column]:
    """sqrt(2 / period) times 1 / sqrt 2, then sin and cos of each harmonic."""
    scale = math.sqrt(2 / period)
    out = [F.lit(scale / math.sqrt(2))]
    for k in range(1, harmonics + 1):
        angle = t * (2 * math.pi * k / period)
        out += [F.sin(angle) * scale, F.cos(angle) * scale]
    return out
