"""Splits, folds and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_split(df: DataFrame, ratio: float | None, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Column ``validation``: the last int(n * ratio) rows of a series; without a ratio all rows are both."""
    if ratio is None:
        return df.withColumn("validation", F.lit(True))
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return df.withColumn("validation", F.row_number().over(w.orderBy(ts)) > n - F.floor(n * ratio))


@dataclass(frozen=True)
class Fold:
    fold: int
    start: int
    end: int
    dead: int


def time_folds(lo: int, hi: int, n: int, *, multiplier: int = 1, dead: int = 0, disjoint: bool = False) -> list[Fold]:
    """Test windows of width span / (n - 1), evenly spread over the span (times in microseconds); adjacent ones overlap unless ``disjoint``, when
    the width is span / n. Training leaves out ``dead`` time around the window."""
    width = (hi - lo) // (n if disjoint else n - 1)
    if dead > width:
        raise ValueError("the dead band is wider than the test window")
    count = n * multiplier
    starts = [lo + (hi - width - lo) * k // max(1, count - 1) for k in range(count)]
    return [Fold(k, s, s + width, dead) for k, s in enumerate(starts)]


def assign_folds(df: DataFrame, folds: Sequence[Fold], *, ts: str = "ts") -> DataFrame:
    """A row for each fold in which it trains or tests, with ``fold`` and ``role``; folds are an array in the plan, no join."""
    us = F.unix_micros(ts)
    role = lambda f: F.when((us >= f["start"]) & (us <= f["end"]), "test").when((us < f["start"] - f["dead"]) | (us > f["end"] + f["dead"]), "train")
    plan = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.start).alias("start"), F.lit(f.end).alias("end"), F.lit(f.dead).alias("dead")) for f in folds])
    out = df.withColumn("_f", F.explode(plan)).withColumn("role", role(F.col("_f")))
    return out.filter("role is not null").withColumn("fold", F.col("_f.fold")).drop("_f")


def _checked(cap) -> int:
    if isinstance(cap, bool) or not isinstance(cap, int):
        raise TypeError("the number of rows must be an integer")
    if cap < 1:
        raise ValueError("the number of rows must be positive")
    return cap


def place(*values: Column) -> Column:
    """A number below 2^48 that depends on the values alone: the head of their digest, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[v.cast("string") for v in values])), 1, 12), 16, 10).cast("bigint")


def _place(keys: Sequence[str], seed: int) -> Column:
    return place(*map(F.col, keys), F.lit(seed))


def sample_rows(df: DataFrame, rows: int, *, seed: int = 0, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Exactly ``rows`` rows, or all; which ones depends on keys and seed alone."""
    return df.withColumn("_p", _place(keys, seed)).orderBy("_p", *keys).limit(_checked(rows)).drop("_p")


def allocate(counts: dict, rows: int) -> dict:
    """Rows of each stratum: in proportion by largest remainder, one at least, none above its count."""
    total = sum(counts.values())
    if rows >= total:
        return dict(counts)
    share = {k: min(n, max(1, rows * n // total)) for k, n in counts.items()}
    left = rows - sum(share.values())
    for k in sorted(counts, key=lambda k: (-((rows * counts[k]) % total), str(k))):
        if left > 0 and share[k] < counts[k]:
            share[k], left = share[k] + 1, left - 1
    for k in sorted(counts, key=lambda k: (share[k] - counts[k], str(k))):
        extra = min(max(left, 0), counts[k] - share[k])
        share[k], left = share[k] + extra, left - extra
    for k in sorted(counts, key=lambda k: (-share[k], str(k))):  # ones at least were too many
        cut = min(max(-left, 0), share[k] - 1)
        share[k], left = share[k] - cut, left + cut
    return share


def sample_by_hour(df: DataFrame, rows: int, *, seed: int = 0, ts: str = "ts", keys: Sequence[str] | None = None) -> DataFrame:
    """``rows`` rows spread over the hours of the day as the table's are; fewer rows than hours: uniformly."""
    keys = keys or [ts]
    hours = {r["_h"]: r["count"] for r in df.groupBy(F.hour(ts).alias("_h")).count().collect()}  # 24 rows
    if _checked(rows) < len(hours):
        return sample_rows(df, rows, seed=seed, keys=keys)
    share = allocate(hours, rows)
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.hour(ts)), F.lit(0)) if share else F.lit(0)
    w = Window.partitionBy(F.hour(ts)).orderBy(_place(keys, seed), *keys)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= quota).drop("_n")
