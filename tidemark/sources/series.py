"""Regular time series from event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import micros


def bucket_start(ts: Column | str, step: str) -> Column:
    """The start of the tumbling bucket of a duration that a time falls into; buckets are counted from 1970."""
    us = micros(step)
    t = F.unix_micros(ts)
    return F.timestamp_micros(t - F.pmod(t, F.lit(us)))


def resample(df: DataFrame, step: str, aggs: dict[str, Column], *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Tumbling aggregates; partial sums are made before the shuffle."""
    return df.groupBy(*by, bucket_start(ts, step).alias(ts)).agg(*[c.alias(k) for k, c in aggs.items()])


def fill_calendar(df: DataFrame, step: str, *, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Every step between a series' first and last time, NULL where there is no row. The span comes from one aggregate;
    the calendar is generated where it is joined."""
    span = df.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = span.select(*by, F.explode(F.transform(F.sequence(F.unix_micros("_lo"), F.unix_micros("_hi"), F.lit(micros(step))), F.timestamp_micros)).alias(ts))
    return grid.join(df, [*by, ts], "left")


def infer_step(df: DataFrame, *, ts: str = "ts", by: Sequence[str] = ()) -> int:
    """Median distance of successive times, in microseconds."""
    from pyspark.sql import Window

    from ..operators.quantiles import exact_quantiles

    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(Window.partitionBy(*by).orderBy(ts))
    median = exact_quantiles(df.select(gap.alias("gap")), "gap", [0.5]).first()
    return int(median["_q"][0])
