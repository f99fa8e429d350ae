"""Feature specifications compiled into window expressions.

A ``Features`` object is a plan: it says which columns will come out, over which time they look and how they are made, without
data. All columns of one layer share one partitioning and order, and so one exchange and one sort. A long series can
be cut into time buckets: rows go to their own bucket and, as a halo as wide as the furthest look back or ahead, to its
neighbours; so a single series is many tasks. In buckets, frames of time may hold any number of irregular rows: sums come from running sums,
minima, medians and the like from one walk over the bucket, so that the work grows with the rows and not with rows times frame.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.aggregates import over
from ..functions.durations import function_name, micros, readable

DAY = micros("1d")


@dataclass(frozen=True)
class Meta:
    """One derived column; times are microseconds relative to the row's own, the past negative."""

    column: str
    name: str
    lag: int | None
    function: str | None
    aggregation_time: int
    spacing_time: int
    start_time: int
    end_time: int
    relative_lags: bool


@dataclass(frozen=True)
class Frame:
    """An aggregate over the last ``width`` microseconds, of ``least`` values at least."""

    name: str
    function: str
    width: int
    least: int


_SUMS = ("count", "sum", "mean", "var", "std")


def by_sums(f: Frame, window) -> Column:
    """Counts and sums of a frame as differences of running ones, which grow row by row; about the partition's mean, in column _m_<name>,
    so that no digits are lost."""
    until, before = (window.rangeBetween(Window.unboundedPreceding, end) for end in (0, -f.width))
    mid = F.col(f"`_m_{f.name}`")
    off = F.col(f.name) - mid
    total = lambda c: F.coalesce(F.sum(c).over(until), F.lit(0.0)) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    n = F.count(f.name).over(until) - F.count(f.name).over(before)
    if f.function == "count":
        value = n
    elif f.function in ("sum", "mean"):
        value = mid * n + total(off) if f.function == "sum" else mid + total(off) / n
    else:
        var = F.when(n > 1, F.greatest(total(off * off) - total(off) * total(off) / n, F.lit(0.0)) / (n - 1))
        value = var if f.function == "var" else F.sqrt(var)
    return F.when(n >= f.least, value)


def by_walk(df: DataFrame, by: Sequence[str], frames: dict[str, Frame]) -> DataFrame:
    """Order statistics and moments of frames, each in one walk over a partition (a series' bucket): what enters and leaves a frame updates its state."""
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in frames)])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us", kind="stable")
        at = pd.to_datetime(pdf["_us"], unit="us")
        for name, f in frames.items():
            values = pd.Series(pdf[f.name].to_numpy("f8"), index=at).rolling(pd.Timedelta(f.width, "us"), min_periods=f.least)
            # rows of one time have one frame, the last one's
            pdf[name] = getattr(values, f.function)().groupby(pdf["_us"].to_numpy()).transform("last").to_numpy()
        return pdf

    return df.groupBy(*by).applyInPandas(walk, schema).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in frames})


@dataclass
class Transform:
    """Roll or bin ``names`` with ``functions``, then lag. lag > 0 looks back, < 0 ahead. ``bins`` are pairs' edges in steps, the
    larger further back: edges 4, 2 aggregate the rows from 3 to 2 steps ago."""

    names: Sequence[str]
    functions: Sequence[str | Callable] = ()
    freq: str | int | None = None
    lags: Sequence[int] = ()
    relative: bool = False
    bins: Sequence[int] = ()
    by_function: bool = False  # order of the columns of bins

    def compile(self, dt: int, window, wide: bool = False) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]], list[Meta]]:
        """(aggregates, columns over them, their metadata). ``wide``: frames of time may hold many rows, so none is aggregated row by row."""
        aggregates, columns, metas = [], [], []
        width = micros(self.freq) if isinstance(self.freq, str) else (self.freq or 1) * dt
        steps = max(1, width // dt)
        edges = sorted(self.bins, reverse=True)
        unit = (max(edges) - min(edges) if edges else steps) if self.relative else 1
        for name in self.names:
            base: list[tuple[str, str | None, int, int]] = []
            if edges:
                pairs = list(zip(edges, edges[1:], strict=False))
                for (a, b), fn in ((p, f) for f, p in product(self.functions, pairs)) if self.by_function else product(pairs, self.functions):
                    frame = window.rowsBetween(-(a - 1), -b)
                    out = f"{name}_{function_name(fn)}_{a}_{b}"
                    aggregates.append((out, F.when(F.count(name).over(frame) >= a - b, over(fn, F.col(name), frame))))
                    base.append((out, function_name(fn), -a * dt, -b * dt))
            elif self.functions:
                frame = window.rangeBetween(-width + 1, 0)
                for fn in self.functions:
                    out = f"{name}_{readable(width)}_{function_name(fn)}"
                    if wide and isinstance(fn, str):
                        aggregates.append((out, Frame(name, fn, width, steps)))
                    else:
                        aggregates.append((out, F.when(F.count(name).over(frame) >= steps, over(fn, F.col(name), frame))))
                    base.append((out, function_name(fn), -width, 0))
            else:
                base.append((name, None, 0, 0))
            for lag, (col, fn, start, end) in product(self.lags, base) if self.lags else ((None, b) for b in base):
                shift = (lag or 0) * unit
                out = col if lag is None else f"{col}_lag_{lag:03d}" if lag >= 0 else f"{col}_lag_{lag:04d}"
                if lag is not None:
                    columns.append((out, F.lag(col, shift).over(window)))
                elif fn is None:
                    continue
                else:
                    columns.append((out, F.col(col)))
                metas.append(Meta(out, name, lag, fn, width if fn else 0, unit * dt, start - shift * dt, end - shift * dt, self.relative))
        return aggregates, columns, metas


@dataclass
class Features:
    """The plan. ``dt``: the series' step; ``by``: columns of a series' key; ``bucket``: cut series into buckets of this duration."""

    dt: str | int
    by: Sequence[str] = ()
    ts: str = "ts"
    bucket: str | None = None
    augment: bool = True
    transforms: list[Transform] = field(default_factory=list)
    targets: list[Transform] = field(default_factory=list)
    normalizers: dict[str, tuple[str, Transform]] = field(default_factory=dict)
    expressions: tuple[str, str] | None = None
    zone: str | None = None
    calendar: bool = False

    def add(self, names: Sequence[str], functions=(), freq=None, lags=(), relative=False, bins=(), by_function=False) -> Features:
        self.transforms.append(Transform(names, functions, freq, lags, relative, bins, by_function))
        return self

    def add_target(self, names: Sequence[str], functions=(), freq=None, lags=(), relative=False, bins=()) -> Features:
        if any(x > 0 for x in lags):
            raise ValueError("a target must not look back")
        self.targets.append(Transform(names, functions, freq, lags, relative, bins))
        return self

    def add_normalizer(self, target: str, function: str, freq: str | int, name: str, lag: int | None = None) -> Features:
        """A rolling statistic of a target, for use in the normalising expressions; a name is taken once."""
        if lag is not None and lag < 0:
            raise ValueError("a normalizer must not look ahead")
        self.normalizers.setdefault(name, (target, Transform([target], [function], freq, [lag] if lag is not None else [])))
        return self

    def normalize_by(self, expression: str, inverse: str) -> Features:
        """SQL expressions over ``{t}``, the target's column, and the normalizers' names."""
        self.expressions = (expression, inverse)
        return self

    def add_time_features(self, zone: str | None = None) -> Features:
        self.calendar, self.zone = True, zone
        return self

    # -- what is known without data

    @property
    def step(self) -> int:
        return micros(self.dt)

    def _compiled(self):
        window = Window.partitionBy(*self.by, *(["_bucket"] if self.bucket else [])).orderBy("_us")
        wide = bool(self.bucket)
        features = [t.compile(self.step, window, wide) for t in self.transforms]
        targets = [t.compile(self.step, window, wide) for t in self.targets]
        normal = {n: t.compile(self.step, window, wide) for n, (_, t) in self.normalizers.items()}
        return features, targets, normal

    def metadata(self, *, target: bool = False) -> list[Meta]:
        return [m for _, _, metas in self._compiled()[1 if target else 0] for m in metas]

    def feature_names(self) -> list[str]:
        return [m.column for m in self.metadata()]

    def target_names(self) -> list[str]:
        return [m.column for m in self.metadata(target=True)]

    def time_limits(self, *, include_target: bool = True) -> dict[str, tuple[int, int]]:
        """Of each signal: the earliest start and the latest end that its columns look at."""
        out: dict[str, tuple[int, int]] = {}
        for m in self.metadata() + (self.metadata(target=True) if include_target else []):
            lo, hi = out.get(m.name, (m.start_time, m.end_time))
            out[m.name] = (min(lo, m.start_time), max(hi, m.end_time))
        return out

    def reach(self) -> tuple[int, int]:
        """How far back and ahead any column looks, in microseconds."""
        normal = [m for _, _, metas in self._compiled()[2].values() for m in metas]
        metas = [*self.metadata(), *self.metadata(target=True), *normal]
        # an aggregate and the lag over it are two windows, one after the other
        return -min([0, *(m.start_time for m in metas)]), max([0, *(m.end_time for m in metas)])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Features:
        d = json.loads(text)
        one = lambda t: Transform(**t)
        d["transforms"], d["targets"] = [one(t) for t in d["transforms"]], [one(t) for t in d["targets"]]
        d["normalizers"] = {k: (a, one(t)) for k, (a, t) in d["normalizers"].items()}
        d["expressions"] = tuple(d["expressions"]) if d["expressions"] else None
        return cls(**d)

    def kept_at_step(self, step_target: str, *, method: str = "periodic", period: str = "24h", tolerance: str = "0s", last_lags: int = 0, last: str = "0s") -> list[str]:
        """Feature columns worth having for one target column. periodic: those whose start or end is a whole number of
        periods before the target's, within the tolerance; up_to: those that end by the target's end. The latest lags and those that end lately stay."""
        target = next(m for m in self.metadata(target=True) if m.column == step_target)
        p, tol, recent = micros(period), micros(tolerance), micros(last)
        out = []
        for m in self.metadata():
            if method == "periodic":
                keep = (target.start_time - m.start_time) % p <= tol or (target.end_time - m.end_time) % p <= tol
            else:
                keep = m.end_time <= target.end_time
            keep = keep or (m.lag is not None and 0 <= m.lag < last_lags) or (recent > 0 and -recent <= m.end_time <= target.end_time)
            if keep:
                out.append(m.column)
        return out

    # -- data

    def transform(self, df: DataFrame, *, drop_nulls: bool = True) -> DataFrame:
        """The frame with all columns; rows with a null in any derived column go if ``drop_nulls``."""
        own = df.columns
        out = df.withColumn("_us", F.unix_micros(self.ts))
        if self.bucket:
            size, (back, ahead) = micros(self.bucket), self.reach()
            mine = F.floor(F.col("_us") / size)
            # the own bucket and all whose rows may look at this row
            out = out.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_us") - ahead) / size), F.floor((F.col("_us") + back) / size)))).withColumn("_mine", F.col("_bucket") == mine)
        features, targets, normal = self._compiled()
        derived = []
        for layer in (features, targets, list(normal.values())):
            for aggregates, columns, _ in layer:
                made = {n: c for n, c in aggregates if n not in out.columns}
                if made:
                    out = self._made(out, made)
                if lagged := {n: c for n, c in columns if n not in out.columns}:
                    out = out.withColumns(lagged)
        names, aims = self.feature_names(), self.target_names()
        derived += [*names, *(a for a in aims if a not in names)]
        for n, (_, _, metas) in normal.items():
            out = out.withColumn(n, F.col(metas[0].column))
            derived.append(n)
        if self.bucket:
            out = out.filter("_mine")
        if self.expressions:
            out = out.withColumns({a: F.expr(self.expressions[0].format(t=f"`{a}`")) for a in aims})
        if drop_nulls and derived:
            out = out.dropna(subset=derived)
        keys = [*self.by, self.ts]
        out = out.select(*(own if self.augment else keys), *[c for c in derived if not self.augment or c not in own])
        return time_features(out, self.ts, self.zone) if self.calendar else out

    def _made(self, out: DataFrame, made: dict) -> DataFrame:
        window = Window.partitionBy(*self.by, "_bucket").orderBy("_us")
        frames = {n: f for n, f in made.items() if isinstance(f, Frame)}
        walked = {n: f for n, f in frames.items() if f.function not in _SUMS}
        if walked:
            out = by_walk(out, [*self.by, "_bucket"], walked)
        means = {f"_m_{f.name}": F.avg(f.name).over(Window.partitionBy(*self.by, "_bucket")) for f in frames.values() if f.function in _SUMS}
        out = out.withColumns({n: c for n, c in means.items() if n not in out.columns}) if means else out
        sums = {n: by_sums(f, window) for n, f in frames.items() if f.function in _SUMS}
        return out.withColumns({n: sums.get(n, c) for n, c in made.items() if n not in walked}) if len(walked) < len(made) else out

    def denormalize(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Back from normalised targets, or predictions of them, where the normalizers' columns are there."""
        return df.withColumns({c: F.expr(self.expressions[1].format(t=f"`{c}`")) for c in columns})


def time_features(df: DataFrame, ts: str = "ts", zone: str | None = None) -> DataFrame:
    """hour, dayofweek (Monday 0), minuteofday, and utc_offset in hours where a zone is given."""
    local = F.from_utc_timestamp(ts, zone) if zone else F.col(ts)
    hour, minute = F.hour(local).cast("int"), F.minute(local)
    out = {"hour": hour, "dayofweek": F.weekday(local).cast("int"), "minuteofday": (hour * 60 + minute).cast("int")}
    if zone:
        out["utc_offset"] = (F.unix_micros(local) - F.unix_micros(ts)) / 3.6e9
    return df.withColumns(out)


def global_form(df: DataFrame, names: Sequence[str], shared: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One row a time and signal: target, name, and the shared columns."""
    return df.unpivot([ts, *shared], list(names), "name", "target")
