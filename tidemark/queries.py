"""Every operator as a query over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as agg
from .operators import forecasts, holidays, learners, metrics, models, reconcile, scenarios, splits, stateful, windows
from .plans.features import Features, global_form, time_features
from .sources.series import bucket_start, fill_calendar, infer_step, resample
from .sources.session import table
from .sources.storage import written
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def r(c: Column | str, digits: int = 8) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r(F.col(f"`{c}`")) for c in cols})


# -- series ------------------------------------------------------------------------------------

H_SQL = """
h0 AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS y, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1),
hourly AS (SELECT g.ts, h0.y, h0.n FROM (SELECT unnest(generate_series((SELECT min(ts) FROM h0), (SELECT max(ts) FROM h0), INTERVAL 1 HOUR)) AS ts) g LEFT JOIN h0 ON g.ts = h0.ts)"""
P_SQL = """
p0 AS (SELECT event_type AS name, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2),
pspan AS (SELECT name, min(ts) AS lo, max(ts) AS hi FROM p0 GROUP BY 1),
panel AS (SELECT g.name, g.ts, p0.y FROM (SELECT name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM pspan) g LEFT JOIN p0 ON g.name = p0.name AND g.ts = p0.ts)"""
F_SQL = P_SQL + """,
fc AS (SELECT * FROM (SELECT name, ts, y, lag(y, 24) OVER (PARTITION BY name ORDER BY ts) AS f FROM panel) WHERE y IS NOT NULL AND f IS NOT NULL),
qf AS (SELECT fc.*, a.alpha, fc.f + (a.alpha - 0.5) * 40 AS q FROM fc, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS alpha) a)"""
R_SQL = P_SQL + """,
ahead AS (
  SELECT name, ts, s.step, CASE s.step WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS f, CASE s.step WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y FROM (
    SELECT name, ts, lag(y, 23) OVER w AS f1, lag(y, 22) OVER w AS f2, lag(y, 21) OVER w AS f3, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3
    FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts)), (SELECT unnest([1, 2, 3]) AS step) s)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return fill_calendar(resample(table(spark, d, "events"), "1h", {"y": F.avg("value"), "n": F.count("*")}), "1h")


def panel(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("name", F.col("event_type"))
    return fill_calendar(resample(events, "1h", {"y": F.avg("value")}, by=["name"]), "1h", by=["name"])


def forecast_pairs(spark: SparkSession, d: str) -> DataFrame:
    own = Features("1h", ["name"]).add(["y"], lags=[24]).transform(panel(spark, d), drop_nulls=False)
    return own.withColumnRenamed("y_lag_024", "f").dropna(subset=["y", "f"])


def quantile_pairs(spark: SparkSession, d: str) -> DataFrame:
    levels = F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return forecast_pairs(spark, d).withColumn("alpha", levels).withColumn("q", F.col("f") + (F.col("alpha") - 0.5) * 40)


def steps_ahead(spark: SparkSession, d: str) -> DataFrame:
    """name, ts, step, f, y of the seasonal forecast, three steps ahead."""
    df = written(panel(spark, d), "panel")
    f = forecasts.seasonal_persistent(df, "y", 24, 3, by=["name"]).drop("y")
    return f.join(forecasts.truth_ahead(df, "y", 3, by=["name"]), ["name", "ts", "step"])


def wide(spark: SparkSession, d: str) -> DataFrame:
    kinds = [x[0] for x in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # names of signals
    return panel(spark, d).groupBy("ts").pivot("name", kinds).agg(F.first("y"))


# -- features ----------------------------------------------------------------------------------


@query(f"""WITH {H_SQL}, x AS (
  SELECT ts, y, n, lag(y, 1) OVER (ORDER BY ts) AS a, lead(y, 1) OVER (ORDER BY ts) AS b,
    CASE WHEN count(y) OVER w3 >= 3 THEN avg(y) OVER w3 END AS m, CASE WHEN count(y) OVER w42 >= 2 THEN max(y) OVER w42 END AS x
  FROM hourly WINDOW w3 AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w42 AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING))
SELECT ts, round(y, 8) AS y, n, round(a, 8) AS y_lag_001, round(b, 8) AS "y_lag_-001", round(m, 8) AS y_3h_mean, round(x, 8) AS y_max_4_2,
  CAST(extract(hour FROM ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS minuteofday
FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND m IS NOT NULL AND x IS NOT NULL""")
def fmt_hourly_features(spark, d):
    """One series, cut into buckets with halos, so that it is several tasks."""
    plan = Features("1h", bucket="5d").add(["y"], lags=[1, -1]).add(["y"], ["mean"], "3h").add(["y"], ["max"], bins=[4, 2]).add_time_features()
    return rounded(plan.transform(hourly(spark, d)), "y", "y_lag_001", "y_lag_-001", "y_3h_mean", "y_max_4_2")


@query(f"""WITH {P_SQL} SELECT name, ts, round(y, 8) AS y, round(lag(y, 1) OVER w, 8) AS y_lag_001, round(lag(y, 24) OVER w, 8) AS y_lag_024, round(lead(y, 2) OVER w, 8) AS "y_lag_-002"
FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts)""")
def fmt_lag_lead(spark, d):
    out = Features("1h", ["name"]).add(["y"], lags=[1, 24, -2]).transform(panel(spark, d), drop_nulls=False)
    return rounded(out, "y", "y_lag_001", "y_lag_024", "y_lag_-002")


_ROLL = ", ".join(f"round(CASE WHEN count(value) OVER w >= 3 THEN {f}(value) OVER w END, 8) AS value_6h_{n}" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median"), ("std", "stddev_samp"), ("sum", "sum")))


@query(f"""SELECT event_id, {_ROLL}, CASE WHEN count(value) OVER w >= 3 THEN CAST(count(value) OVER w AS DOUBLE) END AS value_6h_count
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW)""")
def fmt_rolling_stats(spark, d):
    """Time frames over irregular events; every type is cut into buckets of two days."""
    plan = Features("2h", ["event_type"], bucket="2d").add(["value"], ["mean", "min", "max", "median", "std", "sum", "count"], "6h")
    out = plan.transform(table(spark, d, "events"), drop_nulls=False)
    out = out.withColumn("value_6h_count", F.col("value_6h_count").cast("double"))
    return rounded(out.select("event_id", *plan.feature_names()), *[f"value_6h_{f}" for f in ("mean", "min", "max", "median", "std", "sum")])


@query(f"""WITH {P_SQL} SELECT name, ts, round(CASE WHEN count(y) OVER w >= 6 THEN median(y) OVER w END, 8) AS y_6h_median FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def fmt_rolling_median(spark, d):
    """Over a regular panel, frames of few rows."""
    plan = Features("1h", ["name"], augment=False).add(["y"], ["median"], "6h")
    return rounded(plan.transform(panel(spark, d), drop_nulls=False), "y_6h_median")


_BIN = ", ".join(f"round(CASE WHEN count(y) OVER w{i} >= {a - b} THEN {f}(y) OVER w{i} END, 8) AS \"y_{n}_{a}_{b}\"" for i, (a, b) in enumerate(((6, 4), (4, 0), (0, -2))) for n, f in (("mean", "avg"), ("max", "max")))


@query(f"""WITH {P_SQL} SELECT name, ts, {_BIN} FROM panel WINDOW w0 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 4 PRECEDING),
w1 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def fmt_agg_bins(spark, d):
    plan = Features("1h", ["name"], augment=False).add(["y"], ["mean", "max"], bins=[6, 4, 0, -2])
    out = plan.transform(panel(spark, d), drop_nulls=False)
    return rounded(out, *plan.feature_names())


@query(f"""WITH {P_SQL}, a AS (SELECT name, ts, CASE WHEN count(y) OVER w0 >= 2 THEN max(y) OVER w0 END AS a, CASE WHEN count(y) OVER w1 >= 2 THEN max(y) OVER w1 END AS b
  FROM panel WINDOW w0 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), w1 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT name, ts, {', '.join(f'round(lag({c}, {4 * k}) OVER v, 8) AS y_max_{n}_lag_00{k}' for c, n in (('a', '4_2'), ('b', '2_0')) for k in (1, 2))} FROM a WINDOW v AS (PARTITION BY name ORDER BY ts)""")
def fmt_bins_lags(spark, d):
    """Bins, then lags in units of all bins."""
    plan = Features("1h", ["name"], augment=False).add(["y"], ["max"], bins=[4, 2, 0], lags=[1, 2], relative=True)
    return rounded(plan.transform(panel(spark, d), drop_nulls=False), *plan.feature_names())


@query(f"""WITH {P_SQL} SELECT name, ts, {', '.join(f'round(CASE WHEN count(y) OVER w{i} >= 2 THEN {f}(y) OVER w{i} END, 8) AS "y_{n}_{a}"' for n, f in (('mean', 'avg'), ('min', 'min')) for i, a in enumerate(('4_2', '2_0')))}
FROM panel WINDOW w0 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), w1 AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def fmt_bins_by_function(spark, d):
    """The columns of one function side by side, bins within."""
    plan = Features("1h", ["name"], augment=False).add(["y"], ["mean", "min"], bins=[4, 2, 0], by_function=True)
    return rounded(plan.transform(panel(spark, d), drop_nulls=False), *plan.feature_names())


@query("""WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) SELECT CAST(floor(median(gap)) AS BIGINT) AS step_us FROM g""")
def step_of_events(spark, d):
    return spark.createDataFrame([(infer_step(table(spark, d, "events"), by=["event_type"]),)], "step_us long")


@query("""SELECT event_id, round(value, -1) AS tens, value > (SELECT avg(value) FROM events) AS high FROM events""")
def binary_preparation(spark, d):
    own = table(spark, d, "events").select("event_id", F.round("value", -1).alias("tens"), F.col("value").alias("high"))
    return models.above_mean(own, ["high"])


_ORDER = [f"{{r: CASE WHEN isfinite(c{k}) THEN c{k} ELSE -2 END, i: -{k}, v: x{k}}}" for k in (1, 2, 3)]


@query(f"""WITH {P_SQL}, x AS (SELECT name, ts, y, lag(y, 1) OVER w AS x1, lag(y, 5) OVER w AS x2, lag(y, 24) OVER w AS x3 FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts)),
c AS (SELECT corr(y, x1) AS c1, corr(y, x2) AS c2, corr(y, x3) AS c3 FROM x), s AS (SELECT name, ts, list_transform(list_reverse_sort([{', '.join(_ORDER)}]), lambda e: e.v) AS l FROM x, c)
SELECT name, ts, round(l[1], 8) AS y_lag_001, round(l[2], 8) AS y_lag_005, round(l[3], 8) AS y_lag_024 FROM s""")
def correlation_reorder(spark, d):
    """Values of the lags that go with the target most, first, under the names of the lags."""
    plan = Features("1h", ["name"]).add(["y"], lags=[1, 5, 24])
    own = written(plan.transform(panel(spark, d), drop_nulls=False), "lagged")
    names = plan.feature_names()
    return rounded(models.reorder(own, names, models.correlation_order(own, names, "y")).select("name", "ts", *names), *names)


@query(f"""WITH {P_SQL}, t AS (SELECT name, CAST(extract(hour FROM ts) * 3600 AS INTEGER) AS tod, avg(y) AS usual FROM panel WHERE extract(hour FROM ts) < 18 GROUP BY ALL)
SELECT p.name, p.ts, round(usual, 8) AS usual FROM panel p LEFT JOIN t ON t.name = p.name AND t.tod = extract(hour FROM p.ts) * 3600""")
def tod_lookup(spark, d):
    own = panel(spark, d).select("name", "ts", "y")
    usual = own.filter(F.hour("ts") < 18).groupBy("name", (F.hour("ts") * 3600).alias("tod")).agg(F.avg("y").alias("usual"))
    return rounded(models.time_of_day_lookup(own, usual, ["usual"], by=["name"]).select("name", "ts", "usual"), "usual")


@query(f"""WITH {P_SQL}, a AS (SELECT name, ts, CASE WHEN count(y) OVER w >= 4 THEN avg(y) OVER w END AS m FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT name, ts, round(lag(m, 4) OVER v, 8) AS y_4h_mean_lag_001, round(lag(m, 8) OVER v, 8) AS y_4h_mean_lag_002 FROM a WINDOW v AS (PARTITION BY name ORDER BY ts)""")
def fmt_relative_lags(spark, d):
    plan = Features("1h", ["name"], augment=False).add(["y"], ["mean"], "4h", lags=[1, 2], relative=True)
    return rounded(plan.transform(panel(spark, d), drop_nulls=False), *plan.feature_names())


@query(f"""WITH {H_SQL} SELECT ts, h0, h1, h2 FROM (SELECT ts, round(y, 8) AS h0, round(lead(y, 1) OVER (ORDER BY ts), 8) AS h1, round(lead(y, 2) OVER (ORDER BY ts), 8) AS h2, row_number() OVER (ORDER BY ts DESC) AS k FROM hourly) WHERE k > 2""")
def fmt_hankel(spark, d):
    return rounded(windows.hankel(hourly(spark, d), "y", 3).select("ts", "h0", "h1", "h2"), "h0", "h1", "h2")


@query(f"""WITH {P_SQL} SELECT name, ts, round(list_sum(past), 8) AS past_sum, round(list_sum(future), 8) AS future_sum FROM (
  SELECT name, ts, list(y) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS past0, list(y) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future0,
    list_filter(past0, lambda v: v IS NOT NULL) AS past, list_filter(future0, lambda v: v IS NOT NULL) AS future FROM panel) WHERE len(past) = 6 AND len(future) = 3""")
def fmt_sliding(spark, d):
    out = windows.sliding(panel(spark, d), "y", 6, 3, by=["name"])
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, v: a + v))
    return out.select("name", "ts", total("past").alias("past_sum"), total("future").alias("future_sum"))


@query("""SELECT event_id, CAST(extract(hour FROM ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS minuteofday FROM events""")
def fmt_time_features(spark, d):
    return time_features(table(spark, d, "events").select("event_id", "ts")).drop("ts")


@query("""WITH z AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 12 HOUR AS ts FROM (SELECT ts FROM events UNION ALL SELECT o_orderdate FROM orders)),
s AS (SELECT ts, make_date(CAST(year(ts) AS INTEGER), 3, 31) AS m, make_date(CAST(year(ts) AS INTEGER), CASE WHEN year(ts) < 1996 THEN 9 ELSE 10 END, CASE WHEN year(ts) < 1996 THEN 30 ELSE 31 END) AS o FROM z),
b AS (SELECT ts, CAST(m - CAST(isodow(m) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AS lo, CAST(o - CAST(isodow(o) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AS hi FROM s),
l AS (SELECT ts, CASE WHEN ts >= lo AND ts < hi THEN 2 ELSE 1 END AS off FROM b)
SELECT ts, CAST(off AS DOUBLE) AS utc_offset, CAST(extract(hour FROM ts + to_hours(off)) AS INTEGER) AS hour FROM l""")
def fmt_utc_offset(spark, d):
    days = table(spark, d, "events").select("ts").unionByName(table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")))
    noon = days.select((bucket_start("ts", "1d") + F.expr("INTERVAL 12 HOURS")).alias("ts")).distinct()
    return time_features(noon, zone="Europe/Zurich").select("ts", "utc_offset", "hour")


@query("""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
years AS (SELECT unnest(generate_series((SELECT min(year(day)) - 1 FROM days), (SELECT max(year(day)) + 1 FROM days))) AS y),
e0 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS d FROM e0),
e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7 AS e FROM e1),
e3 AS (SELECT y, d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114 AS k FROM e2),
free AS (
  SELECT make_date(CAST(y AS INTEGER), m, dd) AS day FROM years, (VALUES (1, 1), (8, 1), (12, 25)) t(m, dd)
  UNION SELECT make_date(CAST(y AS INTEGER), CAST(k // 31 AS INTEGER), CAST(k % 31 + 1 AS INTEGER)) + 39 FROM e3),
f AS (SELECT day, day IN (SELECT day FROM free) AS h, isodow(day) > 5 AS w, (day - 1) IN (SELECT day FROM free) AS hp, (day + 1) IN (SELECT day FROM free) AS hn,
  isodow(day - 1) > 5 AS wp, isodow(day + 1) > 5 AS wn, isodow(day) AS k, (day - 2) IN (SELECT day FROM free) AS hpp, (day + 2) IN (SELECT day FROM free) AS hnn FROM days)
SELECT CAST(day AS TIMESTAMP) AS ts, CAST(CASE WHEN h THEN 3 WHEN k = 6 AND (hp OR hn OR hnn) THEN 2 WHEN k = 7 AND (hp OR hn OR hpp) THEN 2
  WHEN NOT w AND (hp OR wp) AND (hn OR wn) AND (hp OR hn) THEN 1 ELSE 0 END AS INTEGER) AS holiday FROM f""")
def fmt_holidays(spark, d):
    return holidays.add_holidays(table(spark, d, "orders").select(bucket_start("o_orderdate", "1d").alias("ts")).distinct(), "CH")


_NORM = Features("1h", ["name"], augment=False).add(["y"], lags=[0]).add_target(["y"], lags=[-1]).add_normalizer("y", "mean", "24h", "level").normalize_by("{t} / (level + 1)", "{t} * (level + 1)")
_NORM_SQL = f"""WITH {P_SQL}, x AS (SELECT name, ts, y, lead(y, 1) OVER w AS t, CASE WHEN count(y) OVER v >= 24 THEN avg(y) OVER v END AS level
FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts), v AS (PARTITION BY name ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query(_NORM_SQL + """ SELECT name, ts, round(y, 8) AS y_lag_000, round(t / (level + 1), 8) AS "y_lag_-001", round(level, 8) AS level FROM x WHERE y IS NOT NULL AND t IS NOT NULL AND level IS NOT NULL""")
def fmt_normalize(spark, d):
    return rounded(_NORM.transform(panel(spark, d)), "y_lag_000", "y_lag_-001", "level")


@query(_NORM_SQL + """ SELECT name, ts, round(t, 8) AS "y_lag_-001" FROM x WHERE y IS NOT NULL AND t IS NOT NULL AND level IS NOT NULL""")
def fmt_denormalize_roundtrip(spark, d):
    return rounded(_NORM.denormalize(_NORM.transform(panel(spark, d)), ["y_lag_-001"]).select("name", "ts", "y_lag_-001"), "y_lag_-001")


@query(f"""WITH {H_SQL}, {P_SQL.lstrip()} SELECT p.ts, p.name, round(p.y, 8) AS target, h.n FROM panel p JOIN hourly h ON p.ts = h.ts WHERE p.y IS NOT NULL""")
def fmt_global_form(spark, d):
    both = wide(spark, d).join(hourly(spark, d).select("ts", "n"), "ts")
    return rounded(global_form(both, [c for c in both.columns if c not in ("ts", "n")], ["n"]).filter("target is not null"), "target").select("ts", "name", "target", "n")


@query(f"""WITH {P_SQL} SELECT name, ts, round(y, 8) AS y_lag_000, round(lag(y, 1) OVER w, 8) AS y_lag_001, round(lag(y, 18) OVER w, 8) AS y_lag_018 FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts)""")
def fmt_prune_periodic(spark, d):
    plan = Features("1h", ["name"], augment=False).add(["y"], lags=range(31)).add_target(["y"], lags=[-6])
    kept = plan.kept_at_step("y_lag_-006", method="periodic", period="24h", last_lags=2)
    return rounded(plan.transform(panel(spark, d), drop_nulls=False).select("name", "ts", *kept), *kept)


@query("""WITH d AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM d), (SELECT max(ts) FROM d), INTERVAL 1 DAY)) AS ts) SELECT g.ts, round(d.y, 3) AS y FROM g LEFT JOIN d ON g.ts = d.ts""")
def resample_fill(spark, d):
    daily = resample(table(spark, d, "orders").withColumn("ts", F.col("o_orderdate")), "1d", {"y": F.sum("o_totalprice")})
    return fill_calendar(daily, "1d").withColumn("y", r("y", 3))


@query("""WITH x AS (SELECT l_shipdate AS ts, l_extendedprice * (1 - l_discount) AS v FROM lineitem)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(sum(v), 4) AS revenue, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""")
def resample_daily_revenue(spark, d):
    items = table(spark, d, "lineitem").withColumn("ts", F.col("l_shipdate"))
    out = resample(items, "1d", {"revenue": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "n": F.count("*")})
    return out.withColumn("revenue", r("revenue", 4))


@query(f"""WITH {P_SQL} SELECT name, ts, {', '.join(f'round(sqrt(2.0 / 24) * {e}, 9) + 0.0 AS b{i}' for i, e in enumerate(['sqrt(0.5)'] + [f'{f}(2 * pi() * {k} * extract(hour FROM ts) / 24)' for k in (1, 2) for f in ('sin', 'cos')]))} FROM panel""")
def fourier_basis(spark, d):
    cols = windows.fourier_basis(F.hour("ts"), 24, 2)
    return panel(spark, d).select("name", "ts", *[(r(c, 9) + 0.0).alias(f"b{i}") for i, c in enumerate(cols)])


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events""")
def encode_labels(spark, d):
    return metrics.encode_labels(table(spark, d, "events"), "event_type", "code").select("event_id", "code")


@query("""WITH a AS (SELECT avg(value) AS m FROM events), g AS (SELECT event_type, (sum(value) + 10 * (SELECT m FROM a)) / (count(value) + 10) AS enc FROM events GROUP BY 1)
SELECT event_id, round(enc, 8) AS enc FROM events JOIN g USING (event_type)""")
def target_encode(spark, d):
    return metrics.target_encode(table(spark, d, "events"), "event_type", "value", "enc").select("event_id", r("enc").alias("enc"))


@query("""SELECT * FROM (SELECT 'l_linenumber' AS col UNION ALL SELECT 'l_returnflag' UNION ALL SELECT 'l_linestatus') WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem) <= 24""")
def categorical_columns(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(c,) for c in metrics.categorical_columns(items)], "col string")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity FROM lineitem")
def dtype_shrink(spark, d):
    shrunk = metrics.shrink(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return shrunk.withColumn("l_orderkey", F.col("l_orderkey").cast("bigint"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 8) AS l_quantity, round((l_discount - md) / sd, 8) AS l_discount FROM lineitem, s""")
def standardize(spark, d):
    return rounded(metrics.standardize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]), "l_quantity", "l_discount")


_OUT = "(((l_quantity - mq) / sq) ** 2 + ((l_extendedprice - mp) / sp) ** 2)"


@query(f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_OUT}, 8) AS outlier FROM lineitem, s ORDER BY {_OUT} DESC, l_orderkey, l_linenumber LIMIT 20""")
def outlier_topk(spark, d):
    """The limit is the report's."""
    scored = metrics.outlier_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return scored.orderBy(F.desc("outlier"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", r("outlier").alias("outlier"))


@query(f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem),
o AS (SELECT l_returnflag, {_OUT} AS outlier FROM lineitem, s)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM o WHERE outlier <= (SELECT quantile_cont(outlier, 0.9) FROM o) GROUP BY 1""")
def without_outliers(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return metrics.without_outliers(items, ["l_quantity", "l_extendedprice"], 0.1).groupBy("l_returnflag").agg(F.count("*").alias("n"))


_QB = "(CASE WHEN {c} > k{n}[1] THEN 1 ELSE 0 END + CASE WHEN {c} > k{n}[2] THEN 1 ELSE 0 END + CASE WHEN {c} > k{n}[3] THEN 1 ELSE 0 END)"


@query(f"""WITH k AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS kx, quantile_cont(l_discount, [0.25, 0.5, 0.75]) AS ky FROM lineitem),
c AS (SELECT {_QB.format(c='l_quantity', n='x')} AS x, {_QB.format(c='l_discount', n='y')} AS y, l_extendedprice AS v FROM lineitem, k)
SELECT CAST(x AS INTEGER) AS x_cell, {', '.join(f'round(coalesce(avg(v) FILTER (y = {i}), 0), 4) AS y_{i}' for i in range(4))} FROM c GROUP BY 1""")
def hist_2d(spark, d):
    out = metrics.histogram_2d(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), "l_extendedprice", "l_quantity", "l_discount")
    return out.select(F.col("x_cell").cast("int").alias("x_cell"), *[r(f"y_{i}", 4).alias(f"y_{i}") for i in range(4)])


# -- scores --------------------------------------------------------------------------------------

_HOUR = "CAST(extract(hour FROM ts) AS INTEGER) AS hour"


def _hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour("ts").cast("int"))


@query(f"WITH {F_SQL} SELECT name, {_HOUR}, round(sqrt(avg((f - y) * (f - y))), 8) AS rmse FROM fc GROUP BY ALL")
def metric_rmse(spark, d):
    return rounded(metrics.score(_hour(forecast_pairs(spark, d)), metrics.rmse(), ["name", "hour"], "rmse"), "rmse")


@query(f"WITH {F_SQL} SELECT name, {_HOUR}, round(avg(abs(f - y) / (abs(y) + 1e-5)), 8) AS mape FROM fc GROUP BY ALL")
def metric_mape(spark, d):
    return rounded(metrics.score(_hour(forecast_pairs(spark, d)), metrics.mape(), ["name", "hour"], "mape"), "mape")


@query(f"""WITH {F_SQL}, s AS (SELECT ts, avg(abs(y)) AS size FROM fc GROUP BY 1), o AS (SELECT 0.01 * quantile_cont(size, 0.5) + 1e-12 AS off FROM s)
SELECT name, round(avg(abs(f - y) / (size + off)), 8) AS nmae FROM fc JOIN s USING (ts), o GROUP BY 1""")
def metric_nmae(spark, d):
    return rounded(metrics.nmae(forecast_pairs(spark, d), ["name"]), "nmae")


@query(f"WITH {F_SQL} SELECT name, alpha, round(avg((CASE WHEN q - y > 0 THEN 1.0 ELSE 0.0 END - alpha) * (q - y)), 8) AS pinball FROM qf GROUP BY ALL")
def metric_pinball(spark, d):
    return rounded(metrics.score(quantile_pairs(spark, d), metrics.pinball(), ["name", "alpha"], "pinball"), "pinball")


@query(f"WITH {F_SQL}, l AS (SELECT name, alpha, avg((CASE WHEN q - y > 0 THEN 1.0 ELSE 0.0 END - alpha) * (q - y)) AS loss FROM qf GROUP BY ALL) SELECT name, round(avg(loss), 8) AS crps FROM l GROUP BY 1")
def metric_crps(spark, d):
    return rounded(metrics.crps(quantile_pairs(spark, d), ["name"]), "crps")


@query(f"WITH {F_SQL} SELECT name, alpha, round(avg(CASE WHEN q - y > 0 THEN 1.0 ELSE 0.0 END), 8) AS reliability, round(avg(CASE WHEN q - y > 0 THEN 1.0 ELSE 0.0 END - alpha), 8) AS excess FROM qf GROUP BY ALL")
def metric_reliability(spark, d):
    out = quantile_pairs(spark, d).groupBy("name", "alpha").agg(metrics.reliability().alias("reliability"), metrics.reliability(minus_alpha=True).alias("excess"))
    return rounded(out, "reliability", "excess")


@query(f"""WITH {F_SQL}, k AS (SELECT quantile_cont(f, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM fc),
g AS (SELECT 'f' AS key, CAST(len(list_filter(c, lambda v: v < f)) AS VARCHAR) AS "group", f, y FROM fc, k UNION ALL SELECT 'name', name, f, y FROM fc),
m AS (SELECT key, "group", sqrt(avg((f - y) * (f - y))) AS a, avg(abs(f - y) / (abs(y) + 1e-5)) AS b FROM g GROUP BY ALL)
SELECT key, "group", 'rmse' AS metric, round(a, 8) AS value FROM m UNION ALL SELECT key, "group", 'mape', round(b, 8) FROM m""")
def summary_by_qcut(spark, d):
    own = forecast_pairs(spark, d).withColumn("level", F.col("f"))
    out = metrics.summary(own, {"rmse": metrics.rmse(), "mape": metrics.mape()}, ["level", "name"])
    return rounded(out.withColumn("key", F.when(F.col("key") == "level", "f").otherwise(F.col("key"))), "value")


@query(f"""WITH {F_SQL}, s AS (SELECT name, sqrt(avg((f - y) * (f - y))) AS e FROM fc GROUP BY 1) SELECT name, round(e, 8) AS rmse, CAST(dense_rank() OVER (ORDER BY e) AS INTEGER) AS rank FROM s""")
def rank_series(spark, d):
    return metrics.dense_rank(metrics.score(forecast_pairs(spark, d), metrics.rmse(), ["name"], "rmse"), "rmse").select("name", r("rmse").alias("rmse"), F.col("rank").cast("int").alias("rank"))


# -- baselines, linear models, uncertainty --------------------------------------------------------


@query(f"WITH {P_SQL} SELECT name, ts, s.step, round(y, 8) AS f FROM panel, (SELECT unnest([1, 2, 3]) AS step) s")
def model_persistent(spark, d):
    return forecasts.persistent(panel(spark, d), "y", 3).select("name", "ts", "step", r("f").alias("f"))


@query(f"WITH {R_SQL} SELECT name, ts, step, round(f, 8) AS f FROM ahead")
def model_seasonal(spark, d):
    return forecasts.seasonal_persistent(panel(spark, d), "y", 24, 3, by=["name"]).select("name", "ts", "step", r("f").alias("f"))


_DISC = f"""WITH {P_SQL}, v AS (SELECT name, CAST(extract(hour FROM ts) * 3600 AS INTEGER) AS tod, floor(y / 20) * 20 AS value FROM panel WHERE y IS NOT NULL),
c AS (SELECT name, tod, value, count(*) AS n FROM v GROUP BY ALL), pr AS (SELECT name, tod, value, n / (sum(n) OVER (PARTITION BY name, tod) + 1e-12) AS p FROM c)"""


def _distribution(spark, d):
    own = panel(spark, d).filter("y is not null").withColumn("value", (F.floor(F.col("y") / 20) * 20).cast("double"))
    return forecasts.discrete_distribution(own, "value", by=["name"])


@query(_DISC + " SELECT name, tod, value, round(p, 8) AS p FROM pr")
def model_discrete(spark, d):
    return rounded(_distribution(spark, d), "p")


@query(_DISC + " SELECT name, tod, round(sum(value * p), 8) AS expected FROM pr GROUP BY ALL")
def model_discrete_expected(spark, d):
    return rounded(forecasts.expected_value(_distribution(spark, d), ["name"]), "expected")


_ERR = f"""WITH {R_SQL}, e AS (SELECT CAST(extract(hour FROM ts) AS INTEGER) AS hour, step, y - f AS e FROM ahead WHERE y IS NOT NULL AND f IS NOT NULL),
er AS (SELECT hour, step, CAST(0.1 AS DOUBLE) AS alpha, quantile_cont(e, 0.1) AS e FROM e GROUP BY ALL UNION ALL SELECT hour, step, CAST(0.5 AS DOUBLE), quantile_cont(e, 0.5) FROM e GROUP BY ALL
  UNION ALL SELECT hour, step, CAST(0.9 AS DOUBLE), quantile_cont(e, 0.9) FROM e GROUP BY ALL)"""
LEVELS = (0.1, 0.5, 0.9)


@query(_ERR + " SELECT hour, step, alpha, round(e, 8) AS e FROM er")
def err_distr_hourly(spark, d):
    return rounded(forecasts.residual_quantiles(steps_ahead(spark, d), LEVELS).select(F.col("hour").cast("int").alias("hour"), "step", "alpha", "e"), "e")


@query(f"""WITH {R_SQL}, e AS (SELECT step, y - f AS e FROM ahead WHERE y IS NOT NULL AND f IS NOT NULL), q AS (SELECT step, quantile_cont(e, [0.1, 0.5, 0.9]) AS q FROM e GROUP BY 1)
SELECT CAST(h.hour AS INTEGER) AS hour, step, a.alpha, round(q[a.k], 8) AS e FROM q, (SELECT unnest(range(24)) AS hour) h, (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) a(k, alpha)""")
def err_distr_global(spark, d):
    out = forecasts.residual_quantiles(steps_ahead(spark, d), LEVELS, by_hour=False)
    return rounded(out.select(F.col("hour").cast("int").alias("hour"), "step", "alpha", "e"), "e")


@query(_ERR + " SELECT name, ts, a.step, er.alpha, round(a.f + er.e, 8) AS q FROM ahead a JOIN er ON er.hour = extract(hour FROM a.ts) AND er.step = a.step WHERE a.f IS NOT NULL AND a.y IS NOT NULL")
def predict_quantiles(spark, d):
    own = written(steps_ahead(spark, d).dropna(subset=["y", "f"]), "ahead")
    out = forecasts.with_quantiles(own, forecasts.residual_quantiles(own, LEVELS))
    return rounded(out.select("name", "ts", "step", "alpha", "q"), "q")


@query(_ERR + """, q AS (SELECT name, ts, a.step, a.f + er.e AS q FROM ahead a JOIN er ON er.hour = extract(hour FROM a.ts) AND er.step = a.step WHERE a.f IS NOT NULL AND a.y IS NOT NULL)
SELECT name, ts, step, b.bin, round(avg(CASE WHEN q >= b.lo AND (q < b.hi OR (b.bin = 2 AND q = b.hi)) THEN 1.0 ELSE 0.0 END), 8) AS p FROM q, (VALUES (0, -100.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 300.0)) b(bin, lo, hi) GROUP BY ALL""")
def predict_pmf(spark, d):
    own = written(steps_ahead(spark, d).dropna(subset=["y", "f"]), "ahead")
    out = forecasts.with_quantiles(own, forecasts.residual_quantiles(own, LEVELS))
    return rounded(forecasts.pmf(out, [-100.0, 50.0, 100.0, 300.0], ["name", "ts", "step"]), "p")


@query(f"""WITH {F_SQL}, u AS (SELECT name, ts, f, (extract(hour FROM ts) + 0.5) / 24.0 AS u FROM fc)
SELECT name, ts, round(u, 8) AS u, round(CASE WHEN u < 0.5 THEN f - 16 + (u - 0.1) * 16 / 0.4 ELSE f + (u - 0.5) * 16 / 0.4 END, 8) AS v FROM u""")
def interp_quantiles(spark, d):
    own = forecast_pairs(spark, d).withColumn("u", (F.hour("ts") + 0.5) / 24.0).withColumn("qs", F.array(F.col("f") - 16, F.col("f"), F.col("f") + 16))
    return forecasts.interpolate_quantiles(own, "u", LEVELS, "qs", "v").select("name", "ts", r("u").alias("u"), r("v").alias("v"))


@query(f"""WITH {P_SQL}, a AS (SELECT x.name AS nx, z.name AS nz, CAST(extract(hour FROM x.ts) AS INTEGER) AS hour, x.y AS a, z.y AS b FROM panel x JOIN panel z ON x.ts = z.ts),
names AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT name FROM panel)),
c AS (SELECT nx, nz, hour, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, covar_pop(a, b) AS cov FROM a GROUP BY ALL), v AS (SELECT nx, hour, cov AS var FROM c WHERE nx = nz)
SELECT c.hour, p.i, q.i AS j, round(cov / (sqrt(v.var) * sqrt(w.var)) + CASE WHEN p.i = q.i THEN 1e-6 ELSE 0 END, 8) AS r FROM c JOIN v ON v.nx = c.nx AND v.hour = c.hour JOIN v w ON w.nx = c.nz AND w.hour = c.hour JOIN names p ON p.name = c.nx JOIN names q ON q.name = c.nz""")
def corr_by_hour(spark, d):
    own = wide(spark, d)
    return rounded(scenarios.hourly_correlation(own, [c for c in own.columns if c != "ts"]).withColumn("hour", F.col("hour").cast("int")), "r")


@query(f"""WITH {H_SQL}, s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM hourly), f AS (SELECT k AS fold, epoch_us(lo) + ((epoch_us(hi) - (epoch_us(hi) - epoch_us(lo)) // 3) - epoch_us(lo)) * k // 3 AS a, (epoch_us(hi) - epoch_us(lo)) // 3 AS w FROM s, (SELECT unnest([0, 1, 2, 3]) AS k)),
x AS (SELECT ts, fold, CASE WHEN epoch_us(ts) BETWEEN a AND a + w THEN 'test' WHEN epoch_us(ts) < a - 7200000000 OR epoch_us(ts) > a + w + 7200000000 THEN 'train' END AS role FROM hourly, f)
SELECT ts, fold, role FROM x WHERE role IS NOT NULL""")
def tkfcv_folds(spark, d):
    own = hourly(spark, d).select("ts")
    lo, hi = own.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    return splits.assign_folds(own, splits.time_folds(lo, hi, 4, dead=7_200_000_000)).select("ts", "fold", "role")


@query(f"""WITH {P_SQL}, k AS (SELECT name, ts, row_number() OVER (PARTITION BY name ORDER BY ts) AS i, count(*) OVER (PARTITION BY name) AS n FROM panel) SELECT name, ts, i > n - CAST(floor(n * 0.2) AS BIGINT) AS validation FROM k""")
def val_split(spark, d):
    return splits.tail_split(panel(spark, d), 0.2, by=["name"]).select("name", "ts", "validation")


@query(f"""WITH {P_SQL}, x AS (SELECT name, ts, y, lag(y, 1) OVER (PARTITION BY name ORDER BY ts) AS x FROM panel), b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x)
SELECT name, ts, round(x * s + i, 4) AS f FROM x, b WHERE x IS NOT NULL""")
def linear_gram(spark, d):
    own = written(Features("1h", ["name"]).add(["y"], lags=[1]).transform(panel(spark, d), drop_nulls=False), "lagged")
    return forecasts.fit_linear(own, ["y_lag_001"], ["y"]).predict(own.filter("y_lag_001 is not null")).select("name", "ts", r("y_hat", 4).alias("f"))


def _one_lag(spark, d):
    return written(Features("1h", ["name"]).add(["y"], lags=[1]).transform(panel(spark, d)).select("name", "ts", "y", "y_lag_001"), "lagged")


_LAG1 = f"""WITH {P_SQL}, x AS (SELECT * FROM (SELECT name, ts, y, lag(y, 1) OVER (PARTITION BY name ORDER BY ts) AS x FROM panel) WHERE x IS NOT NULL), b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x),
lin AS (SELECT name, ts, y, x * s + i AS f FROM x, b)"""


@query(_LAG1 + " SELECT 'linear' AS model, round(sqrt(avg((f - y) * (f - y))), 8) AS rmse, round((SELECT sqrt(avg((x - y) * (x - y))) FROM x), 8) AS identity_rmse FROM lin")
def model_scores(spark, d):
    """One number a model, as a search compares them."""
    own, score = _one_lag(spark, d), models.scorer(metrics.rmse(), ["y"])
    value = [score(models.MODELS[m](own, ["y_lag_001"], ["y"]), own) for m in ("linear", "identity")]
    return rounded(spark.createDataFrame([("linear", *value)], "model string, rmse double, identity_rmse double"), "rmse", "identity_rmse")


@query(f"WITH {P_SQL} SELECT * FROM (SELECT name, ts, round(lag(y, 1) OVER (PARTITION BY name ORDER BY ts), 8) AS y_hat FROM panel) WHERE y_hat IS NOT NULL")
def model_identity(spark, d):
    own = Features("1h", ["name"]).add(["y"], lags=[1]).transform(panel(spark, d))
    return rounded(models.Identity(["y_lag_001"], ["y"]).predict(own).select("name", "ts", "y_hat"), "y_hat")


@query(_LAG1 + """, e AS (SELECT extract(hour FROM ts) AS hour, quantile_cont(y - f, [0.1, 0.5, 0.9]) AS q FROM lin WHERE y IS NOT NULL GROUP BY 1)
SELECT name, ts, 1 AS step, a.alpha, round(f + q[a.k], 6) AS q FROM lin JOIN e ON e.hour = extract(hour FROM ts), (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) a(k, alpha)""")
def model_quantiles(spark, d):
    """Any fitted model's quantiles: its forecast and its errors' at the hour."""
    own = _one_lag(spark, d)
    return models.fit_uncertain(own, ["y_lag_001"], ["y"], alphas=LEVELS).quantiles(own).withColumn("q", r("q", 6))


@query(_LAG1.replace(", b AS (SELECT regr_slope", f""", m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS a, regr_sxy(y, x) AS c, regr_syy(y, x) AS yy, regr_count(y, x) AS n FROM x WHERE y IS NOT NULL),
g AS (SELECT alpha, c / (a + alpha) AS w, (yy - 2 * c * c / (a + alpha) + a * (c / (a + alpha)) ** 2) / (n - 1 - a / (a + alpha)) ** 2 AS gcv FROM m, (VALUES {', '.join(f'(10.0::DOUBLE ** {x})' for x in np.linspace(-2, 8, 9))}) t(alpha)),
best AS (SELECT arg_min(w, gcv) AS w FROM g), b AS (SELECT regr_slope""") + " SELECT name, ts, round(my + (x - mx) * w, 4) AS y_hat FROM x, m, best")
def model_ridge_single(spark, d):
    own = _one_lag(spark, d)
    return forecasts.fit_ridge(own, ["y_lag_001"], ["y"]).predict(own).select("name", "ts", r("y_hat", 4).alias("y_hat"))


@query(f"""WITH {P_SQL}, f AS (SELECT name, ts, y, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b FROM panel WINDOW w AS (PARTITION BY name ORDER BY ts)),
s AS (SELECT CAST(t AS INTEGER) AS trial, extract(hour FROM ts) // 6 AS fold, avg(abs(CASE t WHEN 0 THEN a ELSE b END - y)) AS score FROM f, (VALUES (0), (1)) v(t) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
o AS (SELECT trial, avg(score) AS score, stddev_samp(score) AS std FROM s GROUP BY 1)
SELECT trial, round(score, 8) AS score, round(std, 8) AS std, CAST(dense_rank() OVER (ORDER BY score) AS INTEGER) AS rank, score = (SELECT min(score) FROM o) AS best FROM o""")
def trial_scores(spark, d):
    """Two ways to forecast on four folds: their mean, its deviation over folds, rank, and the one to take."""
    own = Features("1h", ["name"]).add(["y"], lags=[1, 24]).transform(panel(spark, d)).dropna(subset=["y"])
    each = own.withColumn("fold", F.floor(F.hour("ts") / 6)).select("y", "fold", F.posexplode(F.array("y_lag_001", "y_lag_024")).alias("trial", "f"))
    return rounded(models.trial_summary(each.groupBy("trial", "fold").agg(F.avg(F.abs(F.col("f") - F.col("y"))).alias("score"))), "score", "std")


# -- hierarchy -------------------------------------------------------------------------------------

_REG = """m0 AS (SELECT r_name AS name, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) / 1e6 AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
m AS (SELECT * FROM m0 UNION ALL SELECT 'TOTAL', ts, sum(y) FROM m0 GROUP BY ts),
b AS (SELECT name, ts, y, lag(y, 1) OVER (PARTITION BY name ORDER BY ts) * CASE WHEN name = 'TOTAL' THEN 1.1 ELSE 1.0 END AS f FROM m)"""


def regions(spark, d):
    """(name, ts, y, f) by month: five regions and their total; forecasts that don't add up."""
    from pyspark.sql import Window

    sales = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.date_trunc("month", "o_orderdate").alias("ts"))
    by_nation = sales.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), sales.o_custkey == F.col("c_custkey")).groupBy("c_nationkey", "ts").agg(F.sum("o_totalprice").alias("v"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("name"))
    bottom = by_nation.join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("name", "ts").agg((F.sum("v") / 1e6).alias("y"))
    both = bottom.unionByName(bottom.groupBy("ts").agg(F.sum("y").alias("y")).withColumn("name", F.lit("TOTAL")))
    before = F.lag("y", 1).over(Window.partitionBy("name").orderBy("ts"))
    return both.withColumn("f", before * F.when(F.col("name") == "TOTAL", 1.1).otherwise(1.0))


def _tree(spark, d) -> reconcile.Hierarchy:
    return reconcile.Hierarchy({"TOTAL": sorted(x[0] for x in table(spark, d, "region").select("r_name").collect())})


@query(f"""WITH {_REG}, t AS (SELECT ts, sum(CASE WHEN name = 'TOTAL' THEN f ELSE 0 END) AS top, sum(CASE WHEN name <> 'TOTAL' THEN f ELSE 0 END) AS low FROM b WHERE f IS NOT NULL GROUP BY 1 HAVING count(*) = 6),
o AS (SELECT b.ts, name, f + (top - low) / 6 AS f FROM b JOIN t USING (ts) WHERE name <> 'TOTAL' UNION ALL SELECT ts, 'TOTAL', low + 5 * (top - low) / 6 FROM t) SELECT ts, 1 AS step, name, round(f, 4) AS f FROM o""")
def reconcile_ols(spark, d):
    """The oracle is the closed form for one total of five: the gap is shared by six."""
    h = _tree(spark, d)
    own = regions(spark, d).withColumn("step", F.lit(1))
    return reconcile.reconcile(own, h, reconcile.projection(h)).filter("f is not null").withColumn("f", r("f", 4))


def _reconciled(spark, d, method):
    h = _tree(spark, d)
    own = written(regions(spark, d).withColumn("step", F.lit(1)).dropna(subset=["f"]), "regions")
    cov = reconcile.error_moments(own.select("ts", "name", "step", (F.col("y") - F.col("f")).alias("e")), h)
    out = reconcile.reconcile(own, h, {k: reconcile.projection(h, method, c) for k, c in cov.items()}).filter("f is not null")
    return out.withColumn("f", r("f", 6))


# With one constraint, the total less its parts, both methods share the gap out: by the covariances' columns, or by the parts' covariance alone.
_COV = f"""WITH {_REG}, k AS (SELECT DISTINCT ts FROM b WHERE f IS NOT NULL), nm AS (SELECT DISTINCT name FROM m),
e AS (SELECT k.ts, nm.name, coalesce(b.y - b.f, 0) AS e FROM k CROSS JOIN nm LEFT JOIN b ON b.ts = k.ts AND b.name = nm.name AND b.f IS NOT NULL),
c0 AS (SELECT x.name AS i, z.name AS j, covar_pop(x.e, z.e) AS c FROM e x JOIN e z ON x.ts = z.ts GROUP BY ALL),
gap AS (SELECT ts, sum(CASE WHEN name = 'TOTAL' THEN f ELSE -f END) AS gap FROM b WHERE f IS NOT NULL GROUP BY 1 HAVING count(*) = 6)"""


@query(_COV + """, c AS (SELECT i, j, 0.9 * c + CASE WHEN i = j THEN 0.1 * (SELECT sum(c) / 6 FROM c0 WHERE i = j) ELSE 0 END AS c FROM c0),
w AS (SELECT i, sum(CASE WHEN j = 'TOTAL' THEN c ELSE -c END) AS w FROM c GROUP BY 1), t AS (SELECT sum(CASE WHEN i = 'TOTAL' THEN w ELSE -w END) AS t FROM w)
SELECT b.ts, 1 AS step, b.name, round(b.f - w.w / t.t * gap.gap, 6) AS f FROM b JOIN gap USING (ts) JOIN w ON w.i = b.name, t""")
def reconcile_mint(spark, d):
    return _reconciled(spark, d, "mint")


@query(_COV + """, low AS (SELECT i, j, 0.9 * c + CASE WHEN i = j THEN 0.1 * (SELECT sum(c) / 5 FROM c0 WHERE i = j AND i <> 'TOTAL') ELSE 0 END AS c FROM c0 WHERE i <> 'TOTAL' AND j <> 'TOTAL'),
g AS (SELECT i, sum(c) / ((SELECT sqrt(c) FROM c0 WHERE i = 'TOTAL' AND j = 'TOTAL') + (SELECT sum(c) FROM low)) AS g FROM low GROUP BY 1),
o AS (SELECT b.ts, b.name, b.f + g.g * gap.gap AS f FROM b JOIN gap USING (ts) JOIN g ON g.i = b.name)
SELECT ts, 1 AS step, name, round(f, 6) AS f FROM o UNION ALL SELECT ts, 1, 'TOTAL', round(sum(f), 6) FROM o GROUP BY ts""")
def reconcile_bayes(spark, d):
    return _reconciled(spark, d, "bayes")


@query(f"""WITH {_REG} SELECT CASE WHEN name = 'TOTAL' THEN 0 ELSE 1 END AS level, round(avg(e), 8) AS rmse FROM (SELECT name, sqrt(avg((f - y) * (f - y))) AS e FROM b WHERE f IS NOT NULL GROUP BY 1) GROUP BY 1""")
def hierarchy_kpi(spark, d):
    levels = spark.createDataFrame([*_tree(spark, d).levels().items()], "name string, level int")
    each = metrics.score(regions(spark, d).dropna(subset=["f"]), metrics.rmse(), ["name"], "rmse")
    return rounded(each.join(F.broadcast(levels), "name").groupBy("level").agg(F.avg("rmse").alias("rmse")), "rmse")  # a row a node


@query()
def reconcile_mint_glasso(spark, d):
    return _reconciled(spark, d, "mint_glasso")


@query(f"""WITH {_REG}, o AS (SELECT name, ts, f, y - f AS e FROM b WHERE f IS NOT NULL), t AS (SELECT DISTINCT ts FROM o),
k AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM t),
s AS (SELECT t.ts, sc.scenario, CAST('0x' || substr(md5(concat_ws('/', epoch_us(t.ts), sc.scenario, 0)), 1, 12) AS BIGINT) % (SELECT max(n) FROM k) + 1 AS i FROM t, (SELECT unnest(range(20)) AS scenario) sc),
x AS (SELECT o.ts, o.name, o.f + e.e AS f FROM o JOIN s ON s.ts = o.ts JOIN k ON k.i = s.i JOIN o e ON e.ts = k.ts AND e.name = o.name)
SELECT ts, name, 1 AS step, a.alpha, round(quantile_cont(f, [0.1, 0.5, 0.9])[a.k], 4) AS q FROM x, (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) a(k, alpha) GROUP BY ts, name, a.alpha, a.k""")
def reconcile_bootstrap_quantiles(spark, d):
    own = written(regions(spark, d).withColumn("step", F.lit(1)).dropna(subset=["f"]), "regions")
    errors = own.select("ts", "name", "step", (F.col("y") - F.col("f")).alias("e"))
    drawn = reconcile.bootstrap_scenarios(own.select("ts", "name", "step", "f"), errors, 20)
    return reconcile.scenario_quantiles(drawn, LEVELS).withColumn("q", r("q", 4))


_TREE = f"""WITH {_REG}, x AS (SELECT name, ts, y, lag(y, 1) OVER (PARTITION BY name ORDER BY ts) AS x FROM m), k AS (SELECT *, CASE WHEN name = 'TOTAL' THEN name ELSE 'bottom' END AS model FROM x WHERE x IS NOT NULL),
p AS (SELECT model, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM k GROUP BY 1), b2 AS (SELECT name, ts, y, x * s + i AS f FROM k JOIN p USING (model))"""


def _tree_models(spark, d):
    """A linear model of the total, and one of all regions, on last month's sales."""
    own = Features("1h", ["name"]).add(["y"], lags=[1]).transform(regions(spark, d).select("name", "ts", "y"))
    own = written(own, "regions")
    return own, models.fit_tree(own, _tree(spark, d), ["y_lag_001"], ["y"])


@query(_TREE + " SELECT name, ts, 1 AS step, round(f, 4) AS f FROM b2")
def hierarchy_models(spark, d):
    own, fitted = _tree_models(spark, d)
    return fitted.predict(own).select("name", "ts", "step", r("f", 4).alias("f"))


@query(_TREE + """, t AS (SELECT ts, sum(CASE WHEN name = 'TOTAL' THEN f ELSE 0 END) AS top, sum(CASE WHEN name <> 'TOTAL' THEN f ELSE 0 END) AS low FROM b2 GROUP BY 1 HAVING count(*) = 6),
o AS (SELECT b2.ts, name, f + (top - low) / 6 AS f FROM b2 JOIN t USING (ts) WHERE name <> 'TOTAL' UNION ALL SELECT ts, 'TOTAL', low + 5 * (top - low) / 6 FROM t) SELECT ts, 1 AS step, name, round(f, 4) AS f FROM o""")
def hierarchy_models_reconciled(spark, d):
    own, fitted = _tree_models(spark, d)
    h = _tree(spark, d)
    out = reconcile.reconcile(fitted.predict(own), h, reconcile.projection(h)).filter("f is not null")
    return out.withColumn("f", r("f", 4))


# -- samples ---------------------------------------------------------------------------------------


_PLACE = "CAST('0x' || substr(md5(concat_ws('/', event_id, 0)), 1, 12) AS BIGINT)"


@query(f"SELECT event_id, ts FROM events ORDER BY {_PLACE}, event_id LIMIT 200")
def sample_uniform(spark, d):
    return splits.sample_rows(table(spark, d, "events").select("event_id", "ts"), 200, keys=["event_id"])


@query(f"""WITH h AS (SELECT extract(hour FROM ts) AS h, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY 1),
a AS (SELECT h, n, least(n, greatest(1, 200 * n // total)) AS s, (200 * n) % total AS rest FROM h),
b AS (SELECT h, s + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(h AS VARCHAR)) <= 200 - (SELECT sum(s) FROM a) THEN 1 ELSE 0 END AS quota FROM a),
k AS (SELECT event_id, ts, row_number() OVER (PARTITION BY extract(hour FROM ts) ORDER BY {_PLACE}, event_id) AS i FROM events)
SELECT event_id, ts FROM k JOIN b ON b.h = extract(hour FROM ts) WHERE i <= quota""")
def sample_by_hour(spark, d):
    return splits.sample_by_hour(table(spark, d, "events").select("event_id", "ts"), 200, keys=["event_id"])


@query()
def bootstrap_mean(spark, d):
    return learners.bootstrap_mean(table(spark, d, "events"), "value", 700, by=["event_type"], keys=["event_id"])


# -- stateful models --------------------------------------------------------------------------------


def _walked(spark, d, model):
    out = stateful.forecast(panel(spark, d), model)
    return out.select("name", "ts", "y", r(F.element_at("f", 1)).alias("f1"), r(F.element_at("f", -1)).alias("f_last"))


@query()
def model_holt_winters(spark, d):
    return _walked(spark, d, stateful.HoltWinters((24, 168), 8))


@query()
def model_holt_winters_multi(spark, d):
    return _walked(spark, d, stateful.bands([stateful.HoltWinters((24, 168), 6, alpha=0.3), stateful.HoltWinters((24, 168), 24, alpha=0.05)], [6, 24]))


@query()
def model_holt_winters_corrected(spark, d):
    """Trained up to the last fifth of each series' time; residuals are regressed on the value itself and the hour's wave."""
    own = panel(spark, d)
    ends = own.groupBy("name").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = F.unix_seconds("ts") < F.unix_seconds("lo") + 0.8 * (F.unix_seconds("hi") - F.unix_seconds("lo"))
    wave = F.sin(F.hour("ts") * F.lit(2 * 3.141592653589793 / 24))
    out = stateful.forecast_corrected(own.join(ends, "name").select("name", "ts", "y", wave.alias("wave"), at.alias("old")), stateful.HoltWinters((24, 168), 8), ["y", "wave"], "old")
    return out.select("name", "ts", "y", r(F.element_at("f", 1)).alias("f1"), r(F.element_at("f", -1)).alias("f_last"))


@query()
def model_fourier_smoothing(spark, d):
    return _walked(spark, d, stateful.FourierSmoothing(48, 8, 8))


@query()
def model_fourier_kalman(spark, d):
    return _walked(spark, d, stateful.FourierKalman(48, 4, 8))


@query()
def model_fourier_kalman_mix(spark, d):
    return _walked(spark, d, stateful.FourierKalmanMix(2, 48, 6, 3))


_ES = "CASE WHEN k.y IS NULL THEN s.l + 0.95 * s.b ELSE k.y END"
_ES_LEVEL = f"(0.3 * {_ES} + 0.7 * (s.l + 0.95 * s.b))"


@query(f"""WITH RECURSIVE {P_SQL.lstrip()}, k AS (SELECT name, ts, y, row_number() OVER (PARTITION BY name ORDER BY ts) AS i FROM panel),
s AS (SELECT name, i, ts, y, l, b FROM (SELECT name, 0 AS i, ts, y, coalesce(y, 0.0) AS l, 0.0::DOUBLE AS b FROM k WHERE i = 1)
  UNION ALL SELECT k.name, k.i, k.ts, k.y, {_ES_LEVEL}, 0.05 * ({_ES_LEVEL} - s.l) + 0.95 * 0.95 * s.b FROM s JOIN k ON k.name = s.name AND k.i = s.i + 1)
SELECT name, ts, y, round(l + 0.95 * b, 8) AS f1, round(l + ({' + '.join(f'0.95 ** {j}' for j in range(1, 7))}) * b, 8) AS f_last FROM s WHERE i > 0""")
def model_exponential_smoothing(spark, d):
    return _walked(spark, d, stateful.SimpleSmoothing(6))


@query()
def model_exponential_smoothing_fitted(spark, d):
    """The parameters of the least squared one-step error among those drawn, then the walk."""
    from functools import partial

    own = written(panel(spark, d), "panel")
    trials = stateful.tune(own, partial(stateful.SimpleSmoothing, 1), {"alpha": (0.01, 0.6), "beta": (0.0, 0.2)}, 8)
    return _walked(spark, d, stateful.SimpleSmoothing(6, **stateful.best(trials)))


@query()
def tune_holt_winters(spark, d):
    from functools import partial

    return stateful.tune(panel(spark, d), partial(stateful.HoltWinters, (24, 168), 1), {"alpha": (0.01, 0.5), "beta": (0.0, 0.01)}, 4)


@query(f"""WITH {P_SQL}, k AS (SELECT name, coalesce(y, 0) AS y, row_number() OVER (PARTITION BY name ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM panel),
m AS (SELECT name, f, sum(y * cos(2 * pi() * ((f * i) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((f * i) % n) / n)) ** 2 AS m FROM k, (SELECT unnest(range(5000)) AS f) WHERE f < n // 2 GROUP BY ALL),
t AS (SELECT name, f, row_number() OVER (PARTITION BY name ORDER BY m DESC, f) AS j FROM m) SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY f) AS INTEGER) AS rank, CAST(f + 1 AS INTEGER) AS frequency FROM t WHERE j <= 3""")
def top_frequencies(spark, d):
    return learners.top_frequencies(panel(spark, d), "y", 3)


# -- scenarios ---------------------------------------------------------------------------------------


def _scenarios(spark, d, n=12):
    own = written(steps_ahead(spark, d).dropna(subset=["y", "f"]), "ahead")
    q = forecasts.with_quantiles(own, forecasts.residual_quantiles(own, LEVELS))
    by_step = q.groupBy("name", "ts", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("alpha", "q"))), lambda x: x["q"]).alias("qs"))
    full = by_step.groupBy("name", "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "qs"))), lambda x: x["qs"]).alias("q")).filter(F.size("q") == 3)
    errors = own.withColumn("e", F.col("y") - F.col("f")).groupBy("ts", "name").pivot("step", [1, 2, 3]).agg(F.first("e")).toDF("ts", "name", "e1", "e2", "e3")
    corr = scenarios.hourly_correlation(errors, ["e1", "e2", "e3"], method="shrunk")
    return scenarios.sample(full, corr, LEVELS, n, by=("name", "ts"))


@query()
def corr_glasso(spark, d):
    own = steps_ahead(spark, d).dropna(subset=["y", "f"]).withColumn("e", F.col("y") - F.col("f")).groupBy("ts", "name").pivot("step", [1, 2, 3]).agg(F.first("e")).toDF("ts", "name", "e1", "e2", "e3")
    return rounded(scenarios.hourly_correlation(written(own, "errors"), ["e1", "e2", "e3"], method="glasso_cv"), "r")


def _uncertain(spark, d):
    plan = Features("1h", ["name"]).add(["y"], lags=[0, 23]).add_target(["y"], lags=[-1, -2, -3])
    own = written(plan.transform(panel(spark, d)).withColumnsRenamed({f"y_lag_-{k:03d}": f"t{k}" for k in (1, 2, 3)}), "lagged")
    return own, models.fit_uncertain(own, ["y_lag_000", "y_lag_023"], ["t1", "t2", "t3"], alphas=LEVELS)


@query()
def model_scenarios(spark, d):
    own, fitted = _uncertain(spark, d)
    return fitted.scenarios(own, 8).select("name", "ts", "scenario", F.transform("path", lambda v: F.round(v, 4)).alias("path"))


@query()
def model_trees_online(spark, d):
    own, fitted = _uncertain(spark, d)
    return rounded(fitted.trees(own, [1, 2, 4], 8), "p", "v")


@query()
def model_trees_offline(spark, d):
    """24 trees of the errors made once, each row's hour's with its forecast added."""
    own, fitted = _uncertain(spark, d)
    return rounded(fitted.trees(own, [1, 2, 4], 8, hourly=fitted.hourly_trees([1, 2, 4], 40)), "p", "v")


@query(f"""WITH {R_SQL}, t(node, parent, step, p, v) AS (VALUES (0, -1, 0, 1.0, 0.0), (1, 0, 1, 0.25, -8.0), (2, 0, 1, 0.75, 8.0), (3, 2, 2, 0.75, 2.0))
SELECT name, ts, node, round(t.v * (1 + extract(hour FROM ts)) + f, 8) AS v FROM ahead a JOIN t ON t.step = a.step - 1 WHERE f IS NOT NULL""")
def tree_superimposed(spark, d):
    nodes = spark.createDataFrame([(0, -1, 0, 1.0, 0.0), (1, 0, 1, 0.25, -8.0), (2, 0, 1, 0.75, 8.0), (3, 2, 2, 0.75, 2.0)], "node int, parent int, step int, p double, v double")
    hours = nodes.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("v", F.col("v") * (1 + F.col("hour")))
    f = steps_ahead(spark, d).filter("f is not null").select("name", "ts", F.hour("ts").alias("hour"), (F.col("step") - 1).alias("step"), "f")
    return rounded(scenarios.superimpose(hours, f, on=("hour", "step")).select("name", "ts", "node", "v"), "v")


@query()
def copula_scenarios(spark, d):
    return _scenarios(spark, d).select("name", "ts", "scenario", F.transform("path", lambda v: F.round(v, 4)).alias("path"))


def _trees(spark, d, kind):
    return rounded(scenarios.trees(_scenarios(spark, d), [1, 2, 4], kind=kind, by=("name", "ts")), "p", "v")


@query()
def tree_scenred(spark, d):
    return _trees(spark, d, "scenred")


@query()
def tree_quantiles(spark, d):
    return _trees(spark, d, "quantiles")


@query()
def tree_neural_gas(spark, d):
    return _trees(spark, d, "neural_gas")


@query()
def tree_gradient(spark, d):
    return _trees(spark, d, "gradient")


@query()
def tree_leaf_paths(spark, d):
    return scenarios.leaf_paths(written(_trees(spark, d, "scenred"), "trees"), 3, by=("name", "ts"))


# -- learners ----------------------------------------------------------------------------------------


def _lagged(spark, d, steps=2):
    plan = Features("1h", ["name"]).add(["y"], lags=[0, 1, 23]).add(["y"], ["mean"], "6h").add_target(["y"], lags=[-k for k in range(1, steps + 1)]).add_time_features()
    out = plan.transform(panel(spark, d))
    return written(out.withColumnsRenamed({f"y_lag_-{k:03d}": f"t{k}" for k in range(1, steps + 1)}), "lagged"), ["y_lag_000", "y_lag_001", "y_lag_023", "y_6h_mean", "hour"]


@query()
def model_ridge(spark, d):
    df, x = _lagged(spark, d)
    return rounded(forecasts.fit_ridge(df, x, ["t1", "t2"]).predict(df).select("name", "ts", "t1_hat", "t2_hat"), "t1_hat", "t2_hat")


@query()
def model_boosted(spark, d):
    df, x = _lagged(spark, d)
    return rounded(learners.fit_boosted(df, x, ["t1"], trees=5).predict(df).select("name", "ts", "t1_hat"), "t1_hat")


@query()
def model_hybrid(spark, d):
    df, x = _lagged(spark, d, 3)
    return rounded(learners.fit_hybrid(df, x, ["t1", "t2", "t3"], 1, trees=5).predict(df).select("name", "ts", "step", "f"), "f")


@query()
def model_energy_aware(spark, d):
    df, x = _lagged(spark, d)
    df = df.withColumn("force_off", (F.col("hour") < 6).cast("double"))
    keys = df.select("name", "ts", *x, "force_off", "t1", "t2")
    return rounded(learners.fit_energy_aware(keys, [*x, "force_off"], ["t1", "t2"], ["force_off"], trees=3).predict(keys).select("name", "ts", "t1_hat", "t2_hat"), "t1_hat", "t2_hat")


@query()
def model_quantile_forest(spark, d):
    df, x = _lagged(spark, d)
    return rounded(learners.fit_quantile_forest(df, x, "t1", trees=5).predict(df, LEVELS, ["name", "ts"]), "q")


@query()
def model_random_features(spark, d):
    df, x = _lagged(spark, d)
    return rounded(learners.fit_random_features(df, x, ["t1"], n=12, std=0.5, kind="orf").predict(df).select("name", "ts", "t1_hat"), "t1_hat")


@query()
def model_additive_random_features(spark, d):
    df, x = _lagged(spark, d)
    return rounded(learners.predict_additive(df, learners.fit_additive(df, x, "t1", rounds=2, n=8, std=0.5), "f").select("name", "ts", "f"), "f")


@query()
def model_binned(spark, d):
    df, x = _lagged(spark, d)
    return rounded(learners.fit_binned(df, x, "t1").predict(df, "f").select("name", "ts", "f"), "f")


@query()
def model_network(spark, d):
    df, x = _lagged(spark, d)
    return learners.fit_network(df, x, "t1", epochs=10, loss="normal").predict(df, x).select("name", "ts", r("f", 3).alias("f"), r("sigma", 3).alias("sigma"))


@query()
def cross_validate_ridge(spark, d):
    df, x = _lagged(spark, d, 1)
    lo, hi = df.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()

    def loss(model, test):
        return float(model.predict(test).agg(F.sqrt(F.avg((F.col("t1_hat") - F.col("t1")) ** 2))).first()[0])

    trials = learners.search(df, lambda train, p: forecasts.fit_ridge(train, x, ["t1"], [p["alpha"]]), loss, {"alpha": (0.01, 100.0)}, splits.time_folds(lo, hi, 3, dead=82_800_000_000), trials=2)
    return spark.createDataFrame(learners.summarize_trials(trials))


@query()
def distribution_scores(spark, d):
    """Closed-form CRPS of normal and log-normal forecasts, and the normal's likelihood."""

    @F.pandas_udf("struct<crps: double, nll: double, log_crps: double>")
    def scores(y: pd.Series, m: pd.Series) -> pd.DataFrame:
        sigma = np.full(len(y), 20.0)
        return pd.DataFrame({"crps": agg.normal_crps(y, m, sigma), "nll": agg.normal_nll(y, m, sigma), "log_crps": agg.lognormal_crps(y + 1, np.maximum(m, 1), sigma**2)})

    return forecast_pairs(spark, d).withColumn("s", scores("y", "f")).select("name", "ts", *[r(F.col(f"s.{c}")).alias(c) for c in ("crps", "nll", "log_crps")])


# -- streams -----------------------------------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, event_type, round(avg(value), 8) AS y, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def stream_resample(spark, d):
    stream = streams.resample_stream(streams.read_events(spark, d), "6 hours", {"y": F.avg("value"), "n": F.count("*")}, by=["event_type"])
    return rounded(streams.run_to_table(stream, "stream", "complete"), "y")


@query()
def stream_holt_winters(spark, d):
    events = streams.read_events(spark, d).select(F.col("event_type").alias("name"), "ts", F.col("value").alias("y"))
    return streams.run_to_table(streams.stateful_forecast(events, stateful.HoltWinters((24, 168), 1)), "stream-hw")

