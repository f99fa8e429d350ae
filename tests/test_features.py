import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.durations import function_name, micros, readable
from tidemark.operators.holidays import codes, easter
from tidemark.plans.features import Features


def test_durations():
    assert micros("1d12h") == 36 * 3_600_000_000 and micros("20min") == micros("20T") and micros("30S") == 30_000_000
    assert readable(micros("1d2h3m4s")) == "1d2h3m4s" and readable(micros("3h")) == "3h" and readable(0) == "0s"
    assert readable(micros("3h"), padded=True) == "00d03h00m00s"
    with pytest.raises(ValueError):
        micros("3 parsecs")


def test_function_name():
    from functools import partial

    assert function_name("mean") == "mean" and function_name(partial(math.pow, 2)) == "pow"


def test_easter_and_codes():
    from datetime import date

    assert [easter(y) for y in (2000, 2019, 2024, 2038)] == [date(2000, 4, 23), date(2019, 4, 21), date(2024, 3, 31), date(2038, 4, 25)]
    days = codes("CH", date(2024, 5, 1), date(2024, 5, 31))
    assert days[date(2024, 5, 9)] == 3 and days[date(2024, 5, 10)] == 1
    assert date(2024, 5, 30) not in days and codes("CH", date(2024, 5, 1), date(2024, 5, 31), "TI")[date(2024, 5, 30)] == 3
    assert codes("DE", date(2024, 8, 1), date(2024, 8, 31), "BY")[date(2024, 8, 15)] == 3


def series(spark, n=60, step=3600):
    return spark.range(n).select(F.timestamp_seconds(F.col("id") * step).alias("ts"), F.col("id").cast("double").alias("y"))


def test_buckets_change_nothing(spark):
    plan = lambda b: Features("1h", bucket=b).add(["y"], lags=[1, -2]).add(["y"], ["mean"], "5h", lags=[0, 3]).add(["y"], ["max"], bins=[6, 2])
    one, cut = (plan(b).transform(series(spark)).orderBy("ts").collect() for b in (None, "7h"))
    assert one == cut and len(one) > 40


def test_metadata_without_data():
    plan = Features("1h").add(["y"], ["mean"], "3h", lags=[0, 2], relative=True).add_target(["y"], lags=[-1, -3])
    assert plan.feature_names() == ["y_3h_mean_lag_000", "y_3h_mean_lag_002"]
    assert plan.target_names() == ["y_lag_-001", "y_lag_-003"]
    h = micros("1h")
    assert plan.time_limits() == {"y": (-9 * h, 3 * h)}
    assert Features.from_json(plan.to_json()).metadata() == plan.metadata()


def test_non_anticipative(spark):
    """Columns of the past don't change when the future does."""
    plan = Features("1h").add(["y"], lags=[1, 5]).add(["y"], ["mean", "std"], "4h").add(["y"], ["min"], bins=[8, 4, 1])
    a = series(spark)
    b = a.withColumn("y", F.when(F.col("ts") > F.timestamp_seconds(F.lit(30 * 3600)), 99.0).otherwise(F.col("y")))
    cut = lambda d: plan.transform(d).filter(F.col("ts") <= F.timestamp_seconds(F.lit(30 * 3600))).orderBy("ts").collect()
    assert cut(a) == cut(b)


def test_targets_must_not_look_back():
    with pytest.raises(ValueError):
        Features("1h").add_target(["y"], lags=[1])


def test_callable_aggregate(spark):
    def spread(values):
        return F.array_max(values) - F.array_min(values)

    out = Features("1h").add(["y"], [spread], "3h").transform(series(spark, 10)).collect()
    assert {r.y_3h_spread for r in out} == {2.0}


def test_pruning():
    plan = Features("1h").add(["y"], lags=range(31)).add_target(["y"], lags=[-6])
    assert plan.kept_at_step("y_lag_-006", last_lags=2) == ["y_lag_000", "y_lag_001", "y_lag_018"]
    assert len(plan.kept_at_step("y_lag_-006", method="up_to")) == 31


def test_layers_share_one_exchange(spark):
    plan = Features("1h", ["k"]).add(["y"], lags=[1, 2]).add(["y"], ["mean"], "3h", lags=[1]).add(["y"], ["max"], bins=[4, 2])
    df = plan.transform(series(spark).withColumn("k", F.col("ts").cast("string").substr(1, 4)))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
