"""Scores over long frames: one row a time and target, with ``y`` (truth), ``f`` (forecast), and ``q`` for the forecast of quantile ``alpha``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .quantiles import exact_quantiles


def error() -> Column:
    return F.col("f") - F.col("y")


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mape() -> Column:
    return F.avg(F.abs(error()) / (F.abs("y") + 1e-5))


def score(df: DataFrame, metric: Column, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(metric.alias(name))


def nmae(df: DataFrame, by: Sequence[str], *, row: Sequence[str] = ("ts",), inter_normalization: bool = True) -> DataFrame:
    """Errors relative to the row's mean size, which is lifted by a hundredth of its median over the rows."""
    sizes = df.groupBy(*row).agg(F.avg(F.abs("y")).alias("size"))
    if inter_normalization:
        off = exact_quantiles(sizes, "size", [0.5]).select((0.01 * F.col("_q")[0] + 1e-12).alias("off"))
        sizes = sizes.crossJoin(F.broadcast(off))  # one row
    else:
        sizes = sizes.withColumn("off", F.lit(1e-12))
    return df.join(sizes, list(row)).groupBy(*by).agg(F.avg(F.abs(error()) / (F.col("size") + F.col("off"))).alias("nmae"))


def _excess() -> Column:
    return F.col("q") - F.col("y")


def _below() -> Column:
    return F.when(_excess() > 0, 1.0).when(_excess() <= 0, 0.0)


def pinball() -> Column:
    return F.avg((_below() - F.col("alpha")) * _excess())


def reliability(*, minus_alpha: bool = False) -> Column:
    return F.avg(_below() - F.col("alpha")) if minus_alpha else F.avg(_below())


def crps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean pinball loss over the levels."""
    return df.groupBy(*by, "alpha").agg(pinball().alias("loss")).groupBy(*by).agg(F.avg("loss").alias("crps"))


def quantile_bins(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Right-closed bins between n + 1 quantiles, the first one closed on both sides; numbered from 0. The cut points are one row."""
    cuts = exact_quantiles(df, col, [i / n for i in range(1, n)]).withColumnRenamed("_q", "_cuts")
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col(col).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(col))))).drop("_cuts")


def summary(df: DataFrame, metrics: dict[str, Column], keys: Sequence[str], *, most: int = 10, mask: Column | None = None) -> DataFrame:
    """(key, group, metric, value): every metric by every key. Continuous keys of ``most`` or more values are cut into deciles; ``mask`` picks the entries that count."""
    if mask is not None:
        df = df.filter(mask)
    out = None
    for key in keys:
        own = df
        if dict(df.dtypes)[key] in ("double", "float") and df.select(key).distinct().limit(most).count() >= most:
            own = quantile_bins(df, key, 10, "_group").drop(key).withColumnRenamed("_group", key)
        part = own.groupBy(F.col(key).cast("string").alias("group")).agg(*[c.alias(n) for n, c in metrics.items()]).unpivot(["group"], list(metrics), "metric", "value").withColumn("key", F.lit(key))
        out = part if out is None else out.unionByName(part)
    return out.select("key", "group", "metric", "value")


def histogram_2d(df: DataFrame, value: str, x: str, y: str, n: int = 4) -> DataFrame:
    """Mean of value in the cells of x's and y's quantiles; a column for each cell of y, 0 where there is nothing."""
    cells = quantile_bins(quantile_bins(df, x, n, "x_cell"), y, n, "_y")
    wide = cells.groupBy("x_cell").pivot("_y", list(range(n))).agg(F.avg(value)).fillna(0.0)
    return wide.select("x_cell", *[F.col(str(i)).alias(f"y_{i}") for i in range(n)])


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z scores by the population's deviation; a constant column has scale 1."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}).select(*df.columns)


def outlier_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum of squared z scores of each row."""
    z = standardize(df.withColumns({f"_z_{c}": F.col(c) for c in cols}), [f"_z_{c}" for c in cols])
    return z.withColumn("outlier", sum((F.coalesce(F.col(f"_z_{c}"), F.lit(0.0)) ** 2 for c in cols), F.lit(0.0))).select(*df.columns, "outlier")


def without_outliers(df: DataFrame, cols: Sequence[str], share: float) -> DataFrame:
    """Without the ``share`` of rows that score highest; the cut is a quantile found by counting, so nothing is sorted as a whole."""
    scored = outlier_scores(df, cols)
    cut = exact_quantiles(scored, "outlier", [1 - share]).select(F.col("_q")[0].alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).filter(F.col("outlier") <= F.col("_cut")).select(*df.columns)


def dense_rank(df: DataFrame, col: str, *, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(col)))


def shrunk_types(df: DataFrame) -> dict[str, str]:
    """The smallest type that strictly holds each numeric column's range; one aggregate over the table."""
    # The limits of the integer types
    limits = (("tinyint", 127), ("smallint", 32767), ("int", 2147483647))
    ints = [c for c, t in df.dtypes if t in ("smallint", "int", "bigint")]
    floats = [c for c, t in df.dtypes if t == "double"]
    if not ints + floats:
        return {}
    r = df.agg(*[f(c).alias(f"{p}{c}") for c in ints + floats for p, f in (("lo_", F.min), ("hi_", F.max))]).first()
    out = {}
    for c in ints:
        if r[f"lo_{c}"] is not None and (t := next((t for t, m in limits if -m - 1 < r[f"lo_{c}"] and r[f"hi_{c}"] < m), None)):
            out[c] = t
    out |= {c: "float" for c in floats if r[f"lo_{c}"] is not None and max(abs(r[f"lo_{c}"]), abs(r[f"hi_{c}"])) < 3.4e38}
    return out


def shrink(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in shrunk_types(df).items()})


def categorical_columns(df: DataFrame, most: int = 24) -> list[str]:
    """Columns of at most so many distinct values. A sketch first leaves out those that surely have more, so that distinct values are
    only counted, and shuffled, of columns that have few."""
    about = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in df.columns]).first()
    few = [c for c in df.columns if about[c] <= 2 * most]
    r = df.agg(*[F.count_distinct(c).alias(c) for c in few]).first() if few else {}
    return [c for c in few if r[c] <= most]


def encode_labels(df: DataFrame, col: str, out: str, seen: DataFrame | None = None) -> DataFrame:
    """The place of each value among the sorted distinct ones of ``seen`` (default: df's own); one that wasn't seen is an error."""
    labels = written((df if seen is None else seen).select(F.col(col).cast("string").alias("_v")).dropna().distinct(), "labels")
    # places by counting what is in the range partitions before; no task holds all labels
    parts = labels.repartitionByRange("_v").sortWithinPartitions("_v").select("_v", F.spark_partition_id().alias("_p"))
    parts = written(parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_v"))), "places")
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, base = 0, []
    for p, n in sizes:
        base.append((p, before))
        before += n
    bases = df.sparkSession.createDataFrame(base, "_p int, _b long")
    coded = parts.join(F.broadcast(bases), "_p").select("_v", (F.col("_b") + F.col("_k") - 1).cast("int").alias(out))
    joined = df.join(coded, df[col].cast("string") == F.col("_v"), "left").drop("_v")
    return joined.withColumn(out, F.when(F.col(col).isNull() | F.col(out).isNotNull(), F.col(out)).otherwise(F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string")))))


def target_encode(df: DataFrame, col: str, target: str, out: str, *, smooth: float = 10.0) -> DataFrame:
    """Mean target of a category, drawn to the overall mean by ``smooth`` rows' weight."""
    whole = df.agg(F.avg(target).alias("_all"))
    means = df.groupBy(col).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n")).crossJoin(F.broadcast(whole))
    means = means.select(F.col(col).alias("_key"), ((F.col("_sum") + smooth * F.col("_all")) / (F.col("_n") + smooth)).alias(out))
    return df.join(means, df[col].eqNullSafe(F.col("_key")), "left").drop("_key")
