"""Session and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def clean(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants and NaN becomes NULL, which Spark's aggregates skip as pandas skips NaN."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((c.cast("timestamp") if kind == "timestamp_ntz" else F.when(~F.isnan(c), c) if kind in ("double", "float") else c).alias(name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
