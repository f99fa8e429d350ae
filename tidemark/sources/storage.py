"""Files between steps: in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder is set only where there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut, and nothing is computed twice."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """A model's parameters as one JSON line, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(parameters),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
