"""Structured Streaming: resampling with a watermark, and stateful models fed by a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import clean
from ..sources.storage import shared


def read_events(spark: SparkSession, sf_dir: str, name: str = "events", *, files_per_batch: int = 1) -> DataFrame:
    """A table's file as a stream of the same schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return clean(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def resample_stream(events: DataFrame, step: str, aggs: dict[str, Column], *, late: str = "1 hour", by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Windows of event time, tumbling or sliding; rows later than ``late`` are dropped by the watermark, state is dropped with it."""
    window = F.window("ts", step, slide) if slide else F.window("ts", step)
    out = events.withWatermark("ts", late).groupBy(window.alias("_w"), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("_w.start").alias("ts"), *by, *aggs)


def stateful_forecast(events: DataFrame, model, *, y: str = "y", by: str = "name") -> DataFrame:
    """(name, ts, y, f1): the model's one-step forecast after each value; its state is the group's state between batches.

    Values of one batch are taken in time order; a series' values must not come earlier than those of a batch before.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else None
        pdf = pd.concat(list(frames)).sort_values("ts")  # one series' rows of one batch
        out = []
        for v in pdf[y].to_numpy("f8"):
            state = state or model.start(float(v) if np.isfinite(v) else 0.0)
            state, f = model.step(state, float(v))
            out.append(float(f[0]))
        group.update((json.dumps(state),))
        yield pd.DataFrame({by: key[0], "ts": pdf.ts, "y": pdf[y], "f1": out})

    return events.groupBy(by).applyInPandasWithState(run, f"{by} string, ts timestamp, {y} double, f1 double", "state string", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the source has now, written below the shared folder; in complete mode the last batch is the result."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is tried again overwrites what it wrote."""
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/{number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
