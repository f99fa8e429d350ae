"""Shared storage, tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where the session names
    none (tests, one machine) is a temporary folder set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. What executors lose later is read back from
    the files; nothing upstream is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a written table only where a count proves it within max_rows; beyond, Spark's own choice of join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def remainder(col: str, n: int) -> Column:
    return F.crc32(F.col(col).cast("string")) % n


def only(df: DataFrame, *cols: str) -> DataFrame:
    """Just these columns: whatever else the table carries can't clash with what an operator adds."""
    return df.select(*cols)


def parts(batch, text: int, rows: int = 256, size: int = 8_000_000):
    """Slices of an Arrow batch of at most so many rows, and bytes of text unless a single text has more: what a worker works on at a time
    is bounded, however long the texts are."""
    import pyarrow.compute as pc

    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().tolist()):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


# -- what a worker holds --------------------------------------------------------------------------

_REMEMBERED: dict[str, dict] = {}


def remembered(name: str, held: dict) -> dict:
    """``held``, which a worker keeps between tasks, known by a name for ``lean``."""
    _REMEMBERED[name] = held
    return held


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library keep it for themselves."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(work: Callable, *keeps: str) -> Callable:
    """``work`` over batches, in a worker that other operators used before and will use after: of what is remembered there it finds that
    of ``keeps`` alone, and what it frees goes back to the system."""

    def run(batches):
        forget_but(keeps)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def forget_but(keeps: tuple[str, ...]) -> None:
    for name, held in _REMEMBERED.items():
        if name not in keeps:
            held.clear()


# -- files beside Spark's own ---------------------------------------------------------------------


def file_system(uri: str):
    """pyarrow's file system and path for a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks) -> None:
    where, path = file_system(uri)
    where.create_dir(str(Path(path).parent), recursive=True)
    with where.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)


@contextmanager
def mapped_file(uri: str):
    """A local path to memory-map: the file itself in a mounted folder, else a copy that goes afterwards."""
    from pyarrow import fs

    where, path = file_system(uri)
    if isinstance(where, fs.LocalFileSystem):
        yield path
        return
    with tempfile.TemporaryDirectory() as local:
        target = f"{local}/file"
        with where.open_input_stream(path) as src, open(target, "wb") as dst:
            shutil.copyfileobj(src, dst, 1 << 20)
        yield target
