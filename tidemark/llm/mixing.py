"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Within a source every document has the same expected copies, target / size of the source. The documents stand in the
order of (size, md5 of doc_id, doc_id, text); the prefix sum of expected copies at rank k is then rate * k. With one offset u
a source, a document gives a copy for each integer that the prefix sum plus u crosses at it. As the order is by
size, the words taken differ from the target by at most about the size of the source's longest document.

Ranks come from counts: of (source, size) over the sizes of the source, of 256 slices by md5 within a size, and rows
within a slice. So no task ever orders a whole source, or a whole group of copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Sources beyond this are joined by Spark's own choice instead of a broadcast.
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row a source from (source, size): source_size, n_docs, target, rate, offset.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at max_repeat times
    the source's size and its excess goes to the others by weight. With the sources in the order of cap / weight those
    that stop come first, so the level of the rest follows from sums over that order.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    weighed = totals.withColumn("place", F.row_number().over(by_name) - 1).select(
        "source", "source_size", "n_docs", (F.col("source_size") * max_repeat).alias("cap"),
        F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    )
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    open_at = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level0"))
    return (
        levels.withColumn("level0", open_at["level"])
        .withColumn("target", target)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0)
        .select("source", "source_size", "target", "rate", "offset")
    )


def copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, *, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row, and the columns of ``keep``.

    A null or blank text has size 0; it gives copies as the others, but takes no words. Rows of one doc_id are documents of their own.
    """
    sized = docs.select(
        *[F.col(c).alias(f"kept_{c}") for c in keep], F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("tie"),
    )
    sized = common.written(sized, "sized")
    thin = sized.withColumn("slice", F.substring("h", 1, 2)).withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    slices = thin.groupBy("src", "size", "slice").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    of_sizes = slices.groupBy("src", "size").agg(F.sum("n").alias("n"))
    over_sizes = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    size_base = of_sizes.select(F.col("src"), F.col("size"), F.coalesce(F.sum("n").over(over_sizes), F.lit(0)).alias("size_base"))
    bases = slices.withColumn("slice_base", F.coalesce(F.sum("n").over(in_size), F.lit(0))).join(size_base, ["src", "size"]).select("src", "size", "slice", (F.col("size_base") + F.col("slice_base")).alias("base"))
    in_slice = Window.partitionBy("src", "size", "slice").orderBy("h", "doc_id", "tie")
    ranked = thin.withColumn("k", F.row_number().over(in_slice)).join(bases, ["src", "size", "slice"]).withColumn("k", F.col("k") + F.col("base"))
    targets = common.written(source_targets(sized, weights, max_repeat), "targets").withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")
    crossed = F.floor(F.col("rate") * F.col("k") + F.col("offset")) - F.floor(F.col("rate") * (F.col("k") - 1) + F.col("offset"))
    out = ranked.join(common.small(targets, MAX_BROADCAST_SOURCES), "src").withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"kept_{c}") for c in keep])


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mixed documents themselves: each row once per copy, with the columns it came with."""
    cols = docs.columns
    out = copies(docs, weights, max_repeat, keep=cols)
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"kept_{c}").alias(c) for c in cols])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 3 AS cap, 1 + (ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM totals),
levels AS (
  SELECT *, CAST((SUM(source_size) OVER ()) - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(SUM(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
level0 AS (SELECT level FROM levels WHERE cap >= weight * level ORDER BY cap / weight, encode(source) NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, LEAST(CAST(cap AS DOUBLE), weight * (SELECT level FROM level0)) AS target,
    CAST(CAST('0x' || substr(md5(COALESCE(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS off FROM levels),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS k FROM sized),
counted AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.source, t.off, r.k, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
crossed AS (SELECT *, LEAST(CAST(floor(rate * k + off) - floor(rate * (k - 1) + off) AS BIGINT), 3) AS copies FROM counted)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM crossed
"""
