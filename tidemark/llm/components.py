"""Connected components of a table of links; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component's id is its smallest node.

    Every round a node takes the smallest label among its own and its neighbours', then its label's label. Stars, which
    is what near-duplicate links mostly are, need two or three rounds, chains a number that grows with the log of their length
    at best. An empty table gives an empty one.
    """
    both = common.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = common.written(lower.join(jump, "component").select("node", F.least("component", "further").alias("component"), "was"), "labels")
        if not new.filter("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
