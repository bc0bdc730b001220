"""Connected components by alternating large and small stars; no link or node list comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links go from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    inner = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component: smallest node reachable) for every node of links (a long, b long) but the smallest ones.

    Links to itself, repeated and null ends are ignored. Each round cuts lineage by a table in the shared folder.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, "links"), None
    while True:
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before or digest[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = digest
        now = materialize(_small_star(_large_star(now)), "links")
