"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, saved


#: Links that one task takes at least: small graphs are worked on in few tasks.
LINKS = 100_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Every node links its larger (or its other, not larger) neighbours to the smallest node that it knows."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.repartition(tasks, "u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").repartition(tasks, "u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes in ``links`` (``u``, ``v``)."""
    edges, before = saved(links.filter("u <> v").select("u", "v").distinct()), None
    most = partitions(links.sparkSession)
    tasks = max(1, min(most, edges.count() // LINKS))
    while True:
        edges = saved(_star(_star(edges, True, tasks), False, tasks))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
