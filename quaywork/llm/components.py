"""Connected components of a table of links, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for every id in the links (``a``, ``b``); both are long.

    Alternates two rewrites that keep connectivity: each node hands its larger neighbours to its smallest neighbour,
    then its smaller ones. A path of n nodes becomes a star in O(log n) rounds. Neighbourhoods are only ever reduced to
    a minimum (pre-aggregated before the shuffle) and joined back, so a node with very many links is never gathered.
    Nulls, loops and repeated links are ignored; no links give an empty table.
    """
    spark = links.sparkSession
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    while state["n"]:
        # each node's larger neighbours go to the smallest node near it
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # each node's smaller neighbours go to the smallest of them, which keeps a link to the node itself
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    if not state["n"]:
        return spark.createDataFrame([], "id long, component long")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
