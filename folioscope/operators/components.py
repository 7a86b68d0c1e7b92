"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import delete, materialise_at, new_path


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(mixed, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(mixed, 33))).head())


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Each node links its neighbours (large: those above it; small: those below and itself) to their minimum."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(low, "u")
    moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if both else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)`` (longs); the component is its smallest node.

    Each step is written to the shared folder.  The number of steps grows with the logarithm of the
    longest chain; nothing but three sums a step reaches the driver.
    A round's table is deleted once the next is written.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = materialise_at(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    state = _state(now)
    while state[0]:
        before, path = path, new_path(spark, "edges")
        now = materialise_at(_star(_star(now, True), False), path)
        delete(before)
        new = _state(now)
        if new == state:
            break
        state = new
    below = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return below.unionByName(below.select(F.col("component").alias("node"), "component").distinct())
