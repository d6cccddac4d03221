"""Connected components by alternating large-star and small-star steps.

Each step takes the least neighbour of a node by an aggregation that combines on the map side and joins it back,
so a node with very many links costs no task more than others once Spark splits skewed joins.  Joins are sorted merges: a broadcast
would build each round's table on the driver.  The links are written to
the shared checkpoint folder after each round; only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (u, v) of longs to (node, root), root the least node of the component; nodes without links are left out."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = _mark(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.filter("u <> v").distinct())
        now = _mark(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
