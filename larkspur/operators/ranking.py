"""Weights, conformers, folds and learning curves as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import ranked, seeded


def normalised_weights(df: DataFrame, by: list[str], rho: str, tie: list[str]) -> DataFrame:
    """rho over its sum in the group, and the place in descending order."""
    g = Window.partitionBy(*by)
    out = df.withColumn("rho", F.col(rho) / F.sum(rho).over(g))
    return out.withColumn("place", F.row_number().over(g.orderBy(F.desc("rho"), *tie)))


def cut_weights(df: DataFrame, by: list[str], rho: str, tie: list[str], cut: float) -> DataFrame:
    """Take ``cut`` off the smallest weights: with weights descending, K is the last place whose k rho_k + rest_k exceeds the cut;
    the first K stay, each less by an equal share of what the rest does not cover, at 0 the least, and are normalised again.  A group of one only
    is normalised."""
    g = Window.partitionBy(*by)
    r = normalised_weights(df, by, rho, tie)
    run = F.sum("rho").over(g.orderBy(F.desc("rho"), *tie).rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("run", run).withColumn("size", F.count("*").over(g))
    r = r.withColumn("rest", F.greatest(F.lit(0.0), 1 - F.col("run"))).withColumn("est", F.col("place") * F.col("rho") + F.col("rest"))
    last = F.max(F.when(F.col("est") > cut, F.col("place"))).over(g)
    r = r.withColumn("last", F.when(F.col("size") == 1, F.lit(1)).otherwise(F.coalesce(last, F.lit(1))))
    r = r.withColumn("left", F.max(F.when(F.col("place") == F.col("last"), F.col("rest"))).over(g)).filter("place <= last")
    trim = F.when(F.col("size") == 1, F.col("rho")).otherwise(F.greatest(F.lit(0.0), F.col("rho") - (F.lit(cut) - F.col("left")) / F.col("last")))
    r = r.withColumn("trimmed", trim)
    return r.withColumn("rho", F.col("trimmed") / F.sum("trimmed").over(g)).drop("run", "size", "rest", "est", "last", "left", "trimmed")


def best(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def boltzmann(df: DataFrame, by: list[str], energy: str, kt: float) -> DataFrame:
    """Weights exp(-E/kT), normalised; energies are taken from the least so that nothing overflows."""
    g = Window.partitionBy(*by)
    w = F.exp(-(F.col(energy) - F.min(energy).over(g)) / kt)
    return df.withColumn("_w", w).withColumn("rho", F.col("_w") / F.sum("_w").over(g)).drop("_w")


def prefix_ranges(df: DataFrame, order: str, size: str, buckets: int = 4096) -> DataFrame:
    """Exclusive running sums over an integer column: where each row's segment begins and ends.

    Ranges of ``order`` are cut twice, into ``buckets`` wide ones of ``buckets`` narrow ones each, by its least and greatest value; wide ones are added up first, narrow ones inside a
    wide one, rows inside a narrow one, so that no task orders all rows or all ranges.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets**2))
    narrow = F.floor((F.col(order) - F.lit(low or 0)) / width)
    parts = df.withColumns({"_part": narrow, "_wide": F.floor(narrow / buckets)})
    sums = parts.groupBy("_wide", "_part").agg(F.sum(size).alias("_s"))
    before = Window.unboundedPreceding
    wide = sums.groupBy("_wide").agg(F.sum("_s").alias("_w")).select("_wide", F.coalesce(F.sum("_w").over(Window.orderBy("_wide").rowsBetween(before, -1)), F.lit(0)).alias("_b"))
    offsets = sums.join(wide, "_wide").select("_part", (F.col("_b") + F.coalesce(F.sum("_s").over(Window.partitionBy("_wide").orderBy("_part").rowsBetween(before, -1)), F.lit(0))).alias("_before"))
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy(order).rowsBetween(before, 0))
    return parts.withColumn("_in", inside).join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_in") - F.col(size)).alias("lower"), (F.col("_before") + F.col("_in")).alias("upper")
    )


def folds(df: DataFrame, key: str, n: int, ratio: float = 0.5) -> DataFrame:
    """Repeated random splits: each of n folds orders the keys anew; the first ``ratio`` of them train."""
    keys = df.select(key).distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = ranked(keys, ["fold"], seeded(F.col("fold"), F.col(key)), [key])
    return r.select(key, "fold", (F.col("rank") < F.floor(F.col("n") * ratio)).alias("train"))


def learning_subsets(df: DataFrame, key: str, sizes: list[int], most: int = 8) -> DataFrame:
    """(size, subset, key): for each size one seeded order, cut into disjoint slices, of which at most ``most`` are used: the number of repetitions of a learning curve."""
    s = df.select(key).distinct().withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    s = ranked(s, ["size"], seeded(F.col("size"), F.col(key)), [key]).withColumn("subset", F.floor(F.col("rank") / F.col("size")))
    return s.filter((F.col("subset") < F.floor(F.col("n") / F.col("size"))) & (F.col("subset") < most)).select("size", "subset", key)


def learning_curve(errors: DataFrame, loss=None) -> DataFrame:
    """(size, mean, std): mean and population deviation over subsets of the loss of (size, subset, err)."""
    loss = loss or (lambda e: F.avg(F.abs(e)))
    each = errors.groupBy("size", "subset").agg(loss(F.col("err")).alias("loss"))
    return each.groupBy("size").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"))
