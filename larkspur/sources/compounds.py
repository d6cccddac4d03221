"""Tables of compounds: from files, from objects of other libraries, and pairs of them with options."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .xyz import read_xyz


def with_options(files: DataFrame, **options) -> DataFrame:
    """(name, body, options): each file with the options it is to be worked on with, as strings by name."""
    pairs = [F.lit(str(x)) for k, v in sorted(options.items()) for x in (k, v)]
    return files.select("name", "body", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("options"))


def compounds(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same from a folder of XYZ files."""
    return with_options(read_xyz(spark, path), **options)


def option_pairs(files: DataFrame, first: dict, second: dict) -> DataFrame:
    """(name, side, body, options): each file twice, with the first options and with the second; states of one molecule."""
    return with_options(files, **first).withColumn("side", F.lit(0)).unionByName(with_options(files, **second).withColumn("side", F.lit(1))).select("name", "side", "body", "options")


def file_pairs(files: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """(pair, side, name, body, options) from (pair, first, second) names of files."""
    sides = pairs.select("pair", F.posexplode(F.array("first", "second")).alias("side", "name"))
    return sides.join(with_options(files, **options), "name").select("pair", "side", "name", "body", "options")


def atoms_of(spark: SparkSession, objects: Iterable, name: str = "name") -> DataFrame:
    """(name, atom, z, x, y, c) of objects in memory that give ``get_atomic_numbers()`` and ``get_positions()``, as structures of other libraries do; their place is their name."""
    rows = [(i, a, int(z), *map(float, r)) for i, o in enumerate(objects) for a, (z, r) in enumerate(zip(o.get_atomic_numbers(), o.get_positions(), strict=True))]
    return spark.createDataFrame(rows, f"{name} long, atom long, z int, x double, y double, c double")


def save_results(results: DataFrame, path: str, keys: list[str]) -> None:
    """Results of expensive programs in a store by their options, a folder for each value of ``keys``."""
    results.write.mode("append").partitionBy(*keys).parquet(path)
