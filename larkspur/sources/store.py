"""Tables as stores of models and of results of expensive external programs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.option("compression", compression).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; a local one only where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to a new folder that all executors share, and read from there: what several passes need is made once, and lost executors make nothing again."""
    path = scratch(df.sparkSession, name)
    # a row may hold a block of megabytes: row groups are closed by their bytes after each row, not after a hundred
    df.write.options(**{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def missing(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What is to be computed: rows of ``wanted`` without a cached result for their options."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def with_cache(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache, keys, "left").withColumn("cached", F.coalesce(*[F.col(c).isNotNull() for c in cache.columns if c not in keys][:1], F.lit(False)))
