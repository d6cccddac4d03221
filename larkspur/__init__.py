"""Larkspur: a Spark-native engine for kernel analytics on structured records."""

import os


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, if that folder is theirs too and it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
