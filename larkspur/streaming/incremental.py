"""Incremental training as Structured Streaming: each micro-batch adds its Gramian to a state table.

A batch writes its own part under its number, so a batch that is run again replaces its part and counts once; the sum over parts is the model's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.models import FeatureRidge
from ..operators.solvers import add_parts, gramian_parts


def add_batches(stream: DataFrame, model: FeatureRidge, path: str, checkpoint: str):
    """Start a query that keeps the state of rows (x, y) under ``path``."""

    def one(batch: DataFrame, number: int) -> None:
        z = model.features(batch.select("x", "y"), ["y"]).withColumn("z", F.concat("z", F.array(F.lit(1.0))))
        add_parts(gramian_parts(z, "z", "y")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, model: FeatureRidge, path: str) -> FeatureRidge:
    """The model from the state of all batches."""
    r = add_parts(spark.read.parquet(path).drop("batch")).first()
    model.start()
    if r is not None:
        model.g, model.r, model.yy, model.n = np.array(r["g"]).reshape(r["d"], r["d"]), np.array(r["r"]), r["yy"], r["n"]
    return model.solve()


def models_by_key(stream: DataFrame, key: str, z: Column, y: Column, l2: float, ts: str | None = None, late: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """(key, n, alphas): a ridge model for each key from one stream, given anew whenever rows of its key arrive (output mode update).

    The state of a key is its Z'Z, Z'y and number of rows: d * d numbers however many rows it has seen, kept by Spark over restarts.  With ``ts`` rows later than the watermark (``late``) are
    dropped; with ``ttl_ms`` as well a key's state goes when the watermark is that far past its last row, and rows after that start anew.  Rows with a null label or feature are left out.
    """
    rows = stream if ts is None else stream.withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), z.cast("array<double>").alias("z"), y.cast("double").alias("y"), *([F.col(ts).alias("ts")] if ts else []))
    rows = rows.filter("z is not null and y is not null and not exists(z, v -> v is null)")
    kind = dict(rows.dtypes)["key"]

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        d, g, r, n, last = state.get if state.exists else (0, b"", b"", 0, 0)
        g, r = np.frombuffer(g).reshape(d, d), np.frombuffer(r)
        for part in parts:
            if not len(part):
                continue
            x, t = np.stack([np.asarray(v, float) for v in part["z"]]), part["y"].to_numpy(float)
            g, r = (x.T @ x, x.T @ t) if not n else (g + x.T @ x, r + x.T @ t)
            n += len(t)
            if ts and ttl_ms is not None:
                last = max(last, int(part["ts"].max().timestamp() * 1000))
        if not n:
            return
        state.update((len(r), g.tobytes(), r.tobytes(), n, last))
        if ts and ttl_ms is not None:
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "alphas": [np.linalg.solve(g + l2 * np.eye(len(r)), r).tolist()]})

    timeout = GroupStateTimeout.EventTimeTimeout if ts and ttl_ms is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, alphas array<double>", "d int, g binary, r binary, n long, last long", "update", timeout)


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps each batch's rows under its number; a batch that is run again replaces its rows."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """The last row of each key."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def running_errors(stream: DataFrame, key: str, error: str) -> DataFrame:
    """Number, mean absolute and mean square error by key, kept over the stream."""
    return stream.groupBy(key).agg(F.count(error).alias("n"), F.avg(F.abs(F.col(error))).alias("mae"), F.avg(F.col(error) * F.col(error)).alias("mse"))


def windowed_errors(stream: DataFrame, ts: str, error: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width))
    return w.agg(F.count(error).alias("n"), F.avg(F.abs(F.col(error))).alias("mae")).select(F.col("window.start").alias("start"), "n", "mae")
