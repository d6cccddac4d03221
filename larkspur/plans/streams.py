"""Queries that run as streams over a table's files until all is read, with SQL for the rows they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.features import Signs
from ..sources import store
from ..streaming import incremental
from .catalogue import VECTORS, query, r6, table
from .systems import _NORMAL, eliminated


def stream(s: SparkSession, d: str, name: str, **options) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: as a pattern the path may be either."""
    reader = s.readStream.schema(table(s, d, name).schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(f"{d}/{name}.parque[t]")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream leaves in the end."""
    s = df.sparkSession
    path = store.scratch(s, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = s.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, batch int").parquet(path)
    return last.filter(F.col("batch") == last.agg(F.max("batch")).first()[0]).drop("batch")


def errors(s, d):
    return stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") - 50.0).alias("err"))


@query("stream_running_errors", "SELECT event_type, count(value) AS n, round(avg(abs(value - 50.0)), 6) AS mae, round(avg((value - 50.0) * (value - 50.0)), 6) AS mse FROM events GROUP BY event_type")
def stream_running_errors(s, d):
    return drained(incremental.running_errors(errors(s, d), "event_type", "err"), "complete").select("event_type", "n", r6("mae").alias("mae"), r6("mse").alias("mse"))


@query("stream_windowed_errors", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS n, round(avg(abs(value - 50.0)), 6) AS mae FROM events GROUP BY date_trunc('day', ts)")
def stream_windowed_errors(s, d):
    out = drained(incremental.windowed_errors(errors(s, d), "ts", "err", "1 day", "2 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", r6("mae").alias("mae"))


@query(
    "stream_training",
    f"""WITH RECURSIVE {VECTORS}, {_NORMAL}, sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')},
al AS (SELECT list_transform(a, lambda row: row[-1]) AS al FROM e_x) SELECT ys.id, round(list_dot_product(fv.f, al) + my, 6) AS prediction FROM fv JOIN ys USING (id), al""",
)
def stream_training(s, d):
    """Random-feature ridge whose Gramian grows by micro-batches of a stream."""
    path = store.scratch(s, "training")
    rows = lambda t: t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    model = M.FeatureRidge(Signs.by_rule(1, 1, 64), 1.0, 0.01)
    incremental.add_batches(rows(stream(s, d, "embeddings")), model, path, f"{path}-state").awaitTermination()
    return incremental.finished(s, model, path).predict(rows(table(s, d, "embeddings"))).select("id", r6("prediction").alias("prediction"))


@query(
    "stream_models_by_user",
    """WITH t AS (SELECT user_id, count(*) AS n, count(*) + 0.5 AS a, sum(length(event_type))::DOUBLE AS b, sum(length(event_type) * length(event_type)) + 0.5 AS c, sum(value) AS p, sum(value * length(event_type)) AS q FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, n, round((c * p - b * q) / (a * c - b * b), 4) AS level, round((a * q - b * p) / (a * c - b * b), 4) AS slope FROM t""",
)
def stream_models_by_user(s, d):
    """A ridge model for each user from one stream of events."""
    path = store.scratch(s, "models")
    z = F.array(F.lit(1.0), F.length("event_type").cast("double"))
    models = incremental.models_by_key(stream(s, d, "events"), "user_id", z, F.col("value"), 0.5)
    incremental.keep_latest(models, path, f"{path}-state").awaitTermination()
    return incremental.latest(s, path).select(F.col("key").alias("user_id"), "n", r6(F.col("alphas")[0], 4).alias("level"), r6(F.col("alphas")[1], 4).alias("slope"))
