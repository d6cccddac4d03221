"""Exact search for the k largest inner products, with a table of distances to pivots.

1. A table is written once: each usable row with its distances to ``pivots`` fixed rows.  It is sorted by nearest pivot and distance, so that rows which lie together in a
   file have similar distances.  Pivots come from a bounded sample by farthest-first choice; they decide how much is skipped, never what is found.
2. Queries go in blocks of about ``block`` rows, each with a thirty-second of the table first: the k-th best of that is a true lower limit for each query.
3. Then the whole table, where it lies: for two vectors ``2 <q, c> = |q|^2 + |c|^2 - |q - c|^2``, and ``|q - c|`` is at least ``|d(q, p) - d(c, p)|`` for every pivot p.  A run of rows is passed over by its least and
   largest distances; inside a run, rows are taken in the order of their bound and the run ends where no query's bound reaches its k-th best so far.  Scores are whole numbers, exact below 2**53.
4. What the tasks keep (at most k + 1 rows for each query and task) meets by query.

A block of queries and its limits (16,384 rows by default) are the only things sent to every task.  The candidates are neither shuffled nor copied after the sort, whose order ends with a hash of the row, so equal rows
are spread.

Cases: rows whose vector is null, or holds null or non-finite entries, take no part; a shorter vector has zeros beyond its end; equal scores go by smaller id, a null id last; a query is never its own candidate but other rows with the
same id or vector are; repeated queries are answered each; fewer than k candidates give fewer rows, an empty table none; other columns are ignored.  Entries beyond 2**62 / scale stop there and scores above 2**53 are rounded
as doubles are, and stop at the largest long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named_rows, shared_checkpoints, stored
from .vectors import fixed_point, usable

#: Rows in a run, rows taken at a time inside it, and queries that go through a run together.
RUN, STEP, GROUP = 1024, 256, 512
NO_ID = 2**63 - 1


def choose_pivots(rows: DataFrame, pivots: int, scale: float, sample: int = 1024) -> np.ndarray:
    """Farthest-first choice among ``sample`` rows in hash order."""
    got = rows.filter("v is not null").select(F.xxhash64("file", "row").alias("h"), "v").orderBy("h").limit(sample).toArrow().column("v").combine_chunks()
    x = fixed_point(got.filter(pa.array(usable(got))), scale=scale)
    if not len(x):
        return np.zeros((0, 0))
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    away = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < pivots and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, pivots))
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def pivot_table(rows: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """(file, row, id, v, away), away the distances to the pivots, in the order of the nearest pivot and the distance to it; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(usable(b.column("v"))))
            if not b.num_rows:
                continue
            away = distances(fixed_point(b.column("v"), scale=scale), pivots)
            near = away.argmin(axis=1).astype(np.int32) if len(pivots) else np.zeros(len(away), np.int32)
            first = away.min(axis=1, initial=np.inf)
            offsets = pa.array(np.arange(len(away) + 1, dtype=np.int32) * away.shape[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("file", "row", "id", "v")], pa.ListArray.from_arrays(offsets, pa.array(away.ravel())), pa.array(near), pa.array(first)], names=["file", "row", "id", "v", "away", "near", "first"])

    kind = dict(rows.dtypes)["v"]
    made = rows.mapInArrow(run, f"file long, row long, id long, v {kind}, away array<double>, near int, first double")
    return stored(made.repartitionByRange("near", "first", F.xxhash64("file", "row")).sortWithinPartitions("near", "first").drop("near", "first"))


class Best:
    """The ``k`` best of each query so far, and a limit (score, id) that an entry must beat to matter."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None, limit_id: np.ndarray | None = None):
        self.score, self.id, self.null = np.full((n, k), -np.inf), np.full((n, k), NO_ID), np.ones((n, k), bool)
        self.limit = np.full(n, -np.inf) if limit is None else limit.copy()
        self.limit_id = np.full(n, NO_ID) if limit_id is None else limit_id.copy()

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        k, touched = self.score.shape[1], np.unique(q)
        q = np.concatenate([np.repeat(touched, k), q])
        score, ids, null = (np.concatenate([a[touched].ravel(), b]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, q))
        q, score, ids, null = q[order], score[order], ids[order], null[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        keep = at < k
        q, at = q[keep], at[keep]
        self.score[q, at], self.id[q, at], self.null[q, at] = score[keep], ids[keep], null[keep]
        last, last_id = self.score[touched, -1], np.where(self.null[touched, -1], NO_ID, self.id[touched, -1])
        better = (last > self.limit[touched]) | ((last == self.limit[touched]) & (last_id < self.limit_id[touched]))
        self.limit[touched[better]], self.limit_id[touched[better]] = last[better], last_id[better]


def search_run(best: Best, q: np.ndarray, q2: np.ndarray, q_away: np.ndarray, who: np.ndarray, x: np.ndarray, x2: np.ndarray, away: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
    """The queries ``who`` against one run of rows, in the order of the rows' bounds until no bound reaches a limit.  Returns how many scores were computed."""
    reach = np.zeros((len(who), len(x)))
    for j in range(away.shape[1]):
        np.maximum(reach, np.abs(q_away[who, j][:, None] - away[:, j]), out=reach)
    size = q2[who][:, None] + x2
    bound = (size - reach * reach) / 2 + 1e-9 * size + 1e-3  # rounding never hides a row
    most = bound.max(axis=0)
    order, done = np.argsort(-most, kind="stable"), 0
    for at in range(0, len(order), STEP):
        rows = order[at : at + STEP]
        if most[rows[0]] < best.limit[who].min():
            break
        on = np.flatnonzero((bound[:, rows] >= best.limit[who][:, None]).any(axis=1))
        if not len(on):
            continue
        score = q[who[on]] @ x[rows].T
        done += score.size
        limit, limit_id = best.limit[who[on]][:, None], best.limit_id[who[on]][:, None]
        i, j = np.nonzero((score > limit) | ((score == limit) & ((ids[rows] < limit_id) | (limit_id == NO_ID))))
        if len(i):
            best.add(who[on[i]], score[i, j], ids[rows[j]], null[rows[j]])
    return done


def _searched(table: DataFrame, block: tuple, limits: tuple | None, k: int, scale: float) -> DataFrame:
    """(q, query_id, own, vec_id, score): what each task keeps; q is the query's place in the block, own says that a row may be the query itself."""
    q_id, q_null, q, q_away = block
    q2 = (q * q).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(q), k, *(limits or ()))
        for b in batches:
            if not b.num_rows:
                continue
            x = fixed_point(b.column("v"), q.shape[1], scale)
            qs = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
            away = b.column("away").flatten().to_numpy(zero_copy_only=False).reshape(len(x), q_away.shape[1])
            x2, null = (x * x).sum(axis=1), b.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = b.column("id").fill_null(NO_ID).to_numpy()
            cuts = [slice(a, a + RUN) for a in range(0, len(x), RUN)]
            reach = np.zeros((len(cuts), len(q)))
            for r, c in zip(reach, cuts, strict=True):
                for j in range(away.shape[1]):  # how far a query is from the run's span of distances, at least
                    np.maximum(r, np.maximum(q_away[:, j] - away[c, j].max(), away[c, j].min() - q_away[:, j]), out=r)
            size = q2 + np.array([x2[c].max() for c in cuts])[:, None]
            bound = (size - reach * reach) / 2 + 1e-9 * size + 1e-3
            for t in np.argsort(-bound.max(axis=1), kind="stable"):
                c, who = cuts[t], np.flatnonzero(bound[t] >= best.limit)
                for at in range(0, len(who), GROUP):
                    search_run(best, qs, q2, q_away, who[at : at + GROUP], x[c], x2[c], away[c], ids[c], null[c])
        i, j = np.nonzero(best.score > -np.inf)
        score, ids, null = best.score[i, j], best.id[i, j], best.null[i, j]
        own = (ids == q_id[i]) & (null == q_null[i]) & (score == q2[i])
        whole = np.where(score >= 2.0**63, NO_ID, np.clip(score, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
        yield pa.RecordBatch.from_pydict({"q": pa.array(i, pa.int32()), "query_id": pa.array(q_id[i], mask=q_null[i]), "own": pa.array(own), "vec_id": pa.array(ids, mask=null), "score": pa.array(whole)})

    return table.mapInArrow(run, "q int, query_id long, own boolean, vec_id long, score long")


def _met(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all tasks, with their place ``r`` from 1."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def _block(queries: DataFrame, i: int, blocks: int, scale: float) -> tuple:
    got = queries.filter(F.pmod(F.xxhash64("row", "file"), F.lit(blocks)) == i).select("id", "v", "away").toArrow().combine_chunks()
    ids, v, away = (got.column(c).combine_chunks() for c in ("id", "v", "away"))
    q, near = fixed_point(v, scale=scale), away.flatten().to_numpy(zero_copy_only=False)
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), q, near.reshape(len(q), len(near) // max(1, len(q)))


def top_k(df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", column: str = "embedding", pivots: int = 16, block: int = 16_384, seeds: int = 32, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``df`` where ``queries`` (over ``id``) holds, the k rows with the largest inner products of floor(scale * component), itself left out."""
    rows = named_rows(df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v")))
    spark = df.sparkSession
    table = pivot_table(rows, choose_pivots(rows, pivots, scale), scale)
    asked = stored(table.filter(queries))
    few = stored(table.filter(F.pmod(F.xxhash64("file", "row"), F.lit(seeds)) == 0))
    folder = f"{shared_checkpoints(spark)}/found-{uuid.uuid4().hex}"
    blocks = -(-asked.count() // block)
    for i in range(blocks):
        now = _block(asked, i, blocks, scale)
        if not len(now[0]):
            continue
        limit, limit_id = np.full(len(now[0]), -np.inf), np.full(len(now[0]), NO_ID)
        # the query itself may be among the rows, so the limit is the one after the k-th
        for r in _met(_searched(few, now, None, k + 1, scale), k + 1).filter(F.col("r") == k + 1).select("q", "score", "vec_id").collect():
            limit[r["q"]], limit_id[r["q"]] = r["score"], NO_ID if r["vec_id"] is None else r["vec_id"]
        best = _met(_searched(table, now, (limit, limit_id), k + 1, scale), k + 1)
        own = F.min(F.when(F.col("own"), F.col("r"))).over(Window.partitionBy("q"))
        others = best.withColumn("own", F.coalesce(own, F.lit(k + 1))).filter("r <> own").withColumn("rank", F.when(F.col("r") > F.col("own"), F.col("r") - 1).otherwise(F.col("r")))
        others.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(folder)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(empty.schema).parquet(folder) if blocks else empty
