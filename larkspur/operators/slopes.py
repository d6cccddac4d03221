"""Gradients of leave-one-out losses of ridge models by hyperparameters that move the features.

With rows z, labels y, A = Z'Z + l2 and alpha = A^-1 Z'y, the error of a left-out row is (z alpha - y) / (1 - z' A^-1 z).  A loss of these errors depends on a hyperparameter
through dZ and through l2 = ratio * tr(Z'Z) / min(rows, features).  All derivatives come from three passes that add up on the executors, however many hyperparameters there are:

1. Z'Z, Z'y and the constant's part, for alpha and A^-1;
2. with errors e and slopes w of the loss: sums of u z (u = w / (1 - h)) and of v z z' (v = w e / (1 - h)), and the loss;
3. for each hyperparameter, the sum of dz'g over rows, where g is what a row's features weigh in the loss (reverse mode: it does not depend on the hyperparameter), and of z'dz for l2.

The driver sees d x d numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import solvers

#: Values and slopes of losses of single errors.
LOSSES: dict[str, Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]] = {
    "mae": lambda e, d: (np.abs(e), np.sign(e)),
    "mse": lambda e, d: (e * e, 2 * e),
    "huber": lambda e, d: (np.where(np.abs(e) < 2 * d, e * e / (4 * d), np.abs(e) - d), np.where(np.abs(e) < 2 * d, e / (2 * d), np.sign(e))),
    "logcosh": lambda e, d: ((np.logaddexp(e * math.log(2) / d, -e * math.log(2) / d) - math.log(2)) * d / math.log(2), np.tanh(e * math.log(2) / d)),
}


def vector_total(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray | None]) -> np.ndarray | None:
    """Sum over all batches of a flat array of fixed size: added up by partition, then in at most 64 tasks (fewer where there is little), then in one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        for b in batches:
            if b.num_rows:
                now = f(b)
                out = now if out is None else out + now
        if out is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "s": pa.array([out.tolist()], pa.list_(pa.float64()))})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for v in b.column("s"):
                now = v.values.to_numpy()
                out = now.copy() if out is None else out + now
        if out is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([out], pa.list_(pa.float64()))})

    parts = df.mapInArrow(first, "p int, s array<double>").repartition("p").mapInArrow(again, "s array<double>")
    got = parts.collect()  # at most 64 rows
    return None if not got else sum(np.array(r[0]) for r in got)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(name)
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def loo_gradient(df: DataFrame, z: str, dz: str, y: str, hyper: int, ratio: float, shift: bool = True, loss: str = "mae", delta: float = 1.0) -> tuple[float, np.ndarray, float]:
    """(loss, its derivatives by ``hyper`` hyperparameters, its derivative by the logarithm of ``ratio``); ``dz`` holds the features' derivatives one after the other."""
    rows = df.select(F.col(z).cast("array<double>").alias("z"), F.col(dz).cast("array<double>").alias("dz"), F.col(y).cast("double").alias("y")).filter("z is not null and y is not null")
    with_one = rows.select(F.concat("z", F.array(F.lit(1.0))).alias("z"), "y")  # the constant's part, for the labels' mean
    g, r, _, n = solvers.gramian(with_one, "z", "y")
    if not n:
        return 0.0, np.zeros(hyper), 0.0
    d = len(r) - 1
    mean = r[-1] / n if shift else 0.0
    g, r = g[:d, :d], r[:d] - mean * g[:d, d]
    l2 = solvers.relative_l2(g, n, ratio)
    inverse = np.linalg.inv(g + l2 * np.eye(d))
    alpha, of = inverse @ r, LOSSES[loss]

    def parts(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        zz, y_ = _matrix(b, "z"), b.column("y").to_numpy() - mean
        left, rest = 1 - ((zz @ inverse) * zz).sum(axis=1), zz @ alpha - y_
        err = rest / left
        value, slope = of(err, delta)
        slope = slope / n
        return zz, rest, slope / left, slope * err / left, value / n

    def second(b: pa.RecordBatch) -> np.ndarray:
        zz, _, u, v, value = parts(b)
        return np.concatenate([[value.sum()], u @ zz, ((zz * v[:, None]).T @ zz).ravel()])

    sums = vector_total(rows.select("z", "y"), second)
    total, c, weighed = float(sums[0]), sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
    b_, w = inverse @ c, inverse @ weighed @ inverse
    by_l2 = -(b_ @ alpha) - float(np.trace(w))

    def third(b: pa.RecordBatch) -> np.ndarray:
        zz, rest, u, v, _ = parts(b)
        slopes = _matrix(b, "dz").reshape(len(zz), hyper, d)
        weigh = u[:, None] * alpha - rest[:, None] * b_ - (zz @ b_)[:, None] * alpha + 2 * v[:, None] * (zz @ inverse) - 2 * zz @ w
        return np.concatenate([np.einsum("nhd,nd->h", slopes, weigh), np.einsum("nhd,nd->h", slopes, zz)])

    if not hyper:
        return total, np.zeros(0), float(l2 * by_l2)
    sums = vector_total(rows, third)
    return total, sums[:hyper] + by_l2 * 2 * ratio / max(1, min(n, d)) * sums[hyper:], float(l2 * by_l2)
