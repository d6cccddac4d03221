"""Learning curves whose models choose their hyperparameters anew for each training subset.

Subsets are those of :func:`.ranking.learning_subsets`.  All models of a curve are fitted together: the number of jobs does not depend on how many sizes and subsets there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .kernels import Kernel, _pairs, _runs, _tile_pairs, tiles
from .ranking import learning_subsets
from .tall import LOSSES, _matrix, keyed_totals

POINTS = "size int, subset long, sigma double, l2 double, training_loss double, loss double, n long"


def _models(sizes: list[int], most: int):
    """The number of a model: its size's place and its subset."""
    place = F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col("size")) - 1
    return (place * most + F.col("subset")).cast("long")


def _members(train: DataFrame, key: str, sizes: list[int], most: int) -> DataFrame:
    if not sizes or len(set(sizes)) < len(sizes) or min(sizes) < 2:
        raise ValueError("sizes must be distinct, 2 at least")
    return learning_subsets(train, key, sizes, most).withColumn("_m", _models(sizes, most)).select(key, "_m")


@dataclass
class FeatureCurve:
    """Ridge regression on feature rows, the regularisation of each subset by its own leave-one-out errors.

    Three passes whatever the number of models: Z'Z and Z'y of all subsets, leave-one-out losses of all subsets and ``l2s``, losses of all models on the test rows, where a batch is one product
    with the weights of all of them.  The driver and each task hold d * d numbers for each of at most ``len(sizes) * most`` models.
    """

    sizes: list[int]
    l2s: list[float]  # absolute, or relative to the mean squared singular value of a subset's rows
    relative: bool = False
    shift: bool = True
    most: int = 8
    loss: str = "mae"
    delta: float = 1.0

    def run(self, train: DataFrame, test: DataFrame, key: str = "id", z: str = "z", y: str = "y") -> DataFrame:
        """(size, subset, sigma, l2, training_loss, loss, n): sigma is null; rows with a null in z or y take no part; rows of one key go together."""
        columns = [F.col(z).cast("array<double>").alias("_z"), F.col(y).cast("double").alias("_y")]
        rows = train.select(key, *columns).dropna()
        held = written(rows.join(_members(rows, key, self.sizes, self.most), key).select("_z", "_y", "_m"), "curve")
        of = LOSSES[self.loss]

        def gramians(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            x = np.concatenate([_matrix(b, "_z"), np.ones((b.num_rows, 1)), b.column("_y").to_numpy()[:, None]], axis=1)
            m = b.column("_m").to_numpy()
            return {int(k): (x[m == k].T @ x[m == k]).ravel() for k in np.unique(m)}

        counts, fits = {}, {}
        for k, v in keyed_totals(held, gramians).items():
            size = round(len(v) ** 0.5)
            g, d = v.reshape(size, size), size - 2
            mean = g[d, d + 1] / g[d, d] if self.shift else 0.0
            w, vectors = np.linalg.eigh(g[:d, :d])
            l2 = np.array(self.l2s, float) * (np.trace(g[:d, :d]) / max(1, min(g[d, d], d)) if self.relative else 1.0)
            inverse = 1 / np.maximum(w[:, None] + l2, 1e-300)
            counts[k], fits[k] = g[d, d], (mean, vectors, inverse, vectors @ (inverse * (vectors.T @ (g[:d, d + 1] - mean * g[:d, d]))[:, None]), l2)

        def left_out(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            x, target, m = _matrix(b, "_z"), b.column("_y").to_numpy(), b.column("_m").to_numpy()
            out = {}
            for k in np.unique(m):
                mean, vectors, inverse, weights, _ = fits[int(k)]
                at = m == k
                leverage = (x[at] @ vectors) ** 2 @ inverse
                out[int(k)] = of((x[at] @ weights + mean - target[at, None]) / np.maximum(1 - leverage, 1e-300), self.delta)[0].sum(axis=0)
            return out

        losses = {k: v / counts[k] for k, v in keyed_totals(held, left_out).items()}
        order, best = sorted(fits), {k: int(np.argmin(v)) for k, v in losses.items()}
        points: list[tuple] = []
        if order:
            weights = np.stack([fits[k][3][:, best[k]] for k in order], axis=1)
            means = np.array([fits[k][0] for k in order])

            def errors(b: pa.RecordBatch) -> dict[int, np.ndarray]:
                value = of(_matrix(b, "_z") @ weights + means - b.column("_y").to_numpy()[:, None], self.delta)[0]
                return {0: np.append(value.sum(axis=0), b.num_rows)}

            total = keyed_totals(test.select(*columns).dropna(), errors).get(0, np.zeros(len(order) + 1))
            n = int(total[-1])
            points = [(self.sizes[k // self.most], k % self.most, None, float(fits[k][4][best[k]]), float(losses[k][best[k]]), float(total[i] / n) if n else None, n) for i, k in enumerate(order)]
        return train.sparkSession.createDataFrame(points, POINTS)  # one row for each model


@dataclass
class KernelCurve:
    """Kernel ridge regression, width and regularisation of each subset by its own leave-one-out errors.

    A subset's kernel is made and solved in one task, of ``max(sizes)`` squared numbers at the most; test rows meet the training rows of all models by tiles, as in a kernel matrix, of which no value is shuffled.
    """

    kernel: Kernel
    sizes: list[int]
    sigmas: list[float]
    ratios: list[float]  # of the mean of a kernel's diagonal
    shift: bool = True
    most: int = 8
    loss: str = "mae"
    delta: float = 1.0

    def run(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """(size, subset, sigma, l2, training_loss, loss, n) from rows (id, x, y), ids distinct; rows with a null take no part."""
        columns = [F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")]
        train, test, of = train.select(*columns).dropna(), test.select(*columns).dropna(), LOSSES[self.loss]

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id")
            x, mean = np.stack(part["x"].to_list()).astype(float), part["y"].mean() if self.shift else 0.0
            target, best = part["y"].to_numpy() - mean, None
            for sigma, k in zip(self.sigmas, replace(self.kernel, sigmas=tuple(self.sigmas)).block(x, x), strict=True):
                scale = float(np.mean(np.diag(k)))
                w, v = np.linalg.eigh(k)
                for ratio in self.ratios:
                    inverse = 1 / np.maximum(w + ratio * scale, 1e-300)
                    alphas = v @ (inverse * (v.T @ target))
                    value = float(np.mean(of(alphas / ((v * v) @ inverse), self.delta)[0]))
                    if best is None or value < best[0]:
                        best = value, sigma, ratio * scale, alphas
            return part[["_m", "id", "x"]].assign(alpha=best[3], sigma=best[1], l2=best[2], mean=mean, value=best[0])

        members = train.join(_members(train, "id", self.sizes, self.most), "id")
        ddl = "_m long, id long, x array<double>, alpha double, sigma double, l2 double, mean double, value double"
        fitted = written(members.groupBy("_m").applyInPandas(solve, ddl), "curve")  # at most max(sizes) rows in a group
        heads = {r["_m"]: r for r in fitted.groupBy("_m").agg(*[F.first(c).alias(c) for c in ("sigma", "l2", "mean", "value")]).collect()}  # one for each model
        widths = {m: r["sigma"] for m, r in heads.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _tile_pairs(batch):
                    models, starts = _runs(r["b_z"])
                    for m, lo, hi in zip(models.tolist(), starts.tolist(), [*starts[1:].tolist(), len(r["b_z"])], strict=True):
                        p = replace(self.kernel, sigmas=(widths[m],)).block(r["a_x"], r["b_x"][lo:hi])[0] @ r["b_w"][lo:hi]
                        yield pa.RecordBatch.from_pydict({"id": r["a_ids"], "_m": np.full(len(p), m), "p": p})

        parts = _pairs(tiles(test, "id", "x"), tiles(fitted, "id", "x", "_m", weight="alpha")).mapInArrow(run, "id long, _m long, p double")
        p = parts.groupBy("id", "_m").agg(F.sum("p").alias("p")).join(test.select("id", "y"), "id")
        mean = F.create_map(*[F.lit(v) for m, r in heads.items() for v in (m, r["mean"])])[F.col("_m")] if heads else F.lit(0.0)
        err = p.select("_m", (F.col("p") + mean - F.col("y")).alias("_e"))

        def errors(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            value, m = of(b.column("_e").to_numpy(), self.delta)[0], b.column("_m").to_numpy()
            return {int(k): np.array([value[m == k].sum(), (m == k).sum()]) for k in np.unique(m)}

        total = keyed_totals(err, errors) if heads else {}
        points = []
        for m, r in sorted(heads.items()):
            s, n = total.get(m, (0.0, 0))
            points.append((self.sizes[m // self.most], m % self.most, r["sigma"], r["l2"], r["value"], float(s / n) if n else None, int(n)))
        return train.sparkSession.createDataFrame(points, POINTS)


def curve(points: DataFrame) -> DataFrame:
    """(size, mean, std) of a curve's points: mean and population deviation of the losses of a size's models."""
    return points.groupBy("size").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"))
