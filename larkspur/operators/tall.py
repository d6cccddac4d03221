"""Ridge on tall feature tables without their Gramian: QR by partition and a tree of R factors, paths of regularisation, and shifts, each in a pass or two over the rows.

A Gramian squares the condition number: with singular values from 1 to 1e-10 half of them are lost in Z'Z.  Here each task keeps one triangle of the rows that it has seen, triangles are
stacked and factored again, and the last one has the singular values and right vectors of the whole table to working precision.  The driver sees d x d numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .slopes import LOSSES


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(name)
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def _triangle(*blocks: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def r_factor(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], width: int | None = None) -> np.ndarray:
    """R (with a diagonal that is not negative) of the matrix whose rows ``f`` makes of batches: a triangle for each partition, of these one in each of at most 64 tasks, and the last of those."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in batches:
            if b.num_rows:
                x = f(b)
                r = _triangle(*([] if r is None else [r]), x)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "d": pa.array([r.shape[1]], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for d, v in zip(b.column("d").to_pylist(), b.column("r"), strict=True):
                r = _triangle(*([] if r is None else [r]), v.values.to_numpy().reshape(-1, d))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"d": pa.array([r.shape[1]], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    ddl = "d int, r array<double>"
    got = df.mapInArrow(first, f"p int, {ddl}").repartition("p").mapInArrow(again, ddl).collect()  # at most 64 triangles
    if not got:
        return np.zeros((width or 0, width or 0))
    d = got[0]["d"]
    r = _triangle(*[np.array(g["r"]).reshape(-1, d) for g in got])
    return np.concatenate([r, np.zeros((d - len(r), d))])  # fewer rows than columns: zeros below


def keyed_totals(df: DataFrame, f: Callable[[pa.RecordBatch], dict[int, np.ndarray]], salts: int = 16) -> dict[int, np.ndarray]:
    """For each key, the sum over batches of a flat array: added up by partition, then by key and salt, the rest on the driver (``salts`` arrays for each key at most)."""
    ddl = "k long, p long, s array<double>"

    def rows(out: dict[int, np.ndarray], p: int) -> Iterator[pa.RecordBatch]:
        for k, v in out.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "p": pa.array([p], pa.int64()), "s": pa.array([v.tolist()], pa.list_(pa.float64()))})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in f(b).items():
                    out[k] = out[k] + v if k in out else v
        yield from rows(out, TaskContext.get().partitionId() % salts)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("s"), strict=True):
                out[k] = out[k] + v.values.to_numpy() if k in out else v.values.to_numpy().copy()
        yield from rows(out, 0)

    total: dict[int, np.ndarray] = {}
    for r in df.mapInArrow(first, ddl).repartition("k", "p").mapInArrow(again, ddl).collect():  # ``salts`` arrays for each key at most
        total[r["k"]] = total[r["k"]] + np.array(r["s"]) if r["k"] in total else np.array(r["s"])
    return total


def _rows(df: DataFrame, z: str, y: str | None, weight: str | None, keep: list[str]) -> DataFrame:
    cols = [F.col(z).cast("array<double>").alias("_z"), (F.col(y).cast("double") if y else F.lit(0.0)).alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")]
    return df.select(*keep, *cols).filter("_z is not null and _y is not null and _w is not null")


@dataclass
class TallSVD:
    """Singular values ``s``, falling, right vectors ``v`` (d x rank) and left products ``uy`` = U'y of a table's rows times their weights.

    ``again`` is a second triangle, of the rows times the inverse of the first: left vectors made with both are orthogonal to working precision whatever the condition number.
    """

    s: np.ndarray
    v: np.ndarray
    uy: np.ndarray
    rest: float  # what of y'y the columns leave
    again: np.ndarray | None = None
    first: np.ndarray | None = None

    @classmethod
    def fit(cls, df: DataFrame, z: str = "z", y: str | None = None, weight: str | None = None, rcond: float = 1e-14, refine: bool = False) -> TallSVD:
        """One pass; a second one with ``refine``.  Directions below ``rcond`` of the largest singular value are none."""
        rows = _rows(df, z, y, weight, [])

        def both(b: pa.RecordBatch) -> np.ndarray:
            w = b.column("_w").to_numpy()[:, None]
            return np.concatenate([_matrix(b, "_z"), b.column("_y").to_numpy()[:, None]], axis=1) * w

        whole = r_factor(rows, both, 1)
        d = whole.shape[1] - 1
        r, c = whole[:d, :d], whole[:d, d]
        again = first = None
        if refine and d and np.abs(np.diag(r)).min() > rcond * np.abs(np.diag(r)).max():
            first, inverse = r, np.linalg.inv(r)
            second = r_factor(rows, lambda b: np.concatenate([_matrix(b, "_z") @ inverse, b.column("_y").to_numpy()[:, None]], axis=1) * b.column("_w").to_numpy()[:, None], 1)
            again, c = second[:d, :d], second[:d, d]
            r = again @ r
        u, s, vh = np.linalg.svd(r)
        keep = s > rcond * s.max(initial=0.0)
        rest = float(whole[d, d] ** 2) if len(whole) > d else 0.0
        return cls(s[keep], vh[keep].T, u[:, keep].T @ c, rest, None if again is None else u[:, keep].T @ np.linalg.inv(again).T, None if first is None else np.linalg.inv(first))

    def left(self, z: np.ndarray) -> np.ndarray:
        """Left singular vectors of rows that are already weighted."""
        if self.again is not None:
            return (z @ self.first) @ self.again.T
        return (z @ self.v) / self.s

    def solution(self, l2: float = 0.0) -> np.ndarray:
        """Ridge coefficients; with l2 = 0 the least-norm least squares."""
        return self.v @ (self.s / (self.s**2 + l2) * self.uy)

    def relative_l2(self, ratio: float, rows: int) -> float:
        """ratio times the mean squared singular value."""
        return ratio * float((self.s**2).sum()) / max(1, min(rows, len(self.v)))

    def left_rows(self, df: DataFrame, z: str, keep: list[str], weight: str | None = None) -> DataFrame:
        """keep, u: orthonormal columns that span those of z (``svd_aligned`` rows: u times s is z turned to its principal axes)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = self.left(_matrix(b, "_z") * b.column("_w").to_numpy()[:, None])
                    at = pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1])
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(at, pa.array(u.ravel()))], names=[*keep, "u"])

        ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), "u array<double>"])
        return _rows(df, z, None, weight, keep).mapInArrow(run, ddl)

    def errors(self, df: DataFrame, z: str, y: str, l2: float, keep: list[str], weight: str | None = None) -> DataFrame:
        """keep, leverage, err: leave-one-out errors (fitted - y) / (1 - h) of the rows, weighted ones if there are weights."""
        m = self.s**2 / (self.s**2 + l2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    w = b.column("_w").to_numpy()
                    u, y_ = self.left(_matrix(b, "_z") * w[:, None]), b.column("_y").to_numpy() * w
                    h = (u * u) @ m
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(h), pa.array((u @ (m * self.uy) - y_) / (1 - h))], names=[*keep, "leverage", "err"])

        ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), "leverage double", "err double"])
        return _rows(df, z, y, weight, keep).mapInArrow(run, ddl)

    def loss_path(self, df: DataFrame, z: str, y: str, l2s: list[float], loss: str = "mae", delta: float = 1.0, weight: str | None = None) -> list[tuple[float, float, float]]:
        """(l2, mean loss of leave-one-out errors, its derivative by l2) for all ``l2s`` from one pass over the rows."""
        grid = np.array(l2s, float)
        m = self.s[:, None] ** 2 / (self.s[:, None] ** 2 + grid)
        dm = -(self.s[:, None] ** 2) / (self.s[:, None] ** 2 + grid) ** 2
        of = LOSSES[loss]

        def sums(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            w = b.column("_w").to_numpy()
            u, y_ = self.left(_matrix(b, "_z") * w[:, None]), (b.column("_y").to_numpy() * w)[:, None]
            left = 1 - (u * u) @ m
            e = (u @ (m * self.uy[:, None]) - y_) / left
            de = (u @ (dm * self.uy[:, None])) / left + e * ((u * u) @ dm) / left
            value, slope = of(e, delta)
            return {0: np.concatenate([[len(e)], value.sum(axis=0), (slope * de).sum(axis=0)])}

        got = keyed_totals(_rows(df, z, y, weight, []), sums).get(0)
        if got is None:
            return []
        n, k = got[0], len(grid)
        return [(float(a), float(v / n), float(g / n)) for a, v, g in zip(grid, got[1 : k + 1], got[k + 1 :], strict=True)]

    def best_l2(self, df: DataFrame, z: str, y: str, logs: tuple[float, float], points: int = 16, zooms: int = 3, loss: str = "mae", delta: float = 1.0) -> tuple[float, float]:
        """(l2, loss) of the least loss: a grid in ln l2, then grids around its best point; a pass for each."""
        low, high, best = *logs, (float("inf"), 0.0)
        for _ in range(zooms):
            grid = np.linspace(low, high, points)
            got = self.loss_path(df, z, y, np.exp(grid).tolist(), loss, delta)
            if not got:
                return 0.0, 0.0
            at = int(np.argmin([v for _, v, _ in got]))
            best = min(best, (got[at][1], got[at][0]))
            low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
        return best[1], best[0]


@dataclass
class FoldPath:
    """Mean losses on the rows of each fold, of models that are trained on all other folds, for a path of regularisations."""

    l2s: list[float]  # absolute, or relative to the mean squared singular value of the training rows
    relative: bool = False
    shift: bool = False
    loss: str = "mae"
    delta: float = 1.0

    def run(self, df: DataFrame, z: str, y: str, fold: str) -> list[tuple[int, float, float, float, int]]:
        """(fold, l2 as given, mean loss, derivative by ln l2, rows).

        One aggregation has Z'Z, Z'y and the sums of all folds; a fold's training part is the total less its own, with one eigen-decomposition; a second pass has the errors of all folds and l2s.
        """
        rows = df.select(F.col(z).cast("array<double>").alias("_z"), F.col(y).cast("double").alias("_y"), F.col(fold).cast("long").alias("_f")).filter("_z is not null and _y is not null and _f is not null")

        def gramians(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            x = np.concatenate([_matrix(b, "_z"), np.ones((b.num_rows, 1)), b.column("_y").to_numpy()[:, None]], axis=1)
            f = b.column("_f").to_numpy()
            return {int(k): (x[f == k].T @ x[f == k]).ravel() for k in np.unique(f)}

        parts = keyed_totals(rows, gramians)
        if len(parts) < 2:
            raise ValueError("two folds at least")
        total = sum(parts.values())
        size = int(round(len(total) ** 0.5))
        d, models = size - 2, {}
        for k, own in parts.items():
            g = (total - own).reshape(size, size)
            n = g[d, d]
            mean = g[d, d + 1] / n if self.shift else 0.0
            w, v = np.linalg.eigh(g[:d, :d])
            scale = float(np.trace(g[:d, :d])) / max(1, min(n, d)) if self.relative else 1.0
            l2 = scale * np.array(self.l2s, float)
            vr = v.T @ (g[:d, d + 1] - mean * g[:d, d])
            by = 1 / np.maximum(w[:, None] + l2, 1e-300)
            models[k] = mean, v @ (by * vr[:, None]), v @ (-by * by * l2 * vr[:, None])
        of = LOSSES[self.loss]

        def errors(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            x, y_, f = _matrix(b, "_z"), b.column("_y").to_numpy(), b.column("_f").to_numpy()
            out = {}
            for k in np.unique(f):
                mean, a, da = models[int(k)]
                at = f == k
                value, slope = of(x[at] @ a + mean - y_[at, None], self.delta)
                out[int(k)] = np.concatenate([[at.sum()], value.sum(axis=0), (slope * (x[at] @ da)).sum(axis=0)])
            return out

        k, out = len(self.l2s), []
        for f, s in sorted(keyed_totals(rows, errors).items()):
            out += [(f, float(l), float(s[1 + i] / s[0]), float(s[1 + k + i] / s[0]), int(s[0])) for i, l in enumerate(self.l2s)]
        return out

    def best(self, df: DataFrame, z: str, y: str, fold: str, zooms: int = 3) -> tuple[float, float]:
        """(l2, loss): the least mean over folds of the mean loss; the path of ``l2s`` first, then finer ones around its best point."""
        grid, best = np.log(self.l2s), (float("inf"), 0.0)
        for _ in range(zooms):
            one = FoldPath(np.exp(grid).tolist(), self.relative, self.shift, self.loss, self.delta)
            means: dict[float, list[float]] = {}
            for _, l2, v, _, _ in one.run(df, z, y, fold):
                means.setdefault(l2, []).append(v)
            order = sorted(means)
            at = int(np.argmin([np.mean(means[l]) for l in order]))
            best = min(best, (float(np.mean(means[order[at]])), order[at]))
            grid = np.linspace(np.log(order[max(0, at - 1)]), np.log(order[min(len(order) - 1, at + 1)]), len(grid))
        return best[1], best[0]


def shift_errors(df: DataFrame, z: str, y: str, columns: list[str], l2: float, keep: list[str], weight: str | None = None) -> DataFrame:
    """keep, e0, e1 (array): leave-one-out errors of labels y + columns c are e0 + e1 c.

    The labels and all columns are right-hand sides of one system: Z'Z and Z'[y, columns] in one pass, errors in a second.
    """
    rhs = F.array(F.col(y).cast("double"), *[F.col(c).cast("double") for c in columns])
    rows = df.select(*keep, F.col(z).cast("array<double>").alias("_z"), rhs.alias("_r"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).filter("_z is not null and not exists(_r, v -> v is null)")
    q = 1 + len(columns)
    whole = r_factor(rows, lambda b: np.concatenate([_matrix(b, "_z"), _matrix(b, "_r")], axis=1) * b.column("_w").to_numpy()[:, None], q)
    d = whole.shape[1] - q
    u, s, vh = np.linalg.svd(whole[:d, :d])
    use = s > 1e-14 * s.max(initial=0.0)
    u, s, vh = u[:, use], s[use], vh[use]
    m, uy = s**2 / (s**2 + l2), u.T @ whole[:d, d:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = b.column("_w").to_numpy()[:, None]
                left = (_matrix(b, "_z") * w) @ vh.T / s
                e = (left @ (m[:, None] * uy) - _matrix(b, "_r") * w) / (1 - (left * left) @ m)[:, None]
                at = pa.array(np.arange(len(e) + 1, dtype=np.int32) * (q - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(e[:, 0]), pa.ListArray.from_arrays(at, pa.array(e[:, 1:].ravel()))], names=[*keep, "e0", "e1"])

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), "e0 double", "e1 array<double>"])
    return rows.mapInArrow(run, ddl)


def best_shift(df: DataFrame, z: str, y: str, columns: list[str], l2: float, loss: str = "mae", rounds: int = 60, tol: float = 1e-9, floor: float = 1e-9, weight: str | None = None) -> np.ndarray:
    """c for which the leave-one-out errors of y + columns c are least: in the mean square at once, in the mean absolute value by reweighted least squares, a pass over the written errors for each round."""
    errors = written(shift_errors(df, z, y, columns, l2, [], weight), "errors")

    def step(c: np.ndarray | None) -> np.ndarray:
        def rows(b: pa.RecordBatch) -> np.ndarray:
            e = np.concatenate([_matrix(b, "e1"), b.column("e0").to_numpy()[:, None]], axis=1)
            return e if c is None else e / np.sqrt(np.maximum(np.abs(e[:, -1] + e[:, :-1] @ c), floor))[:, None]

        r = r_factor(errors, rows, len(columns) + 1)
        q = r.shape[1] - 1
        return -np.linalg.lstsq(r[:q, :q], r[:q, q], rcond=1e-12)[0]

    c = step(None)
    for _ in range(rounds if loss == "mae" else 0):
        new = step(c)
        close = np.allclose(new, c, rtol=tol, atol=tol)
        c = new
        if close:
            break
    return c


def shifted(df: DataFrame, y: str, columns: list[str], c: np.ndarray) -> Column:
    """The label that a model with these shifts is trained on; take the same sum off its predictions."""
    return sum((F.col(n) * F.lit(float(v)) for n, v in zip(columns, c, strict=True)), F.col(y))
