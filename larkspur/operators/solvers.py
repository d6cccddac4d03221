"""Linear algebra: Gramians by partition on the executors, small dense systems on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vectors(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(name)
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def gramian_parts(df: DataFrame, z: str, y: str | None = None, weight: str | None = None) -> DataFrame:
    """One row for each partition: d, flat Z'WZ, Z'Wy, y'Wy and the number of rows.  The state that incremental training adds up."""
    cols = [F.col(z).cast("array<double>").alias("z"), (F.col(y).cast("double") if y else F.lit(0.0)).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = r = None
        yy, n = 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            zz, y_, w = _vectors(b, "z"), b.column("y").to_numpy(), b.column("w").to_numpy()
            zw = zz * w[:, None]
            g = zw.T @ zz if g is None else g + zw.T @ zz
            r = zw.T @ y_ if r is None else r + zw.T @ y_
            yy += float((w * y_ * y_).sum())
            n += len(y_)
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array([len(r)], pa.int32()), "g": [g.ravel()], "r": [r], "yy": [yy], "n": [n]})

    return df.select(*cols).filter("z is not null and y is not null").mapInArrow(run, "d int, g array<double>, r array<double>, yy double, n long")


def add_parts(parts: DataFrame) -> DataFrame:
    """One row of sums; component-wise adding is done in pairs of executors' tasks, not on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for r in b.to_pylist():
                now = [np.array(r["g"]), np.array(r["r"]), r["yy"], r["n"]]
                out = now if out is None else [a + b for a, b in zip(out, now, strict=True)]
        if out:
            yield pa.RecordBatch.from_pydict({"d": pa.array([len(out[1])], pa.int32()), "g": [out[0]], "r": [out[1]], "yy": [out[2]], "n": [out[3]]})

    ddl = "d int, g array<double>, r array<double>, yy double, n long"
    n = parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(max(1, min(n, 16))).mapInArrow(run, ddl).coalesce(1).mapInArrow(run, ddl)


def gramian(df: DataFrame, z: str, y: str | None = None, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Z'WZ (d x d), Z'Wy, y'Wy, rows: d*d numbers on the driver, however many rows there are."""
    r = add_parts(gramian_parts(df, z, y, weight)).first()
    if r is None:
        return np.zeros((0, 0)), np.zeros(0), 0.0, 0
    return np.array(r["g"]).reshape(r["d"], r["d"]), np.array(r["r"]), r["yy"], r["n"]


def gramian_rows(df: DataFrame, z: str) -> DataFrame:
    """(a, b, g) for a <= b, wholly relational."""
    v = F.transform(F.col(z).cast("array<double>"), lambda x, i: F.struct(i.alias("pos"), x.alias("v")))
    r = df.select(F.explode(v).alias("l"), v.alias("all")).select("l", F.explode(F.filter("all", lambda s: s["pos"] >= F.col("l")["pos"])).alias("r"))
    return r.groupBy(F.col("l.pos").alias("a"), F.col("r.pos").alias("b")).agg(F.sum(F.col("l.v") * F.col("r.v")).alias("g"))


def right_hand_side(df: DataFrame, z: str, y: str) -> DataFrame:
    """(a, r): sums of z_a y."""
    return df.select(F.posexplode(F.col(z).cast("array<double>")).alias("a", "v"), F.col(y).alias("y")).groupBy("a").agg(F.sum(F.col("v") * F.col("y")).alias("r"))


def normal_equations(df: DataFrame, columns: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of a few columns in one aggregation."""
    n = len(columns)
    sums = [F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1)] + [F.sum(columns[i] * y).alias(f"r{i}") for i in range(n)]
    row = df.agg(*sums).first()
    g, r = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        r[i] = row[f"r{i}"] or 0.0
        for j in range(i + 1):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, r


# Driver solvers.


def symmetric_lstsq(g: np.ndarray, r: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
    """Least-norm solution of g x = r for symmetric g."""
    w, v = np.linalg.eigh(g)
    keep = w > rcond * max(w.max(initial=0.0), 1e-300)
    return v[:, keep] @ ((v[:, keep].T @ r) / w[keep])


def cholesky_solve(a: np.ndarray, b: np.ndarray, shift: float = 0.0) -> np.ndarray:
    low = np.linalg.cholesky(a + shift * np.eye(len(a)))
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def lu_solve(a: np.ndarray, b: np.ndarray, shift: float = 0.0) -> np.ndarray:
    return np.linalg.solve(a + shift * np.eye(len(a)), b)


def eig_solve(a: np.ndarray, b: np.ndarray, shift: float = 0.0) -> np.ndarray:
    w, v = np.linalg.eigh(a)
    return v @ ((v.T @ b) / (w + shift))


def svd_solve(a: np.ndarray, b: np.ndarray, rcond: float = 0.0) -> np.ndarray:
    u, s, vh = np.linalg.svd(a, full_matrices=False)
    keep = s > rcond * s.max(initial=0.0)
    return vh[keep].T @ ((u[:, keep].T @ b) / s[keep])


def lstsq_solve(a: np.ndarray, b: np.ndarray, rcond: float | None = None) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=rcond)[0]


SOLVERS = {"cholesky": cholesky_solve, "lu": lu_solve, "eig": eig_solve}


def ridge_from_svd(z: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    u, s, vh = np.linalg.svd(z, full_matrices=False)
    return vh.T @ (s / (s * s + l2) * (u.T @ y))


def relative_l2(g: np.ndarray, rows: int, ratio: float) -> float:
    """ratio times the mean squared singular value of Z, from its Gramian."""
    return ratio * float(np.trace(g)) / max(1, min(rows, len(g)))


def masked_solutions(k: np.ndarray, y: np.ndarray, known: np.ndarray, l2: float) -> np.ndarray:
    """Several targets (columns of y) with missing labels: one factorisation for each pattern of known rows."""
    out = np.zeros(y.shape)
    patterns: dict[bytes, list[int]] = {}
    for t in range(y.shape[1]):
        patterns.setdefault(known[:, t].tobytes(), []).append(t)
    for targets in patterns.values():
        rows = np.flatnonzero(known[:, targets[0]])
        if len(rows):
            out[np.ix_(rows, targets)] = cholesky_solve(k[np.ix_(rows, rows)], y[np.ix_(rows, targets)], l2)
    return out


def orthogonalised(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(a, full_matrices=False)[2]


def kernel_loo_errors(k: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Leave-one-out errors of kernel ridge: -alpha_i / (K + l2)^-1_ii."""
    inverse = np.linalg.inv(k + l2 * np.eye(len(k)))
    return -(inverse @ y) / np.diag(inverse)


def log_marginal_likelihood(k: np.ndarray, y: np.ndarray) -> float:
    low = np.linalg.cholesky(k)
    half = np.linalg.solve(low, y)
    return float(-0.5 * half @ half - np.log(np.diag(low)).sum() - 0.5 * len(y) * math.log(2 * math.pi))


def feature_loo_errors(df: DataFrame, z: str, y: str, g: np.ndarray, r: np.ndarray, l2: float, keep: list[str]) -> DataFrame:
    """Leave-one-out errors (yhat - y) / (1 - h) with h = z'(Z'Z + l2)^-1 z, row by row on the executors."""
    inverse = np.linalg.inv(g + l2 * np.eye(len(g)))
    alpha = inverse @ r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                zz, y_ = _vectors(b, "_z"), b.column("_y").to_numpy()
                h = ((zz @ inverse) * zz).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(h), pa.array((zz @ alpha - y_) / (1 - h))], names=[*keep, "leverage", "err"])

    rows = df.select(*keep, F.col(z).cast("array<double>").alias("_z"), F.col(y).cast("double").alias("_y"))
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), "leverage double", "err double"])
    return rows.mapInArrow(run, ddl)


def feature_loo_derivative(df: DataFrame, z: str, dz: str, y: str, g: np.ndarray, r: np.ndarray, l2: float, keep: list[str]) -> DataFrame:
    """keep, err, derr: leave-one-out errors and their derivative by a hyperparameter that moves the features by ``dz``.

    With A = Z'Z + l2 and alpha = A^-1 Z'y, the rows' part is local once Z'dZ and dZ'(y - Z alpha) are known: one pass adds these up, a second gives the rows.
    """
    d = len(r)
    inverse = np.linalg.inv(g + l2 * np.eye(d))
    alpha = inverse @ r
    rows = df.select(*keep, F.col(z).cast("array<double>").alias("_z"), F.col(dz).cast("array<double>").alias("_dz"), F.col(y).cast("double").alias("_y"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            if b.num_rows:
                zz, dd = _vectors(b, "_z"), _vectors(b, "_dz")
                m += zz.T @ dd
                v += dd.T @ (b.column("_y").to_numpy() - zz @ alpha)
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "g": [m.ravel()], "r": [v], "yy": [0.0], "n": [0]})

    got = add_parts(rows.mapInArrow(sums, "d int, g array<double>, r array<double>, yy double, n long")).first()
    m, v = np.array(got["g"]).reshape(d, d), np.array(got["r"])
    push, turn = inverse @ (v - m @ alpha), inverse @ m @ inverse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                zz, dd, y_ = _vectors(b, "_z"), _vectors(b, "_dz"), b.column("_y").to_numpy()
                left = 1 - ((zz @ inverse) * zz).sum(axis=1)
                dh = 2 * ((dd @ inverse) * zz).sum(axis=1) - 2 * ((zz @ turn) * zz).sum(axis=1)
                err = (zz @ alpha - y_) / left
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(err), pa.array((dd @ alpha + zz @ push) / left + err * dh / left)], names=[*keep, "err", "derr"])

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), "err double", "derr double"])
    return rows.mapInArrow(run, ddl)


def grid_minimum(f, low: float, high: float, points: int = 32, refine: int = 40) -> tuple[float, float]:
    """The least value of f on a grid, then golden sections around it; points where f is None or not finite are left out."""

    def value(x):
        v = f(x)
        return math.inf if v is None or not math.isfinite(v) else v

    xs = np.linspace(low, high, points).tolist()
    vs = [value(x) for x in xs]
    i = int(np.argmin(vs))
    a, b = xs[max(0, i - 1)], xs[min(points - 1, i + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(refine):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if value(c) <= value(d):
            b = d
        else:
            a = c
    x = (a + b) / 2
    return min((vs[i], xs[i]), (value(x), x))[::-1]


def finite_difference_weights(points: list[float], order: int) -> np.ndarray:
    """Weights w with sum w_i f(p_i) = the derivative of that order at 0, exact for polynomials: a Vandermonde system."""
    p = np.array(points, float)
    rhs = np.zeros(len(p))
    rhs[order] = math.factorial(order)
    return np.linalg.solve(np.vander(p, increasing=True).T, rhs)


def independent_rows(k: np.ndarray, tol: float) -> np.ndarray:
    """Gram-Schmidt in kernel space by pivot-free Cholesky; False where the residual is below tol times the largest diagonal."""
    n = len(k)
    keep, low = np.ones(n, bool), np.zeros((n, n))
    bound = tol * k.diagonal().max(initial=0.0)
    for i in range(n):
        rest = k[i, i] - low[i] @ low[i]
        if rest < bound or rest <= 0:
            keep[i] = False
            low[:, i] = 0
            continue
        low[i:, i] = (k[i:, i] - low[i:, :i] @ low[i, :i]) / math.sqrt(rest)
    return keep


def exclude_nearest(sqdist: np.ndarray, least: float | None = None, count: int | None = None, seed: int = 0) -> np.ndarray:
    """Drop one of each closest pair, a seeded side, until the least distance or the count is reached; the indices left out."""
    d = sqdist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    rng, gone = np.random.default_rng(seed), []
    while len(gone) < (len(d) if count is None else count):
        at = int(np.argmin(d))
        i, j = divmod(at, len(d))
        if not np.isfinite(d[i, j]) or (least is not None and d[i, j] >= least):
            break
        out = (i, j)[int(rng.integers(2))]
        gone.append(out)
        d[out, :] = d[:, out] = np.inf
    return np.array(sorted(gone), int)


def minimise(value_and_gradient, x0: np.ndarray, rounds: int = 500, tol: float = 1e-10, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; the function may be a Spark aggregation of loss and gradient."""
    x = np.array(x0, float)
    f, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max(initial=0.0) < tol:
            break
        q, used = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-300)), g @ q
        if slope <= 0:
            q, slope, pairs = g.copy(), g @ g, []
        for _ in range(60):
            new = x - step * q
            fn, gn = value_and_gradient(new)
            if fn <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, gn - g
        if s @ y > 1e-16:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - fn) <= 1e-15 * max(abs(f), 1e-300)
        x, f, g = new, fn, gn
        if done:
            break
    return x
