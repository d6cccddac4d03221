"""Whitening of embeddings: principal components by block subspace iteration that never forms the covariance.

The fit takes passes over the rows, each one Spark job that sends back d x block numbers (added up on the executors):

1. sums of the fixed-point components, exact, and the number of rows;
2. again and again ``X'(XQ)`` for an orthonormal block ``Q``, the rows ``X`` centred before they are multiplied.  The driver orthogonalises the
   block (QR), and solves the small Rayleigh-Ritz problem in the space of the blocks that it keeps: the Ritz vectors so far and
   the newest residuals.  Earlier blocks stay in that space until it is ``space`` blocks wide and is cut back to the best Ritz vectors, so that a flat
   spectrum needs a handful of passes instead of hundreds; ``space=1`` is the plain iteration on one block;
3. when the residuals of all k pairs are small, a pass with the k vectors alone certifies them: it measures ``|Vq - eq|`` directly and the covariance of the whitened rows.

Rows are read once a pass and nothing is shuffled but the partial sums.  Nothing of the size of the table or of d x d is made anywhere.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped; a null id is an id like any other; repeated rows count each; a vector shorter than the longest has zeros
beyond its end; entries beyond 2**62 / scale stop there.  Components of less than 1e-9 of the largest variance are none, so there may be fewer than ``k``, and none at all for an
empty table, a single row or equal rows: ``whitened`` is then an empty array.  A deviation beyond a long is null.  Vectors of text, or with extra columns of any name, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import fresh
from .vectors import fixed_point, usable

#: Variances below this part of the largest one are rounding.
NOTHING = 1e-9


def _whole(column: pa.Array, width: int, scale: float, offset: int) -> np.ndarray:
    """Fixed-point components of usable vectors, as longs."""
    return fixed_point(column, width, scale).astype(np.int64) + offset


@dataclass(frozen=True)
class Whitening:
    """What a fit yields: sums S (exact), directions (d x k, unit columns), variances, the whole variance, and what certifies them."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int
    scale: float = 1024.0
    offset: int = 100_000

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace > 0 else self.variances

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 for each row, exact; null beyond a long."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1) if x.shape[1] else [0] * len(x)
        return [int(v) if v < 2**63 else None for v in exact]

    def transform(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        """The usable rows of ``df``, all columns kept, with ``whitened`` (array of doubles, a place for each component) and ``deviation`` after them (underscores after a name that is taken)."""
        width, vec = len(self.sums), fresh(df.columns, "_vector")
        names = [fresh(df.columns, "whitened"), fresh(df.columns, "deviation")]
        out = StructType([*df.schema.fields]).add(names[0], ArrayType(DoubleType(), False)).add(names[1], LongType())
        schema, scale, offset = to_arrow_schema(out), self.scale, self.offset
        to = self.directions / np.sqrt(self.variances)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(usable(b.column(vec))))
                x = _whole(b.column(vec), width, scale, offset)
                z = self.centred(x) @ to
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                new = [pa.ListArray.from_arrays(offsets, pa.array(z.ravel())), pa.array(self.deviations(x), pa.int64())]
                kept = [c.cast(f.type) for c, f in zip(b.columns, schema, strict=False) if f.name not in names]
                yield pa.RecordBatch.from_arrays([*kept, *[c.cast(f.type) for c, f in zip(new, list(schema)[-2:], strict=True)]], schema=schema)

        return df.withColumn(vec, F.col(f"`{column}`").cast("array<double>")).mapInArrow(run, out)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n in double precision: the whole part of the mean goes first, exactly."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([float((s - n * m) / n) for s, m in zip(sums, near, strict=True)])
    return (x - np.array(near, np.int64)).astype(float) - rest


def _sums(vectors: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """Number of usable rows, and exact sums by dimension.  Shorter vectors have ``offset`` beyond their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for b in batches:
            c = b.column(0).filter(pa.array(usable(b.column(0))))
            if not len(c):
                continue
            n += len(c)
            x = _whole(c, 0, scale, 0)
            exact = x if not x.size or int(np.abs(x).max()) < 2**62 // len(x) else x.astype(object)
            now = [int(v) for v in exact.sum(axis=0)]
            total = [a + v for a, v in zip(total + [0] * (len(now) - len(total)), now + [0] * (len(total) - len(now)), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"j": pa.array([-1, *range(len(total))], pa.int32()), "s": pa.array([n, *total], pa.decimal128(38, 0))})

    got = {r["j"]: int(r["s"]) for r in vectors.mapInArrow(run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n = got.pop(-1, 0)
    return n, [got[j] + n * offset for j in sorted(got)]


def _products(vectors: DataFrame, q: np.ndarray, n: int, sums: list[int], scale: float, offset: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """X'(XQ), and with ``inner`` also (XQ)'(XQ) and the sums of XQ; last, the sum of squares of X.  Rows are centred first."""
    d, b = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            c = batch.column(0).filter(pa.array(usable(batch.column(0))))
            if not len(c):
                continue
            x = _centred(_whole(c, d, scale, offset), n, sums)
            y = x @ q
            parts = [x.T @ y, y.T @ y, y.sum(axis=0)[None], np.full((1, b), np.einsum("ij,ij", x, x))] if inner else [x.T @ y, np.full((1, b), np.einsum("ij,ij", x, x))]
            now = np.concatenate(parts)
            out = now if out is None else out + now
        if out is not None:
            yield pa.RecordBatch.from_pydict({"j": pa.array(range(len(out)), pa.int32()), "y": pa.array(out.tolist(), pa.list_(pa.float64()))})

    parts = vectors.mapInArrow(run, "j int, y array<double>")
    got = sorted(parts.groupBy("j").agg(*[F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(b)]).collect())
    all_ = np.array([r[1:] for r in got])
    return all_[:d], all_[d : d + b], all_[d + b] if inner else all_[d], float(all_[-1, 0])


def _more(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` has beyond ``basis``, by QR twice; directions that are only rounding go."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        u, s, _ = np.linalg.svd(r)
        new = (q @ u)[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    return new


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, falling, and coordinates in the basis."""
    h = basis.T @ image
    e, y = np.linalg.eigh((h + h.T) / 2)
    return e[::-1], y[:, ::-1]


def fit(df: DataFrame, column: str = "embedding", k: int = 8, extra: int = 8, space: int = 8, tolerance: float = 1e-13, most_passes: int = 200, seed: int = 1, scale: float = 1024.0, offset: int = 100_000) -> Whitening:
    """The first ``k`` principal components of x = floor(scale * c) + offset over all usable rows.

    ``extra`` columns more are iterated besides; ``tolerance`` is the residual asked for, relative to the largest variance, which a last pass certifies (up to a hundredfold of it, for rounding).
    """
    vectors = df.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    n, sums = _sums(vectors, scale, offset)
    d, passes = len(sums), 1
    nothing = Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0, passes, scale, offset)
    if not d:
        return nothing
    apply = lambda q: [a / n for a in _products(vectors, q, n, sums, scale, offset)]
    block = min(d, k + extra)
    basis = np.zeros((d, 0))
    image = basis
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    while True:
        made, _, _, trace = apply(new)
        passes += 1
        if trace <= 0:
            return Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), trace, np.zeros(0), 0.0, passes, scale, offset)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, made], axis=1)
        e, y = _ritz(basis, image)
        y, e = y[:, :block], e[:block]
        left = image @ y - (basis @ y) * e
        size = np.linalg.norm(left, axis=0)
        wanted = min(k, len(e))
        if (size[:wanted] <= tolerance * e[0]).all() or basis.shape[1] == d:
            q, variances, residuals, error, spent = _certified(vectors, basis @ y[:, :wanted], e[:wanted], n, sums, scale, offset)
            passes += spent
            if not len(variances) or residuals.max() <= 100 * tolerance * variances[0]:
                return Whitening(n, tuple(sums), q, variances, trace, residuals, error, passes, scale, offset)
        if passes >= most_passes:
            raise RuntimeError(f"residuals of {size[:wanted].max() / e[0]:.1e} of the largest variance after {passes} passes")
        if space <= 1 or basis.shape[1] + block > space * block:
            # the best Ritz vectors go on, their images with them; for one block that is plain subspace iteration
            new = np.linalg.qr(image @ y)[0] if space <= 1 else new
            basis, image = (np.zeros((d, 0)), np.zeros((d, 0))) if space <= 1 else (basis @ y, image @ y)
        if space > 1:
            new = _more(basis, left)
            if not new.shape[1]:  # an invariant subspace: whatever it lacks comes from a new start
                new = _more(basis, np.random.default_rng(seed + passes).standard_normal((d, min(block, d - basis.shape[1]))))


def _certified(vectors: DataFrame, q: np.ndarray, e: np.ndarray, n: int, sums: list[int], scale: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Directions, variances, true residuals and the whitened rows' distance from unit covariance, all from one pass over the rows."""
    kept = e > NOTHING * e[0]
    q = np.linalg.qr(q)[0][:, kept]
    q = q * np.where(q[np.abs(q).argmax(axis=0), range(q.shape[1])] < 0, -1.0, 1.0)
    made, inner, total, _ = _products(vectors, q, n, sums, scale, offset, inner=True)
    variances = np.diag(inner) / n
    residuals = np.linalg.norm(made / n - q * variances, axis=0)
    by = np.sqrt(variances)
    white = (inner / n - np.outer(total / n, total / n)) / by[:, None] / by
    return q, variances, residuals, float(np.abs(white - np.eye(len(by))).max(initial=0.0)), 1


def whitened(df: DataFrame, column: str = "embedding", k: int = 8, **how) -> DataFrame:
    """Fit on all rows of ``df`` and whiten them: see :func:`fit` and :meth:`Whitening.transform`."""
    return fit(df, column, k, **how).transform(df, column)
