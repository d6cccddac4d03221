"""Kernel matrices: all pairs of vectors, or sums over the atoms of pairs of molecules.

Vectors are packed into tiles of about ``tile`` rows, tiles are dealt out to a square of cells, and a cell's tiles meet by an equi-join: each
pair of tiles is one dense block in NumPy.  Nothing is broadcast, a task holds two tiles and one block at a time, and neither an element nor a
molecule is a join key, so none of them can be hot.  Tiles of molecules hold whole ones, so a block's sums over atoms are final and the
pairs of molecules are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V

TILE = 512


@dataclass(frozen=True)
class Kernel:
    """kind: laplacian, gaussian or matern; order and metric (l1, l2) for matern.  sigmas: one or more widths."""

    kind: str = "gaussian"
    sigmas: tuple[float, ...] = (1.0,)
    order: int = 0
    metric: str = "l1"

    @property
    def uses_l1(self) -> bool:
        return self.kind == "laplacian" or (self.kind == "matern" and self.metric == "l1")

    def of_distance(self, d: np.ndarray, sigma: float) -> np.ndarray:
        """d: the l1 distance, or the squared l2 distance."""
        if self.kind == "laplacian":
            return np.exp(-d / sigma)
        if self.kind == "gaussian":
            return np.exp(-d / (2 * sigma * sigma))
        x = (d if self.metric == "l1" else np.sqrt(d)) / sigma
        if self.order == 0:
            return np.exp(-x)
        if self.order == 1:
            return np.exp(-math.sqrt(3) * x) * (1 + math.sqrt(3) * x)
        return np.exp(-math.sqrt(5) * x) * (1 + math.sqrt(5) * x + 5 * x * x / 3)

    def block(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        if self.kind == "gaussian" and len(self.sigmas) == 1:
            return [gaussian_block(a, b, self.sigmas[0])]
        d = l1_block(a, b) if self.uses_l1 else l2sq_block(a, b)
        return [self.of_distance(d, s) for s in self.sigmas]

    def column(self, a, b, sigma: float | None = None):
        """The same as a Column expression."""
        s = self.sigmas[0] if sigma is None else sigma
        if self.kind == "laplacian":
            return F.exp(-V.l1(a, b) / s)
        if self.kind == "gaussian":
            return F.exp(-V.l2sq(a, b) / (2 * s * s))
        x = (V.l1(a, b) if self.metric == "l1" else F.sqrt(V.l2sq(a, b))) / s
        if self.order == 0:
            return F.exp(-x)
        if self.order == 1:
            return F.exp(-math.sqrt(3) * x) * (1 + math.sqrt(3) * x)
        return F.exp(-math.sqrt(5) * x) * (1 + math.sqrt(5) * x + 5 * x * x / 3)


def l1_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):  # component by component: no array of all differences
        np.subtract(x[:, None], y[None], out=step)
        np.abs(step, out=step)
        out += step
    return out


def l2sq_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By norms and products; clamped at 0 against cancellation."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def gaussian_block(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """Exponents by one product, the norms being two more components; clamped at 0 against cancellation.  One array of the block's size."""
    u, v = np.ones((len(a), a.shape[1] + 2)), np.ones((len(b), b.shape[1] + 2))
    u[:, :-2], v[:, :-2] = a / (sigma * sigma), b
    u[:, -2], v[:, -1] = (a * a).sum(axis=1) / (-2 * sigma * sigma), (b * b).sum(axis=1) / (-2 * sigma * sigma)
    e = u @ v.T
    return np.exp(np.minimum(e, 0, out=e), out=e)


def picked(df: DataFrame, id_col: str, vec: str, z: str | None = None, weight: str | None = None) -> DataFrame:
    cols = (F.col(id_col).cast("long").alias("id"), (F.col(z) if z else F.lit(0)).cast("long").alias("z"), V.as_vector(vec).alias("vec"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return df.select(*cols).filter("id is not null and vec is not null and z is not null")


def tiles(df: DataFrame, id_col: str, vec: str, z: str | None = None, size: int = TILE, weight: str | None = None, whole: bool = False, ranged: bool = False) -> DataFrame:
    """One row for each run of about ``size`` vectors: n, ids, elements, vectors, weights.  Rows stay where they lie; with ``whole`` those of one id come together and share a tile; with
    ``ranged`` tiles are ranges of ids, so that of two tiles that meet twice one meeting can be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < size:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            end = n - n % size
            if whole:
                ids = t.column("id").to_numpy()
                end = int(np.searchsorted(ids, ids[-1]))  # ascending; the last molecule may go on
            yield from cut(t.slice(0, end))
            held, n = [t.slice(end)], n - end
        if n:
            yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        ids, zs, w = (b.column(c).to_numpy() for c in ("id", "z", "w"))
        x = np.asarray(b.column("vec").flatten(), float).reshape(len(ids), -1)
        at = 0
        while at < len(ids):
            end = min(len(ids), at + size)
            if whole and end < len(ids):
                first = int(np.searchsorted(ids, ids[end], "left"))
                end = first if first > at else int(np.searchsorted(ids, ids[end], "right"))
            rows = at + np.argsort(zs[at:end], kind="stable")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int32()), "ids": [ids[rows].tobytes()], "z": [zs[rows].tobytes()], "x": [x[rows].tobytes()], "w": [w[rows].tobytes()], "first": pa.array([ids[rows].min()]), "last": pa.array([ids[rows].max()])})
            at = end

    rows = picked(df, id_col, vec, z, weight)
    if whole or ranged:
        rows = (rows.repartitionByRange("id") if ranged else rows.repartition("id")).sortWithinPartitions("id")
    return rows.mapInArrow(run, "n int, ids binary, z binary, x binary, w binary, first long, last long")


def _pairs(a: DataFrame, b: DataFrame, half: bool = False) -> DataFrame:
    """Every pair of tiles once.  Tiles go to ``g`` rows and columns of cells by their hash, g * g being about the shuffle partitions, so each is sent g times.

    half: not those pairs whose ids of ``a`` are all below those of ``b``.  Where both sides have the same rows, these meet the other way round.
    """
    g = max(1, round(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    cell = lambda *c: F.pmod(F.xxhash64(*c), F.lit(g)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    left = a.select(cell("ids", "x").alias("row"), every.alias("col"), *[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(every.alias("row"), cell("ids", "x").alias("col"), *[F.col(c).alias(f"b_{c}") for c in b.columns])
    met = left.join(right.hint("merge"), ["row", "col"])
    return (met.filter("a_last >= b_first") if half else met).drop("row", "col", *[f"{s}_{c}" for s in "ab" for c in ("first", "last")])


def _tile_pairs(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each pair of tiles of a batch, on the batch's own memory."""
    kinds = {"ids": np.int64, "z": np.int64, "x": np.float64, "w": np.float64}
    names = [n for n in batch.schema.names if n[2:] in kinds]
    for k in range(batch.num_rows):
        r = {n: np.frombuffer(batch.column(n)[k].as_buffer(), kinds[n[2:]]) for n in names}
        for side in "ab":
            r[f"{side}_x"] = r[f"{side}_x"].reshape(len(r[f"{side}_ids"]), -1)
        yield r


def _rows(i: np.ndarray, j: np.ndarray, sigma: float, k: np.ndarray, lower: bool, turned: bool = False) -> pa.RecordBatch:
    """lower: only j <= i; with ``turned`` the pairs with j < i the other way round."""
    ii, jj, kk = np.repeat(i, len(j)), np.tile(j, len(i)), k.ravel()
    if lower:
        keep = jj < ii if turned else jj <= ii
        if not keep.all():
            ii, jj, kk = ii[keep], jj[keep], kk[keep]
    if turned:
        ii, jj = jj, ii
    return pa.RecordBatch.from_arrays([pa.array(ii), pa.array(jj), pa.array(np.full(len(ii), sigma)), pa.array(kk)], names=["i", "j", "sigma", "k"])


K_ROWS = "i long, j long, sigma double, k double"


def kernel_matrix(a: DataFrame, b: DataFrame | None, kernel: Kernel, id_col: str = "id", vec: str = "x", lower: bool = False, tile: int = TILE) -> DataFrame:
    """(i, j, sigma, k) for all pairs; with b None the kernel of ``a`` with itself, only j <= i if ``lower``."""
    ta = tiles(a, id_col, vec, size=tile)
    tb = ta if b is None else tiles(b, id_col, vec, size=tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                if not lower or r["b_ids"].min() <= r["a_ids"].max():
                    for sigma, k in zip(kernel.sigmas, kernel.block(r["a_x"], r["b_x"]), strict=True):
                        yield _rows(r["a_ids"], r["b_ids"], sigma, k, lower)

    return _pairs(ta, tb).mapInArrow(run, K_ROWS)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and where each begins."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return sorted_values[starts], starts


def _molecule_sums(kernel: Kernel, r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Molecules of both tiles and, for each width, sums of kernel values over pairs of atoms of one element."""
    ui, uj = np.unique(r["a_ids"]), np.unique(r["b_ids"])
    out = np.zeros((len(kernel.sigmas), len(ui), len(uj)))
    za, sa = _runs(r["a_z"])
    zb, sb = _runs(r["b_z"])
    ends = {int(z): (int(s), int(e)) for z, s, e in zip(zb, sb, [*sb[1:], len(r["b_z"])], strict=True)}
    for z, lo, hi in zip(za.tolist(), sa.tolist(), [*sa[1:].tolist(), len(r["a_z"])], strict=True):
        if z not in ends:
            continue
        at, end = ends[z]
        oi, oj = lo + np.argsort(r["a_ids"][lo:hi], kind="stable"), at + np.argsort(r["b_ids"][at:end], kind="stable")
        mi, si = _runs(r["a_ids"][oi])
        mj, sj = _runs(r["b_ids"][oj])
        place = np.ix_(np.searchsorted(ui, mi), np.searchsorted(uj, mj))
        for n, k in enumerate(kernel.block(r["a_x"][oi], r["b_x"][oj])):
            out[n][place] += np.add.reduceat(np.add.reduceat(k, si, axis=0), sj, axis=1)
    return ui, uj, out


def local_kernel_matrix(a: DataFrame, b: DataFrame | None, kernel: Kernel, mol: str = "mol", vec: str = "x", z: str | None = None, lower: bool = False, tile: int = TILE) -> DataFrame:
    """(i, j, sigma, k) for pairs of molecules: sums over pairs of atoms, of the same element if ``z`` is given.

    Pairs without a common element have k = 0 and are in the result too.
    """
    own = b is None
    ta = tiles(a, mol, vec, z, tile, whole=True, ranged=own)
    tb = ta if own else tiles(b, mol, vec, z, tile, whole=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                if lower and r["b_ids"].min() > r["a_ids"].max():
                    continue
                i, j, sums = _molecule_sums(kernel, r)
                for sigma, k in zip(kernel.sigmas, sums, strict=True):
                    yield _rows(i, j, sigma, k, lower or own)
                    if own and not lower:
                        yield _rows(i, j, sigma, k, True, True)

    return _pairs(ta, tb, own).mapInArrow(run, K_ROWS)


def local_predictions(train: DataFrame, query: DataFrame, kernel: Kernel, alpha: str = "alpha", mol: str = "id", vec: str = "x", z: str | None = None) -> DataFrame:
    """(id, p): sum over training molecules of alpha * k.  A block leaves one partial sum for each molecule of the query."""
    pairs = _pairs(tiles(query, mol, vec, z, whole=True), tiles(train, mol, vec, z, weight=alpha, whole=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                i, _, sums = _molecule_sums(kernel, r)
                first = np.unique(r["b_ids"], return_index=True)[1]
                yield pa.RecordBatch.from_pydict({"id": i, "p": sums[0] @ r["b_w"][first]})

    return pairs.mapInArrow(run, "id long, p double").groupBy("id").agg(F.sum("p").alias("p"))


def local_dense(df: DataFrame, kernel: Kernel, ids: list[int], mol: str = "id", vec: str = "x", z: str | None = None) -> np.ndarray:
    """The local kernel (n, n) of a training set on the driver, in the order of ids: blocks travel, not rows."""
    t = tiles(df, mol, vec, z, whole=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                i, j, sums = _molecule_sums(kernel, r)
                yield pa.RecordBatch.from_pydict({"i": [i.tobytes()], "j": [j.tobytes()], "k": [sums[0].tobytes()]})

    return _gathered(_pairs(t, t).mapInArrow(run, "i binary, j binary, k binary"), ids, 1)[0]


def _gathered(blocks: DataFrame, ids: list[int], widths: int) -> np.ndarray:
    order = np.argsort(np.array(ids, np.int64))
    known = np.array(ids, np.int64)[order]
    out = np.zeros((widths, len(ids), len(ids)))
    for r in blocks.toLocalIterator():
        i, j = (order[np.searchsorted(known, np.frombuffer(r[c], np.int64))] for c in ("i", "j"))
        out[:, i[:, None], j[None]] = np.frombuffer(r["k"]).reshape(widths, len(i), len(j))
    return out


def mirrored(lower: DataFrame) -> DataFrame:
    """The full symmetric matrix from its lower triangle, which is made once."""
    side = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "sigma", "k")
    both = F.when(F.col("i") == F.col("j"), F.array(side("i", "j"))).otherwise(F.array(side("i", "j"), side("j", "i")))
    return lower.select(F.explode(both).alias("p")).select("p.*")


def kernel_predictions(train: DataFrame, query: DataFrame, kernel: Kernel, alpha: str = "alpha", id_col: str = "id", vec: str = "x") -> DataFrame:
    """(id, prediction): sum over training rows of alpha * k.  A block leaves one partial sum for each query row."""
    pairs = _pairs(tiles(query, id_col, vec), tiles(train, id_col, vec, weight=alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                yield pa.RecordBatch.from_pydict({"id": r["a_ids"], "p": kernel.block(r["a_x"], r["b_x"])[0] @ r["b_w"]})

    return pairs.mapInArrow(run, "id long, p double").groupBy("id").agg(F.sum("p").alias("prediction"))


def dense(df: DataFrame, kernel: Kernel, ids: list[int], id_col: str = "id", vec: str = "x") -> np.ndarray:
    """The kernels (sigmas, n, n) of a training set on the driver, in the order of ids: blocks travel, not rows."""
    t = tiles(df, id_col, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                yield pa.RecordBatch.from_pydict({"i": [r["a_ids"].tobytes()], "j": [r["b_ids"].tobytes()], "k": [np.stack(kernel.block(r["a_x"], r["b_x"])).tobytes()]})

    return _gathered(_pairs(t, t).mapInArrow(run, "i binary, j binary, k binary"), ids, len(kernel.sigmas))


def squared_distances(k: DataFrame) -> DataFrame:
    """(i, j, sqdist): K_ii + K_jj - 2 K_ij from any full kernel table."""
    diagonal = k.filter("i = j")
    di, dj = diagonal.select("i", F.col("k").alias("kii")), diagonal.select("j", F.col("k").alias("kjj"))
    return k.join(di, "i").join(dj, "j").select("i", "j", (F.col("kii") + F.col("kjj") - 2 * F.col("k")).alias("sqdist"))


def _own(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """Each row's kernel with itself."""
    return np.full(len(x), kernel.of_distance(np.zeros(1), kernel.sigmas[0])[0])


def rkhs_distances(a: DataFrame, kernel: Kernel, id_col: str = "id", vec: str = "x", tile: int = TILE) -> DataFrame:
    """(i, j, sqdist) of a kernel of vectors: the diagonal is computed beside each block, which leaves distances and no kernel values."""
    t = tiles(a, id_col, vec, size=tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                d = _own(kernel, r["a_x"])[:, None] + _own(kernel, r["b_x"])[None] - 2 * kernel.block(r["a_x"], r["b_x"])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r["a_ids"], len(r["b_ids"]))), pa.array(np.tile(r["b_ids"], len(r["a_ids"]))), pa.array(d.ravel())], names=["i", "j", "sqdist"])

    return _pairs(t, t).mapInArrow(run, "i long, j long, sqdist double")


def nearest(sqdist: DataFrame) -> DataFrame:
    """(i, j, sqdist) of the nearest other row; the smallest j of equals."""
    return sqdist.filter("i <> j").groupBy("i").agg(F.min(F.struct("sqdist", "j")).alias("m")).select("i", "m.j", "m.sqdist")


def nearest_in_rkhs(a: DataFrame, kernel: Kernel, id_col: str = "id", vec: str = "x", tile: int = TILE, digits: int = 9) -> DataFrame:
    """The same from the vectors: a block leaves one row for each of its rows.  Distances equal to ``digits`` places are ties."""
    t = tiles(a, id_col, vec, size=tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _tile_pairs(batch):
                order = np.argsort(r["b_ids"], kind="stable")
                j = r["b_ids"][order]
                d = np.round(_own(kernel, r["a_x"])[:, None] + _own(kernel, r["b_x"])[None] - 2 * kernel.block(r["a_x"], r["b_x"][order])[0], digits)
                d[r["a_ids"][:, None] == j[None]] = np.inf
                at = d.argmin(axis=1)
                least = d[np.arange(len(at)), at]
                use = np.isfinite(least)
                yield pa.RecordBatch.from_pydict({"i": r["a_ids"][use], "j": j[at][use], "sqdist": least[use]})

    return nearest(_pairs(t, t).mapInArrow(run, "i long, j long, sqdist double"))


def _largest_l1(a: np.ndarray, b: np.ndarray, best: float, most: int = 1 << 10) -> float:
    """The largest l1 distance of a block, or ``best`` if none is above it.  The root of the dimension times the l2 distance bounds it, by one product of matrices; only pairs whose bound is above the best so far are summed up."""
    far, d2 = lambda i, j: np.abs(a[i] - b[j]).sum(axis=1).max(initial=best), l2sq_block(a, b)
    size = (a * a).sum(axis=1).max() + (b * b).sum(axis=1).max()
    slack = 1e-12 * size * a.shape[1]  # rounding of norms and products
    if not np.isfinite(size):
        return float(np.max(l1_block(a, b), initial=best))
    near = lambda v: v * v * (1 - 1e-12) / a.shape[1] - slack
    if d2.max() <= near(best):
        return best
    best = far(np.arange(len(a)), d2.argmax(axis=1))
    i, j = np.nonzero(d2 > near(best))
    for lo in range(0, len(i), most):
        best = far(i[lo : lo + most], j[lo : lo + most])
    return float(best)


def max_pair_distance(df: DataFrame, metric: str, id_col: str = "id", vec: str = "x", tile: int = TILE) -> DataFrame:
    """(max_dist): the largest distance of all pairs; one number leaves each task."""
    ta = tiles(df, id_col, vec, size=tile, ranged=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for r in _tile_pairs(batch):
                m = _largest_l1(r["a_x"], r["b_x"], best or 0.0) if metric == "l1" else math.sqrt(l2sq_block(r["a_x"], r["b_x"]).max())
                best = float(np.maximum(best or 0.0, m))
        if best is not None:
            yield pa.RecordBatch.from_pydict({"d": [float(best)]})

    return _pairs(ta, ta, True).mapInArrow(run, "d double").agg(F.max("d").alias("max_dist"))
