"""Kernel models beyond the memory of the driver, and choices of training rows, over tiles of vectors.

Vectors are packed into tiles where they lie and written once.  What needs all pairs goes through cells: sixteen tiles on a side meet sixteen others, so a task holds a fixed number of
vectors and blocks of the kernel are made, used and dropped.  The driver holds vectors with a number for each row (8 bytes a row and label) and what belongs to the landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..sources.store import written
from .kernels import Kernel, kernel_predictions
from .slopes import vector_total

#: Vectors in a tile, and tiles on each side of a cell.
TILE, SIDE = 1024, 16
#: Near copies that the preconditioner solves together, at most.
BLOCK = 256


@dataclass(frozen=True)
class Linear:
    """The inner product as a kernel."""

    def blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T

    def own(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)


def _block(kernel: Kernel | Linear, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kernel.blocks(a, b) if isinstance(kernel, Linear) else kernel.block(a, b)[0]


def _own(kernel: Kernel | Linear, x: np.ndarray) -> np.ndarray:
    return kernel.own(x) if isinstance(kernel, Linear) else np.full(len(x), float(kernel.of_distance(np.zeros(1), kernel.sigmas[0])[0]))


@dataclass
class Tiles:
    """A written table (rank, n, ids, x, y) of tiles; ``starts`` has each tile's first place in vectors over all rows."""

    table: DataFrame
    starts: np.ndarray
    n: int

    def groups(self, side: int = SIDE) -> int:
        return max(1, -(-(len(self.starts)) // side))

    @classmethod
    def of(cls, df: DataFrame, id_col: str = "id", vec: str = "x", y: list[str] | None = None, tile: int = TILE) -> Tiles:
        """Rows without an id, a vector or a label are left out."""
        labels = F.array(*[F.col(c).cast("double") for c in y]) if y else F.array().cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), V.as_vector(vec).alias("x"), labels.alias("y")).filter("id is not null and x is not null and not exists(y, v -> v is null)")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base, k, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                while n >= tile:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield packed(t.slice(0, tile), base + k)
                    held, n, k = [t.slice(tile)], n - tile, k + 1
            if n:
                yield packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0], base + k)

        def packed(b: pa.RecordBatch, name: int) -> pa.RecordBatch:
            x, y_ = (np.asarray(b.column(c).flatten(), float) for c in ("x", "y"))
            return pa.RecordBatch.from_pydict({"name": pa.array([name]), "n": pa.array([b.num_rows], pa.int32()), "ids": [b.column("id").to_numpy().tobytes()], "x": [x.tobytes()], "y": [y_.tobytes()]})

        table = written(rows.mapInArrow(run, "name long, n int, ids binary, x binary, y binary"), "tiles")
        sizes = table.select("name", "n").orderBy("name").collect()  # one row for each tile
        starts = np.concatenate([[0], np.cumsum([r["n"] for r in sizes], dtype=np.int64)])
        ranks = df.sparkSession.createDataFrame([(r["name"], i) for i, r in enumerate(sizes)], "name long, rank int")
        return cls(table.join(F.broadcast(ranks), "name").drop("name"), starts[:-1], int(starts[-1]))

    def labels(self, columns: int) -> np.ndarray:
        """(n, columns) on the driver."""
        out = np.empty((self.n, columns))
        for r in self.table.select("rank", "n", "y").collect():  # n * columns numbers
            out[self.starts[r["rank"]] :][: r["n"]] = np.frombuffer(r["y"]).reshape(r["n"], columns)
        return out

    def ids(self) -> np.ndarray:
        """In the order of the vectors over all rows, on the driver."""
        got = self.table.select("rank", "ids").orderBy("rank").collect()  # a number for each row
        return np.concatenate([np.frombuffer(r["ids"], np.int64) for r in got]) if got else np.zeros(0, np.int64)

    def each(self, f: Callable[[int, np.ndarray, np.ndarray], Iterator[dict]], ddl: str, columns: tuple[str, ...] = ("x",)) -> DataFrame:
        """``f`` of each tile's rank, ids and arrays; it yields dicts of Arrow-able columns."""
        names = [c.split()[0] for c in ddl.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    ids = np.frombuffer(b.column("ids")[k].as_buffer(), np.int64)
                    arrays = [np.frombuffer(b.column(c)[k].as_buffer()).reshape(len(ids), -1) for c in columns]
                    for out in f(b.column("rank")[k].as_py(), ids, *arrays):
                        yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

        return self.table.select("rank", "ids", *columns).mapInArrow(run, ddl)


def _unpacked(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for r, ids, x in zip(t.column("rank").to_pylist(), t.column("ids").combine_chunks() if t.num_rows else [], t.column("x").combine_chunks() if t.num_rows else [], strict=True):
        i = np.frombuffer(ids.as_buffer(), np.int64)
        out.append((r, i, np.frombuffer(x.as_buffer()).reshape(len(i), -1)))
    return sorted(out, key=lambda v: v[0])


def spread(tiles: Tiles) -> int:
    """Tiles on a side of a cell, sixteen at most: fewer where there would be fewer than some four cells for each core."""
    wanted = math.isqrt(8 * tiles.table.sparkSession.sparkContext.defaultParallelism) + 1
    return min(SIDE, max(1, len(tiles.starts) // wanted))


def cells(left: Tiles, right: Tiles | None, f: Callable[[list, list], Iterator[dict]], ddl: str, side: int = SIDE) -> DataFrame:
    """``f`` of the tiles (rank, ids, x) on both sides of each cell; without ``right`` tiles meet those of their own table, in cells on and above the diagonal only."""
    names = [c.split()[0] for c in ddl.split(",")]
    group = lambda: F.floor(F.col("rank") / side).cast("int")
    a = left.table.select("rank", "ids", "x", group().alias("row"))
    b = (right or left).table.select(*[F.col(c).alias(c) for c in ("rank", "ids", "x")], group().alias("col"))  # columns of their own: both sides may be one table
    rows, cols = left.groups(side), (right or left).groups(side)
    last = F.lit(cols - 1)
    a = a.withColumn("col", F.explode(F.sequence(F.col("row") if right is None else F.lit(0), last)))
    b = b.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("col") if right is None else F.lit(rows - 1))))
    # cells are few and of equal weight: dealt to more partitions than there are, they seldom share a task and are not put together by their bytes
    met = rows * (rows + 1) // 2 if right is None else rows * cols
    a, b = (t.repartition(met if met > 100 else 4 * met, "row", "col") for t in (a, b))

    def run(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:
        got = list(f(_unpacked(l), _unpacked(r)))
        return pa.concat_tables([pa.Table.from_pydict({n: g[n] for n in names}) for g in got]) if got else empty

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    empty = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(","))]).empty_table()
    return a.groupBy("row", "col").cogroup(b.groupBy("row", "col")).applyInArrow(run, ddl)


def _gathered(df: DataFrame, tiles: Tiles, columns: int, put: np.ufunc = np.add) -> np.ndarray:
    """(n, columns) on the driver from parts (rank, s) that belong together by rank, added up or else put together by ``put``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for r, s in zip(b.column("rank").to_pylist(), b.column("s"), strict=True):
                v = np.frombuffer(s.as_buffer())
                out[r] = put(out[r], v) if r in out else v.copy()
        for r, v in out.items():
            yield pa.RecordBatch.from_pydict({"rank": pa.array([r], pa.int32()), "s": [v.tobytes()]})

    out = np.zeros((tiles.n, columns))
    for r in df.repartition("rank").mapInArrow(run, "rank int, s binary").collect():
        v = np.frombuffer(r["s"]).reshape(-1, columns)
        out[tiles.starts[r["rank"]] :][: len(v)] = v
    return out


def paired(tiles: Tiles) -> DataFrame:
    """A written table with a row for each cell, the ranks, sizes and vectors of the tiles on both sides: what many products read without a shuffle."""

    def f(left: list, right: list) -> Iterator[dict]:
        out = {}
        for s, side in (("a", left), ("b", right)):
            out |= {f"r{s}": [np.array([r for r, _, _ in side], np.int64).tobytes()], f"n{s}": [np.array([len(x) for _, _, x in side], np.int64).tobytes()], f"x{s}": [b"".join(x.tobytes() for _, _, x in side)]}
        yield out

    return written(cells(tiles, None, f, "ra binary, na binary, xa binary, rb binary, nb binary, xb binary", spread(tiles)), "pairs")


def kernel_product(tiles: Tiles, kernel: Kernel | Linear, p: np.ndarray, pairs: DataFrame | None = None) -> np.ndarray:
    """K p for the kernel of all rows with each other: each block is made once and used on both sides.  pairs: from ``paired``."""
    starts = tiles.starts

    def side(b: pa.RecordBatch, k: int, s: str) -> list[tuple[int, np.ndarray]]:
        r, n = (np.frombuffer(b.column(f"{c}{s}")[k].as_buffer(), np.int64) for c in "rn")
        x = np.frombuffer(b.column(f"x{s}")[k].as_buffer()).reshape(int(n.sum()), -1)
        return list(zip(r.tolist(), np.split(x, np.cumsum(n)[:-1]), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                right = side(batch, k, "b")
                for ra, xa in side(batch, k, "a"):
                    for rb, xb in right:
                        if rb < ra:
                            continue
                        block = _block(kernel, xa, xb)
                        for r, v in ((ra, block @ p[starts[rb] :][: len(xb)]), (rb, block.T @ p[starts[ra] :][: len(xa)]))[: 1 + (ra != rb)]:
                            out[r] = out[r] + v if r in out else v
        for r, v in out.items():
            yield pa.RecordBatch.from_pydict({"rank": pa.array([r], pa.int32()), "s": [v.tobytes()]})

    return _gathered((paired(tiles) if pairs is None else pairs).mapInArrow(run, "rank int, s binary"), tiles, p.shape[1])


def near_copies(tiles: Tiles, kernel: Kernel, least: float = 0.9) -> np.ndarray:
    """Of each row the place of the first row of its block.  A row goes with the first one whose kernel with it is at least ``least`` of their own, and on with that one's first: one pass, and a number for each row on the driver."""
    starts = tiles.starts

    def f(left: list, right: list) -> Iterator[dict]:
        out: dict[int, np.ndarray] = {}
        for ra, _, xa in left:
            for rb, _, xb in right:
                if rb < ra:
                    continue
                near = _block(kernel, xa, xb) >= least * np.sqrt(_own(kernel, xa)[:, None] * _own(kernel, xb))
                for r, o, v in ((ra, rb, near), (rb, ra, near.T))[: 1 + (ra != rb)]:
                    first = np.where(v.any(axis=1), starts[o] + v.argmax(axis=1), np.inf)
                    out[r] = np.minimum(out[r], first) if r in out else first
        for r, v in out.items():
            yield {"rank": pa.array([r], pa.int32()), "s": pa.array([v.tobytes()], pa.binary())}

    first = np.minimum(_gathered(cells(tiles, None, f, "rank int, s binary", spread(tiles)), tiles, 1, np.minimum)[:, 0], np.arange(tiles.n)).astype(np.int64)
    while (first[first] != first).any():
        first = first[first]
    return first


def regrouped(tiles: Tiles, first: np.ndarray, tile: int = TILE, most: int = BLOCK) -> Tiles:
    """The same rows, those of a block side by side in one tile; ``blocks`` has the sizes of a tile's blocks, at most ``most`` rows each (larger ones are cut)."""
    order = np.argsort(first, kind="stable")
    sizes = np.unique(first, return_counts=True)[1]
    sizes = np.concatenate([[most] * (k // most) + [k % most] * (k % most > 0) for k in sizes.tolist()]).astype(np.int64) if (sizes > most).any() else sizes
    ends, starts, cut = np.cumsum(sizes), [0], [0]
    while starts[-1] < tiles.n:
        cut.append(max(cut[-1] + 1, int(np.searchsorted(ends, starts[-1] + tile, "right"))))
        starts.append(int(ends[cut[-1] - 1]))
    bounds, place, old = np.array(starts), np.empty(tiles.n, np.int64), tiles.starts
    place[order] = np.arange(tiles.n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[k].as_buffer(), np.int64)
                x, y = (np.frombuffer(b.column(c)[k].as_buffer()).reshape(len(ids), -1) for c in ("x", "y"))
                at = place[old[b.column("rank")[k].as_py()] :][: len(ids)]
                to = np.searchsorted(bounds, at, "right") - 1
                for r in np.unique(to):
                    own = to == r
                    yield pa.RecordBatch.from_pydict({"rank": pa.array([r], pa.int32()), "at": [at[own].tobytes()], "ids": [ids[own].tobytes()], "x": [x[own].tobytes()], "y": [y[own].tobytes()]})

    def gather(t: pa.Table) -> pa.Table:
        r = t.column("rank")[0].as_py()
        at, ids = (np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in t.column(c)]) for c in ("at", "ids"))
        x, y = (np.concatenate([np.frombuffer(v.as_buffer()) for v in t.column(c)]).reshape(len(ids), -1) for c in ("x", "y"))
        o = np.argsort(at)
        return pa.Table.from_pydict({"rank": pa.array([r], pa.int32()), "n": pa.array([len(o)], pa.int32()), "ids": [ids[o].tobytes()], "x": [x[o].tobytes()], "y": [y[o].tobytes()], "blocks": [sizes[cut[r] : cut[r + 1]].tobytes()]})

    dealt = tiles.table.select("rank", "ids", "x", "y").mapInArrow(deal, "rank int, at binary, ids binary, x binary, y binary")
    return Tiles(written(dealt.groupBy("rank").applyInArrow(gather, "rank int, n int, ids binary, x binary, y binary, blocks binary"), "blocks"), bounds[:-1], tiles.n)


@dataclass
class Pivots:
    """Rows in the order of their choice, with what was left of each when it was chosen: x, ids, residuals, and the Cholesky factor of their kernel."""

    ids: list[int]
    x: np.ndarray
    residuals: list[float]
    low: np.ndarray
    passes: int = 0

    def columns(self, kernel: Kernel | Linear, x: np.ndarray) -> np.ndarray:
        """(rows, pivots): the rows of the low-rank factor L with K close to L L'."""
        return np.linalg.solve(self.low, _block(kernel, self.x, x)).T if self.ids else np.zeros((len(x), 0))


def pivoted(tiles: Tiles, kernel: Kernel | Linear, most: int, tol: float = 1e-10, slack: float = 1.0, batch: int = 256) -> Pivots:
    """Partial pivoted Cholesky: again and again the row with the largest residual of its kernel (the smallest id of equals), until ``most`` rows or a residual of ``tol`` times the largest diagonal.

    A pass over the tiles brings the ``batch`` rows with the largest residuals to the driver.  Among these the choice goes on as long as the next one's residual, brought up to date, is
    at least ``slack`` times the largest of all rows that stayed behind: residuals only fall, so with ``slack=1`` the rows are those of the dense form, one after the other, in far fewer passes.
    """
    out = Pivots([], np.zeros((0, 0)), [], np.zeros((0, 0)))
    scale = None
    while len(out.ids) < most:
        now = out

        def largest(rank: int, ids: np.ndarray, x: np.ndarray, now=now) -> Iterator[dict]:
            l = now.columns(kernel, x)
            left = _own(kernel, x) - (l * l).sum(axis=1)
            at = np.lexsort((ids, -left))[: batch + 1]
            yield {"id": ids[at], "left": left[at], "x": [r.tobytes() for r in x[at]]}

        rows = tiles.each(largest, "id long, left double, x binary").filter(~F.col("id").isin(out.ids) if out.ids else F.lit(True)).orderBy(F.desc("left"), "id").limit(batch + 1).collect()
        out.passes += 1
        if not rows:
            break
        scale = max(r["left"] for r in rows) if scale is None else scale
        bound = rows[batch]["left"] if len(rows) > batch else -math.inf
        rows = rows[:batch]
        x, ids, left = np.array([np.frombuffer(r["x"]) for r in rows]), [r["id"] for r in rows], np.array([r["left"] for r in rows])
        l = out.columns(kernel, x)
        grew = False
        while len(out.ids) < most:
            p = int(np.lexsort((ids, -left))[0])
            if left[p] <= tol * scale or not math.isfinite(left[p]):
                return out
            if grew and left[p] < slack * bound:
                break
            column = (_block(kernel, x, x[p : p + 1])[:, 0] - l @ l[p]) / math.sqrt(left[p])
            low = np.zeros((len(out.ids) + 1,) * 2)
            low[:-1, :-1], low[-1, :-1], low[-1, -1] = out.low, l[p], math.sqrt(left[p])
            out = Pivots([*out.ids, ids[p]], np.concatenate([out.x.reshape(-1, x.shape[1]), x[p : p + 1]]), [*out.residuals, float(left[p])], low, out.passes)
            l, left = np.concatenate([l, column[:, None]], axis=1), left - column * column
            left[p] = -math.inf
            grew = True
    return out


def chosen_rows(df: DataFrame, kernel: Kernel | Linear, most: int, id_col: str = "id", vec: str = "x", tol: float = 1e-10) -> DataFrame:
    """(id, place, residual): the rows that pivoted Cholesky takes, in order.  With ``most`` at least the rank, the rows left out depend on these."""
    got = pivoted(Tiles.of(df, id_col, vec), kernel, most, tol)
    return df.sparkSession.createDataFrame([(i, k, r) for k, (i, r) in enumerate(zip(got.ids, got.residuals, strict=True))], "id long, place int, residual double")


def _by_blocks(sizes: np.ndarray, flat: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Each block's matrix times its rows of r; ``flat`` has the matrices one after the other."""
    rows, entries = np.cumsum(sizes) - sizes, np.cumsum(sizes * sizes) - sizes * sizes
    out, one = np.empty_like(r), sizes == 1
    out[rows[one]] = flat[entries[one]][:, None] * r[rows[one]]
    for at, k, size in zip(rows[~one].tolist(), entries[~one].tolist(), sizes[~one].tolist(), strict=True):
        out[at : at + size] = flat[k : k + size * size].reshape(size, size) @ r[at : at + size]
    return out


@dataclass
class LargeKernelRidge:
    """Kernel ridge regression by conjugate gradients over tiles, preconditioned by ``landmarks`` pivoted rows (Nystroem) and, of what these leave, by blocks of near copies.  l2 = ratio * mean of the kernel's diagonal.

    Several labels are solved side by side with the same products.  The kernel is never held: each step makes its blocks in cells.
    """

    kernel: Kernel
    ratio: float = 1e-9
    shift: bool = True
    landmarks: int = 512
    tol: float = 1e-10
    most: int = 500

    def fit(self, df: DataFrame, y: tuple[str, ...] = ("y",)) -> LargeKernelRidge:
        """df: id, x and labels."""
        tiles = Tiles.of(df, y=list(y))
        tiles = self.tiles = regrouped(tiles, near_copies(tiles, self.kernel)) if tiles.n else tiles
        labels = tiles.labels(len(y))
        self.y = y
        self.mean = labels.mean(axis=0) if self.shift and len(labels) else np.zeros(len(y))
        b = labels - self.mean
        kernel = self.kernel
        self.l2 = self.ratio * float(vector_total(tiles.each(lambda rank, ids, x: iter([{"v": [float(_own(kernel, x).sum())]}]), "v double"), lambda t: np.array([t.column(0).to_numpy().sum()]))[0]) / tiles.n if tiles.n else 0.0
        self.pivots = pivoted(tiles, kernel, min(self.landmarks, tiles.n), tol=1e-12, slack=0.5)
        solve, pairs = self._preconditioner(tiles), paired(tiles) if tiles.n else None
        a, r = np.zeros_like(b), b.copy()
        z = solve(r)
        p, rz, size = z, (r * z).sum(axis=0), np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        self.rounds = 0
        while (np.linalg.norm(r, axis=0) > self.tol * size).any():
            if self.rounds == self.most:
                raise RuntimeError(f"residual {np.max(np.linalg.norm(r, axis=0) / size):.1e} after {self.most} rounds; more landmarks or a larger ratio help")
            q = kernel_product(tiles, kernel, p, pairs) + self.l2 * p
            step = np.divide(rz, (p * q).sum(axis=0), out=np.zeros_like(rz), where=rz > 0)
            a, r = a + step * p, r - step * q
            z = solve(r)
            new = (r * z).sum(axis=0)
            p, rz = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p, new
            self.rounds += 1
        self.alphas = a
        return self

    def _preconditioner(self, tiles: Tiles) -> Callable[[np.ndarray], np.ndarray]:
        """(L L' + D)^-1 with the factor L of the pivots and D, the blocks of near copies of K - L L' + l2: D^-1 L, rows by m numbers, and D^-1 are written once; then L'D^-1 r and D^-1 (r - L t), a pass each.

        Near copies have small eigenvalues, which no landmarks reach; a block's inverse does.
        """
        kernel, pivots, l2, starts = self.kernel, self.pivots, self.l2, tiles.starts
        m = len(pivots.ids)
        if not m:
            return lambda r: r

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    sizes = np.frombuffer(b.column("blocks")[k].as_buffer(), np.int64)
                    x = np.frombuffer(b.column("x")[k].as_buffer()).reshape(int(sizes.sum()), -1)
                    l, inverse = pivots.columns(kernel, x), []
                    for at, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                        own = slice(at, at + size)
                        if size == 1:
                            inverse.append(np.array([[1 / (max(0.0, float(_own(kernel, x[own])[0] - l[at] @ l[at])) + l2)]]))
                            continue
                        w, v = np.linalg.eigh(_block(kernel, x[own], x[own]) - l[own] @ l[own].T)
                        inverse.append((v / (np.maximum(w, 0) + l2)) @ v.T)
                    flat = np.concatenate([v.ravel() for v in inverse])
                    yield pa.RecordBatch.from_pydict({"rank": b.column("rank").slice(k, 1), "l": [l.tobytes()], "e": [_by_blocks(sizes, flat, l).tobytes()], "blocks": [sizes.tobytes()], "inverse": [flat.tobytes()]})

        factor = written(tiles.table.select("rank", "x", "blocks").mapInArrow(made, "rank int, l binary, e binary, blocks binary, inverse binary"), "factor")

        def of(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
            for r, l in zip(b.column("rank").to_pylist(), b.column(name), strict=True):
                yield r, np.frombuffer(l.as_buffer()).reshape(-1, m)

        inner = vector_total(factor.select("rank", "l", "e"), lambda b: sum((l.T @ e for (_, l), (_, e) in zip(of(b, "l"), of(b, "e"), strict=True)), np.zeros((m, m))).ravel()).reshape(m, m)
        w, v = np.linalg.eigh((inner + inner.T) / 2)
        shrink = v / (1 + np.maximum(w, 0)) @ v.T

        def solve(r: np.ndarray) -> np.ndarray:
            c = r.shape[1]

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield pa.RecordBatch.from_pydict({"s": [sum((e.T @ r[starts[k] :][: len(e)] for b in batches for k, e in of(b, "e")), np.zeros((m, c))).tobytes()]})

            # no shuffles in what each step does: a row of m numbers for each task, then one for each tile
            t = shrink @ sum(np.frombuffer(v["s"]).reshape(m, c) for v in factor.select("rank", "e").mapInArrow(sums, "s binary").collect())

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for (k, e), sizes, flat in zip(of(b, "e"), b.column("blocks"), b.column("inverse"), strict=True):
                        own = _by_blocks(np.frombuffer(sizes.as_buffer(), np.int64), np.frombuffer(flat.as_buffer()), r[starts[k] :][: len(e)])
                        yield pa.RecordBatch.from_pydict({"rank": pa.array([k], pa.int32()), "s": [(own - e @ t).tobytes()]})

            out = np.empty_like(r)
            for v in factor.select("rank", "e", "blocks", "inverse").mapInArrow(run, "rank int, s binary").collect():  # n numbers for each label
                own = np.frombuffer(v["s"]).reshape(-1, c)
                out[starts[v["rank"]] :][: len(own)] = own
            return out

        return solve

    def rows(self, label: int = 0) -> DataFrame:
        """(id, x, alpha) of the training rows, made where they lie."""
        a, starts = self.alphas[:, label], self.tiles.starts

        def f(rank: int, ids: np.ndarray, x: np.ndarray) -> Iterator[dict]:
            yield {"id": ids, "x": list(x), "alpha": a[starts[rank] :][: len(ids)]}

        return self.tiles.each(f, "id long, x array<double>, alpha double")

    def predict(self, query: DataFrame, label: int = 0) -> DataFrame:
        """(id, prediction)."""
        return kernel_predictions(self.rows(label), query, self.kernel).withColumn("prediction", F.col("prediction") + F.lit(float(self.mean[label])))


def _nearest(left: Tiles, right: Tiles, kernel: Kernel | Linear | None, digits: int) -> DataFrame:
    """(i, sqdist, j): for each row of ``left`` the nearest other row of ``right``, the smallest j of equals; a cell leaves one row for each of its rows."""

    def f(a: list, b: list) -> Iterator[dict]:
        for _, ids, x in a:
            best, at = np.full(len(ids), np.inf), np.full(len(ids), 2**63 - 1)
            for _, others, y in b:
                d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T if kernel is None else _own(kernel, x)[:, None] + _own(kernel, y) - 2 * _block(kernel, x, y)
                d = np.round(np.maximum(d, 0), digits)
                d[ids[:, None] == others] = np.inf
                order = np.argsort(others, kind="stable")
                k = order[d[:, order].argmin(axis=1)]
                v = d[np.arange(len(ids)), k]
                better = (v < best) | ((v == best) & (others[k] < at))
                best, at = np.where(better, v, best), np.where(better, others[k], at)
            use = np.isfinite(best)
            yield {"i": ids[use], "sqdist": best[use], "j": at[use]}

    found = cells(left, right, f, "i long, sqdist double, j long")
    return found.groupBy("i").agg(F.min(F.struct("sqdist", "j")).alias("m")).select("i", "m.sqdist", "m.j")


def thinned(df: DataFrame, least: float | None = None, count: int | None = None, kernel: Kernel | Linear | None = None, id_col: str = "id", vec: str = "x", seed: int = 0, digits: int = 9) -> DataFrame:
    """(id, partner, sqdist): rows to leave out, so that no two of those kept are nearer than ``least``; or the ``count`` first ones of that order.

    The plain form drops one of the closest pair, a side drawn by seed and ids, again and again.  A pair of rows that are each other's nearest meets that fate whatever happens elsewhere, so all such
    pairs go in one round; rows whose nearest was dropped search again among those left.  Distances, of vectors or in the kernel's space, are rounded to ``digits`` places; equal ones go by ids.
    """
    base = written(df.select(F.col(id_col).cast("long").alias("id"), V.as_vector(vec).alias("x")).filter("id is not null and x is not null").dropDuplicates(["id"]), "rows")
    side = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "i", "j")), 1, 2), 16, 10).cast("int") % 2
    below = F.lit(True) if least is None else F.col("sqdist") < float(least) ** 2
    tiles = Tiles.of(base)
    near, gone, known = written(_nearest(tiles, tiles, kernel, digits), "nearest"), [], []
    while True:
        back = near.select(F.col("i").alias("j"), F.col("j").alias("i"))
        pairs = near.filter("i < j").filter(below).join(back, ["i", "j"])
        drop = written(pairs.select(F.when(side == 0, F.col("i")).otherwise(F.col("j")).alias("id"), F.when(side == 0, F.col("j")).otherwise(F.col("i")).alias("partner"), "sqdist"), "dropped")
        if count is not None and known:
            ahead = near.agg(F.min("sqdist")).first()[0]
            done = gone[0].unionByName(gone[1]) if len(gone) == 2 else gone[0]
            for g in gone[2:]:
                done = done.unionByName(g)
            if ahead is None or done.filter(F.col("sqdist") < F.lit(ahead)).count() >= count:
                break
        gone.append(drop)
        known.append(drop.count())
        if not known[-1]:
            break
        out = drop.select(F.col("id").alias("j"))
        rows = base
        for g in gone:  # a round drops a part of all rows, so there are few
            rows = rows.join(g.select("id"), "id", "left_anti")
        left = near.join(drop.select(F.col("id").alias("i")), "i", "left_anti")
        stale = base.join(left.join(out, "j", "left_semi").select(F.col("i").alias("id")), "id")
        near = written(left.join(out, "j", "left_anti").select("i", "sqdist", "j").unionByName(_nearest(Tiles.of(stale), Tiles.of(rows), kernel, digits)), "nearest")
    all_ = gone[0]
    for g in gone[1:]:
        all_ = all_.unionByName(g)
    if count is None:
        return all_
    low, high = F.least("id", "partner"), F.greatest("id", "partner")
    return all_.orderBy("sqdist", low, high).limit(count)
