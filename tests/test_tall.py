"""Tall tables by triangles, paths of regularisation, shifts, pivoted rows, thinning and large kernel models, against dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import large_kernels, solvers, tall
from larkspur.operators.kernels import Kernel
from larkspur.operators.models import KernelRidge


def rows(spark, z, y, w=None, extra=()):
    data = [(i, a.tolist(), float(t), float(1 if w is None else w[i]), i % 3) for i, (a, t) in enumerate(zip(z, y, strict=True))]
    return spark.createDataFrame([*data, *extra], "id long, z array<double>, y double, w double, fold int").repartition(5)


def stretched(condition, n=200, d=6, seed=1):
    """A matrix with singular values from 1 to 1 / condition."""
    rng = np.random.default_rng(seed)
    u, _ = np.linalg.qr(rng.normal(size=(n, d)))
    v, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return (u * np.geomspace(1, 1 / condition, d)) @ v.T, rng.normal(size=n), np.geomspace(1, 1 / condition, d)


def test_singular_values_where_a_gramian_fails(spark):
    z, y, s = stretched(1e10)
    df = rows(spark, z, y)
    svd = tall.TallSVD.fit(df, "z", "y")
    assert np.allclose(svd.s, s, rtol=1e-4) and svd.s[-1] == pytest.approx(1e-10, rel=1e-4)
    gramian = np.sqrt(np.abs(np.linalg.eigvalsh(solvers.gramian(df, "z", "y")[0])[::-1]))
    assert abs(gramian[-1] / 1e-10 - 1) > 1  # half of the digits are lost there
    fine = tall.TallSVD.fit(df, "z", "y", refine=True)
    u = np.array([r["u"] for r in fine.left_rows(df, "z", ["id"]).orderBy("id").collect()])
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-12 and np.allclose(u * fine.s @ fine.v.T, z, atol=1e-12)
    # least squares: the residual is orthogonal to the columns of z
    x = fine.solution()
    assert np.allclose(z @ x, u @ (u.T @ y), atol=1e-4)


@pytest.mark.parametrize("weighted", [False, True])
def test_errors_and_paths_against_dense(spark, weighted):
    z, y, _ = stretched(50.0, n=60)
    w = np.random.default_rng(2).uniform(0.5, 2, 60) if weighted else np.ones(60)
    df = rows(spark, z, y, w, extra=[(900, None, 1.0, 1.0, 0), (901, [1.0] * 6, None, 1.0, 0)])
    weight = "w" if weighted else None
    zw, yw = z * w[:, None], y * w
    svd = tall.TallSVD.fit(df, "z", "y", weight)

    def dense(l2):
        hat = zw @ np.linalg.solve(zw.T @ zw + l2 * np.eye(6), zw.T)
        return (hat @ yw - yw) / (1 - np.diag(hat))

    got = {r["id"]: r["err"] for r in svd.errors(df, "z", "y", 0.01, ["id"], weight).collect()}
    assert len(got) == 60 and np.allclose([got[i] for i in range(60)], dense(0.01))
    assert np.allclose(svd.solution(0.01), np.linalg.solve(zw.T @ zw + 0.01 * np.eye(6), zw.T @ yw))
    for l2, value, slope in svd.loss_path(df, "z", "y", [1e-4, 0.01, 1.0], "mse", weight=weight):
        h = 1e-6 * l2
        assert value == pytest.approx((dense(l2) ** 2).mean()) and slope == pytest.approx(((dense(l2 + h) ** 2).mean() - (dense(l2 - h) ** 2).mean()) / (2 * h), rel=1e-3, abs=1e-7)
    if not weighted:
        l2, value = svd.best_l2(df, "z", "y", (-14.0, 5.0))
        assert value <= min(np.abs(dense(math.exp(t))).mean() for t in np.linspace(-14, 5, 60)) + 1e-6 and value == pytest.approx(np.abs(dense(l2)).mean())


def test_fold_path_against_dense(spark):
    z, y, _ = stretched(20.0, n=50)
    df = rows(spark, z, y)
    fold = np.arange(50) % 3
    for relative in (False, True):
        got = tall.FoldPath([0.001, 0.1, 3.0], relative=relative, shift=True).run(df, "z", "y", "fold")
        assert len(got) == 9
        for f, l2, mae, slope, n in got:
            def error(l2, f=f):
                a, b = fold != f, fold == f
                g, mean = z[a].T @ z[a], y[a].mean()
                scale = np.trace(g) / 6 if relative else 1.0
                x = np.linalg.solve(g + scale * l2 * np.eye(6), z[a].T @ (y[a] - mean))
                return np.abs(z[b] @ x + mean - y[b]).mean()

            assert n == (fold == f).sum() and mae == pytest.approx(error(l2)) and slope == pytest.approx((error(l2 * (1 + 1e-6)) - error(l2 * (1 - 1e-6))) / 2e-6, abs=1e-4)
    l2, value = tall.FoldPath(np.geomspace(1e-4, 10, 8).tolist()).best(df, "z", "y", "fold")
    coarse = tall.FoldPath(np.geomspace(1e-4, 10, 30).tolist()).run(df, "z", "y", "fold")
    assert value <= min(np.mean([v for _, a, v, _, _ in coarse if a == b]) for b in {a for _, a, _, _, _ in coarse}) + 1e-4
    with pytest.raises(ValueError):
        tall.FoldPath([1.0]).run(df.filter("fold = 0"), "z", "y", "fold")


def test_shifts(spark):
    z, y, _ = stretched(5.0, n=80)
    rng = np.random.default_rng(4)
    c = rng.integers(0, 5, (80, 2)).astype(float)
    y = y - 3 * c[:, 0] + 2 * c[:, 1]
    df = spark.createDataFrame([(i, z[i].tolist(), float(y[i]), *map(float, c[i])) for i in range(80)], "id long, z array<double>, y double, a double, b double")
    hat = z @ np.linalg.solve(z.T @ z + 0.1 * np.eye(6), z.T)
    errors = lambda y: (hat @ y - y) / (1 - np.diag(hat))
    got = {r["id"]: (r["e0"], *r["e1"]) for r in tall.shift_errors(df, "z", "y", ["a", "b"], 0.1, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(80)], np.stack([errors(y), errors(c[:, 0]), errors(c[:, 1])], axis=1))
    best = tall.best_shift(df, "z", "y", ["a", "b"], 0.1)
    loss = lambda t: np.abs(errors(y + c @ t)).mean()
    assert np.allclose(best, [3, -2], atol=1.0) and all(loss(best) <= loss(best + d) + 1e-6 for d in rng.normal(size=(50, 2)) * 0.05)
    moved = df.select("id", tall.shifted(df, "y", ["a", "b"], best).alias("y")).orderBy("id").collect()
    assert np.allclose([r["y"] for r in moved], y + c @ best)


def points(spark, x, y=None):
    return spark.createDataFrame([(i, v.tolist(), float(0 if y is None else y[i])) for i, v in enumerate(x)], "id long, x array<double>, y double")


def greedy(k, most):
    left, l, out = k.diagonal().copy(), np.zeros((len(k), 0)), []
    while len(out) < most and left.max() > 1e-10 * k.diagonal().max():
        p = int(np.argmax(left))
        l = np.concatenate([l, ((k[:, p] - l @ l[p]) / math.sqrt(left[p]))[:, None]], axis=1)
        left = k.diagonal() - (l * l).sum(axis=1)
        left[[*out, p]] = -1
        out.append(p)
    return out


@pytest.mark.parametrize("batch", [4, 64])
def test_pivoted_rows_are_the_greedy_ones(spark, batch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    tiles = large_kernels.Tiles.of(points(spark, x), tile=16)
    kernel = Kernel("gaussian", (1.2,))
    got = large_kernels.pivoted(tiles, kernel, 10, batch=batch)
    k = kernel.block(x, x)[0]
    assert got.ids == greedy(k, 10) and got.passes <= 11
    l = got.columns(kernel, x)
    assert np.allclose(l @ l.T, k, atol=math.sqrt(got.residuals[-1]) * 2)


def test_dependent_rows_are_left_out(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (40, 4)).astype(float) @ rng.integers(-2, 3, (4, 9))
    got = large_kernels.chosen_rows(points(spark, x), large_kernels.Linear(), 40).collect()
    assert len(got) == np.linalg.matrix_rank(x) and np.linalg.matrix_rank(x[[r["id"] for r in got]]) == len(got)
    assert large_kernels.chosen_rows(points(spark, x).limit(0), large_kernels.Linear(), 5).count() == 0


def dropped(x, least=None, count=None, seed=0):
    """One of the closest pair, again and again."""
    import hashlib

    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    left, out = set(range(len(x))), []
    while len(left) > 1 and (count is None or len(out) < count):
        v, i, j = min((d[i, j], i, j) for i in left for j in left if i < j)
        if least is not None and v >= least**2:
            break
        a = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:2], 16) % 2
        out.append((i, j) if a == 0 else (j, i))
        left.remove(out[-1][0])
    return out


@pytest.mark.parametrize("how", [{"least": 0.6}, {"count": 9}])
def test_thinning_is_the_plain_form(spark, how):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(rng.normal(size=(26, 2)), 1), np.zeros((4, 2))])
    got = {(r["id"], r["partner"]) for r in large_kernels.thinned(points(spark, x), **how, seed=3).collect()}
    assert got == set(dropped(x, **how, seed=3))


def test_large_kernel_ridge_agrees_with_cholesky(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    df = points(spark, x, y).withColumn("y2", F.col("y") * 2 - 1)
    kernel = Kernel("gaussian", (1.5,))
    model = large_kernels.LargeKernelRidge(kernel, 1e-3, landmarks=250, tol=1e-9)
    model.fit(df, ("y", "y2"))
    k = kernel.block(x, x)[0] + 1e-3 * np.eye(400)
    want = np.linalg.solve(k, y - y.mean())
    got = {r["id"]: r["alpha"] for r in model.rows().collect()}
    fitted = kernel.block(x, x)[0] @ np.array([got[i] for i in range(400)])
    assert np.abs(fitted - kernel.block(x, x)[0] @ want).max() < 1e-6 and model.rounds < 25
    plain = KernelRidge(kernel, 1e-3).fit(df)
    probe = points(spark, rng.normal(size=(20, 4)))
    a, b, c = ({r["id"]: r["prediction"] for r in p.collect()} for p in (model.predict(probe), plain.predict(probe), model.predict(probe, 1)))
    assert all(abs(a[i] - b[i]) < 1e-5 and abs(2 * a[i] - 1 - c[i]) < 1e-5 for i in a)


def test_large_kernel_ridge_with_near_copies(spark):
    """Groups of near copies take few steps: their small eigenvalues are solved by blocks."""
    rng = np.random.default_rng(12)
    x = np.repeat(1.5 * rng.normal(size=(30, 8)), [1, 20, 3] * 10, axis=0)
    x = x[rng.permutation(len(x))] + 0.05 * rng.normal(size=x.shape)
    y = x[:, 0] + rng.normal(size=len(x))
    kernel, n = Kernel("gaussian", (1.0,)), len(x)
    model = large_kernels.LargeKernelRidge(kernel, 1e-3, landmarks=8, tol=1e-8, most=15).fit(points(spark, x, y).repartition(3))  # before: over 200 steps
    k = kernel.block(x, x)[0]
    want = k @ np.linalg.solve(k + 1e-3 * np.eye(n), y - y.mean())
    got = {r["id"]: r["alpha"] for r in model.rows().collect()}
    assert len(got) == n and np.abs(k @ np.array([got[i] for i in range(n)]) - want).max() < 1e-6


def test_blocks_of_near_copies(spark):
    """Near rows go together, large blocks are cut, a block lies in one tile, and each row keeps its vector and label."""
    x = np.concatenate([np.arange(9)[:, None] * 0.05, [[50.0]], np.full((7, 1), 99.0)])[np.random.default_rng(1).permutation(17)]
    tiles = large_kernels.Tiles.of(points(spark, x, x[:, 0]).repartition(2), y=["y"], tile=3)
    first = large_kernels.near_copies(tiles, Kernel("gaussian", (1.0,)))
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in tiles.table.orderBy("rank").collect()])
    assert all((x[ids[first[a]]] == 50) == (v == 50) and (x[ids[first[a]]] == 99) == (v == 99) for a, v in enumerate(x[ids]))
    assert len(np.unique(first)) == 3 and (first[first] == first).all()
    got = large_kernels.regrouped(tiles, first, tile=6, most=4)
    rows = got.table.orderBy("rank").collect()
    sizes = [np.frombuffer(r["blocks"], np.int64).tolist() for r in rows]
    assert sorted(sum(sizes, [])) == [1, 1, 3, 4, 4, 4] and all(sum(v) == r["n"] <= 6 for v, r in zip(sizes, rows, strict=True)) and got.starts.tolist() == [0, *np.cumsum([r["n"] for r in rows])[:-1]]
    seen = {i: (v, w) for r in rows for i, v, w in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["x"]), np.frombuffer(r["y"]), strict=True)}
    assert seen == {i: (v, v) for i, v in enumerate(x[:, 0])}
    for r, v in zip(rows, sizes, strict=True):
        for part in np.split(np.frombuffer(r["x"]), np.cumsum(v)[:-1]):
            assert np.ptp(part) <= 4


def test_cells_hold_sixteen_tiles_a_side(spark):
    """However many tiles there are, a cell has no more than sixteen on a side, and each pair of tiles meets once."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(330, 2))
    tiles = large_kernels.Tiles.of(points(spark, x).repartition(1), tile=8)
    sizes = large_kernels.cells(tiles, None, lambda a, b: iter([{"l": [len(a)], "r": [len(b)], "p": [sum(j[0] >= i[0] for i in a for j in b)]}]), "l long, r long, p long").collect()
    assert len(tiles.starts) == 42 and max(max(r["l"], r["r"]) for r in sizes) == 16 and sum(r["p"] for r in sizes) == 42 * 43 // 2
    p = rng.normal(size=(330, 2))
    k = Kernel("gaussian", (1.0,))
    order = [i for r in tiles.table.orderBy("rank").collect() for i in np.frombuffer(r["ids"], np.int64)]
    assert np.allclose(large_kernels.kernel_product(tiles, k, p), k.block(x[order], x[order])[0] @ p)
