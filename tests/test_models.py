import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import features, levels, solvers
from larkspur.operators.features import Signs
from larkspur.operators.kernels import Kernel
from larkspur.operators.models import FeatureRidge, KernelRidge, LocalKernelRidge, descend, kernel_learning_curve, uncertainty_targets


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.random((60, 5))
    y = np.sin(3 * x[:, 0]) + x[:, 1] * 2 + 4
    return x, y, spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(60)], "id long, x array<double>, y double")


def gauss(a, b, s):
    return np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * s * s))


def test_kernel_ridge(spark, data, tmp_path):
    x, y, df = data
    train, test = df.filter("id < 40"), df.filter("id >= 40")
    model = KernelRidge(Kernel("gaussian", (1.0,)), 1e-6).fit(train)
    k = gauss(x[:40], x[:40], 1.0)
    alpha = np.linalg.solve(k + 1e-6 * np.eye(40), y[:40] - y[:40].mean())
    want = gauss(x[40:], x[:40], 1.0) @ alpha + y[:40].mean()
    got = [r["prediction"] for r in model.predict(test).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-6)
    model.save(f"{tmp_path}/m")
    again = [r["prediction"] for r in KernelRidge.load(spark, f"{tmp_path}/m").predict(test).orderBy("id").collect()]
    assert np.allclose(again, got)
    errors = model.loo_errors(train)
    for i in (0, 7):
        rest = [j for j in range(40) if j != i]
        a = np.linalg.solve(k[np.ix_(rest, rest)] + 1e-6 * np.eye(39), (y[:40] - y[:40].mean())[rest])
        assert math.isclose(errors[i], k[i, rest] @ a - (y[i] - y[:40].mean()), rel_tol=1e-4, abs_tol=1e-7)
    better = KernelRidge(Kernel("gaussian", (1.0,))).optimise(train, (-2.0, 2.0), points=5).fit(train)
    err = [abs(r["prediction"] - y[r["id"]]) for r in better.predict(test).collect()]
    assert np.mean(err) < 0.05


def test_local_kernel_ridge(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for m in range(24):
        n = int(rng.integers(1, 5))
        z, x = rng.integers(1, 3, n), rng.random((n, 3))
        rows += [(m, int(e), v.tolist()) for e, v in zip(z, x, strict=True)]
        labels.append((m, float(sum(5.0 * e + v[0] for e, v in zip(z, x, strict=True)))))
    atoms, y = spark.createDataFrame(rows, "id long, z int, x array<double>"), spark.createDataFrame(labels, "id long, y double")
    model = LocalKernelRidge(Kernel("gaussian", (1.0,)), 1e-8).fit_atoms(atoms, y)
    got = {r["id"]: r["prediction"] for r in model.predict_atoms(atoms).collect()}
    assert all(abs(got[m] - v) < 1e-2 for m, v in labels)


def test_feature_ridge(data):
    x, y, df = data
    p = Signs.seeded(4, 3, 8, 1)
    z = p.map(x, 0.7)
    model = FeatureRidge(p, 0.7, 1e-4).fit(df)
    g = z.T @ z
    l2 = 1e-4 * np.trace(g) / min(60, 32)
    alpha = np.linalg.solve(g + l2 * np.eye(32), z.T @ (y - y.mean()))
    got = [r["prediction"] for r in model.predict(df).orderBy("id").collect()]
    assert np.allclose(got, z @ alpha + y.mean(), atol=1e-6)
    parts = FeatureRidge(p, 0.7, 1e-4).start().add(df.filter("id % 2 = 0")).add(df.filter("id % 2 = 1")).solve()
    assert np.allclose(parts.alphas, model.alphas)
    h = np.einsum("ij,jk,ik->i", z, np.linalg.inv(g + l2 * np.eye(32)), z)
    loo = {r["id"]: r["err"] for r in model.loo(df, ["id"]).collect()}
    assert np.allclose([loo[i] for i in range(60)], (z @ alpha - (y - y.mean())) / (1 - h), atol=1e-6)
    d2 = {r["id"]: r["d2"] for r in model.plane_distances(df, ["id"]).collect()}
    assert np.allclose([d2[i] for i in range(60)], l2 * h, atol=1e-9)
    both = model.loo(df, ["id"]).join(model.plane_distances(df, ["id"]), "id")
    assert uncertainty_targets(both).filter("y < 0").count() == 0
    assert model.optimise_ratio(df, points=4).ratio > 0


def test_features(spark, data):
    x, _, df = data
    p = Signs.seeded(2, 3, 8, 4)
    assert np.allclose(features.walsh_hadamard(features.walsh_hadamard(x[:, :4])), x[:, :4])
    eps = 1e-6
    assert np.allclose((p.map(x, 1.0 + eps) - p.map(x, 1.0 - eps)) / (2 * eps), p.sigma_gradient(x, 1.0), atol=1e-6)
    out = np.random.default_rng(1).normal(size=(60, 16))
    g = p.input_gradient(x, 0.9, out)
    for k in range(5):
        e = np.zeros_like(x)
        e[:, k] = eps
        assert np.allclose(((p.map(x + e, 0.9) - p.map(x - e, 0.9)) / (2 * eps) * out).sum(axis=1), g[:, k], atol=1e-6)
    assert np.allclose(p.map_even(x, 1.0), p.map_even(-x, 1.0))
    assert np.allclose(p.map_extensive(3 * x, 1.0, 0.5), 3 * p.map_extensive(x, 1.0, 0.5))
    back = Signs.of_table(p.table(spark))
    assert np.array_equal(back.signs, p.signs) and np.allclose(back.biases, p.biases)
    big = Signs.seeded(64, 3, 8, 2)
    z = big.map(x, 1.0)
    assert np.abs(z @ z.T - gauss(x, x, 1.0)).max() < 0.25  # features approximate the Gaussian kernel
    atoms = df.select((F.col("id") % 7).alias("mol"), (F.col("id") % 2).alias("z"), "x")
    params = {0: Signs.seeded(1, 2, 8, 5), 1: Signs.seeded(1, 2, 8, 6)}
    got = {r["mol"]: r["z"] for r in features.local_random_features(atoms, "mol", "z", "x", params, 1.0).collect()}
    for m, v in got.items():
        assert np.allclose(v, sum(params[i % 2].map(x[i : i + 1], 1.0)[0] for i in range(60) if i % 7 == m))
    r = features.reductor(df, "x", 3)
    w, v = np.linalg.eigh(x.T @ x)
    assert np.allclose(np.abs(r.T @ v[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
    assert set(features.reductors_by_element(atoms, "z", "x", 2)) == {0, 1}
    rest = features.projected_with_remainder(df, "x", r, ["id"]).collect()
    assert all(math.isclose(sum(c * c for c in row["z"]), (x[row["id"]] ** 2).sum(), rel_tol=1e-9) for row in rest)


def test_solvers():
    rng = np.random.default_rng(10)
    a = rng.normal(size=(12, 6))
    g, b = a.T @ a, rng.normal(size=6)
    for s in solvers.SOLVERS.values():
        assert np.allclose((g + 0.3 * np.eye(6)) @ s(g, b, 0.3), b)
    y = rng.normal(size=12)
    assert np.allclose(solvers.svd_solve(a, y), solvers.lstsq_solve(a, y))
    assert np.allclose(solvers.ridge_from_svd(a, y, 0.2), np.linalg.solve(g + 0.2 * np.eye(6), a.T @ y))
    k = a @ a.T + np.eye(12)
    known = rng.random((12, 3)) > 0.3
    ys = rng.normal(size=(12, 3))
    out = solvers.masked_solutions(k, ys, known, 0.1)
    for t in range(3):
        rows = np.flatnonzero(known[:, t])
        assert np.allclose((k[np.ix_(rows, rows)] + 0.1 * np.eye(len(rows))) @ out[rows, t], ys[rows, t])
    low = a @ a.T
    keep = solvers.independent_rows(low, 1e-9)
    assert keep.sum() == 6 and keep[:6].all()
    d = np.abs(np.subtract.outer([0, 0.1, 5, 9, 9.05], [0, 0.1, 5, 9, 9.05])) ** 2
    gone = solvers.exclude_nearest(d, least=1.0)
    assert len(gone) == 2 and len({0, 1} & set(gone)) == 1
    assert np.allclose(solvers.finite_difference_weights([-1, 0, 1], 2), [1, -2, 1])
    at, v = solvers.grid_minimum(lambda x: None if x < -3 else (x - 0.7) ** 2, -4, 4)
    assert math.isclose(at, 0.7, abs_tol=1e-4) and v < 1e-7
    q = np.diag([1.0, 10.0, 100.0])
    got = solvers.minimise(lambda x: (0.5 * (x - 1) @ q @ (x - 1), q @ (x - 1)), np.zeros(3))
    assert np.allclose(got, 1, atol=1e-6)
    kk = gauss(a, a, 2.0) + 0.1 * np.eye(12)
    sign, logdet = np.linalg.slogdet(kk)
    assert math.isclose(solvers.log_marginal_likelihood(kk, y), -0.5 * y @ np.linalg.solve(kk, y) - 0.5 * logdet - 6 * math.log(2 * math.pi))
    curve = kernel_learning_curve(kk, y, kk, y, {4: [[0, 1, 2, 3], [4, 5, 6, 7]], 12: [list(range(12))]}, 1e-12)
    assert curve[12][0] < 1e-6 < curve[4][0] and curve[12][1] == 0
    assert np.allclose(descend(lambda x: float(((x - [1.0, -2.0]) ** 2).sum()), np.zeros(2), shortest=1e-4), [1, -2], atol=0.05)
    assert np.allclose(solvers.orthogonalised(a) @ solvers.orthogonalised(a).T, np.eye(6))


def test_gramian_rows(data):
    x, y, df = data
    g = {(r["a"], r["b"]): r["g"] for r in solvers.gramian_rows(df, "x").collect()}
    assert all(math.isclose(v, x[:, a] @ x[:, b]) for (a, b), v in g.items()) and len(g) == 15
    gg, r, yy, n = solvers.gramian(df, "x", "y")
    assert np.allclose(gg, x.T @ x) and np.allclose(r, x.T @ y) and n == 60
    assert solvers.gramian(df.limit(0), "x", "y")[3] == 0


def test_levels(spark, data):
    x, _, df = data
    assert levels.datatype(["array_1D", "element_id", "list", "rhos"]).simpleString() == "struct<components:array<struct<representation:array<double>,element_id:int>>,rhos:array<double>>"
    obj = df.groupBy((F.col("id") % 3).alias("m")).agg(F.collect_list("x").alias("l"), F.collect_list(F.lit(0.5)).alias("rhos"))
    got = obj.select("m", levels.component_sum(levels.normalise())(F.col("l")).alias("s"), levels.weighted_component_sum()(F.struct(F.col("l").alias("components"), "rhos")).alias("w"))
    for r in got.collect():
        mine = x[np.arange(60) % 3 == r["m"]]
        assert np.allclose(r["s"], (mine / np.linalg.norm(mine, axis=1, keepdims=True)).sum(axis=0)) and np.allclose(r["w"], mine.sum(axis=0) / 2)
    switch = levels.element_switch({0: levels.full_rescale(2.0), 1: levels.fork(levels.resize(2), levels.resize(1))})
    rows = df.select("id", switch(F.struct(F.col("x").alias("representation"), (F.col("id") % 2).cast("int").alias("element_id"))).alias("y")).collect()
    assert all(np.allclose(r["y"], x[r["id"]] / 2 if r["id"] % 2 == 0 else [*x[r["id"]][:2], x[r["id"]][0]]) for r in rows)
    params = {0: Signs.seeded(2, 2, 8, 1)}
    pipe = levels.Pipeline([("column", levels.normalise()), ("map", levels.FeatureLevel(params)), ("sum", ["m"]), ("map", levels.FeatureLevel({0: Signs.seeded(1, 2, 16, 2)}))])
    nested = df.select((F.col("id") % 5).alias("m"), "x")
    pipe.guess_sigmas(nested)
    out = {r["m"]: r["x"] for r in pipe.run(nested).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s0 = math.sqrt(unit.var(axis=0).sum())
    assert math.isclose(pipe.steps[1][1].sigma, s0)
    z = np.stack([params[0].map(unit[np.arange(60) % 5 == m], s0).sum(axis=0) for m in range(5)])
    want = pipe.steps[3][1].params[0].map(z, math.sqrt(z.var(axis=0).sum()))
    assert all(np.allclose(out[m], want[m]) for m in range(5))
    assert np.allclose(levels.guess_range_sigmas([1.0, 3.0, 5.0], [0, 2, 3]), [math.sqrt(8), math.sqrt(10)])
