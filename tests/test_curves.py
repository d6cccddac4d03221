"""Learning curves with hyperparameters of each subset, against dense algebra."""

import numpy as np
import pytest

from larkspur.operators import curves
from larkspur.operators.kernels import Kernel
from larkspur.operators.ranking import learning_subsets

LOSS = {"mae": np.abs, "mse": np.square}


def made(spark, n=90, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + 5 + 0.2 * rng.normal(size=n)
    data = [(i, a.tolist(), a.tolist(), float(t)) for i, (a, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*data, (900, None, None, 1.0), (901, [1.0] * d, [1.0] * d, None)], "id long, x array<double>, z array<double>, y double").repartition(4)
    return x, y, df.filter("id % 3 > 0 or y is null"), df.filter("id % 3 = 0")


def members(train, sizes, most):
    out = {}
    for r in learning_subsets(train.dropna(), "id", sizes, most).collect():
        out.setdefault((r["size"], r["subset"]), []).append(r["id"])
    return {k: np.array(sorted(v)) for k, v in out.items()}


@pytest.mark.parametrize(("loss", "relative", "shift"), [("mae", False, True), ("mse", True, False)])
def test_feature_curve(spark, loss, relative, shift):
    x, y, train, test = made(spark)
    l2s, sizes = [1e-3, 0.1, 1.0, 30.0], [3, 8, 20]
    got = {(r["size"], r["subset"]): r for r in curves.FeatureCurve(sizes, l2s, relative, shift, 3, loss).run(train, test).collect()}
    want = members(train, sizes, 3)
    assert set(got) == set(want) and {k: sum(a == k for a, _ in want) for k in sizes} == {3: 3, 8: 3, 20: 3}
    at = np.arange(0, 90, 3)
    for k, ids in want.items():
        z, mean = x[ids], y[ids].mean() if shift else 0.0
        scale = np.trace(z.T @ z) / min(len(ids), 4) if relative else 1.0
        best = []
        for l2 in np.array(l2s) * scale:
            inverse = np.linalg.inv(z.T @ z + l2 * np.eye(4))
            a = inverse @ z.T @ (y[ids] - mean)
            e = (z @ a + mean - y[ids]) / (1 - np.einsum("ij,jk,ik->i", z, inverse, z))
            best.append((LOSS[loss](e).mean(), l2, LOSS[loss](x[at] @ a + mean - y[at]).mean()))
        assert np.allclose([got[k]["training_loss"], got[k]["l2"], got[k]["loss"]], min(best), rtol=1e-8) and got[k]["n"] == 30


@pytest.mark.parametrize(("kernel", "loss"), [(Kernel("gaussian"), "mae"), (Kernel("laplacian"), "mse")])
def test_kernel_curve(spark, kernel, loss):
    x, y, train, test = made(spark)
    ratios, sigmas, sizes = [1e-3, 0.1], [0.7, 2.0, 5.0], [5, 15]
    got = {(r["size"], r["subset"]): r for r in curves.KernelCurve(kernel, sizes, sigmas, ratios, most=4, loss=loss).run(train, test).collect()}
    want = members(train, sizes, 4)
    assert set(got) == set(want) and len(want) == 8
    at = np.arange(0, 90, 3)
    for k, ids in want.items():
        mean, best = y[ids].mean(), []
        for sigma in sigmas:
            block = lambda b, s=sigma: Kernel(kernel.kind, (s,)).block(b, x[ids])[0]  # noqa: E731, B023
            for ratio in ratios:
                inverse = np.linalg.inv(block(x[ids]) + ratio * np.eye(len(ids)))
                a = inverse @ (y[ids] - mean)
                best.append((LOSS[loss](a / np.diag(inverse)).mean(), sigma, ratio, LOSS[loss](block(x[at]) @ a + mean - y[at]).mean()))
        r = got[k]
        assert np.allclose([r["training_loss"], r["sigma"], r["l2"], r["loss"]], min(best), rtol=1e-7) and r["n"] == 30
    c = {r["size"]: r for r in curves.curve(curves.KernelCurve(kernel, sizes, sigmas, ratios, most=4, loss=loss).run(train, test)).collect()}
    for s in sizes:
        losses = [r["loss"] for k, r in got.items() if k[0] == s]
        assert np.allclose([c[s]["mean"], c[s]["std"]], [np.mean(losses), np.std(losses)])


def test_nothing_to_learn_from(spark):
    _, _, train, test = made(spark)
    for model in (curves.FeatureCurve([4], [1.0]), curves.KernelCurve(Kernel("gaussian"), [4], [1.0], [0.1])):
        assert model.run(train.limit(0), test).count() == 0
        assert model.run(train.dropna().limit(3), test).count() == 0  # no subset is full
        assert [(r["loss"], r["n"]) for r in model.run(train, test.limit(0)).collect()][:1] == [(None, 0)]
    with pytest.raises(ValueError, match="distinct"):
        curves.FeatureCurve([4, 4], [1.0]).run(train, test)
