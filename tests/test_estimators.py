"""Estimators over rows against dense algebra, and the pieces they are made of."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import levels, objects, ranking, representations, selection, solvers, statistics
from larkspur.operators import models as M
from larkspur.operators.features import Signs
from larkspur.operators.kernels import Kernel


def molecules(spark, n=24, seed=0):
    """Atoms (id, z, x) of small molecules, and a label for each."""
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.choice([1, 6, 8])), rng.normal(size=4).tolist()) for i in range(n) for _ in range(int(rng.integers(1, 5)))]
    y = {i: sum(z + x[0] for j, z, x in rows if j == i) for i in range(n)}
    return rows, y, spark.createDataFrame(rows, "id long, z int, x array<double>"), spark.createDataFrame(list(y.items()), "id long, y double")


@pytest.mark.parametrize("shift", [False, True])
def test_local_feature_ridge(spark, shift):
    rows, y, atoms, labels = molecules(spark)
    params = {e: Signs.seeded(1, 2, 8, e) for e in (1, 6, 8)}
    model = M.LocalFeatureRidge(params[1], 1.3, 1e-3, shift, elements=params).fit_atoms(atoms, labels)
    ids = sorted(y)
    z = np.array([sum(params[e].map(np.array([x]), 1.3)[0] for i, e, x in rows if i == k) for k in ids])
    counts = np.array([[sum(1 for i, e, _ in rows if i == k and e == c) for c in (1, 6, 8)] for k in ids], float)
    t = np.array([y[k] for k in ids])
    base = counts @ np.linalg.lstsq(counts, t, rcond=None)[0] if shift else np.zeros(len(t))
    g = z.T @ z
    a = np.linalg.solve(g + 1e-3 * np.trace(g) / min(len(ids), 8) * np.eye(8), z.T @ (t - base))
    got = {r["id"]: r["prediction"] for r in model.predict_atoms(atoms).collect()}
    assert np.allclose([got[k] for k in ids], z @ a + base, atol=1e-6)


def test_fold_objectives_agree(spark):
    """Features whose products are the kernel give the kernel's objective, with one ridge."""
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    folds = ranking.folds(spark.createDataFrame([(i,) for i in range(20)], "id long"), "id", 3)
    rows = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(z, y, strict=True))], "id long, z array<double>, y double")
    want, got = [], {r["fold"]: ([], []) for r in folds.collect()}
    for r in folds.collect():
        got[r["fold"]][0 if r["train"] else 1].append(r["id"])
    for a, b in got.values():
        g = z[a].T @ z[a]
        w = np.linalg.solve(g + 0.1 * np.trace(g) / min(len(a), 3) * np.eye(3), z[a].T @ y[a])
        want.append(np.abs(z[b] @ w - y[b]).mean())
    assert math.isclose(M.feature_fold_objective(rows, folds, "id", 0.1), -1 / np.mean(want), rel_tol=1e-9)
    k = z @ z.T + np.eye(20)
    v = M.fold_objective(k, y, list(range(20)), folds, "id", 0.2)
    maes = [np.abs(k[np.ix_(b, a)] @ np.linalg.solve(k[np.ix_(a, a)] + 0.2 * np.mean(np.diag(k)) * np.eye(len(a)), y[a]) - y[b]).mean() for a, b in got.values()]
    assert math.isclose(v, -1 / np.mean(maes), rel_tol=1e-9)


def test_local_fold_objective_refuses_many(spark):
    _, _, atoms, labels = molecules(spark, 5)
    with pytest.raises(ValueError):
        M.local_fold_objective(atoms, labels, Kernel(), ranking.folds(labels, "id", 2), most=4)


def vectors(spark, n=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    y = x[:, 0] - 0.5 * x[:, 1] + 3
    return x, y, spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")


@pytest.mark.parametrize("logs", [False, True])
def test_uncertainty(spark, logs):
    _, _, df = vectors(spark)
    first = M.FeatureRidge(Signs.seeded(2, 2, 4, 1), 2.0, 1e-2).fit(df)
    u = M.Uncertainty(first, M.FeatureRidge(Signs.seeded(1, 2, 4, 2), 2.0, 1e-2), logs).fit(df).predict(df).collect()
    assert len(u) == 40 and all(r["uncertainty"] >= 0 and math.isfinite(r["uncertainty"]) for r in u)


def multilevel(spark, n=30):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.choice([0, 1])), rng.normal(size=4).tolist()) for i in range(n) for _ in range(3)]
    labels = [(i, float(sum(x[0] + z for j, z, x in rows if j == i))) for i in range(n)]
    level = levels.FeatureLevel({e: Signs.seeded(1, 2, 8, e) for e in (0, 1)}, 1.0)
    steps = levels.Pipeline([("map", level, "z"), ("sum", ["mol"])])
    return levels.MultilevelModel(steps, "mol", 1e-3), spark.createDataFrame(rows, "mol long, z int, x array<double>"), spark.createDataFrame(labels, "mol long, y double")


def test_multilevel_model(spark):
    model, objects_, labels = multilevel(spark)
    model.pipeline.guess_sigmas(objects_)
    model.fit(objects_, labels)
    whole = {r["mol"]: r["prediction"] for r in model.predict(objects_).collect()}
    early = F.col("mol") < 11
    again, _, _ = multilevel(spark)
    again.pipeline.steps[0][1].sigma = model.pipeline.steps[0][1].sigma
    again.fit(objects_.filter(early), labels.filter(early)).refit(objects_.filter(~early), labels.filter(~early))
    assert all(abs(whole[r["mol"]] - r["prediction"]) < 1e-6 for r in again.predict(objects_).collect())
    curve = model.learning_curve(objects_, labels, objects_, labels, [5, 10], most=2).orderBy("size").collect()
    assert [r["size"] for r in curve] == [5, 10] and all(r["mean"] >= 0 for r in curve)
    before = model.loo(objects_, labels).agg(F.avg(F.abs("err"))).first()[0]
    after = model.optimise(objects_, labels, rounds=2).loo(objects_, labels).agg(F.avg(F.abs("err"))).first()[0]
    assert after <= before + 1e-9


def test_feature_loo_derivative(spark):
    rng = np.random.default_rng(4)
    z, dz, y = rng.normal(size=(15, 3)), rng.normal(size=(15, 3)), rng.normal(size=15)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), float(t)) for i, (a, b, t) in enumerate(zip(z, dz, y, strict=True))], "id long, z array<double>, dz array<double>, y double")

    def errors(h):
        m = z + h * dz
        p = m @ np.linalg.solve(m.T @ m + 0.3 * np.eye(3), m.T)
        return (p @ y - y) / (1 - np.diag(p))

    got = {r["id"]: r for r in solvers.feature_loo_derivative(df, "z", "dz", "y", z.T @ z, z.T @ y, 0.3, ["id"]).collect()}
    assert np.allclose([got[i]["err"] for i in range(15)], errors(0))
    assert np.allclose([got[i]["derr"] for i in range(15)], (errors(1e-6) - errors(-1e-6)) / 2e-6, atol=1e-5)


def test_shift_errors_are_linear():
    rng = np.random.default_rng(6)
    loo, y, c = selection.LeaveOneOut(rng.normal(size=(12, 3))), rng.normal(size=12), rng.normal(size=(12, 2))
    a, b = loo.shift_errors(y, c, 0.2)
    t = np.array([0.7, -1.1])
    assert np.allclose(a @ t + b, loo.errors(y + c @ t, 0.2))


def test_reduced_parameters():
    r = selection.Reduced({"sigma": 2.0, "mix": -0.5, "l2": 1e-3}, fixed={"l2"})
    x = r.reduced()
    assert r.names == ["sigma", "mix"] and np.allclose(x, [math.log(2), -0.5]) and r.full(x) == pytest.approx({"sigma": 2.0, "mix": -0.5, "l2": 1e-3})
    assert np.allclose(r.gradient({"sigma": 3.0, "mix": 4.0}), [6.0, 4.0])


@pytest.mark.parametrize("fourier", [1, 2])
def test_fchl19_slopes(fourier):
    rng = np.random.default_rng(1)
    z, r = rng.choice([1, 6, 8], 5), rng.normal(size=(5, 3)) * 2
    x, g = representations.fchl19_gradient(z, r, (1, 6, 8), fourier=fourier)
    assert np.allclose(x, representations.fchl19(z, r, (1, 6, 8), fourier=fourier))
    assert np.allclose(g, representations.numeric_gradient(lambda p: representations.fchl19(z, p, (1, 6, 8), fourier=fourier), r), atol=1e-9)


def test_gradients_of_losses(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=25) * 3
    rows = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(e)], "id long, g string, e double")
    value = {
        "mae": lambda v: np.abs(v).mean(), "mse": lambda v: (v * v).mean(), "rmse": lambda v: math.sqrt((v * v).mean()),
        "huber": lambda v: np.where(np.abs(v) < 2.4, v * v / 4.8, np.abs(v) - 1.2).mean(), "logcosh": lambda v: (np.log(np.cosh(v * math.log(2) / 1.2)) * 1.2 / math.log(2)).mean(),
    }
    for kind, f in value.items():
        for squared in (False, True):
            h = (lambda v, f=f: f(v) ** 2) if squared else f
            got = {r["id"]: r for r in statistics.loss_gradients(rows, "e", kind, ["g"], 1.2 if kind in ("huber", "logcosh") else None, squared).collect()}
            slope = [(h(e + 1e-6 * d) - h(e - 1e-6 * d)) / 2e-6 for d in np.eye(25)]
            assert math.isclose(got[0]["loss"], h(e), rel_tol=1e-9) and np.allclose([got[i]["gradient"] for i in range(25)], slope, atol=1e-6), kind
    losses = statistics.self_consistent_by(rows, "e", 0.3, ["g"], "logcosh")
    got = {r["id"]: r for r in statistics.self_consistent_gradients(rows, "e", losses, ["g"], 0.3, "logcosh", True).collect()}

    def solved(v):
        low, high = 0.0, float(np.abs(v).mean())
        for _ in range(100):
            mid = (low + high) / 2
            d = 0.3 * mid
            low, high = (mid, high) if (np.log(np.cosh(v * math.log(2) / d)) * d / math.log(2)).mean() > mid else (low, mid)
        return mid * mid

    assert math.isclose(got[0]["loss"], solved(e), rel_tol=1e-6)
    assert np.allclose([got[i]["gradient"] for i in range(25)], [(solved(e + 1e-5 * d) - solved(e - 1e-5 * d)) / 2e-5 for d in np.eye(25)], atol=1e-5)


def test_whole_tables_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    for f in (lambda: statistics.self_consistent_huber(df, "a", 0.5), lambda: statistics.weighted_median(df, "a", "b")):
        with pytest.raises(ValueError):
            f()


def test_odd_objects_and_elements(spark):
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0])], "mol long, x array<double>")
    o = objects.lists(objects.with_vector(ragged), ["mol"], ["x"])
    with pytest.raises(ValueError):
        objects.checked(o, F.col("object"))
    nulls = objects.lists(objects.with_vector(spark.createDataFrame([(1, [1.0]), (2, None)], "mol long, x array<double>")), ["mol"], ["mol"])
    with pytest.raises(ValueError):
        objects.checked(nulls, F.col("object"))
    assert objects.checked(nulls, F.col("object"), nullable=True).count() == 2
    z = spark.createDataFrame([(1,), (7,)], "z int")
    with pytest.raises(Exception, match="unknown element"):
        z.select(S.element_place(F.col("z"), [1, 6])).collect()


def test_segments_of_sparse_ids(spark):
    rows = [(10**12 * i + i % 3, i % 5) for i in range(60)]
    got = ranking.prefix_ranges(spark.createDataFrame(rows, "mol long, n int"), "mol", "n", buckets=4).orderBy("mol").collect()
    at = 0
    for (m, n), r in zip(rows, got, strict=True):
        assert (r["mol"], r["lower"], r["upper"]) == (m, at, at + n)
        at += n
    assert ranking.prefix_ranges(spark.createDataFrame([], "mol long, n int"), "mol", "n").count() == 0
