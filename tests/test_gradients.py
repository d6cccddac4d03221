"""Derivatives through levels and of leave-one-out losses, against differences and dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import levels, slopes
from larkspur.operators.features import Signs

from .test_plans import plan


def objects(spark, n=24):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.choice([1, 6])), float(rng.uniform(0.5, 2)), rng.normal(size=5).tolist()) for i in range(n) for _ in range(3)]
    return spark.createDataFrame(rows, "mol long, z int, w double, x array<double>"), spark.createDataFrame([(i, float(rng.normal())) for i in range(n)], "mol long, y double")


def pipeline(kind="plain"):
    species = {e: Signs.seeded(2, 2, 8, e) for e in (1, 6)}
    top = Signs.seeded(1, 2, 16, 9)
    return levels.Pipeline([
        ("column", levels.resize(6)), ("column", levels.rescale([0.7, 1.5], [0, 2, 6])), ("map", levels.FeatureLevel(species, 1.3, kind, 0.6), "z"), ("weighted_sum", ["mol"], "w"),
        ("column", levels.normalise()), ("column", levels.power_rescale(0.8, [1.0, 2.0, 0.5])), ("column", levels.compress([0.5, 1.0])), ("map", levels.FeatureLevel({0: top}, 0.4)), ("column", levels.full_rescale(1.1)),
    ])


def features(pipe, df, dual=False):
    return np.array([r["x"] for r in pipe.run(df, dual=dual).orderBy("mol").collect()])


@pytest.mark.parametrize("kind", ["plain", "even", "extensive"])
def test_duals_are_differences(spark, kind):
    df, _ = objects(spark, 6)
    pipe = pipeline(kind)
    t = pipe.logs()
    assert len(t) == (7 if kind == "extensive" else 6)
    got = features(pipe, df, dual=True).reshape(6, 1 + len(t), -1)
    assert np.allclose(got[:, 0], features(pipe, df))
    for k in {"plain": (0, 3, 5), "even": (1, 2, 4), "extensive": (2, 3, 6)}[kind]:
        ends = []
        for h in (1e-5, -1e-5):
            pipe.set_logs(t + h * np.eye(len(t))[k])
            ends.append(features(pipe, df))
        assert np.allclose(got[:, 1 + k], (ends[0] - ends[1]) / 2e-5, atol=2e-8)
    pipe.set_logs(t)


def test_zero_vectors_have_zero_slopes(spark):
    df = spark.createDataFrame([(1, 1, 1.0, [0.0] * 5), (2, 6, 1.0, [0.0] * 5), (3, 1, 1.0, None)], "mol long, z int, w double, x array<double>")
    pipe = levels.Pipeline([("column", levels.normalise()), ("map", levels.FeatureLevel({e: Signs.seeded(1, 2, 8, e) for e in (1, 6)}, 1.0, "extensive", 0.5), "z")])
    got = pipe.run(df, dual=True).collect()
    assert len(got) == 2 and all(r["x"] == [0.0] * 24 for r in got)
    with pytest.raises(Exception, match="no parameters"):
        levels.Pipeline([("map", levels.FeatureLevel({1: Signs.seeded(1, 2, 8, 1)}), "z")]).run(df).collect()
    with pytest.raises(ValueError):
        levels.Pipeline([("column", lambda v: v), ("map", levels.FeatureLevel({0: Signs.seeded(1, 2, 8, 1)}))]).run(df, dual=True)


def dense_loss(z, y, ratio, loss, delta=0.7):
    n, d = z.shape
    y = y - y.mean()
    a = z.T @ z
    a += ratio * np.trace(a) / min(n, d) * np.eye(d)
    hat = z @ np.linalg.solve(a, z.T)
    return slopes.LOSSES[loss]((hat @ y - y) / (1 - np.diag(hat)), delta)[0].mean()


@pytest.mark.parametrize("loss", ["mae", "mse", "huber", "logcosh"])
def test_loss_slopes_are_differences(spark, loss):
    df, labels = objects(spark)
    model = levels.MultilevelModel(pipeline(), "mol", 0.05)
    y = np.array([r["y"] for r in labels.orderBy("mol").collect()])
    value, by, by_ratio = model.loss_and_slopes(df, labels, loss, 0.7)
    t = model.pipeline.logs()
    at = lambda t, r: (model.pipeline.set_logs(t), dense_loss(features(model.pipeline, df), y, r, loss))[1]
    assert np.isclose(value, at(t, 0.05))
    for k in (0, 4):
        h = 1e-5 * np.eye(len(t))[k]
        assert np.isclose(by[k], (at(t + h, 0.05) - at(t - h, 0.05)) / 2e-5, atol=1e-6)
    model.pipeline.set_logs(t)
    assert np.isclose(by_ratio, (at(t, 0.05 * np.exp(1e-5)) - at(t, 0.05 * np.exp(-1e-5))) / 2e-5, atol=1e-6)


def test_descent_along_slopes(spark):
    df, labels = objects(spark, 40)
    model = levels.MultilevelModel(pipeline(), "mol", 0.05)
    before = model.fit(df, labels).loo(df, labels).agg(F.avg(F.abs("err"))).first()[0]
    after = model.optimise(df, labels, rounds=4).loo(df, labels).agg(F.avg(F.abs("err"))).first()[0]
    assert np.isclose(model.history[0], before) and np.isclose(model.history[-1], after) and after < before and model.history == sorted(model.history, reverse=True)


def test_levels_read_their_rows_once(spark, sf):
    """However many elements a level has parameters for, the rows are scanned once, and a sum shuffles once for its parts and once for the vector."""
    from larkspur.plans import catalogue, systems

    model, rows, _ = systems.multilevel(spark, sf)
    for dual in (False, True):
        text = plan(model.pipeline.run(rows, dual=dual))
        assert text.count("Scan parquet") == 1 and "Union" not in text and text.count("Exchange") <= 2
    assert catalogue.QUERIES["multilevel_features"](spark, sf).count() > 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "z array<double>, dz array<double>, y double")
    loss, by, by_ratio = slopes.loo_gradient(empty, "z", "dz", "y", 3, 0.1)
    assert loss == 0 and by.tolist() == [0, 0, 0] and by_ratio == 0


def test_annealing(spark):
    """Two starts, two cycles; the better start goes on and the error does not grow."""
    df, labels = objects(spark, 30)
    species = {e: Signs.seeded(1, 2, 8, e) for e in (1, 6)}
    model = levels.MultilevelModel(levels.Pipeline([("map", levels.FeatureLevel(species, 1.3), "z"), ("sum", ["mol"])]), "mol", 0.05)
    before = model.fit(df, labels).loo(df, labels).agg(F.avg(F.abs("err"))).first()[0]
    after = model.anneal(df, labels, coefficients=(1.0, 0.25), starts=2, rounds=1).loo(df, labels).agg(F.avg(F.abs("err"))).first()[0]
    assert after <= before + 1e-9 and [h[0] for h in model.history] == [1.0, 1.0, 0.25] and np.isclose(model.history[0][2], before)
