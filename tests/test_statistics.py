import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ranking, statistics
from larkspur.plans.ranks import ranked, seeded


def huber(e, d):
    return np.where(np.abs(e) < 2 * d, e * e / (4 * d), np.abs(e) - d).mean()


@pytest.mark.parametrize("c", [0.05, 0.25, 1.0])
def test_self_consistent_huber(spark, c):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=30), 1: rng.standard_cauchy(25), 2: np.array([2.0]), 3: np.array([1.0, 1.0, 1.0]), 4: np.zeros(3)}
    df = spark.createDataFrame([(g, float(e)) for g, v in groups.items() for e in v], "g int, e double")
    got = {r["g"]: r["loss"] for r in statistics.self_consistent_huber(df, "e", c, ["g"]).collect()}
    for g, e in groups.items():
        if g == 4:
            assert got[g] == 0
            continue
        assert got[g] > 0 and math.isclose(got[g], huber(e, c * got[g]), rel_tol=1e-9)
    one = statistics.self_consistent(df.filter("g = 0"), "e", c, lambda e, d: statistics.huber_term(e, d))
    assert math.isclose(one, got[0], rel_tol=1e-8)


def test_losses(spark):
    e = np.random.default_rng(2).normal(size=50) * 3
    df = spark.createDataFrame([(float(x),) for x in e], "e double")
    got = df.agg(*[f(F.col("e")) for f in (statistics.mae, statistics.mse, statistics.rmse)], statistics.huber(F.col("e"), 1.0), statistics.logcosh(F.col("e"), 1.0)).first()
    d = math.log(2)
    want = [np.abs(e).mean(), (e * e).mean(), math.sqrt((e * e).mean()), huber(e, 1.0), (np.log(np.cosh(e * d)) / d).mean()]
    assert np.allclose(list(got), want)


def test_weighted_median(spark):
    rng = random.Random(3)
    rows = [(i % 3, rng.choice([-2.0, 0.5, 1.0, 3.0]), rng.gauss(0, 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    for r in statistics.weighted_median(df, "a", "b", ["g"]).collect():
        loss = lambda x: sum(abs(a * x - b) for g, a, b in rows if g == r["g"])  # noqa: E731, B023
        assert loss(r["x"]) <= min(loss(b / a) for g, a, b in rows if g == r["g"]) + 1e-9


def test_weighted_median_of_all(spark):
    rng = random.Random(5)
    for values in ([rng.gauss(0, 5) for _ in range(200)], [rng.choice([1.0, 2.0, 2.0, 7.0]) for _ in range(50)], [3.0]):
        rows = [(rng.choice([0.5, 1.0, 3.0]), v) for v in values]
        df = spark.createDataFrame(rows, "a double, b double").withColumn("g", F.lit(0))
        want = statistics.weighted_median(df, "a", "b", ["g"]).first()["x"]
        assert statistics.weighted_median_of_all(df, "a", "b", bins=8) == want
    assert statistics.weighted_median_of_all(df.limit(0), "a", "b") is None


def plain_cut(rho, cut):
    rho = sorted((x / sum(rho) for x in rho), reverse=True)
    if len(rho) == 1:
        return rho
    keep = 1
    for k in range(1, len(rho) + 1):
        if k * rho[k - 1] + sum(rho[k:]) > cut:
            keep = k
    out = [max(0.0, x - (cut - sum(rho[keep:])) / keep) for x in rho[:keep]]
    return [x / sum(out) for x in out]


def test_cut_weights(spark):
    rng = random.Random(4)
    groups = {g: [rng.random() + 0.01 for _ in range(rng.randrange(1, 9))] for g in range(40)}
    df = spark.createDataFrame([(g, i, x) for g, v in groups.items() for i, x in enumerate(v)], "g int, i int, w double")
    got = {}
    for r in ranking.cut_weights(df, ["g"], "w", ["i"], 0.2).orderBy("g", F.desc("rho")).collect():
        got.setdefault(r["g"], []).append(r["rho"])
    for g, v in groups.items():
        assert np.allclose(got[g], plain_cut(v, 0.2))


def test_ranks_are_those_of_one_sort(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    got = ranked(df, ["g"], seeded(F.col("id")), ["id"], buckets=16)
    rows = got.withColumn("h", seeded(F.col("id"))).collect()
    for g in range(3):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in mine] == list(range(len(mine))) and all(r["n"] == len(mine) for r in mine)


def test_folds_and_learning(spark):
    df = spark.range(41).withColumnRenamed("id", "k")
    f = ranking.folds(df, "k", 3, 0.25).collect()
    assert all(sum(r["train"] for r in f if r["fold"] == i) == 10 and sum(r["fold"] == i for r in f) == 41 for i in range(3))
    s = ranking.learning_subsets(df, "k", [5, 20], 4).collect()
    for size, parts in ((5, 4), (20, 2)):
        mine = [(r["subset"], r["k"]) for r in s if r["size"] == size]
        assert len(mine) == size * parts == len({k for _, k in mine})
    errors = spark.createDataFrame([(5, 0, 1.0), (5, 0, -3.0), (5, 1, 4.0)], "size int, subset int, err double")
    assert list(ranking.learning_curve(errors).first()) == [5, 3.0, 1.0]


def test_moments_and_shifts(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(40, 3)), rng.random(40)
    df = spark.createDataFrame([(i, i % 4, x[i].tolist(), float(w[i])) for i in range(40)], "id long, g long, x array<double>, w double")
    assert math.isclose(statistics.vector_std(df, "x").first()[0], math.sqrt(x.var(axis=0).sum()))
    m = sorted(statistics.component_moments(df, "x", F.col("w")).collect())
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    assert np.allclose([r["mean"] for r in m], mean) and np.allclose([r["variance"] for r in m], (w[:, None] * (x - mean) ** 2).sum(axis=0) / w.sum())
    for r in statistics.vector_sum(df, ["g"], "x", F.col("w")).collect():
        assert np.allclose(r["x"], (w[:, None] * x)[np.arange(40) % 4 == r["g"]].sum(axis=0))
    n = rng.integers(0, 4, (40, 2))
    y = n @ [2.0, -1.0] + 5
    df = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in zip(n, y, strict=True)], "a int, b int, y double")
    assert np.allclose(statistics.dressed_atoms(df, ["a", "b"], "y"), [2, -1, 5])
    assert abs(statistics.shift_mean(df, "y").agg(F.sum("shifted")).first()[0]) < 1e-9
    c = ranking.prefix_ranges(spark.createDataFrame([(i * 3000, i % 3) for i in range(10)], "mol long, n int"), "mol", "n").orderBy("mol").collect()
    assert [(r["lower"], r["upper"]) for r in c] == [(sum(j % 3 for j in range(i)), sum(j % 3 for j in range(i + 1))) for i in range(10)]
