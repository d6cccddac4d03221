import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.functions import vector as V
from larkspur.operators.features import walsh_hadamard


@pytest.fixture(scope="module")
def one(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=8), rng.normal(size=8)
    return spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>"), a, b


def test_vectors(one):
    df, a, b = one
    x, y = F.col("a"), F.col("b")
    got = df.select(
        V.l1(x, y), V.l2sq(x, y), V.dot(x, y), V.norm(x), V.normalised(x), V.padded(x, 10), V.padded(x, 3), V.ranges_divided(x, [2.0, 4.0], [0, 3, 8]),
        V.powers_divided(x, 3.0, [1.0, 2.0]), V.compressed(x, [1.0, 2.0, 3.0, 4.0]), V.hadamard(x, 8),
    ).first()
    n = np.linalg.norm(a)
    want = [
        np.abs(a - b).sum(), ((a - b) ** 2).sum(), a @ b, n, a / n, [*a, 0, 0], a[:3], a / np.array([2] * 3 + [4] * 5),
        a / np.array([3, 9] * 4), a.reshape(2, 4) @ [1, 2, 3, 4], walsh_hadamard(a),
    ]
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w)


def test_scalars(spark):
    df = spark.createDataFrame([(1,), (5,), (8,), (17,), (19,), (0,)], "n int")
    rows = df.select("n", S.is_power_of_two(F.col("n")).alias("p"), S.next_power_of_two(F.col("n")).alias("q"), S.period_valence(F.col("n")).alias("v"), S.symbol_of(F.col("n")).alias("s")).collect()
    for r in rows:
        n = r["n"]
        assert r["p"] == (n > 0 and n & (n - 1) == 0)
        assert r["q"] == (1 if n <= 1 else 1 << (n - 1).bit_length())
    assert [r["v"] for r in rows] == [[1, 1, 0, 0], [2, 2, 1, 0], [2, 2, 4, 0], [3, 2, 5, 0], None, None]
    assert [r["s"] for r in rows] == ["H", "B", "O", "Cl", "K", None]
    x = spark.createDataFrame([(0.3,)], "x double")
    h = x.select(*[S.hermite(F.col("x"), k) for k in range(5)], S.cosine_cutoff(F.col("x"), 1.0), S.nuclear_charge(F.lit(" cL ")), S.clamped_acos(F.lit(1.5)), S.negative_inverse(F.lit(4.0)), S.negative_inverse(F.lit(0.0))).first()
    t = 0.3
    assert np.allclose(h[:5], [1, -2 * t, 4 * t**2 - 2, -8 * t**3 + 12 * t, 16 * t**4 - 48 * t**2 + 12])
    assert np.allclose(list(h[5:]), [0.5 * (math.cos(math.pi * t) + 1), 17, 0, -0.25, 0])
