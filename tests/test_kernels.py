import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import forces, kernels, orbitals
from larkspur.operators.kernels import Kernel
from larkspur.operators.representations import numeric_gradient, toy

KINDS = [Kernel("laplacian", (2.0,)), Kernel("gaussian", (0.5, 2.0))] + [Kernel("matern", (1.5,), o, m) for o in (0, 1, 2) for m in ("l1", "l2")]


def plain(k, a, b, sigma):
    l1, l2 = np.abs(a - b).sum(), ((a - b) ** 2).sum()
    if k.kind == "laplacian":
        return math.exp(-l1 / sigma)
    if k.kind == "gaussian":
        return math.exp(-l2 / (2 * sigma**2))
    x = (l1 if k.metric == "l1" else math.sqrt(l2)) / sigma
    return [math.exp(-x), math.exp(-math.sqrt(3) * x) * (1 + math.sqrt(3) * x), math.exp(-math.sqrt(5) * x) * (1 + math.sqrt(5) * x + 5 * x * x / 3)][k.order]


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(i, i // 3, int(rng.integers(1, 4)), rng.random(5)) for i in range(n)]
    a, b = make(13), make(8)
    df = lambda rows: spark.createDataFrame([(i, m, z, x.tolist()) for i, m, z, x in rows], "id long, mol long, z int, x array<double>")
    return a, b, df(a), df(b)


@pytest.mark.parametrize("k", KINDS)
def test_global(sets, k):
    a, b, da, db = sets
    got = {(r["i"], r["j"], r["sigma"]): r["k"] for r in kernels.kernel_matrix(da, db, k, tile=4).collect()}
    assert len(got) == 13 * 8 * len(k.sigmas)
    for (i, j, s), v in got.items():
        assert math.isclose(v, plain(k, a[i][3], b[j][3], s), rel_tol=1e-9)
    column = da.alias("l").crossJoin(db.alias("r")).select("l.id", "r.id", k.column(F.col("l.x"), F.col("r.x"))).collect()
    assert all(math.isclose(v, got[i, j, k.sigmas[0]], rel_tol=1e-9) for i, j, v in column)


@pytest.mark.parametrize("matched", [False, True])
@pytest.mark.parametrize("k", [KINDS[0], KINDS[1], KINDS[4]])
def test_local(sets, k, matched):
    a, b, da, db = sets
    got = {(r["i"], r["j"], r["sigma"]): r["k"] for r in kernels.local_kernel_matrix(da, db, k, z="z" if matched else None, tile=4).collect()}
    assert len(got) == 5 * 3 * len(k.sigmas)
    for (i, j, s), v in got.items():
        want = sum(plain(k, x, y, s) for _, m, z, x in a if m == i for _, n, w, y in b if n == j and (z == w or not matched))
        assert math.isclose(v, want, rel_tol=1e-9, abs_tol=1e-12)


def test_symmetric(sets):
    a, _, da, _ = sets
    k = KINDS[1]
    full = {(r["i"], r["j"], r["sigma"]): r["k"] for r in kernels.kernel_matrix(da, None, k).collect()}
    lower = kernels.kernel_matrix(da, None, k, lower=True, tile=4)
    assert lower.filter("j > i").count() == 0
    back = {(r["i"], r["j"], r["sigma"]): r["k"] for r in kernels.mirrored(lower).collect()}
    assert back.keys() == full.keys() and all(math.isclose(back[x], full[x], rel_tol=1e-9) for x in full)
    one = kernels.kernel_matrix(da, None, Kernel("gaussian", (1.0,)))
    near = {r["i"]: r["j"] for r in kernels.nearest(kernels.squared_distances(one)).collect()}
    for i, _, _, x in a:
        assert near[i] == min((j for j, *_ in a if j != i), key=lambda j: ((x - a[j][3]) ** 2).sum())
    for m in ("l1", "l2"):
        want = max(np.abs(x - y).sum() if m == "l1" else np.linalg.norm(x - y) for *_, x in a for *_, y in a)
        assert math.isclose(kernels.max_pair_distance(da, m, tile=3).first()[0], want, rel_tol=1e-9)


def test_nulls_and_empty(spark, sets):
    *_, db = sets
    odd = spark.createDataFrame([(None, 0, 1, [1.0] * 5), (1, 0, 1, None)], "id long, mol long, z int, x array<double>")
    assert kernels.kernel_matrix(odd, db, KINDS[0]).count() == 0


def test_force_kernels(spark):
    """Derivative blocks against differences of the plain kernel."""
    rng = np.random.default_rng(3)
    sigma = 1.3

    def molecule(n):
        z, r = np.array([1, 3, 1][:n]), rng.normal(size=(n, 3)) * 2
        return z, r, forces.Molecule(z, toy(z, r, 4), numeric_gradient(lambda x: toy(z, x, 4), r))

    (za, ra, a), (zb, rb, b) = molecule(3), molecule(2)

    def k(x, y):
        u, v = toy(za, x, 4), toy(zb, y, 4)
        d = ((u[:, None] - v[None]) ** 2).sum(axis=2)
        return (np.exp(-d / (2 * sigma**2)) * (za[:, None] == zb[None])).sum()

    got = forces.process_block(a, b, sigma)
    assert math.isclose(got[0, 0], k(ra, rb), rel_tol=1e-9)
    assert np.allclose(got[0, 1:], -numeric_gradient(lambda y: np.array(k(ra, y)), rb).ravel(), atol=1e-6)
    assert np.allclose(got[1:, 0], -numeric_gradient(lambda x: np.array(k(x, rb)), ra).ravel(), atol=1e-6)
    mixed = numeric_gradient(lambda x: numeric_gradient(lambda y: np.array(k(x, y)), rb), ra)
    assert np.allclose(got[1:, 1:], mixed.reshape(6, 9).T, atol=1e-4)
    op = forces.operator_block(a, b, sigma)
    assert np.allclose(op.sum(axis=0), got[0], atol=1e-9)
    y = forces.joined_targets([1.0, 2.0], [np.ones((3, 3)), np.zeros((2, 3))])
    e, f = forces.split_targets(y, [3, 2])
    assert e.tolist() == [1, 2] and f[0].sum() == 9 and f[1].shape == (2, 3)
    rows = [(i, m.z.tobytes(), m.x.tobytes(), m.g.tobytes(), m.x.shape[1]) for i, m in enumerate((a, b))]
    mols = spark.createDataFrame(rows, "mol long, z binary, x binary, g binary, d long")
    targets = spark.createDataFrame([(0, 0.5, [0.1] * 9), (1, -0.2, [0.0] * 6)], "mol long, energy double, forces array<double>")
    for process in (True, False):
        model = forces.ForceRidge(sigma, 1e-10, process).fit(mols, targets)
        got = {r["mol"]: r for r in model.predict(mols).collect()}
        assert len(got[0]["forces"]) == 9 and len(got[1]["forces"]) == 6
        if process:
            assert np.allclose([got[0]["energy"], got[1]["energy"]], [0.5, -0.2], atol=1e-3)
    with pytest.raises(ValueError):
        forces.ForceRidge(sigma, most=9).fit(mols, targets)


def test_orbital_kernel(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 12, i // 4, 0.4 + (i // 4) % 3, i, float(rng.random()), rng.random(3).tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, "mol long, orb long, orb_rho double, arep long, rho double, v array<double>")
    s, g = [0.5, 1.0, 2.0], 0.8
    for norm in ("l2", "l1"):
        f = lambda u, v: math.exp(-sum((((x - y) * (0.5 if norm == "l2" else 1) / w) ** 2 if norm == "l2" else abs(x - y) / w) for x, y, w in zip(u, v, s, strict=True)))  # noqa: E731, B023
        orbs = {}
        for m, o, r, _, w, v in rows:
            orbs.setdefault((m, o, r), []).append((w, v))
        dot = lambda p, q: sum(a * b * f(u, v) for a, u in p for b, v in q)  # noqa: E731, B023
        want = {}
        for (m, _, r), p in orbs.items():
            for (n, _, t), q in orbs.items():
                c = dot(p, q) / math.sqrt(dot(p, p) * dot(q, q))
                want[m, n] = want.get((m, n), 0) + r * t * math.exp(-(1 - c) / g**2)
        got = {(r["i"], r["j"]): r["k"] for r in orbitals.orbital_kernel(df, df, s, g, norm).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)
    pair = orbitals.determinant_pairs(df, df)
    assert abs(orbitals.orbital_kernel(pair, pair, s, g).agg(F.sum(F.abs("k"))).first()[0]) < 1e-9
    assert np.allclose(orbitals.renormed_sigmas(np.array([1.0, 1e-9, 3.0])), [math.sqrt(3), 2 * math.sqrt(3), 3 * math.sqrt(3)])


def test_orbital_representation(spark):
    """Orthonormal orbitals: atoms' weights of an orbital sum to 1, populations to the weight."""
    rng = np.random.default_rng(6)
    n = 6
    m = rng.normal(size=(n, n))
    s = m @ m.T + n * np.eye(n)
    w, v = np.linalg.eigh(s)
    c = v / np.sqrt(w) @ v.T @ np.linalg.qr(rng.normal(size=(n, n)))[0]
    assert np.allclose(c.T @ s @ c, np.eye(n))
    momenta, spans = np.array([0, 1, 1, 0, 0, 1]), [(0, 3), (3, 4), (4, 6)]
    for k in range(n):
        assert math.isclose(sum(orbitals.populations(c[:, k], s, momenta, a, 1).sum() for a in spans), 1.0)
    f = orbitals.rebuilt_matrices(c, np.arange(n) - 2.0, np.array([2.0, 2, 2, 0, 0, 0]), s)
    assert np.allclose(c.T @ f[1] @ c, np.diag(np.arange(n) - 2.0)) and np.allclose(orbitals.propagators(c, np.zeros(n), s, [1.0])[0], s)
    for parts in orbitals.orbital_representation(c, s, f, momenta, spans, 1, cut=0.0):
        assert math.isclose(sum(p[1] for p in parts), 1.0) and all(math.isclose(v[:2].sum(), 1.0) for _, _, v in parts)
    row = (7, c.ravel().tolist(), s.ravel().tolist(), (np.arange(n) - 2.0).tolist(), [2.0, 2.0, 2.0, 0.0, 0.0, 0.0], momenta.tolist(), [0, 3, 4])
    df = spark.createDataFrame([row], "mol long, coeff array<double>, overlap array<double>, energy array<double>, occ array<double>, momenta array<int>, starts array<int>")
    rows = orbitals.representation_rows(df)
    assert rows.select("orb").distinct().count() == 3
    k = orbitals.orbital_kernel(rows, rows, [1.0] * len(rows.first()["v"]), 1.0).first()["k"]
    assert 0 < k <= 36 + 1e-9
    assert orbitals.by_atom(rows).filter("size(parts) > 3").count() == 0
