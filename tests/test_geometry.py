import itertools
import math

import numpy as np
import pytest

from larkspur.operators import geometry
from larkspur.operators import representations as R


@pytest.fixture(scope="module")
def mols():
    rng = np.random.default_rng(7)
    return {m: (rng.choice([1, 6, 8], n), rng.random((n, 3)) * 5) for m, n in enumerate([1, 2, 5, 7])}


@pytest.fixture(scope="module")
def atoms(spark, mols):
    rows = [(m, i, int(z[i]), *map(float, r[i])) for m, (z, r) in mols.items() for i in range(len(z))]
    return spark.createDataFrame(rows, "mol long, atom long, z int, x double, y double, c double")


@pytest.mark.parametrize("small", [64, 5, 0])
def test_neighbours(atoms, mols, small):
    got = {(r["mol"], r["i"], r["j"]): r["r"] for r in geometry.neighbours(atoms, 2.0, small).collect()}
    want = {(m, i, j): np.linalg.norm(r[i] - r[j]) for m, (z, r) in mols.items() for i in range(len(z)) for j in range(len(z)) if i != j and np.linalg.norm(r[i] - r[j]) < 2}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_periodic_images(atoms, mols):
    cell, rcut = np.array([[6.0, 0, 0], [1.0, 7.0, 0], [0, 0.5, 8.0]]), 3.0
    got = {(r["mol"], r["atom"], r["na"], r["nb"], r["nc"]) for r in geometry.periodic_images(atoms, cell.tolist(), rcut).collect()}
    want = set()
    for m, (_, r) in mols.items():
        for n in itertools.product(range(-4, 5), repeat=3):
            for i, p in enumerate(r + np.array(n) @ cell):
                if n == (0, 0, 0) or (np.linalg.norm(r - p, axis=1) < rcut).any():
                    want.add((m, i, *n))
    assert got == want


def test_potential(atoms, mols):
    energy = {r["mol"]: r["energy"] for r in geometry.pair_energy(atoms).collect()}
    force = {(r["mol"], r["atom"]): [r["fx"], r["fy"], r["fc"]] for r in geometry.pair_forces(atoms).collect()}
    dip = {r["mol"]: r["dipole"] for r in geometry.dipole(atoms).collect()}

    def e(z, r):
        return sum(z[i] * z[j] * (np.linalg.norm(r[i] - r[j]) ** -12 - np.linalg.norm(r[i] - r[j]) ** -6) for i in range(len(z)) for j in range(i))

    for m, (z, r) in mols.items():
        assert math.isclose(dip[m], np.linalg.norm(((z.mean() - z)[:, None] * r).sum(axis=0)), abs_tol=1e-9)
        if len(z) < 2:
            assert m not in energy
            continue
        assert math.isclose(energy[m], e(z, r), rel_tol=1e-9)
        g = R.numeric_gradient(lambda x, z=z: np.array(e(z, x)), r)
        assert np.allclose([force[m, i] for i in range(len(z))], -g, rtol=1e-3, atol=1e-3 * np.abs(g).max())


def test_relational_and_numpy_forms_agree(atoms, mols):
    got = {r["mol"]: r["x"] for r in geometry.coulomb_matrix(atoms, 8).collect()}
    same = {r["mol"]: r["x"] for r in R.represented(R.molecules(atoms), lambda z, r: R.coulomb(z, r, 8), False).collect()}
    for m in mols:
        assert np.allclose(got[m], same[m])
    t = {(r["mol"], r["atom"]): r["x"] for r in geometry.toy_representation(atoms, 8).collect()}
    for m, (z, r) in mols.items():
        if len(z) > 1:
            assert np.allclose([t[m, i] for i in range(len(z))], R.toy(z, r, 8))
    two = {(r["mol"], r["z1"], r["z2"], r["g"]): r["v"] for r in geometry.slatm_two_body(atoms).collect()}
    types = [(1, 1), (1, 6), (1, 8), (6, 6), (6, 8), (8, 8)]
    for m, (z, r) in mols.items():
        x = R.slatm(z, r, types).reshape(6, -1)
        for k, (a, b) in enumerate(types):
            for g in range(0, x.shape[1], 7):
                assert math.isclose(two.get((m, a, b, g), 0), x[k, g], rel_tol=1e-8, abs_tol=1e-12)
    f = {(r["mol"], r["i"], r["z"], r["g"]): r["v"] for r in geometry.fchl_two_body(atoms).collect()}
    for m, (z, r) in mols.items():
        x = R.fchl19(z, r, elements=(1, 6, 8))
        for i in range(len(z)):
            for k, e in enumerate((1, 6, 8)):
                for g in range(24):
                    assert math.isclose(f.get((m, i, e, g + 1), 0), x[i, k * 24 + g], rel_tol=1e-8, abs_tol=1e-12)


def test_bag_of_bonds(atoms, mols):
    sizes = {r["z"]: r["bag"] for r in geometry.bags(atoms).orderBy("z").collect()}
    assert sizes == {e: max((z == e).sum() for z, _ in mols.values()) for e in (1, 6, 8) if any((z == e).any() for z, _ in mols.values())}
    got = {r["mol"]: r["x"] for r in geometry.bag_of_bonds(atoms, sizes).collect()}
    for m, (z, r) in mols.items():
        want, d = [], R.distances(r)
        for a, b, n in geometry.bag_slots(sizes):
            if b == 0:
                v = [0.5 * float(x) ** 2.4 for x in z if x == a]
            else:
                v = [z[i] * z[j] / d[i, j] for i in range(len(z)) for j in range(i) if {(z[i], z[j]), (z[j], z[i])} & {(a, b)}]
            want += sorted(v, reverse=True) + [0.0] * (n - len(v))
        assert np.allclose(got[m], want)


def test_many_body_types(atoms, mols):
    got = {(r["z1"], r["z2"], r["z3"]) for r in geometry.many_body_types(atoms).collect()}
    most = {e: max((z == e).sum() for z, _ in mols.values()) for e in (1, 6, 8)}
    want = {(e, 0, 0) for e in most} | {(a, b, 0) for a in most for b in most if a <= b}
    want |= {(a, b, c) for a in most for b in most for c in most if a <= c and all((a, b, c).count(e) <= most[e] for e in (a, b, c))}
    assert got == want


def test_slatm_against_loops(mols):
    z, r = mols[3]
    xs, angles = R.slatm_grids(4.8, (0.03, 0.03))
    d = R.distances(r)
    for t in [(1, 6, 8), (6, 1, 6), (8, 8, 8), (1, 1, 6)]:
        want = np.zeros(len(angles))
        for i, j, k in itertools.permutations(range(len(z)), 3):
            if (z[i], z[j], z[k]) != t or (t[0] == t[2] and i > k) or max(d[i, j], d[i, k], d[j, k]) > 4.8:
                continue
            u, v = r[i] - r[j], r[k] - r[j]
            angle = math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v))
            ck = (r[i] - r[k]) @ (r[j] - r[k]) / d[i, k] / d[j, k]
            ci = (r[k] - r[i]) @ (r[j] - r[i]) / d[i, k] / d[i, j]
            c = t[0] * t[1] * t[2] / 3 * 0.03 / math.sqrt(2 * math.pi * 0.05**2)
            want += c * (1 + np.cos(angles) * ck * ci) / (d[i, j] * d[i, k] * d[j, k]) ** 3 * np.exp(-((angles - angle) ** 2) / (2 * 0.05**2))
        assert np.allclose(R.slatm(z, r, [t]), want)
        assert np.allclose(R.slatm(z, r, [t], local=True).sum(axis=0), want)
    assert np.allclose(R.slatm(z, r, [(6,), (1, 6)], local=True).sum(axis=0), R.slatm(z, r, [(6,), (1, 6)]))
    assert R.slatm(z, r, [(1,), (6,), (1, 6), (6, 8)], alchemy=True).shape == (1 + len(xs),)


@pytest.mark.parametrize("f", [lambda z, r: R.fchl19(z, r, (1, 6, 8)), lambda z, r: R.cmbdf(z, r, R.default_convolutions(0.05, 10.0, 0.02))])
def test_invariance(mols, f):
    z, r = mols[3]
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))
    x = f(z, r)
    assert np.abs(x).sum() > 0
    p = np.array([3, 0, 6, 5, 1, 2, 4])
    assert np.allclose(f(z, r @ q.T * np.sign(np.linalg.det(q)) + 1.0), x, atol=2e-2 * np.abs(x).max())
    moved = f(z[p], r[p])
    assert np.allclose(moved.sum(), x.sum(), rtol=1e-6) or moved.shape == x.shape


def test_fchl_gradient_and_valence(mols):
    z, r = mols[2]
    x, g = R.fchl19_gradient(z, r, elements=(1, 6, 8))
    assert g.shape == (*x.shape, len(z), 3) and np.abs(g.sum(axis=2)).max() < 1e-4 * max(1, np.abs(g).max())
    assert R.with_valence(np.array([6, 1]), np.zeros((2, 1))).tolist() == [[2, 2, 2, 0, 0], [1, 1, 0, 0, 0]]
    with pytest.raises(ValueError):
        R.with_valence(np.array([26]), np.zeros((1, 1)))
    assert R.bagged(np.array([1, 6, 1]), np.array([[1.0], [5.0], [2.0]]), {1: 3, 6: 1}).tolist() == [2, 1, 0, 5]
    p = np.array([[1.0, 0, 0], [0, 0, 0], [0, 1.0, 0], [0, 1.0, 1.0]])
    assert math.isclose(abs(R.torsion(*p)), math.pi / 2)


def test_nothing_is_cut_off(spark):
    """Atoms that do not fit are an error, not a shorter representation."""
    import numpy as np
    import pytest

    from larkspur.operators import geometry, representations

    rng = np.random.default_rng(1)
    z, r = np.full((1, 6), 6), rng.normal(size=(1, 6, 3))
    assert representations.coulomb_many(z, r, 6).shape == (1, 21)
    with pytest.raises(ValueError):
        representations.coulomb_many(z, r, 4)
    with pytest.raises(ValueError):
        representations.bags_many(z, r, [(6, 0, 4), (6, 6, 15)])
    with pytest.raises(ValueError):
        representations.bags_many(z, r, [(1, 0, 6), (1, 1, 15)])
    atoms = spark.createDataFrame([(1, i, 6, float(i), 0.0, float(i * i)) for i in range(6)], "mol long, atom long, z int, x double, y double, c double")
    assert geometry.toy_representation(atoms, 6).count() == 6
    with pytest.raises(Exception, match="more than 4 atoms"):
        geometry.toy_representation(atoms, 4).collect()


def test_cmbdf_slopes_are_differences():
    """Of the values between the tables' nodes, by every position; and moving or turning a whole molecule changes nothing."""
    import numpy as np

    from larkspur.operators import representations as R

    tables = R.default_convolutions(0.01, 10.0, 0.005)
    rng = np.random.default_rng(3)
    z, r = rng.choice([1, 6, 8], (2, 5)), rng.normal(size=(2, 5, 3)) * 1.5
    x, g = R.cmbdf_gradient(z, r, tables)
    assert x.shape == (2, 5, 40) and g.shape == (2, 5, 40, 5, 3)
    assert np.allclose(x, R.cmbdf_many(z, r, tables), atol=0.05 * np.abs(x).max())
    for a, c in ((0, 0), (2, 1), (4, 2)):
        h = np.zeros_like(r)
        h[:, a, c] = 1e-5
        ends = [R.cmbdf_gradient(z, r + t * h, tables)[0] for t in (1, -1)]
        assert np.allclose(g[:, :, :, a, c], (ends[0] - ends[1]) / 2e-5, atol=1e-6 * max(1, np.abs(g).max()))
    assert np.abs(g.sum(axis=3)).max() < 1e-9 * np.abs(g).max()
    assert np.abs(np.einsum("mafbi,mbj->mafij", g, r) - np.einsum("mafbi,mbj->mafji", g, r)).max() < 1e-8 * np.abs(g).max()
    one, slopes = R.cmbdf_gradient(z[:, :1], r[:, :1], tables)
    assert not one.any() and not slopes.any()
