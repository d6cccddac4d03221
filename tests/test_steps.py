"""Systems of many rows are solved by steps: no factors by blocks are written, no n x n numbers are on the driver."""

import numpy as np
import pytest

from larkspur.operators import blocks, large_kernels, orbitals, ranking
from larkspur.operators import models as M
from larkspur.operators.kernels import Kernel
from larkspur.plans import systems
from larkspur.plans.catalogue import vectors


def _none(*_, **__):
    raise AssertionError("not to be called")


def test_kernel_ridge_without_a_kernel(spark, sf, monkeypatch):
    """F2"""
    rows = vectors(spark, sf).selectExpr("id", "x", "cast(z as double) y")
    want = M.KernelRidge(Kernel("gaussian", (1.0,)), 1e-6).fit(rows)
    cholesky, plain = blocks.solve, blocks.kernel_blocks
    monkeypatch.setattr(blocks, "kernel_blocks", _none)
    got = M.KernelRidge(Kernel("gaussian", (1.0,)), 1e-6, dense=100).fit(rows)
    assert got.ids == want.ids and got.mean == pytest.approx(want.mean) and np.allclose(got.alphas, want.alphas, rtol=1e-5, atol=1e-7)
    used = []
    monkeypatch.setattr(blocks, "kernel_blocks", lambda *a: used.append(1) or plain(*a))
    monkeypatch.setattr(blocks, "solve", lambda *a: used.append(2) or cholesky(*a))
    monkeypatch.setattr(large_kernels.LargeKernelRidge, "fit", lambda *a: (_ for _ in ()).throw(RuntimeError("too many steps")))
    again = M.KernelRidge(Kernel("gaussian", (1.0,)), 1e-6, dense=100).fit(rows)  # by blocks where the steps do not end
    assert used == [1, 2] and np.allclose(again.alphas, want.alphas, rtol=1e-5, atol=1e-7)


def test_local_models_write_no_factors(spark, sf, monkeypatch):
    """F18, F22"""
    monkeypatch.setattr(blocks, "ATOMS", 70)
    monkeypatch.setattr(blocks, "solve", _none)
    monkeypatch.setattr(blocks, "subset", _none)
    mols, labels, k = systems.mol_rows(spark, sf), systems.mol_labels(spark, sf), Kernel("gaussian", (1.0,))
    a, b = (M.LocalKernelRidge(k, 0.1, shift=False, dense=d).fit_atoms(mols, labels) for d in (10_000, 10))
    assert a.ids == b.ids and np.allclose(a.alphas, b.alphas, atol=1e-9)
    folds = ranking.folds(labels, "id", 2)
    a, b = (M.local_fold_objective(mols, labels, k, folds, 0.1, dense=d) for d in (10_000, 10))
    assert np.isclose(a, b, rtol=1e-9)


def test_orbital_ridge_of_many_molecules(spark, sf):
    """more molecules than the driver holds the kernel of were refused."""
    o = systems.orbital_rows(spark, sf)
    labels = o.groupBy("mol").agg({"arep": "avg"}).toDF("mol", "y")
    a, b = (orbitals.OrbitalRidge([0.5] * 64, 0.7, 0.01, most=m).fit(o, labels) for m in (10_000, 3))
    assert len(a.alphas) > 3 and np.allclose(a.alphas, b.alphas, rtol=1e-8, atol=1e-9 * np.abs(a.alphas).max())


def test_conjugate_gradients():
    rng = np.random.default_rng(3)
    f = rng.normal(size=(80, 12))
    k, b = f @ f.T, rng.normal(size=80)
    for l2, own in ((0.1, None), (0.1, np.arange(9)), (1e-3, np.arange(20))):
        got = blocks.conjugate(lambda p: k @ p, b, l2, None if own is None else k[:, own], own)
        assert np.allclose(got, np.linalg.solve(k + l2 * np.eye(80), b), rtol=1e-6, atol=1e-8)
    assert blocks.conjugate(lambda p: -p, b, 0.5) is None and blocks.conjugate(lambda p: p * np.nan, b, 0.5) is None
    assert blocks.conjugate(lambda p: k @ p, np.zeros(80), 0.1).tolist() == [0.0] * 80


def test_mirrored_kernel_is_made_once(spark):
    """F3"""
    from larkspur.operators import kernels

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "id long, x array<double>")
    k = Kernel("gaussian", (2.0,))
    got = kernels.mirrored(kernels.kernel_matrix(df, None, k, lower=True, tile=3))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # two sides' tiles and the blocks
    rows = {(r["i"], r["j"]): r["k"] for r in got.collect()}
    assert got.count() == len(rows) == 49 and got.columns == ["i", "j", "sigma", "k"]
    assert all(v == pytest.approx(np.exp(-((i - j) ** 2) / 8), abs=1e-12) for (i, j), v in rows.items())


def test_rows_that_are_no_near_copies(spark):
    """F2, F16: rows with three fifths of their kernel are not put together; blocks in one array are those by distances."""
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, x array<double>")
    tiles = large_kernels.Tiles.of(df, tile=4)
    assert len(np.unique(large_kernels.near_copies(tiles, Kernel("gaussian", (1.0,))))) == 6
    a, b = np.random.default_rng(1).normal(size=(2, 30, 5))
    one, many = Kernel("gaussian", (0.7,)), Kernel("gaussian", (0.7, 1.0))
    assert np.allclose(one.block(a, b)[0], many.block(a, b)[0], atol=1e-14) and one.block(a, a)[0].max() <= 1
