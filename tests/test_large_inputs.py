"""What kept queries from larger tables."""

import numpy as np

from larkspur.operators import forces
from larkspur.plans import systems


def test_gradients_by_entries(spark, sf, monkeypatch):
    """Same blocks and features as with whole gradients, however they are cut, from rows that grow with the atoms."""
    rng = np.random.default_rng(3)
    n, m = 7, 5
    whole = [forces.Molecule(rng.integers(1, 3, k), rng.normal(size=(k, 4)), rng.normal(size=(k, 4, k, 3)) * (rng.random((k, 1, k, 1)) < 0.4)) for k in (n, m)]
    some = []
    for mol in whole:
        e = np.argwhere(np.abs(mol.g).sum(axis=(1, 3)) > 0)
        some.append(forces.Molecule(mol.z, mol.x, mol.g[e[:, 0], :, e[:, 1]], e))
    want = [f(*whole, 0.9) for f in (forces.process_block, forces.operator_block)]
    for most in (1, 300, 1 << 18):
        monkeypatch.setattr(forces, "MOST", most)
        for parts in (1, 3):
            for f, size, block in ((forces.process_stripes, whole[0].size, want[0]), (forces.operator_stripes, n, want[1])):
                got = forces._whole((s for p in range(parts) for s in f(*some, 0.9, p, parts)), size, whole[1].size)
                assert np.allclose(got, block, atol=1e-12)
    row = systems.supplier_molecules(spark, sf).selectExpr("max(length(g) / length(z))").first()[0]
    assert row == 9  # before: 9 for each atom


def test_streams_of_folders(spark, sf, tmp_path):
    from larkspur.plans import streams

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert streams.stream_training(spark, str(tmp_path)).count() == e.count()


def test_objects_of_larger_molecules(spark, sf, tmp_path):
    from larkspur.plans import nested

    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("* except (l_orderkey)", "l_orderkey div 64 as l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    most = nested.objects_of_molecules(spark, str(tmp_path)).agg({"atoms": "max"}).first()[0]
    assert most > 16


def test_reductor_of_all_vectors(spark):
    from larkspur.operators.features import reductor

    x = np.random.default_rng(1).normal(size=(1500, 3)) * [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    w = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    assert np.allclose(np.abs((reductor(df, "x", 3, None) * w).sum(axis=0)), 1, atol=1e-12)


def test_minima_of_one_dimension(spark, sf):
    from larkspur.plans import everyday

    r = everyday.minima(spark, sf).first()
    assert r["grid"] == r["steepest"] == 1.25


def test_kernel_models_by_blocks(spark, sf, monkeypatch):
    """More rows than the dense form takes give the same models."""
    from larkspur.operators import blocks
    from larkspur.operators import models as M
    from larkspur.operators.kernels import Kernel
    from larkspur.plans.catalogue import vectors

    monkeypatch.setattr(blocks, "ROWS", 100)
    monkeypatch.setattr(blocks, "ATOMS", 130)
    rows = vectors(spark, sf).selectExpr("id", "x", "cast(z as double) y")
    a, b = (M.KernelRidge(Kernel("gaussian", (1.0,)), 1e-6, most=k, dense=k).fit(rows) for k in (10_000, 100))
    assert a.ids == b.ids and np.isclose(a.l2, b.l2) and np.allclose(a.alphas, b.alphas, rtol=1e-5, atol=1e-7)
    mols, labels = systems.mol_rows(spark, sf), systems.mol_labels(spark, sf)
    a, b = (M.LocalKernelRidge(Kernel("gaussian", (1.0,)), 0.1, shift=False, most=k, dense=k).fit_atoms(mols, labels) for k in (10_000, 10))
    assert a.ids == b.ids and np.isclose(a.l2, b.l2) and np.allclose(a.alphas, b.alphas, atol=1e-9)


def test_force_process_by_blocks(spark, sf, monkeypatch):
    """More energies and forces than the dense form takes give the same model; ranges of large molecules and small ones that share a block."""
    from larkspur.operators import blocks

    mols = systems.supplier_molecules(spark, sf)
    targets = systems.force_targets(spark, sf)
    dense = forces.ForceRidge(1.5, 0.1, dense=10_000).fit(mols, targets).alphas
    for rows in (7, 40):
        monkeypatch.setattr(blocks, "ROWS", rows)
        got = forces.ForceRidge(1.5, 0.1, dense=10).fit(mols, targets)
        assert np.allclose(got.alphas, dense, atol=1e-9)
    sizes = [blocks.grouped(s, 4) for s in ([3, 1, 2, 5], [0, 4, 0])]
    assert sizes == [([(0, 0), (0, 3), (1, 0), (2, 0)], [4, 2, 5]), ([(0, 0), (0, 0), (0, 4)], [4])]


def test_local_folds_by_blocks(spark, sf, monkeypatch):
    from larkspur.operators import blocks
    from larkspur.operators import models as M
    from larkspur.operators import ranking
    from larkspur.operators.kernels import Kernel

    monkeypatch.setattr(blocks, "ROWS", 12)
    monkeypatch.setattr(blocks, "ATOMS", 70)
    mols, labels = systems.mol_rows(spark, sf), systems.mol_labels(spark, sf)
    folds = ranking.folds(labels, "id", 2)
    for matched in (True, False):
        a, b = (M.local_fold_objective(mols, labels, Kernel("gaussian", (1.0,)), folds, 0.1, matched, dense=k) for k in (10_000, 10))
        assert np.isclose(a, b, rtol=1e-9)


def _atoms(spark, sizes):
    rng = np.random.default_rng(8)
    rows = [(m, k + 1, int(rng.choice([1, 6, 8])), *(rng.random(3) * 6).tolist()) for m, n in enumerate(sizes) for k in range(n)]
    return rows, spark.createDataFrame(rows, "mol long, atom long, z int, x double, y double, c double")


def test_too_close_of_small_molecules(spark):
    """Small molecules are one cell: the same rows as by cells of the distance."""
    from pyspark.sql import functions as F

    from larkspur.operators import geometry

    rows, atoms = _atoms(spark, [3, 9, 70, 1])
    points = atoms.select("mol", "atom", (F.col("x") + 1.3).alias("x"), "y", "c")
    want = {(m, k) for m, k, _, x, y, c in rows if any(m == o[0] and (x + 1.3 - o[3]) ** 2 + (y - o[4]) ** 2 + (c - o[5]) ** 2 < 1.21 for o in rows)}
    assert 0 < len(want) < len(rows)
    for small in (0, 8, 64, 100):
        got = geometry.too_close(points, atoms, 1.1, small)
        assert got.columns == points.columns and {(r["mol"], r["atom"]) for r in got.collect()} == want


def test_pair_grids(spark):
    """Two-body grids against plain sums, whatever is taken at once; no join and no state of all grid places."""
    from larkspur.operators import geometry

    rows, atoms = _atoms(spark, [3, 9, 9, 40, 1])
    want, wide = {}, {}
    x = 0.1 + np.arange(17) * (7.9 / 16)
    for m, i, zi, *a in rows:
        for o, j, zj, *b in rows:
            r = np.linalg.norm(np.subtract(a, b))
            if m != o or i == j or r >= 8:
                continue
            s2, mu, g = np.log(1 + 0.32 / r**2), np.log(r / np.sqrt(1 + 0.32 / r**2)), np.arange(1, 9.0)
            wide[m, i, zj] = wide.get((m, i, zj), 0) + 0.5 * (np.cos(r * np.pi / 8) + 1) / (np.sqrt(s2 * 2 * np.pi) * g) * np.exp(-((np.log(g) - mu) ** 2) / (2 * s2)) / r**1.8
            if i > j:
                key = (m, min(zi, zj), max(zi, zj))
                want[key] = want.get(key, 0) + zi * zj / x**6 * (0.48 / np.sqrt(2 * np.pi * 0.36)) * np.exp(-((x - r) ** 2) / 0.72)
    for df, all_, first in ((geometry.slatm_two_body(atoms, 8.0, 0.6, 0.48), want, 0), (geometry.fchl_two_body(atoms, 8.0, 8), wide, 1)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(r)[:-1]: r["v"] for r in df.collect()}
        assert got.keys() == {(*k, n + first) for k, v in all_.items() for n in range(len(v))}
        assert all(np.isclose(got[(*k, n + first)], t, rtol=1e-9) for k, v in all_.items() for n, t in enumerate(v))


def test_weighted_medians_by_histograms(spark):
    """No window over the rows of a group; ties, equal values, outliers, an empty key."""
    from larkspur.operators import statistics

    rng = np.random.default_rng(4)
    rows = [(g, float(w), float(w * v)) for g, n in (("a", 400), ("b", 1), ("c", 2), (None, 50)) for w, v in zip(rng.integers(-3, 4, n), rng.choice([1.0, 2.5, 1e9, -7.0, *rng.random(40)], n), strict=True)]
    rows += [("d", 1.0, 4.0), ("d", -1.0, -5.0), ("b", 2.0, 6.0)]
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted((b / a, abs(a)) for k, a, b in rows if k == g and a)
        run = np.cumsum([w for _, w in v])
        if v:
            want[g] = v[int(np.argmax(2 * run >= run[-1]))][0]
    df = spark.createDataFrame(rows, "g string, a double, b double").filter("a <> 0")
    for bins in (2, 1024):
        got = {r["g"]: r["x"] for r in statistics.weighted_median(df, "a", "b", ["g"], bins).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)
    assert want["d"] == 4.0


def test_block_sums_stay_with_their_vectors(spark, sf):
    """Sums of blocks are those of the vectors, and no vector leaves the task that makes it."""
    from larkspur.operators import representations as R
    from larkspur.plans import everyday
    from larkspur.plans.catalogue import atoms

    mols, f = R.molecules(atoms(spark, sf).filter("mol < 300")), everyday._fchl
    blocks = [((z,), 24) for z in (1, 6, 8)] + [(p, 40) for p in ((1, 1), (1, 6), (1, 8), (6, 6), (6, 8), (8, 8))]
    got = {(r["mol"], r["atom"], r["z1"], r["z2"]): (r["total"], r["placed"]) for most in (1, 1 << 15) for r in R.block_sums(mols, f, True, blocks, most).collect()}
    want = {}
    for r in R.represented_many(mols, f, True).collect():
        at = 0
        for t, n in blocks:
            v, at = np.array(r["x"][at : at + n]), at + n
            if v.any():
                want[(r["mol"], r["atom"], *(*t, 0)[:2])] = v.sum(), v @ np.arange(1, n + 1)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)
    for q in (everyday.fchl19_blocks, everyday.slatm_blocks, everyday.slatm_local_blocks):
        assert "lambdafunction" not in q(spark, sf)._jdf.queryExecution().analyzed().toString()  # before: lambdas over vectors of some hundred numbers for each row


def test_tiles_of_one_table_meet_once(spark):
    """Kernels of a table with itself, and largest distances: half the blocks, the same rows; ids may repeat and lie in any order."""
    from larkspur.operators import kernels as K
    from larkspur.operators import orbitals

    rng = np.random.default_rng(4)
    rows = [(int(i), int(z), x.tolist()) for i, z, x in zip(rng.integers(0, 40, 150), rng.integers(0, 2, 150), rng.normal(size=(150, 6)), strict=True)]
    df = spark.createDataFrame(rows, "mol long, z int, x array<double>").repartition(3)
    other = df.select("*")
    kernel, key = K.Kernel("laplacian", (2.0, 3.0)), lambda d: {(r["i"], r["j"], r["sigma"]): r["k"] for r in d.collect()}
    for z in (None, "z"):
        for lower in (False, True):
            one = K.local_kernel_matrix(df, None, kernel, z=z, lower=lower, tile=16)
            got, want = key(one), key(K.local_kernel_matrix(df, other, kernel, z=z, lower=lower, tile=16))
            assert one.count() == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
            assert "a_last" in one._jdf.queryExecution().optimizedPlan().toString()  # before: every block twice
    o = df.selectExpr("mol", "z as orb", "0.5 as orb_rho", "cast(x[0] * 1e6 as long) as arep", "1.0 as rho", "x as v")
    got, want = ({(r["i"], r["j"]): r["k"] for r in orbitals.orbital_kernel(o, b, [1.0] * 6, 0.7).collect()} for b in (o, o.select("*")))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    x = np.array([r[2] for r in rows])
    for metric, d in (("l1", np.abs(x[:, None] - x).sum(axis=2)), ("l2", np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)))):
        assert abs(K.max_pair_distance(df, metric, "mol", tile=16).first()[0] - d.max()) < 1e-9


def test_largest_distance_by_bounds(monkeypatch):
    """Pairs whose bound is below the best distance are not summed up."""
    from larkspur.operators import kernels as K

    rng = np.random.default_rng(5)
    for scale in (1e-150, 1e-3, 1.0, 1e8):
        for shift in (0.0, 1e3):
            a, b = (scale * (rng.normal(size=(n, 7)) + shift) for n in (60, 80))
            d = K.l1_block(a, b)
            for best in (0.0, 0.9 * d.max(), 2 * d.max()):
                assert abs(K._largest_l1(a, b, best, 50) - max(best, d.max())) <= 1e-12 * d.max()
    monkeypatch.setattr(K, "l1_block", None)  # before: every pair by all components
    assert K._largest_l1(np.zeros((2, 3)), np.ones((2, 3)), 0.0) == 3.0
    monkeypatch.undo()
    a[3, 2] = np.nan
    assert np.isnan(K._largest_l1(a, b, 5.0))


def test_property_files_are_read_once(spark, sf):
    """Words and properties of a file come from one reading, the same as by one query each."""
    from larkspur.plans import everyday
    from larkspur.sources import catalogues

    f = everyday._files(spark, sf)
    names = {"dipole": "Dipole moment", "frequency": catalogues.HIGHEST_FREQUENCY}
    got = {r["name"]: (r["smiles"], r["inchi"], r["dipole"], r["frequency"]) for r in catalogues.qm9_row(f, names).collect()}
    want = {r["name"]: [r["smiles"], r["inchi"]] for r in catalogues.identifiers(f).collect()}
    for n in names.values():
        for r in catalogues.qm9_property(f, n).collect():
            want[r["name"]].append(r["value"])
    assert got == {k: tuple(v) for k, v in want.items()}
    plan = everyday.property_files(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # atoms with orders; before: also the files with themselves, for each property


def test_entries_are_those_of_vectors(spark, sf):
    """Entries without zeros, unpadded, are those of the padded vectors."""
    from larkspur.operators import geometry
    from larkspur.plans import catalogue, everyday

    a = catalogue.atoms(spark, sf).filter("mol < 400").cache()
    sizes = {r["z"]: r["bag"] for r in geometry.bags(a).orderBy("z").collect()}
    for entries, whole in ((geometry.coulomb_entries(a, 32), geometry.coulomb_matrix(a, 32)), (geometry.bag_entries(a, sizes), geometry.bag_of_bonds(a, sizes))):
        got = {(r["mol"], r["pos"]): r["v"] for r in entries.collect()}
        want = {(r["mol"], k): v for r in whole.collect() for k, v in enumerate(r["x"]) if v}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for q in (catalogue.coulomb_matrix, everyday.bob_positions, everyday.cmbdf_slopes):
        assert "Generate" not in q(spark, sf)._jdf.queryExecution().optimizedPlan().toString()  # before: padded vectors went to the JVM to be taken apart


def test_orbital_kernel_is_gathered_by_batches(spark, monkeypatch):
    """The driver reads batches of the kernel, not a row for each pair of molecules."""
    from larkspur.operators import orbitals

    read, rng = [], np.random.default_rng(6)
    monkeypatch.setattr(orbitals, "written", lambda df, name: read.append(df.count()) or df)
    rows = spark.createDataFrame([(m, o, 0.5, a, 1.0, rng.normal(size=3).tolist()) for m in range(30) for o in range(2) for a in range(2)], "mol long, orb long, orb_rho double, arep long, rho double, v array<double>")
    labels = rows.selectExpr("mol", "mol % 7 * 1.0 as y").distinct()
    got = orbitals.OrbitalRidge([1.0] * 3, 0.7, 1e-9).fit(rows, labels).predict(rows).collect()
    assert all(abs(r["prediction"] - r["mol"] % 7) < 1e-4 for r in got) and len(got) == 30
    assert read and read[0] < 30  # before: 900


def test_self_consistent_losses_gather_no_group(spark):
    """Losses of all groups by aggregations, the same as by bisection; zeros, nulls, outliers, equal and single errors, groups without errors."""
    import math

    from larkspur.operators import statistics

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=300), "zeros": np.zeros(4), "one": [-3.0], "equal": [2.0] * 5, "far": [1e9, *[1e-3] * 200], "mixed": [0.0] * 50 + [7.0], "none": []}
    rows = [(g, float(e)) for g, v in groups.items() for e in v] + [("a", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, err double")
    terms = {"logcosh": lambda e, d: (abs(e) * math.log(2) / d + np.log1p(np.exp(-2 * abs(e) * math.log(2) / d)) - math.log(2)) * d / math.log(2), "huber": lambda e, d: np.where(abs(e) < 2 * d, e * e / (4 * d), abs(e) - d)}
    for kind, c in (("logcosh", 0.25), ("logcosh", 20.0), ("huber", 0.25), ("huber", 5.0)):
        out = statistics.self_consistent_by(df, "err", c, ["g"], kind)
        got = {r["g"]: r["loss"] for r in out.collect()}
        assert got.keys() == set(groups) - {"none"} and got["zeros"] == 0 and out.columns == ["g", "loss"]
        for g in got.keys() - {"zeros"}:
            v = np.array(groups[g])
            assert abs(terms[kind](v, c * got[g]).mean() - got[g]) < 1e-11 * np.abs(v).mean() and got[g] > 0
        assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()  # before: a row for each group, with all its errors


def test_slatm_sums_make_no_vectors(monkeypatch):
    """Sums of SLATM's blocks are those of its vectors; pairs and triples are summed over the grid before they are added up."""
    from larkspur.operators import representations as R

    rng = np.random.default_rng(8)
    types = [(1,), (6,), (8,), *[(a, b) for a in (1, 6, 8) for b in (1, 6, 8) if a <= b], *[(a, m, b) for a in (1, 6, 8) for m in (1, 6) for b in (1, 6, 8) if a <= b]]
    widths, n2, n3 = [], *map(len, R.slatm_grids(6.0, (0.3, 0.2)))
    added = R.added_up
    for n in (1, 2, 5):
        z, r = rng.choice([1, 6, 8], (7, n)), rng.normal(size=(7, n, 3)) * 3
        for local in (False, True):
            x = R.slatm_many(z, r, types, local, (0.2, 0.3), (0.3, 0.2), 6.0)
            want, at = [], 0
            for k in (len(t) for t in types):
                v, at = x[..., at : at + {1: 1, 2: n2, 3: n3}[k]], at + {1: 1, 2: n2, 3: n3}[k]
                want += [v.sum(axis=-1), v @ np.arange(1, v.shape[-1] + 1)]
            monkeypatch.setattr(R, "added_up", lambda v, *a: widths.append(v.shape[1]) or added(v, *a))
            assert np.allclose(R.slatm_many(z, r, types, local, (0.2, 0.3), (0.3, 0.2), 6.0, sums=True), np.stack(want, axis=-1), rtol=1e-11)
            monkeypatch.undo()
    assert set(widths) == {2}
