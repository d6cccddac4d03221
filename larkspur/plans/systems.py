"""Queries that solve systems, fit models and differentiate, with SQL for the same rows.

Small systems are solved in SQL by Gauss-Jordan elimination over one row that holds the matrix as a list of lists; every step is a row of a recursive query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import forces, kernels, large_kernels, levels, orbitals, selection, solvers, statistics, tall
from ..operators import models as M
from ..operators.features import Signs
from ..operators.kernels import Kernel
from .catalogue import ATOMS, BIAS, H, L2, SIGN, SQL, VECTORS, atoms, query, r6, table, vectors


def eliminated(name: str, source: str, size: str = "len(a)") -> str:
    """Recursive CTE ``name`` (k, a, ld): rows ``a`` of ``source`` reduced to the identity on their first columns; ld is the logarithm of the determinant."""
    step = """list_transform(a, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / a[k + 1][k + 1])
    ELSE list_transform(list_zip(row, a[k + 1]), lambda t: t[1] - row[k + 1] / a[k + 1][k + 1] * t[2]) END)"""
    return f"""{name} AS (SELECT 0 AS k, a, 0.0::DOUBLE AS ld FROM {source} UNION ALL SELECT k + 1, {step}, ld + ln(a[k + 1][k + 1]) FROM {name} WHERE k < {size}),
{name}_x AS (SELECT a, ld FROM {name} ORDER BY k DESC LIMIT 1)"""


def table_of(rows: list[tuple], spark, ddl: str):
    return spark.createDataFrame(rows, ddl)


# Ten vectors: the mean of the embeddings of each label, and what is learned from them.

MEANS = f"""{VECTORS}, u AS (SELECT z, unnest(x) AS e, unnest(range(64)) AS p FROM v), mu AS (SELECT z, p, avg(e) AS e FROM u GROUP BY z, p),
t AS (SELECT z::BIGINT AS id, list(e ORDER BY p) AS x FROM mu GROUP BY z), y AS (SELECT z::BIGINT AS id, avg(id % 97)::DOUBLE AS y FROM v GROUP BY z)"""


def means(s, d):
    v = vectors(s, d)
    n = v.groupBy("z").agg(F.count("*").alias("n"), F.avg((F.col("id") % 97).cast("double")).alias("y"))
    x = statistics.vector_sum(v, ["z"], "x").join(n, "z")
    return x.select(F.col("z").cast("long").alias("id"), F.transform("x", lambda e: e / F.col("n")).alias("x"), "y")


SIGMA = 0.4


def gauss(sigma: float, l: str = "l", r: str = "r") -> str:
    return f"exp(-{L2} / (2.0 * {sigma} * {sigma}))".replace("l.x", f"{l}.x").replace("r.x", f"{r}.x")


def kernel_system(right: str, l2: str, sigma: float = SIGMA) -> str:
    """CTEs kk (i, j, k) and sys (a): rows of K + l2, then the right-hand side(s)."""
    return f"""kk AS (SELECT l.id AS i, r.id AS j, {gauss(sigma)} AS k FROM t l CROSS JOIN t r),
rows AS (SELECT i, list(k + CASE WHEN i = j THEN {l2} ELSE 0 END ORDER BY j) AS row FROM kk GROUP BY i),
sys AS (SELECT list(list_concat(row, {right}) ORDER BY i) AS a FROM rows JOIN y ON y.id = i CROSS JOIN (SELECT avg(y) AS my, count(*) AS n FROM y) m)"""


RANKED = "SELECT id, y, row_number() OVER (ORDER BY id) AS n FROM y"


@query(
    "krr_fit_predict",
    f"""WITH RECURSIVE {MEANS}, {kernel_system('[y - my]', '0.01')}, {eliminated('e', 'sys')},
al AS (SELECT unnest(list_transform(a, lambda row: row[-1])) AS alpha, unnest(range(1, len(a) + 1)) AS n FROM e_x), tr AS (SELECT t.*, row_number() OVER (ORDER BY id) AS n FROM t)
SELECT l.id, round(sum({gauss(SIGMA)} * alpha) + (SELECT avg(y) FROM y), 6) AS prediction FROM v l CROSS JOIN tr r JOIN al ON al.n = r.n GROUP BY l.id""",
)
def krr_fit_predict(s, d):
    model = M.KernelRidge(Kernel("gaussian", (SIGMA,)), 0.01).fit(means(s, d))
    return model.predict(vectors(s, d)).select("id", r6("prediction").alias("prediction"))


_SOLVED = f"""WITH RECURSIVE {MEANS}, {kernel_system('[y]', '0.01')}, {eliminated('e', 'sys')}, ids AS ({RANKED}),
al AS (SELECT unnest(list_transform(a, lambda row: row[-1])) AS alpha, unnest(range(1, len(a) + 1)) AS n FROM e_x)"""


@query("solvers_agree", f"{_SOLVED} SELECT s.solver, ids.id, round(alpha, 6) AS alpha FROM al JOIN ids ON al.n = ids.n CROSS JOIN (SELECT unnest(['cholesky', 'eig', 'lstsq', 'lu', 'svd']) AS solver) s")
def solvers_agree(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows])
    k = kernels.dense(m, Kernel("gaussian", (SIGMA,)), ids)[0]
    got = {n: f(k, y, 0.01) for n, f in solvers.SOLVERS.items()}
    full = k + 0.01 * np.eye(len(k))
    got |= {"svd": solvers.svd_solve(full, y), "lstsq": solvers.lstsq_solve(full, y)}
    return table_of([(n, i, float(v)) for n, x in got.items() for i, v in zip(ids, x, strict=True)], s, "solver string, id long, alpha double").select("solver", "id", r6("alpha").alias("alpha"))


@query(
    "masked_solutions",
    f"""WITH RECURSIVE {MEANS}, kk AS (SELECT l.id AS i, r.id AS j, {gauss(SIGMA)} AS k FROM t l CROSS JOIN t r),
rows AS (SELECT i, list(k + CASE WHEN i = j THEN 0.01 ELSE 0 END ORDER BY j) AS row FROM kk WHERE i % 3 <> 0 AND j % 3 <> 0 GROUP BY i),
sys AS (SELECT list(list_concat(row, [y]) ORDER BY i) AS a FROM rows JOIN y ON y.id = i), {eliminated('e', 'sys')},
rows2 AS (SELECT i, list(k + CASE WHEN i = j THEN 0.01 ELSE 0 END ORDER BY j) AS row FROM kk GROUP BY i),
sys2 AS (SELECT list(list_concat(row, [y * 2.0, y + 1.0]) ORDER BY i) AS a FROM rows2 JOIN y ON y.id = i), {eliminated('g', 'sys2')},
p AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM y WHERE id % 3 <> 0), q AS ({RANKED}),
o AS (SELECT 0 AS target, p.id, a[p.n][-1] AS alpha FROM p, e_x UNION ALL SELECT 0, id, 0.0 FROM y WHERE id % 3 = 0
  UNION ALL SELECT 1, q.id, a[q.n][-2] FROM q, g_x UNION ALL SELECT 2, q.id, a[q.n][-1] FROM q, g_x)
SELECT target, id, round(alpha, 6) + 0.0 AS alpha FROM o""",
)
def masked_solutions(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = np.array([r["id"] for r in rows]), np.array([r["y"] for r in rows])
    k = kernels.dense(m, Kernel("gaussian", (SIGMA,)), ids.tolist())[0]
    targets, known = np.stack((y, 2 * y, y + 1), axis=1), np.ones((len(y), 3), bool)
    known[:, 0] = ids % 3 != 0
    out = solvers.masked_solutions(k, targets, known, 0.01)
    return table_of([(t, int(i), float(out[n, t])) for t in range(3) for n, i in enumerate(ids)], s, "target int, id long, alpha double").select("target", "id", (r6("alpha") + 0.0).alias("alpha"))


_INVERSE = f"""WITH RECURSIVE {MEANS}, kk AS (SELECT l.id AS i, r.id AS j, {gauss(SIGMA)} AS k FROM t l CROSS JOIN t r), ids AS ({RANKED}),
rows AS (SELECT i, list(k + CASE WHEN i = j THEN 0.01 ELSE 0 END ORDER BY j) AS row FROM kk GROUP BY i),
sys AS (SELECT list(list_concat(list_concat(row, list_transform(range(1, (SELECT count(*) FROM y) + 1), lambda c: CASE WHEN c = ids.n THEN 1.0 ELSE 0.0 END)), [y]) ORDER BY i) AS a FROM rows JOIN ids ON ids.id = i), {eliminated('e', 'sys')},
inv AS (SELECT ids.id, ids.y, ids.n, a[ids.n][len(a) + ids.n] AS d, a[ids.n][-1] AS alpha, ld, len(a) AS m FROM ids, e_x)"""


@query("krr_loo_errors", f"{_INVERSE} SELECT id, round(-alpha / d, 6) AS err FROM inv")
def krr_loo_errors(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows])
    e = solvers.kernel_loo_errors(kernels.dense(m, Kernel("gaussian", (SIGMA,)), ids)[0], y, 0.01)
    return table_of([(i, float(v)) for i, v in zip(ids, e, strict=True)], s, "id long, err double").select("id", r6("err").alias("err"))


@query("krr_loo_loss", f"{_INVERSE} SELECT round(avg(abs(alpha / d)), 6) AS mae, round(sqrt(avg(alpha / d * alpha / d)), 6) AS rmse FROM inv")
def krr_loo_loss(s, d):
    e = krr_loo_errors(s, d)
    model = M.KernelRidge(Kernel("gaussian", (SIGMA,)), 0.01, shift=False)
    v = model.loo_errors(means(s, d))
    return table_of([(float(np.abs(v).mean()), float(np.sqrt((v * v).mean())))], e.sparkSession, "mae double, rmse double").select(r6("mae").alias("mae"), r6("rmse").alias("rmse"))


@query("gpr_log_likelihood", f"{_INVERSE} SELECT round(-0.5 * sum(y * alpha) - 0.5 * any_value(ld) - 0.5 * count(*) * ln(2 * pi()), 6) AS likelihood FROM inv")
def gpr_log_likelihood(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows])
    k = kernels.dense(m, Kernel("gaussian", (SIGMA,)), ids)[0] + 0.01 * np.eye(len(ids))
    return table_of([(solvers.log_marginal_likelihood(k, y),)], s, "likelihood double").select(r6("likelihood").alias("likelihood"))


@query(
    "mae_by_lambda",
    f"""WITH RECURSIVE {MEANS}, ev AS (SELECT id, x, row_number() OVER (ORDER BY id) AS n FROM t WHERE id % 2 = 0), od AS (SELECT id, x FROM t WHERE id % 2 = 1), ya AS (SELECT id, y FROM y),
rows AS (SELECT l.n AS i, list({gauss(0.4)} + CASE WHEN l.n = r.n THEN 0.05 ELSE 0 END ORDER BY r.n) AS row, l.id FROM ev l CROSS JOIN ev r GROUP BY l.n, l.id),
sys AS (SELECT list(list_concat(row, [y]) ORDER BY i) AS a FROM rows JOIN ya USING (id)), {eliminated('e', 'sys')},
sys2 AS (SELECT list(list_concat(rows.row, [e_x.a[rows.i][-1]]) ORDER BY rows.i) AS a FROM rows, e_x), {eliminated('g', 'sys2')},
p AS (SELECT l.id, sum({gauss(0.4)} * e_x.a[r.n][-1]) AS f, -sum({gauss(0.4)} * g_x.a[r.n][-1]) AS df FROM od l CROSS JOIN ev r, e_x, g_x GROUP BY l.id)
SELECT round(avg(abs(f - y)), 6) AS mae, round(avg(sign(f - y) * df), 6) AS derivative FROM p JOIN ya USING (id)""",
)
def mae_by_lambda(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = np.array([r["id"] for r in rows]), np.array([r["y"] for r in rows])
    k = kernels.dense(m, Kernel("gaussian", (0.4,)), ids.tolist())[0]
    a, b = np.flatnonzero(ids % 2 == 0), np.flatnonzero(ids % 2 == 1)
    v = selection.mae_by_lambda(k[np.ix_(a, a)], y[a], k[np.ix_(a, b)], y[b], 0.05)
    return table_of([tuple(map(float, v))], s, "mae double, derivative double").select(r6("mae").alias("mae"), r6("derivative").alias("derivative"))


@query(
    "fold_objective",
    f"""WITH RECURSIVE {MEANS}, ev AS (SELECT id, x, row_number() OVER (ORDER BY id) AS n FROM t WHERE id % 2 = 0), od AS (SELECT id, x FROM t WHERE id % 2 = 1),
rows AS (SELECT l.n AS i, list({gauss(0.4)} + CASE WHEN l.n = r.n THEN 0.01 ELSE 0 END ORDER BY r.n) AS row, l.id FROM ev l CROSS JOIN ev r GROUP BY l.n, l.id),
sys AS (SELECT list(list_concat(row, [y]) ORDER BY i) AS a FROM rows JOIN y USING (id)), {eliminated('e', 'sys')},
p AS (SELECT l.id, sum({gauss(0.4)} * e_x.a[r.n][-1]) AS f FROM od l CROSS JOIN ev r, e_x GROUP BY l.id) SELECT round(-1 / avg(abs(f - y)), 6) AS objective FROM p JOIN y USING (id)""",
)
def fold_objective(s, d):
    m = means(s, d)
    rows = m.select("id", "y").orderBy("id").collect()  # one for each label
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows])
    folds = m.select("id", F.lit(0).alias("fold"), (F.col("id") % 2 == 0).alias("train"))
    v = M.fold_objective(kernels.dense(m, Kernel("gaussian", (0.4,)), ids)[0], y, ids, folds, "id", 0.01)
    return table_of([(v,)], s, "objective double").select(r6("objective").alias("objective"))


# Molecules of ten embeddings each: local models.

MOLS = f"{VECTORS}, t AS (SELECT mol AS id, z, x FROM v), y AS (SELECT mol AS id, sum(z * z + id % 7)::DOUBLE AS y FROM v GROUP BY mol)"


def mol_rows(s, d):
    return vectors(s, d).select(F.col("mol").alias("id"), "z", "x")


def mol_labels(s, d):
    return vectors(s, d).groupBy(F.col("mol").alias("id")).agg(F.sum((F.col("z") * F.col("z") + F.col("id") % 7).cast("double")).alias("y"))


@query(
    "local_ridge",
    f"""WITH RECURSIVE {MOLS}, kk AS (SELECT l.id AS i, r.id AS j, sum(CASE WHEN l.z = r.z THEN {gauss(1.0)} ELSE 0 END) AS k FROM t l CROSS JOIN t r GROUP BY l.id, r.id),
dg AS (SELECT 0.1 * avg(k) AS l2 FROM kk WHERE i = j), rows AS (SELECT i, list(k + CASE WHEN i = j THEN l2 ELSE 0 END ORDER BY j) AS row FROM kk CROSS JOIN dg GROUP BY i),
sys AS (SELECT list(list_concat(row, [y]) ORDER BY i) AS a FROM rows JOIN y ON y.id = i), {eliminated('e', 'sys')}, ids AS ({RANKED})
SELECT kk.i AS id, round(sum(k * a[ids.n][-1]), 5) AS prediction FROM kk JOIN ids ON kk.j = ids.id, e_x GROUP BY kk.i""",
)
def local_ridge(s, d):
    model = M.LocalKernelRidge(Kernel("gaussian", (1.0,)), 0.1, shift=False).fit_atoms(mol_rows(s, d), mol_labels(s, d))
    return model.predict_atoms(mol_rows(s, d)).select("id", r6("prediction", 5).alias("prediction"))


@query(
    "local_fold_objective",
    f"""WITH RECURSIVE {MOLS}, kk AS (SELECT l.id AS i, r.id AS j, sum(CASE WHEN l.z = r.z THEN {gauss(1.0)} ELSE 0 END) AS k FROM t l CROSS JOIN t r GROUP BY l.id, r.id),
dg AS (SELECT 0.1 * avg(k) AS l2 FROM kk WHERE i = j), rows AS (SELECT i, list(k + CASE WHEN i = j THEN l2 ELSE 0 END ORDER BY j) AS row FROM kk CROSS JOIN dg WHERE i % 2 = 0 AND j % 2 = 0 GROUP BY i),
sys AS (SELECT list(list_concat(row, [y]) ORDER BY i) AS a FROM rows JOIN y ON y.id = i), {eliminated('e', 'sys')}, ids AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM y WHERE id % 2 = 0),
p AS (SELECT kk.i AS id, sum(k * a[ids.n][-1]) AS f FROM kk JOIN ids ON kk.j = ids.id, e_x WHERE kk.i % 2 = 1 GROUP BY kk.i) SELECT round(-1 / avg(abs(f - y)), 6) AS objective FROM p JOIN y USING (id)""",
)
def local_fold_objective(s, d):
    folds = mol_labels(s, d).select("id", F.lit(0).alias("fold"), (F.col("id") % 2 == 0).alias("train"))
    v = M.local_fold_objective(mol_rows(s, d), mol_labels(s, d), Kernel("gaussian", (1.0,)), folds, 0.1)
    return table_of([(v,)], s, "objective double").select(r6("objective").alias("objective"))


# Random features of one block: 64 cosines of signed Hadamard sums.

FEATURES = f"""j AS (SELECT unnest(range(64)) AS j), u AS (SELECT id, z, unnest(x) AS e, unnest(range(64)) AS i FROM v),
f AS (SELECT u.id, j.j, cos(sum(e / 1.0 * {SIGN.format(sp=0)} * {H}) + {BIAS.format(sp=0)}) * sqrt(2.0 / 64) AS f FROM u CROSS JOIN j GROUP BY u.id, j.j), fv AS (SELECT id, list(f ORDER BY j) AS f FROM f GROUP BY id)"""
_Y = "ys AS (SELECT id, z::DOUBLE AS y, avg(z) OVER () AS my FROM v)"
_NORMAL = f"""{FEATURES}, {_Y}, g AS (SELECT l.j AS a, r.j AS b, sum(l.f * r.f) AS g FROM f l JOIN f r ON l.id = r.id GROUP BY l.j, r.j), lam AS (SELECT 0.01 * sum(g) / least(64, (SELECT count(*) FROM v)) AS l2 FROM g WHERE a = b),
rr AS (SELECT j AS a, sum(f * (y - my)) AS r FROM f JOIN ys USING (id) GROUP BY j),
rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a)"""
_UNIT64 = "list_transform(range(64), lambda c: CASE WHEN c = rows.a THEN 1.0 ELSE 0.0 END)"


def feature_model(s, d, ratio: float = 0.01):
    rows = vectors(s, d).withColumn("y", F.col("z").cast("double"))
    return rows, M.FeatureRidge(Signs.by_rule(1, 1, 64), 1.0, ratio).fit(rows)


@query(
    "sorf_ridge",
    f"""WITH RECURSIVE {VECTORS}, {_NORMAL}, sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')},
al AS (SELECT list_transform(a, lambda row: row[-1]) AS al FROM e_x) SELECT ys.id, round(list_dot_product(fv.f, al) + my, 6) AS prediction FROM fv JOIN ys USING (id), al""",
)
def sorf_ridge(s, d):
    rows, model = feature_model(s, d)
    return model.predict(rows).select("id", r6("prediction").alias("prediction"))


_LOO64 = f"""WITH RECURSIVE {VECTORS}, {_NORMAL}, sys AS (SELECT list(list_concat(list_concat(row, {_UNIT64}), [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')},
m AS (SELECT list_transform(a, lambda row: row[65:128]) AS inv, list_transform(a, lambda row: row[129]) AS al FROM e_x),
q AS (SELECT ys.id, y - my AS y, list_dot_product(fv.f, al) AS p, list_dot_product(fv.f, list_transform(inv, lambda row: list_dot_product(row, fv.f))) AS h FROM fv JOIN ys USING (id), m)"""


@query("sorf_loo", f"{_LOO64} SELECT id, round(h, 6) AS leverage, round((p - y) / (1 - h), 6) AS err FROM q")
def sorf_loo(s, d):
    rows, model = feature_model(s, d)
    return model.loo(rows, ["id"]).select("id", r6("leverage").alias("leverage"), r6("err").alias("err"))


@query("training_plane_distances", f"{_LOO64} SELECT id, round(greatest(0, l2 * h), 6) AS d2 FROM q CROSS JOIN lam")
def plane_distances(s, d):
    rows, model = feature_model(s, d)
    return model.plane_distances(rows, ["id"]).select("id", r6("d2").alias("d2"))


@query("uncertainty_ratios", f"{_LOO64} SELECT id, round(abs((p - y) / (1 - h)) / (l2 * h), 4) AS ratio, round(ln(abs((p - y) / (1 - h)) / (l2 * h)), 4) AS log_ratio FROM q CROSS JOIN lam")
def uncertainty_ratios(s, d):
    rows, model = feature_model(s, d)
    e = model.loo(rows, ["id"]).select("id", "err").join(model.plane_distances(rows, ["id"]), "id")
    plain, logs = M.uncertainty_targets(e), M.uncertainty_targets(e, True)
    return plain.select("id", r6("y", 4).alias("ratio")).join(logs.select("id", r6("y", 4).alias("log_ratio")), "id")


@query(
    "uncertainty",
    f"""{_LOO64}, t AS (SELECT id, abs((p - y) / (1 - h)) / (l2 * h) AS y2, l2 * h AS d2 FROM q CROSS JOIN lam), my2 AS (SELECT avg(y2) AS my2 FROM t),
r2 AS (SELECT list(r ORDER BY j) AS r FROM (SELECT j, sum(f * (y2 - my2)) AS r FROM f JOIN t USING (id), my2 GROUP BY j)), al2 AS (SELECT list_transform(inv, lambda row: list_dot_product(row, r)) AS al2 FROM m, r2)
SELECT t.id, round(abs(list_dot_product(fv.f, al2) + my2) * d2, 6) AS uncertainty FROM fv JOIN t USING (id), al2, my2""",
)
def uncertainty(s, d):
    """What a second model says of the first one's errors, beside each prediction."""
    rows, model = feature_model(s, d)
    return M.Uncertainty(model, M.FeatureRidge(Signs.by_rule(1, 1, 64), 1.0, 0.01)).fit(rows).predict(rows).select("id", r6("uncertainty").alias("uncertainty"))


@query(
    "local_sorf_ridge",
    f"""WITH RECURSIVE {VECTORS}, j AS (SELECT unnest(range(64)) AS j), u AS (SELECT id, mol, z, unnest(x) AS e, unnest(range(64)) AS i FROM v),
fa AS (SELECT u.id, u.mol, j.j, cos(sum(e / 2.0 * {SIGN.format(sp='u.z')} * {H}) + {BIAS.format(sp='any_value(u.z)')}) * sqrt(2.0 / 64) AS f FROM u CROSS JOIN j GROUP BY u.id, u.mol, j.j),
f AS (SELECT mol AS id, j, sum(f) AS f FROM fa GROUP BY mol, j), fv AS (SELECT id, list(f ORDER BY j) AS f FROM f GROUP BY id), y AS (SELECT mol AS id, sum(z * z + id % 7)::DOUBLE AS y FROM v GROUP BY mol),
g AS (SELECT l.j AS a, r.j AS b, sum(l.f * r.f) AS g FROM f l JOIN f r ON l.id = r.id GROUP BY l.j, r.j), lam AS (SELECT 0.01 * sum(g) / least(64, (SELECT count(*) FROM y)) AS l2 FROM g WHERE a = b),
rr AS (SELECT j AS a, sum(f * y) AS r FROM f JOIN y USING (id) GROUP BY j), rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a),
sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')}, al AS (SELECT list_transform(a, lambda row: row[-1]) AS al FROM e_x)
SELECT id, round(list_dot_product(f, al), 5) AS prediction FROM fv, al""",
)
def local_sorf_ridge(s, d):
    params = {e: Signs.by_rule(1, 1, 64, e) for e in range(10)}
    model = M.LocalFeatureRidge(params[0], 2.0, 0.01, shift=False, elements=params).fit_atoms(mol_rows(s, d), mol_labels(s, d))
    return model.predict_atoms(mol_rows(s, d)).select("id", r6("prediction", 5).alias("prediction"))


_LEVELS = f"""{VECTORS}, j AS (SELECT unnest(range(64)) AS j), u AS (SELECT id, mol, z, unnest(x) AS e, unnest(range(64)) AS i FROM v),
fa AS (SELECT u.id, u.mol, j.j, cos(sum(e / 2.0 * {SIGN.format(sp='u.z')} * {H}) + {BIAS.format(sp='any_value(u.z)')}) * sqrt(2.0 / 64) AS f FROM u CROSS JOIN j GROUP BY u.id, u.mol, j.j),
s1 AS (SELECT mol, j, sum(f) AS f FROM fa GROUP BY mol, j), nn AS (SELECT mol, sqrt(sum(f * f)) AS n FROM s1 GROUP BY mol), w AS (SELECT s1.mol AS id, j AS i, f / n AS e FROM s1 JOIN nn USING (mol)),
f AS (SELECT u.id, j.j, cos(sum(e / 0.5 * {SIGN.format(sp=0)} * {H}) + {BIAS.format(sp=0)}) * sqrt(2.0 / 64) AS f FROM w u CROSS JOIN j GROUP BY u.id, j.j), fv AS (SELECT id, list(f ORDER BY j) AS f FROM f GROUP BY id),
y AS (SELECT mol AS id, sum(z * z + id % 7)::DOUBLE AS y FROM v GROUP BY mol), my AS (SELECT avg(y) AS my, count(*) AS n FROM y),
g AS (SELECT l.j AS a, r.j AS b, sum(l.f * r.f) AS g FROM f l JOIN f r ON l.id = r.id GROUP BY l.j, r.j), lam AS (SELECT 0.01 * sum(g) / least(64, (SELECT n FROM my)) AS l2 FROM g WHERE a = b),
rr AS (SELECT j AS a, sum(f * (y - my)) AS r FROM f JOIN y USING (id) CROSS JOIN my GROUP BY j), rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a),
sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')}, al AS (SELECT list_transform(a, lambda row: row[-1]) AS al FROM e_x)"""


def multilevel(s, d):
    atoms_level = levels.FeatureLevel({e: Signs.by_rule(1, 1, 64, e) for e in range(10)}, 2.0)
    top = levels.FeatureLevel({0: Signs.by_rule(1, 1, 64)}, 0.5)
    steps = levels.Pipeline([("map", atoms_level, "z"), ("sum", ["mol"]), ("column", levels.normalise()), ("map", top)])
    labels = mol_labels(s, d).withColumnRenamed("id", "mol")
    return levels.MultilevelModel(steps, "mol", 0.01), vectors(s, d).select("mol", "z", "x"), labels


@query("multilevel_fit_predict", f"WITH RECURSIVE {_LEVELS} SELECT id AS mol, round(list_dot_product(f, al) + my, 5) AS prediction FROM fv, al, my")
def multilevel_fit(s, d):
    model, objects, labels = multilevel(s, d)
    return model.fit(objects, labels).predict(objects).select("mol", r6("prediction", 5).alias("prediction"))


@query("multilevel_refit", f"WITH RECURSIVE {_LEVELS} SELECT id AS mol, round(list_dot_product(f, al) + my, 5) AS prediction FROM fv, al, my")
def multilevel_refit(s, d):
    model, objects, labels = multilevel(s, d)
    early = F.col("mol") % 3 == 0
    model.fit(objects.filter(early), labels.filter(early)).refit(objects.filter(~early), labels.filter(~early))
    return model.predict(objects).select("mol", r6("prediction", 5).alias("prediction"))


@query("multilevel_features", f"WITH RECURSIVE {_LEVELS} SELECT id AS mol, j::INTEGER AS pos, round(f, 6) AS v FROM f")
def multilevel_features(s, d):
    model, objects, _ = multilevel(s, d)
    return model.features(objects).select("mol", F.posexplode("x").alias("pos", "v")).select("mol", "pos", r6("v").alias("v"))


@query("multilevel_mean_diagonal", f"WITH RECURSIVE {_LEVELS} SELECT round(sum(f * f) / count(DISTINCT id), 6) AS mean FROM f")
def multilevel_mean_diagonal(s, d):
    from ..functions import vector as V

    model, objects, _ = multilevel(s, d)
    return model.features(objects).agg(r6(F.avg(V.norm_sq(F.col("x")))).alias("mean"))


# Leave-one-out on a feature that a hyperparameter moves, and shifts.


@query(
    "loo_feature_derivative",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS z, l_quantity * l_discount AS dz, l_extendedprice AS y FROM lineitem),
s AS (SELECT sum(z * z) + 10.0 AS a, sum(z * y) AS r, 2 * sum(z * dz) AS da, sum(dz * y) AS dr FROM r),
e AS (SELECT l_orderkey, (z * r / a - y) / (1 - z * z / a) AS err, (dz * r / a + z * dr / a - z * r * da / (a * a)) / (1 - z * z / a) + (z * r / a - y) / (1 - z * z / a) * (2 * z * dz / a - z * z * da / (a * a)) / (1 - z * z / a) AS derr FROM r, s)
SELECT l_orderkey, round(sum(err), 3) AS err, round(sum(derr), 3) AS derr FROM e GROUP BY l_orderkey""",
)
def loo_feature_derivative(s, d):
    q = F.col("l_quantity").cast("double")
    t = table(s, d, "lineitem").select("l_orderkey", F.array(q).alias("z"), F.array(q * F.col("l_discount")).alias("dz"), F.col("l_extendedprice").alias("y"))
    g, r, _, _ = solvers.gramian(t, "z", "y")
    e = solvers.feature_loo_derivative(t, "z", "dz", "y", g, r, 10.0, ["l_orderkey"])
    return e.groupBy("l_orderkey").agg(r6(F.sum("err"), 3).alias("err"), r6(F.sum("derr"), 3).alias("derr"))


NATIONS = "n AS (SELECT s_nationkey AS id, count(*)::DOUBLE AS a, avg(s_acctbal) / 1000 AS b, avg(s_suppkey % 13)::DOUBLE AS y FROM supplier GROUP BY s_nationkey)"


def nations(s, d):
    t = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("id"))
    return t.agg(F.count("*").cast("double").alias("a"), (F.avg("s_acctbal") / 1000).alias("b"), F.avg((F.col("s_suppkey") % 13).cast("double")).alias("y"))


_TWO = f"""WITH {NATIONS}, g AS (SELECT sum(a * a) + 0.5 AS aa, sum(a * b) AS ab, sum(b * b) + 0.5 AS bb, sum(a * y) AS ay, sum(b * y) AS bw FROM n), i AS (SELECT *, aa * bb - ab * ab AS det FROM g),
c AS (SELECT *, (bb * ay - ab * bw) / det AS ca, (aa * bw - ab * ay) / det AS cb FROM i),
h AS (SELECT id, a, b, y, (a * a * bb - 2 * a * b * ab + b * b * aa) / det AS h, a * ca + b * cb AS p, det, aa, ab, bb, ca, cb FROM n, c)"""


@query("loo_svd_errors", f"{_TWO} SELECT id, round((p - y) / (1 - h), 6) AS err FROM h")
def loo_svd_errors(s, d):
    rows = nations(s, d).withColumn("z", F.array("a", "b"))
    return tall.TallSVD.fit(rows, "z", "y").errors(rows, "z", "y", 0.5, ["id"]).select("id", r6("err").alias("err"))


@query(
    "loo_lambda_derivative",
    f"""{_TWO}, q AS (SELECT *, -((a * bb - b * ab) * ca + (b * aa - a * ab) * cb) / det AS dp,
  -(pow((a * bb - b * ab) / det, 2) + pow((b * aa - a * ab) / det, 2)) AS dh FROM h)
SELECT round(avg(abs((p - y) / (1 - h))), 6) AS mae, round(avg(sign((p - y) / (1 - h)) * (dp / (1 - h) + (p - y) * dh / ((1 - h) * (1 - h)))), 6) AS derivative FROM q""",
)
def loo_lambda_derivative(s, d):
    rows = nations(s, d).withColumn("z", F.array("a", "b"))
    got = tall.TallSVD.fit(rows, "z", "y").loss_path(rows, "z", "y", [0.5])
    return table_of([v[1:] for v in got], s, "mae double, derivative double").select(r6("mae").alias("mae"), r6("derivative").alias("derivative"))


@query("ridge_by_svd", f"{_TWO} SELECT DISTINCT round(ca, 6) AS ca, round(cb, 6) AS cb FROM h")
def ridge_by_svd(s, d):
    x = tall.TallSVD.fit(nations(s, d).withColumn("z", F.array("a", "b")), "z", "y").solution(0.5)
    return table_of([tuple(map(float, x))], s, "ca double, cb double").select(r6("ca").alias("ca"), r6("cb").alias("cb"))


@query("independent_rows", "SELECT n_nationkey, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS independent FROM nation")
def independent_rows(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i == F.col("n_regionkey")).cast("double")).alias("x"))
    taken = large_kernels.chosen_rows(n, large_kernels.Linear(), 32, "n_nationkey").select(F.col("id").alias("n_nationkey"), F.lit(True).alias("taken"))
    return n.join(taken, "n_nationkey", "left").select("n_nationkey", F.coalesce("taken", F.lit(False)).alias("independent"))


@query(
    "dressed_atoms_solved",
    f"""WITH RECURSIVE {ATOMS}, c AS (SELECT mol, count(*) FILTER (z = 1)::DOUBLE AS h, count(*) FILTER (z = 6)::DOUBLE AS n, count(*) FILTER (z = 8)::DOUBLE AS o, 1.0::DOUBLE AS one FROM a GROUP BY mol), q AS (SELECT c.*, o_totalprice / 1000 AS y FROM c JOIN orders ON o_orderkey = mol),
sys AS (SELECT [[sum(h*h), sum(h*n), sum(h*o), sum(h), sum(h*y)], [sum(h*n), sum(n*n), sum(n*o), sum(n), sum(n*y)], [sum(h*o), sum(n*o), sum(o*o), sum(o), sum(o*y)], [sum(h), sum(n), sum(o), sum(one), sum(y)]] AS a FROM q), {eliminated('e', 'sys')}
SELECT unnest(['1', '6', '8', 'constant']) AS term, unnest(list_transform(a, lambda row: round(row[5], 4))) AS coefficient FROM e_x""",
)
def dressed_atoms_solved(s, d):
    a = atoms(s, d)
    counts = statistics.element_counts(a, "mol", "z", [1, 6, 8]).join(table(s, d, "orders").select(F.col("o_orderkey").alias("mol"), (F.col("o_totalprice") / 1000).alias("y")), "mol")
    c = statistics.dressed_atoms(counts, ["n_1", "n_6", "n_8"], "y")
    return table_of([(n, float(v)) for n, v in zip(("1", "6", "8", "constant"), c, strict=True)], s, "term string, coefficient double").select("term", r6("coefficient", 4).alias("coefficient"))


# Losses with their gradients.


def _errors(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", (F.col("value") - 50.0).alias("err"))


def _add_gradients() -> None:
    d = 10.0
    x = f"(abs(err) * (ln(2.0) / {d}))"
    sql = {
        "mae": ("avg(abs(err))", "sign(err) / n", None),
        "mse": ("avg(err * err)", "2 * err / n", None),
        "rmse": ("sqrt(avg(err * err))", "err / n / loss", None),
        "huber": (f"avg(CASE WHEN abs(err) < 2 * {d} THEN err * err / (4 * {d}) ELSE abs(err) - {d} END)", f"CASE WHEN abs(err) < 2 * {d} THEN err / (2 * {d}) ELSE sign(err) END / n", d),
        "logcosh": (f"avg(({x} + ln(1 + exp(-2 * {x})) - ln(2.0)) * ({d} / ln(2.0)))", f"((1 - exp(-2 * err * (ln(2.0) / {d}))) / (1 + exp(-2 * err * (ln(2.0) / {d})))) / n", d),
    }
    for squared in (False, True):
        for kind, (loss, der, delta) in sql.items():
            if squared and kind not in ("rmse", "huber", "logcosh"):
                continue
            text = f"""WITH e AS (SELECT event_id, event_type, value - 50.0 AS err FROM events), l AS (SELECT event_type, {loss} AS loss, count(err) AS n FROM e GROUP BY event_type), g AS (SELECT event_id, loss, {der} AS g FROM e JOIN l USING (event_type))
SELECT event_id, round({'loss * loss' if squared else 'loss'}, 6) AS loss, round(({'2 * loss * g' if squared else 'g'}) * 1000, 6) + 0.0 AS gradient FROM g"""
            query(f"loss_gradient_{'squared_' if squared else ''}{kind}", text)(
                lambda s, path, kind=kind, delta=delta, squared=squared: statistics.loss_gradients(_errors(s, path), "err", kind, ["event_type"], delta, squared).select("event_id", r6("loss").alias("loss"), (r6(F.col("gradient") * 1000) + 0.0).alias("gradient"))
            )


_add_gradients()

_SELF = """WITH e AS (SELECT event_id, user_id, value - 50.0 AS err, abs(value - 50.0) AS a FROM events WHERE value IS NOT NULL),
w AS (SELECT *, row_number() OVER o AS m, count(*) OVER (PARTITION BY user_id) AS n, sum(a * a) OVER (o ROWS UNBOUNDED PRECEDING) AS s2,
  sum(a) OVER (PARTITION BY user_id) - sum(a) OVER (o ROWS UNBOUNDED PRECEDING) AS s1, lead(a) OVER o AS nxt FROM e WINDOW o AS (PARTITION BY user_id ORDER BY a)),
l AS (SELECT *, (4 * 0.25 * s1 + sqrt(4 * 0.25 * s1 * 4 * 0.25 * s1 + 4 * (4 * 0.25 * (n + 0.25 * (n - m))) * s2)) / (2 * 4 * 0.25 * (n + 0.25 * (n - m))) AS loss FROM w),
t AS (SELECT user_id, CASE WHEN min(a) >= 2 * 0.25 * (avg(a) / 1.25) THEN avg(a) / 1.25 ELSE
  coalesce(min(CASE WHEN a <= 2 * 0.25 * loss AND (nxt IS NULL OR nxt >= 2 * 0.25 * loss) AND loss > 0 THEN loss END), 0) END AS loss FROM l GROUP BY user_id),
f AS (SELECT event_id, user_id, err, loss, CASE WHEN loss > 0 THEN CASE WHEN abs(err) < 2 * 0.25 * loss THEN err / (2 * 0.25 * loss) ELSE sign(err) END ELSE 0 END AS f FROM e JOIN t USING (user_id)),
g AS (SELECT *, sum(err * f) OVER (PARTITION BY user_id) AS s FROM f), h AS (SELECT event_id, loss, CASE WHEN s > 0 THEN loss * f / s ELSE 0 END AS g FROM g)"""


def _self_consistent(s, d, squared):
    e = _errors(s, d).filter("err is not null")
    losses = statistics.self_consistent_huber(e, "err", 0.25, ["user_id"])
    out = statistics.self_consistent_gradients(e, "err", losses, ["user_id"], 0.25, "huber", squared)
    return out.select("event_id", r6("loss").alias("loss"), (r6("gradient") + 0.0).alias("gradient"))


query("loss_gradient_self_consistent_huber", f"{_SELF} SELECT event_id, round(loss, 6) AS loss, round(g, 6) + 0.0 AS gradient FROM h")(lambda s, d: _self_consistent(s, d, False))
query("loss_gradient_squared_self_consistent_huber", f"{_SELF} SELECT event_id, round(loss * loss, 6) AS loss, round(2 * loss * g, 6) + 0.0 AS gradient FROM h")(lambda s, d: _self_consistent(s, d, True))

_BISECT = """WITH RECURSIVE e AS (SELECT event_type, list(value - 50.0 ORDER BY event_id) AS es, 0.0::DOUBLE AS low, avg(abs(value - 50.0)) AS high FROM events WHERE value IS NOT NULL GROUP BY event_type),
b AS (SELECT 0 AS k, event_type, es, low, high FROM e UNION ALL
  SELECT k + 1, event_type, es, CASE WHEN up THEN mid ELSE low END, CASE WHEN up THEN high ELSE mid END FROM (SELECT *, (low + high) / 2 AS mid,
    list_avg(list_transform(es, lambda x: (abs(x) * (ln(2.0) / (0.25 * (low + high) / 2)) + ln(1 + exp(-2 * abs(x) * (ln(2.0) / (0.25 * (low + high) / 2)))) - ln(2.0)) * (0.25 * (low + high) / 2 / ln(2.0)))) > (low + high) / 2 AS up FROM b WHERE k < 45)),
t AS (SELECT event_type, (low + high) / 2 AS loss FROM b WHERE k = 45)"""


@query("loss_self_consistent_logcosh_by", f"{_BISECT} SELECT event_type, round(loss, 6) AS loss, round(loss * loss, 5) AS squared FROM t")
def self_consistent_logcosh_by(s, d):
    t = statistics.self_consistent_by(_errors(s, d), "err", 0.25, ["event_type"], "logcosh", 45)
    return t.select("event_type", r6("loss").alias("loss"), r6(F.col("loss") * F.col("loss"), 5).alias("squared"))


_LOGCOSH_SLOPE = "((1 - exp(-2 * err * (ln(2.0) / (0.25 * loss)))) / (1 + exp(-2 * err * (ln(2.0) / (0.25 * loss)))))"


@query(
    "loss_gradient_squared_self_consistent_logcosh",
    f"""{_BISECT}, f AS (SELECT event_id, event_type, loss, value - 50.0 AS err FROM events JOIN t USING (event_type) WHERE value IS NOT NULL),
g AS (SELECT *, {_LOGCOSH_SLOPE} AS f FROM f), h AS (SELECT event_id, loss, f, sum(err * f) OVER (PARTITION BY event_type) AS s FROM g) SELECT event_id, round(loss * loss, 5) AS loss, round(2000 * loss * loss * f / s, 6) + 0.0 AS gradient FROM h""",
)
def squared_logcosh_gradient(s, d):
    e = _errors(s, d).filter("err is not null")
    losses = statistics.self_consistent_by(e, "err", 0.25, ["event_type"], "logcosh", 45)
    out = statistics.self_consistent_gradients(e, "err", losses, ["event_type"], 0.25, "logcosh", True)
    return out.select("event_id", r6("loss", 5).alias("loss"), (r6(F.col("gradient") * 1000) + 0.0).alias("gradient"))


# Forces: suppliers are atoms of their nation; the representation is the position, so its gradient is one.

SUPPLIERS = """a AS (SELECT s_nationkey AS mol, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 8 END AS z,
  [s_acctbal / 2000, (s_suppkey % 7) * 0.9, (s_suppkey % 11) * 0.7]::DOUBLE[] AS x FROM supplier)"""
SIG = 1.5


def supplier_atoms(s, d):
    k = F.col("s_suppkey")
    z = F.when(k % 3 == 0, 1).when(k % 3 == 1, 6).otherwise(8)
    return table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("mol"), k.cast("long").alias("atom"), z.alias("z"), (F.col("s_acctbal") / 2000).alias("x"), ((k % 7) * 0.9).cast("double").alias("y"), ((k % 11) * 0.7).cast("double").alias("c"))


def positions(z, r):
    own = np.arange(len(z))
    return r.copy(), (np.stack((own, own), axis=1), np.tile(np.eye(3), (len(z), 1, 1)))


def supplier_molecules(s, d):
    from ..operators.representations import molecules

    return forces.packed(molecules(supplier_atoms(s, d)), positions)


FORCE_PAIRS = f"""{SUPPLIERS}, pr AS (SELECT l.mol AS i, l.p, r.mol AS j, r.p AS q, list_transform(list_zip(l.x, r.x), lambda t: (t[1] - t[2]) / {SIG * SIG}) AS d, CASE WHEN l.z = r.z THEN exp(-{L2} / {2 * SIG * SIG}) ELSE 0 END AS k FROM a l CROSS JOIN a r),
ax AS (SELECT unnest([1, 2, 3]) AS c), bx AS (SELECT unnest([1, 2, 3]) AS e)"""


@query(
    "force_kernel_process",
    f"""WITH {FORCE_PAIRS}, o AS (SELECT i, 0 AS p, j, 0 AS q, sum(k) AS k FROM pr GROUP BY i, j UNION ALL SELECT i, 0, j, 3 * q + c, -sum(k * d[c]) FROM pr, ax GROUP BY i, j, q, c UNION ALL SELECT i, 3 * p + c, j, 0, sum(k * d[c]) FROM pr, ax GROUP BY i, j, p, c
  UNION ALL SELECT i, 3 * p + c, j, 3 * q + e, k * (CASE WHEN c = e THEN {1 / (SIG * SIG)} ELSE 0 END - d[c] * d[e]) FROM pr, ax, bx)
SELECT i::BIGINT AS i, p::BIGINT AS p, j::BIGINT AS j, q::BIGINT AS q, round(k, 6) + 0.0 AS k FROM o""",
)
def force_kernel_process(s, d):
    m = supplier_molecules(s, d)
    return forces.force_kernel(m, m, SIG).select("i", "p", "j", "q", (r6("k") + 0.0).alias("k"))


@query(
    "force_kernel_operator",
    f"""WITH {FORCE_PAIRS}, o AS (SELECT i, p, j, 0 AS q, sum(k) AS k FROM pr GROUP BY i, p, j UNION ALL SELECT i, p, j, 3 * q + c, -k * d[c] FROM pr, ax)
SELECT i::BIGINT AS i, p::BIGINT AS p, j::BIGINT AS j, q::BIGINT AS q, round(k, 6) + 0.0 AS k FROM o""",
)
def force_kernel_operator(s, d):
    m = supplier_molecules(s, d)
    return forces.force_kernel(m, m, SIG, False).select("i", "p", "j", "q", (r6("k") + 0.0).alias("k"))


def force_targets(s, d):
    """Energies and forces of the pair potential's kind, from the suppliers' numbers."""
    a = supplier_atoms(s, d)
    e = a.groupBy("mol").agg(F.sum(F.col("z") * 0.1 + F.col("x")).alias("energy"))
    f = a.groupBy("mol").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("atom", "x", "y", "c"))), lambda t: F.array(t["x"] * 0.01, t["y"] * 0.02, -t["c"] * 0.01))).alias("forces"))
    return e.join(f, "mol")


FORCE_Y = """y AS (SELECT mol, 0 AS q, sum(z * 0.1 + x[1]) AS y FROM a GROUP BY mol UNION ALL SELECT mol, 3 * p + c, CASE c WHEN 1 THEN x[1] * 0.01 WHEN 2 THEN x[2] * 0.02 ELSE -x[3] * 0.01 END FROM a, ax),
oy AS (SELECT *, row_number() OVER (ORDER BY mol, q) AS n FROM y)"""


@query(
    "force_ridge",
    f"""WITH RECURSIVE {FORCE_PAIRS}, {FORCE_Y}, o AS (SELECT i, 0 AS p, j, 0 AS q, sum(k) AS k FROM pr GROUP BY i, j UNION ALL SELECT i, 0, j, 3 * q + c, -sum(k * d[c]) FROM pr, ax GROUP BY i, j, q, c UNION ALL SELECT i, 3 * p + c, j, 0, sum(k * d[c]) FROM pr, ax GROUP BY i, j, p, c
  UNION ALL SELECT i, 3 * p + c, j, 3 * q + e, k * (CASE WHEN c = e THEN {1 / (SIG * SIG)} ELSE 0 END - d[c] * d[e]) FROM pr, ax, bx),
kk AS (SELECT l.n AS i, r.n AS j, k FROM o JOIN oy l ON l.mol = o.i AND l.q = o.p JOIN oy r ON r.mol = o.j AND r.q = o.q), lam AS (SELECT 0.1 * avg(k) AS l2 FROM kk WHERE i = j),
rows AS (SELECT i, list(k + CASE WHEN i = j THEN l2 ELSE 0 END ORDER BY j) AS row FROM kk CROSS JOIN lam GROUP BY i), sys AS (SELECT list(row ORDER BY i) AS a FROM rows), b AS (SELECT list(y ORDER BY n) AS b FROM oy),
cg AS (SELECT 0 AS k, list_transform(b, lambda v: 0.0::DOUBLE) AS x, b AS r, b AS p, list_dot_product(b, b) AS rr FROM b UNION ALL
  SELECT k + 1, list_transform(list_zip(x, p), lambda t: t[1] + al * t[2]), rn, list_transform(list_zip(rn, p), lambda t: t[1] + list_dot_product(rn, rn) / rr * t[2]), list_dot_product(rn, rn) FROM (
    SELECT *, list_transform(list_zip(r, ap), lambda t: t[1] - al * t[2]) AS rn FROM (SELECT *, rr / list_dot_product(p, ap) AS al FROM (SELECT cg.*, list_transform(a, lambda row: list_dot_product(row, p)) AS ap FROM cg, sys WHERE k < 400 AND rr > 1e-26)))),
sol AS (SELECT x FROM cg ORDER BY k DESC LIMIT 1)
SELECT l.mol::BIGINT AS mol, l.q::INTEGER AS q, round(sum(kk.k * x[kk.i]), 4) + 0.0 AS v FROM kk JOIN oy l ON l.n = kk.j, sol GROUP BY l.mol, l.q""",
)
def force_ridge(s, d):
    m = supplier_molecules(s, d)
    p = forces.ForceRidge(SIG, 0.1).fit(m, force_targets(s, d)).predict(m)
    return p.select("mol", F.posexplode(F.concat(F.array("energy"), "forces")).alias("q", "v")).select("mol", "q", (r6("v", 4) + 0.0).alias("v"))


FEATURE4 = f"""{SUPPLIERS}, j AS (SELECT unnest(range(4)) AS j), u AS (SELECT mol, p, CASE z WHEN 1 THEN 1 WHEN 6 THEN 6 ELSE 8 END AS z, unnest(x) AS e, unnest(range(3)) AS i FROM a),
ph AS (SELECT mol, p, z, j.j, sum(e / 2.0 * {SIGN.format(sp='u.z')} * {H}) + {BIAS.format(sp='any_value(u.z)')} AS ph FROM u CROSS JOIN j GROUP BY mol, p, z, j.j), ci AS (SELECT unnest(range(3)) AS i),
fr AS (SELECT mol, 0 AS q, j, sum(cos(ph)) * sqrt(2.0 / 4) AS v FROM ph GROUP BY mol, j UNION ALL SELECT u.mol, 3 * u.p + u.i + 1, j.j, sin(u.ph) * sqrt(2.0 / 4) * {SIGN.format(sp='u.z')} * {H} / 2.0 FROM (SELECT * FROM ph, ci) u JOIN j ON u.j = j.j)"""


@query("force_features", f"WITH {FEATURE4} SELECT mol::BIGINT AS mol, q::BIGINT AS q, j::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM fr")
def force_features(s, d):
    params = {e: Signs.by_rule(1, 1, 4, e) for e in (1, 6, 8)}
    z = forces.feature_force_rows(supplier_molecules(s, d), params, 2.0)
    return z.select("mol", "q", F.posexplode("z").alias("pos", "v")).select("mol", "q", "pos", (r6("v") + 0.0).alias("v"))


@query(
    "force_feature_ridge",
    f"""WITH RECURSIVE {FEATURE4}, ax AS (SELECT unnest([1, 2, 3]) AS c), {FORCE_Y}, nat AS (SELECT mol, count(*) AS n FROM a GROUP BY mol), w AS (SELECT oy.mol, oy.q, oy.y, CASE WHEN q = 0 THEN 1.0 ELSE 1.0 / nat.n END AS w FROM oy JOIN nat USING (mol)),
g AS (SELECT l.j AS a, r.j AS b, sum(l.v * r.v * w) AS g FROM fr l JOIN fr r ON l.mol = r.mol AND l.q = r.q JOIN w ON w.mol = l.mol AND w.q = l.q GROUP BY l.j, r.j), rr AS (SELECT j AS a, sum(v * y * w) AS r FROM fr JOIN w USING (mol, q) GROUP BY j),
lam AS (SELECT 0.01 * sum(g) / least(4, (SELECT count(*) FROM y)) AS l2 FROM g WHERE a = b), rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a),
sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('el', 'sys')}
SELECT mol::BIGINT AS mol, q::INTEGER AS q, round(sum(v * a[j + 1][-1]), 5) + 0.0 AS v FROM fr, el_x GROUP BY mol, q""",
)
def force_feature_ridge(s, d, solver="gramian"):
    params = {e: Signs.by_rule(1, 1, 4, e) for e in (1, 6, 8)}
    m = supplier_molecules(s, d)
    p = forces.FeatureForceRidge(params, 2.0, 0.01, solver=solver).fit(m, force_targets(s, d)).predict(m)
    return p.select("mol", F.posexplode(F.concat(F.array("energy"), "forces")).alias("q", "v")).select("mol", "q", (r6("v", 5) + 0.0).alias("v"))


query("force_feature_triangle", SQL["force_feature_ridge"])(lambda s, d: force_feature_ridge(s, d, "triangle"))


@query(
    "force_fold_objective",
    f"""WITH RECURSIVE {FEATURE4}, ax AS (SELECT unnest([1, 2, 3]) AS c), {FORCE_Y}, nat AS (SELECT mol, count(*) AS n FROM a GROUP BY mol), w AS (SELECT oy.mol, oy.q, oy.y, CASE WHEN q = 0 THEN 1.0 ELSE 1.0 / nat.n END AS w FROM oy JOIN nat USING (mol)),
g AS (SELECT l.j AS a, r.j AS b, sum(l.v * r.v * w) AS g FROM fr l JOIN fr r ON l.mol = r.mol AND l.q = r.q JOIN w ON w.mol = l.mol AND w.q = l.q WHERE l.mol % 2 = 0 GROUP BY l.j, r.j), rr AS (SELECT j AS a, sum(v * y * w) AS r FROM fr JOIN w USING (mol, q) WHERE mol % 2 = 0 GROUP BY j),
lam AS (SELECT 0.01 * sum(g) / least(4, (SELECT count(*) FROM y WHERE mol % 2 = 0)) AS l2 FROM g WHERE a = b), rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a),
sys AS (SELECT list(list_concat(row, [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('el', 'sys')}, p AS (SELECT mol, q, sum(v * a[j + 1][-1]) AS p FROM fr, el_x WHERE mol % 2 = 1 GROUP BY mol, q)
SELECT round(-1 / avg(abs(p - y) * sqrt(w)), 5) AS objective FROM p JOIN w USING (mol, q)""",
)
def force_fold_objective(s, d):
    params = {e: Signs.by_rule(1, 1, 4, e) for e in (1, 6, 8)}
    t = force_targets(s, d)
    folds = t.select("mol", F.lit(0).alias("fold"), (F.col("mol") % 2 == 0).alias("train"))
    v = forces.force_fold_objective(forces.FeatureForceRidge(params, 2.0, 0.01), supplier_molecules(s, d), t, folds)
    return table_of([(v,)], s, "objective double").select(r6("objective", 5).alias("objective"))


# Orbitals: a ridge on their kernel.

ORBITALS = f"""{VECTORS}, o AS (SELECT CAST(floor(id / 40) AS BIGINT) AS mol, CAST(floor(id / 4) AS BIGINT) AS orb, id, (z + 1) / 10.0 AS rho, list_transform(x, lambda t: t * 0.5 / 0.5) AS x FROM v),
own AS (SELECT l.orb, sqrt(sum(l.rho * r.rho * exp(-{L2}))) AS n FROM o l JOIN o r ON l.orb = r.orb GROUP BY l.orb), w AS (SELECT o.mol, o.orb, o.x, o.rho / own.n AS rho FROM o JOIN own ON o.orb = own.orb),
p AS (SELECT l.mol AS i, l.orb AS oi, r.mol AS j, r.orb AS oj, sum(l.rho * r.rho * exp(-{L2})) AS p FROM w l CROSS JOIN w r GROUP BY l.mol, l.orb, r.mol, r.orb), kk AS (SELECT i, j, sum(0.25 * exp(-(1 - p) / 0.49)) AS k FROM p GROUP BY i, j)"""


def orbital_rows(s, d):
    v = vectors(s, d)
    return v.select(F.floor(F.col("id") / 40).alias("mol"), F.floor(F.col("id") / 4).alias("orb"), F.lit(0.5).alias("orb_rho"), F.col("id").alias("arep"), ((F.col("z") + 1) / 10.0).alias("rho"), F.col("x").alias("v"))


@query("orbital_whole_vectors", f"WITH {ORBITALS} SELECT i, j, round(k, 6) AS k FROM kk")
def orbital_whole_vectors(s, d):
    o = orbital_rows(s, d)
    return orbitals.orbital_kernel(o, o, [0.5] * 64, 0.7).select("i", "j", r6("k").alias("k"))


@query(
    "orbital_ridge",
    f"""WITH RECURSIVE {ORBITALS}, y AS (SELECT mol AS id, avg(id % 31)::DOUBLE AS y FROM o GROUP BY mol), dg AS (SELECT 0.01 * avg(k) AS l2 FROM kk WHERE i = j), rows AS (SELECT i, list(k + CASE WHEN i = j THEN l2 ELSE 0 END ORDER BY j) AS row FROM kk CROSS JOIN dg GROUP BY i),
sys AS (SELECT list(list_concat(row, [y - (SELECT avg(y) FROM y)]) ORDER BY i) AS a FROM rows JOIN y ON y.id = i), {eliminated('e', 'sys')}, ids AS ({RANKED})
SELECT kk.i AS mol, round(sum(k * a[ids.n][-1]) + (SELECT avg(y) FROM y), 5) AS prediction FROM kk JOIN ids ON kk.j = ids.id, e_x GROUP BY kk.i""",
)
def orbital_ridge(s, d):
    o = orbital_rows(s, d)
    labels = o.groupBy("mol").agg(F.avg((F.col("arep") % 31).cast("double")).alias("y"))
    return orbitals.OrbitalRidge([0.5] * 64, 0.7, 0.01).fit(o, labels).predict(o).select("mol", r6("prediction", 5).alias("prediction"))


# Saved models and guessed widths.


@query(
    "krr_saved",
    f"""WITH RECURSIVE {MEANS}, {kernel_system('[y - my]', '0.01')}, {eliminated('e', 'sys')},
al AS (SELECT unnest(list_transform(a, lambda row: row[-1])) AS alpha, unnest(range(1, len(a) + 1)) AS n FROM e_x), tr AS (SELECT t.*, row_number() OVER (ORDER BY id) AS n FROM t)
SELECT l.id, round(sum({gauss(SIGMA)} * alpha) + (SELECT avg(y) FROM y), 6) AS prediction FROM v l CROSS JOIN tr r JOIN al ON al.n = r.n GROUP BY l.id""",
)
def krr_saved(s, d):
    from ..sources.store import scratch

    path = scratch(s, "model")
    M.KernelRidge(Kernel("gaussian", (SIGMA,)), 0.01, solver="lu").fit(means(s, d)).save(path)
    return M.KernelRidge.load(s, path).predict(vectors(s, d)).select("id", r6("prediction").alias("prediction"))


@query(
    "multilevel_width_guesses",
    f"""WITH {VECTORS}, sa AS (SELECT sqrt(sum(v)) AS s FROM (SELECT pos, var_pop(e) AS v FROM (SELECT unnest(x) AS e, unnest(range(64)) AS pos FROM v) GROUP BY pos)), j AS (SELECT unnest(range(64)) AS j), u AS (SELECT id, mol, z, unnest(x) / (SELECT s FROM sa) AS e, unnest(range(64)) AS i FROM v),
fa AS (SELECT u.id, u.mol, j.j, cos(sum(e * {SIGN.format(sp='u.z')} * {H}) + {BIAS.format(sp='any_value(u.z)')}) * sqrt(2.0 / 64) AS f FROM u CROSS JOIN j GROUP BY u.id, u.mol, j.j), s1 AS (SELECT mol, j, sum(f) AS f FROM fa GROUP BY mol, j),
nn AS (SELECT mol, sqrt(sum(f * f)) AS n FROM s1 GROUP BY mol), w AS (SELECT j, f / n AS e FROM s1 JOIN nn USING (mol)), sb AS (SELECT sqrt(sum(v)) AS s FROM (SELECT j, var_pop(e) AS v FROM w GROUP BY j))
SELECT 0 AS map, round(s, 6) AS sigma FROM sa UNION ALL SELECT 1, round(s, 6) FROM sb""",
)
def multilevel_width_guesses(s, d):
    model, objects, _ = multilevel(s, d)
    maps = model.pipeline.guess_sigmas(objects).maps()
    return table_of([(i, float(m.sigma)) for i, m in enumerate(maps)], s, "map int, sigma double").select("map", r6("sigma").alias("sigma"))
