"""Queries of gradients, tall systems, large kernels, choices of rows, paths of regularisation and shifts, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, definitions, large_kernels, tall
from ..operators.features import Signs
from ..operators.kernels import Kernel
from .catalogue import BIAS, H, L2, SEED, SIGN, VECTORS, query, r6, table, vectors
from .systems import eliminated, gauss, multilevel, table_of

# Derivatives through two levels: atoms to molecules (width 2), normalised, and a top map (width 1/2).

_DUAL = f"""{VECTORS}, j AS (SELECT unnest(range(64)) AS j), u AS (SELECT id, mol, z, unnest(x) AS e, unnest(range(64)) AS i FROM v),
pa AS (SELECT u.id, u.mol, j.j, sum(e / 2.0 * {SIGN.format(sp='u.z')} * {H}) AS ph, {BIAS.format(sp='any_value(u.z)')} AS b FROM u CROSS JOIN j GROUP BY u.id, u.mol, j.j),
s1 AS (SELECT mol, j, sum(cos(ph + b)) * sqrt(2.0 / 64) AS f, sum(sin(ph + b) * ph) * sqrt(2.0 / 64) AS g FROM pa GROUP BY mol, j), nn AS (SELECT mol, sqrt(sum(f * f)) AS n, sum(f * g) AS fg FROM s1 GROUP BY mol),
w AS (SELECT s1.mol AS id, j AS i, f / n AS e, (g - f * fg / (n * n)) / n AS de FROM s1 JOIN nn USING (mol)),
pb AS (SELECT u.id, j.j, sum(e / 0.5 * {SIGN.format(sp=0)} * {H}) AS ph, sum(de / 0.5 * {SIGN.format(sp=0)} * {H}) AS dph, {BIAS.format(sp=0)} AS b FROM w u CROSS JOIN j GROUP BY u.id, j.j),
f AS (SELECT id, j, cos(ph + b) * sqrt(2.0 / 64) AS f, -sin(ph + b) * dph * sqrt(2.0 / 64) AS d1, sin(ph + b) * ph * sqrt(2.0 / 64) AS d2 FROM pb)"""


@query("multilevel_feature_slopes", f"WITH {_DUAL} SELECT id AS mol, j::INTEGER AS pos, round(f, 6) AS v, round(d1, 6) + 0.0 AS by_atoms, round(d2, 6) + 0.0 AS by_top FROM f")
def multilevel_feature_slopes(s, d):
    model, objects, _ = multilevel(s, d)
    x = model.pipeline.run(objects, dual=True)
    part = lambda k: F.slice("x", 64 * k + 1, 64)
    e = x.select("mol", F.posexplode(F.arrays_zip(part(0).alias("v"), part(1).alias("a"), part(2).alias("b"))).alias("pos", "t"))
    return e.select("mol", "pos", r6("t.v").alias("v"), (r6("t.a") + 0.0).alias("by_atoms"), (r6("t.b") + 0.0).alias("by_top"))


@query(
    "multilevel_defined",
    f"WITH {_DUAL} SELECT CAST(floor(id / 5) AS BIGINT) AS grp, j::INTEGER AS pos, round(sum(f * (id % 3 + 1)), 6) AS v FROM f GROUP BY floor(id / 5), j",
)
def multilevel_defined(s, d):
    """Atoms in molecules in weighted groups of molecules, by a checked definition."""
    of = definitions.ObjectType(64, (definitions.Nesting("list", "mol"), definitions.Nesting("rhos", "grp", "w")), "z", tuple(range(10)))
    rows = vectors(s, d).select("mol", F.floor(F.col("mol") / 5).alias("grp"), (F.col("mol") % 3 + 1).cast("double").alias("w"), "z", "x")
    # the innermost sum is over a molecule's atoms, the outer one over a group's molecules
    x = definitions.features(
        ["sorf", "element_id_switch", "component_sum", "normalization", "sorf", "weighted_component_sum"], of, rows, {0: {"sigma": 2.0}, 4: {"sigma": 0.5}},
        signs=lambda place, element, stacks, transforms, size: Signs.by_rule(stacks, transforms, size, element),
    )
    return x.select("grp", F.posexplode("x").alias("pos", "v")).select("grp", "pos", r6("v").alias("v"))


def _moved(k: int) -> str:
    """CTEs of what hyperparameter ``k`` moves: Z'dZ, dZ'(y - p), l2, and the derivative of each error."""
    return f"""m{k} AS (SELECT list(row ORDER BY a) AS m FROM (SELECT l.j AS a, list(s ORDER BY b) AS row FROM (SELECT l.j AS j, r.j AS b, sum(l.f * r.d{k}) AS s FROM f l JOIN f r ON l.id = r.id GROUP BY l.j, r.j) l GROUP BY l.j)),
v{k} AS (SELECT list(s ORDER BY j) AS v FROM (SELECT j, sum(f.d{k} * (y - p)) AS s FROM f JOIN q USING (id) GROUP BY j)), t{k} AS (SELECT 0.02 * sum(f * d{k}) / least(64, any_value(n)) AS dl FROM f, my),
p{k} AS (SELECT list_transform(inv, lambda row: list_dot_product(row, list_transform(list_zip(v, m, al), lambda t: t[1] - list_dot_product(t[2], al) - dl * t[3]))) AS push FROM i, m{k}, v{k}, t{k}),
e{k} AS (SELECT q.id, err, (list_dot_product(d{k}, al) + list_dot_product(f, push)) / (1 - h)
  + err * (2 * list_dot_product(d{k}, iz) - 2 * list_dot_product(iz, list_transform(m, lambda row: list_dot_product(row, iz))) - dl * list_dot_product(iz, iz)) / (1 - h) AS de FROM q, i, m{k}, t{k}, p{k})"""


_LOSS = f"""WITH RECURSIVE {_DUAL}, fv AS (SELECT id, list(f ORDER BY j) AS f, list(d1 ORDER BY j) AS d1, list(d2 ORDER BY j) AS d2 FROM f GROUP BY id),
ys AS (SELECT mol AS id, sum(z * z + id % 7)::DOUBLE AS y FROM v GROUP BY mol), my AS (SELECT avg(y) AS my, count(*) AS n FROM ys),
g AS (SELECT l.j AS a, r.j AS b, sum(l.f * r.f) AS g FROM f l JOIN f r ON l.id = r.id GROUP BY l.j, r.j), lam AS (SELECT 0.01 * sum(g) / least(64, (SELECT n FROM my)) AS l2 FROM g WHERE a = b),
rr AS (SELECT j AS a, sum(f * (y - my)) AS r FROM f JOIN ys USING (id) CROSS JOIN my GROUP BY j), rows AS (SELECT a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g CROSS JOIN lam GROUP BY a),
sys AS (SELECT list(list_concat(list_concat(row, list_transform(range(64), lambda c: CASE WHEN c = rows.a THEN 1.0 ELSE 0.0 END)), [r]) ORDER BY rows.a) AS a FROM rows JOIN rr ON rr.a = rows.a), {eliminated('e', 'sys')},
i AS MATERIALIZED (SELECT list_transform(a, lambda row: row[65:128]) AS inv, list_transform(a, lambda row: row[129]) AS al FROM e_x),
q AS MATERIALIZED (SELECT *, list_dot_product(f, iz) AS h, (p - y) / (1 - list_dot_product(f, iz)) AS err FROM (SELECT id, f, d1, d2, y - my AS y, list_dot_product(f, al) AS p, list_transform(inv, lambda row: list_dot_product(row, f)) AS iz FROM fv JOIN ys USING (id), my, i)),
{_moved(1)}, {_moved(2)},
p3 AS (SELECT list_transform(inv, lambda row: -l2 * list_dot_product(row, al)) AS push FROM i, lam), e3 AS (SELECT err, list_dot_product(f, push) / (1 - h) - err * l2 * list_dot_product(iz, iz) / (1 - h) AS de FROM q, p3, lam)"""


@query(
    "multilevel_loss_slopes",
    f"""{_LOSS} SELECT 'loss' AS term, round(avg(abs(err)), 5) AS v FROM q UNION ALL SELECT 'atoms', round(avg(sign(err) * de), 5) FROM e1
UNION ALL SELECT 'top', round(avg(sign(err) * de), 5) FROM e2 UNION ALL SELECT 'ratio', round(avg(sign(err) * de), 5) FROM e3""",
)
def multilevel_loss_slopes(s, d):
    model, objects, labels = multilevel(s, d)
    loss, slopes, by_ratio = model.loss_and_slopes(objects, labels)
    rows = [("loss", loss), ("atoms", float(slopes[0])), ("top", float(slopes[1])), ("ratio", by_ratio)]  # one for each hyperparameter
    return table_of(rows, s, "term string, v double").select("term", r6("v", 5).alias("v"))


# Tall tables: five features of each line item.

FIVE = """t AS (SELECT l_orderkey, l_linenumber, [1.0::DOUBLE, l_quantity, l_discount * 100, l_tax * 100, l_extendedprice / 10000]::DOUBLE[] AS z, (l_partkey % 11 + l_quantity / 10)::DOUBLE AS y, l_orderkey % 4 AS fold FROM lineitem),
gg AS (SELECT a, list(g ORDER BY b) AS row FROM (SELECT a, b, sum(z[a] * z[b]) AS g FROM t, range(1, 6) p(a), range(1, 6) q(b) GROUP BY a, b) GROUP BY a),
gr AS (SELECT a, sum(z[a] * y) AS r FROM t, range(1, 6) p(a) GROUP BY a)"""


def five(s, d):
    t, c = table(s, d, "lineitem"), lambda n: F.col(n).cast("double")
    z = F.array(F.lit(1.0), c("l_quantity"), c("l_discount") * 100, c("l_tax") * 100, c("l_extendedprice") / 10000)
    return t.select("l_orderkey", "l_linenumber", z.alias("z"), ((F.col("l_partkey") % 11) + c("l_quantity") / 10).cast("double").alias("y"), (F.col("l_orderkey") % 4).alias("fold"))


@query(
    "tall_r_factor",
    f"""WITH RECURSIVE {FIVE}, gy AS (SELECT list(list_concat(row, [r]) ORDER BY gg.a) AS a FROM gg JOIN gr USING (a)),
c AS (SELECT 0 AS k, a, NULL::DOUBLE[] AS row FROM gy UNION ALL SELECT k + 1, list_transform(a, lambda row, i: list_transform(row, lambda v, j: v - row[k + 1] * a[k + 1][j] / a[k + 1][k + 1])), list_transform(a[k + 1], lambda v: v / sqrt(a[k + 1][k + 1])) FROM c WHERE k < 5)
SELECT k AS row, j::INTEGER AS col, round(c.row[j], 4) AS r FROM c, range(1, 6) q(j) WHERE k > 0 AND j >= k""",
)
def tall_r_factor(s, d):
    import numpy as np

    r = tall.r_factor(five(s, d).select("z"), lambda b: np.asarray(b.column("z").flatten(), float).reshape(b.num_rows, -1))
    return table_of([(i + 1, j + 1, float(r[i, j])) for i in range(5) for j in range(i, 5)], s, "row int, col int, r double").select("row", "col", r6("r", 4).alias("r"))


_RIDGE = f"""WITH RECURSIVE {FIVE}, sys AS (SELECT list(list_concat(list_concat(list_transform(row, lambda v, j: v + CASE WHEN j = gg.a THEN 0.5 ELSE 0 END), list_transform(range(1, 6), lambda c: CASE WHEN c = gg.a THEN 1.0 ELSE 0.0 END)), [r]) ORDER BY gg.a) AS a FROM gg JOIN gr USING (a)), {eliminated('e', 'sys')},
m AS (SELECT list_transform(a, lambda row: row[6:10]) AS inv, list_transform(a, lambda row: row[11]) AS al FROM e_x)"""


@query("tall_ridge", f"{_RIDGE} SELECT unnest(range(1, 6))::INTEGER AS pos, round(unnest(al), 6) AS alpha FROM m")
def tall_ridge(s, d):
    a = tall.TallSVD.fit(five(s, d), "z", "y").solution(0.5)
    return table_of([(i + 1, float(v)) for i, v in enumerate(a)], s, "pos int, alpha double").select("pos", r6("alpha").alias("alpha"))


@query(
    "tall_loo_errors",
    f"""{_RIDGE}, q AS (SELECT l_orderkey, l_linenumber, y, list_dot_product(z, al) AS p, list_dot_product(z, list_transform(inv, lambda row: list_dot_product(row, z))) AS h FROM t, m)
SELECT l_orderkey, count(*) AS n, round(sum(h) * 1000, 5) AS leverage, round(sum((p - y) / (1 - h)), 5) AS err FROM q GROUP BY l_orderkey""",
)
def tall_loo_errors(s, d):
    rows = five(s, d)
    e = tall.TallSVD.fit(rows, "z", "y").errors(rows, "z", "y", 0.5, ["l_orderkey"])
    return e.groupBy("l_orderkey").agg(F.count("*").alias("n"), r6(F.sum("leverage") * 1000, 5).alias("leverage"), r6(F.sum("err"), 5).alias("err"))


def _keyed(name: str, source: str, size: int) -> str:
    """Like ``eliminated``, for a system in each row (key, a) of ``source``; the result is (key, a)."""
    step = """list_transform(a, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / a[k + 1][k + 1])
    ELSE list_transform(list_zip(row, a[k + 1]), lambda t: t[1] - row[k + 1] / a[k + 1][k + 1] * t[2]) END)"""
    return f"{name} AS (SELECT key, 0 AS k, a FROM {source} UNION ALL SELECT key, k + 1, {step} FROM {name} WHERE k < {size}), {name}_x AS (SELECT key, a FROM {name} WHERE k = {size})"


PATH = [0.01, 1.0, 100.0, 10_000.0, 1_000_000.0]


@query(
    "fold_path",
    f"""WITH RECURSIVE {FIVE.split(',' + chr(10) + 'gg')[0]}, my AS (SELECT f.fold, avg(y) AS my FROM t, (SELECT DISTINCT fold FROM t) f WHERE t.fold <> f.fold GROUP BY f.fold),
h AS (SELECT f.fold, a, b, sum(z[a] * z[b]) AS g FROM t, (SELECT DISTINCT fold FROM t) f, range(1, 6) p(a), range(1, 6) q(b) WHERE t.fold <> f.fold GROUP BY f.fold, a, b),
hr AS (SELECT my.fold, a, sum(z[a] * (y - my)) AS r FROM t JOIN my ON t.fold <> my.fold, range(1, 6) p(a) GROUP BY my.fold, a),
hh AS (SELECT fold, l2, a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM h, (SELECT unnest({PATH}::DOUBLE[]) AS l2) GROUP BY fold, l2, a),
s AS (SELECT {{'fold': fold, 'l2': l2}} AS key, list(list_concat(row, [r]) ORDER BY a) AS a FROM hh JOIN hr USING (fold, a) GROUP BY fold, l2), {_keyed('e', 's', 5)},
al AS (SELECT key.fold AS fold, key.l2 AS l2, list_transform(a, lambda row: row[6]) AS al FROM e_x)
SELECT fold, l2, round(avg(abs(list_dot_product(z, al) + my - y)), 6) AS mae, count(*) AS n FROM t JOIN al USING (fold) JOIN my USING (fold) GROUP BY fold, l2""",
)
def fold_path(s, d):
    got = tall.FoldPath(PATH, shift=True).run(five(s, d), "z", "y", "fold")
    return table_of([(f, l2, v, n) for f, l2, v, _, n in got], s, "fold long, l2 double, mae double, n long").select("fold", "l2", r6("mae").alias("mae"), "n")


@query(
    "loo_path",
    f"""WITH RECURSIVE {FIVE}, ls AS (SELECT unnest({PATH}::DOUBLE[]) AS key),
s AS (SELECT key, list(list_concat(list_concat(list_transform(row, lambda v, j: v + CASE WHEN j = gg.a THEN key ELSE 0 END), list_transform(range(1, 6), lambda c: CASE WHEN c = gg.a THEN 1.0 ELSE 0.0 END)), [r]) ORDER BY gg.a) AS a FROM gg JOIN gr USING (a), ls GROUP BY key),
{_keyed('e', 's', 5)}, m AS (SELECT key, list_transform(a, lambda row: row[6:10]) AS inv, list_transform(a, lambda row: row[11]) AS al FROM e_x),
w AS (SELECT key, al, list_transform(inv, lambda row: list_dot_product(row, al)) AS dal, inv FROM m),
q AS (SELECT key, y, list_dot_product(z, al) AS p, -list_dot_product(z, dal) AS dp, list_transform(inv, lambda row: list_dot_product(row, z)) AS iz, z FROM t, w),
r AS (SELECT key, (p - y) / (1 - list_dot_product(z, iz)) AS e, dp / (1 - list_dot_product(z, iz)) AS f, list_dot_product(iz, iz) / (1 - list_dot_product(z, iz)) AS g FROM q)
SELECT key AS l2, round(avg(abs(e)), 6) AS mae, round(avg(sign(e) * (f - e * g)) * key, 6) + 0.0 AS slope FROM r GROUP BY key""",
)
def loo_path(s, d):
    rows = five(s, d)
    got = tall.TallSVD.fit(rows, "z", "y").loss_path(rows, "z", "y", PATH)
    return table_of([(l2, v, g * l2) for l2, v, g in got], s, "l2 double, mae double, slope double").select("l2", r6("mae").alias("mae"), (r6("slope") + 0.0).alias("slope"))


# Shifts: what each line item and each return add to an order's price, so that the leave-one-out errors of the rest are least.

ORDERS = """o AS (SELECT o_orderkey AS id, o_totalprice / 10000 AS y, [1.0::DOUBLE, o_custkey % 7, o_custkey % 5]::DOUBLE[] AS z, n::DOUBLE AS n, r::DOUBLE AS r FROM orders
  JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
gg AS (SELECT a, list(g ORDER BY b) AS row FROM (SELECT a, b, sum(z[a] * z[b]) + CASE WHEN a = b THEN 2.0 ELSE 0 END AS g FROM o, range(1, 4) p(a), range(1, 4) q(b) GROUP BY a, b) GROUP BY a),
gr AS (SELECT a, sum(z[a] * y) AS ry, sum(z[a] * n) AS rn, sum(z[a] * r) AS rr FROM o, range(1, 4) p(a) GROUP BY a),
sys AS (SELECT list(list_concat(list_concat(row, list_transform(range(1, 4), lambda c: CASE WHEN c = gg.a THEN 1.0 ELSE 0.0 END)), [ry, rn, rr]) ORDER BY gg.a) AS a FROM gg JOIN gr USING (a))"""
_SHIFT = f"""WITH RECURSIVE {ORDERS}, {eliminated('e', 'sys')},
m AS (SELECT list_transform(a, lambda row: row[4:6]) AS inv, list_transform(a, lambda row: row[7]) AS ay, list_transform(a, lambda row: row[8]) AS an, list_transform(a, lambda row: row[9]) AS ar FROM e_x),
k AS (SELECT id, 1 - list_dot_product(z, list_transform(inv, lambda row: list_dot_product(row, z))) AS left_, list_dot_product(z, ay) - y AS b0, list_dot_product(z, an) - n AS b1, list_dot_product(z, ar) - r AS b2 FROM o, m),
ee AS MATERIALIZED (SELECT id, b0 / left_ AS e0, b1 / left_ AS e1, b2 / left_ AS e2 FROM k)"""


def _orders(s, d):
    c = lambda n: F.col(n).cast("double")
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (c("o_totalprice") / 10000).alias("y"), F.array(F.lit(1.0), (F.col("o_custkey") % 7).cast("double"), (F.col("o_custkey") % 5).cast("double")).alias("z"))
    return o.join(n, "id")


@query("loo_shift_errors", f"{_SHIFT} SELECT id, round(e0, 6) AS e0, round(e1, 6) AS by_item, round(e2, 6) AS by_return FROM ee")
def loo_shift_errors(s, d):
    e = tall.shift_errors(_orders(s, d), "z", "y", ["n", "r"], 2.0, ["id"])
    return e.select("id", r6("e0").alias("e0"), r6(F.col("e1")[0]).alias("by_item"), r6(F.col("e1")[1]).alias("by_return"))


_SOLVE = """SELECT {k} AS k, -(s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS c1, -(s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS c2 FROM (
  SELECT {k0} sum(w * e1 * e1) AS s11, sum(w * e1 * e2) AS s12, sum(w * e2 * e2) AS s22, sum(w * e1 * e0) AS t1, sum(w * e2 * e0) AS t2 FROM {rows})"""


@query(
    "loo_best_shift",
    f"""{_SHIFT}, c AS ({_SOLVE.format(k='0', k0='', rows='(SELECT *, 1.0 AS w FROM ee)')} UNION ALL
{_SOLVE.format(k='k + 1', k0='any_value(k) AS k,', rows='(SELECT k, e0, e1, e2, 1 / greatest(abs(e0 + c1 * e1 + c2 * e2), 1e-3) AS w FROM c, ee WHERE k < 12) HAVING count(*) > 0')})
SELECT CASE WHEN k = 0 THEN 'mse' ELSE 'mae' END AS loss, round(c1, 5) AS by_item, round(c2, 5) AS by_return FROM c WHERE k IN (0, 12)""",
)
def loo_best_shift(s, d):
    rows = _orders(s, d)
    got = [(loss, *map(float, tall.best_shift(rows, "z", "y", ["n", "r"], 2.0, loss, rounds=12, tol=0.0, floor=1e-3))) for loss in ("mse", "mae")]
    return table_of(got, s, "loss string, by_item double, by_return double").select("loss", r6("by_item", 5).alias("by_item"), r6("by_return", 5).alias("by_return"))


# Choices of rows and large kernels, over the embeddings.


@query(
    "pivoted_rows",
    f"""WITH RECURSIVE {VECTORS}, e AS (SELECT 0 AS k, id, x, 1.0::DOUBLE AS res, []::DOUBLE[] AS l, false AS used FROM v UNION ALL
  SELECT k + 1, id, x, res - w * w, list_append(l, w), used OR id = pid FROM (SELECT *, ({gauss(0.7).replace('l.x', 'x').replace('r.x', 'px')} - coalesce(list_dot_product(l, pl), 0)) / sqrt(pr) AS w FROM (
    SELECT *, first_value(id) OVER w AS pid, first_value(x) OVER w AS px, first_value(l) OVER w AS pl, first_value(res) OVER w AS pr FROM e WHERE k < 12 WINDOW w AS (ORDER BY used, res DESC, id)))),
f AS (SELECT k::INTEGER AS place, id, res, row_number() OVER (PARTITION BY k ORDER BY used, res DESC, id) AS n FROM e WHERE k < 12)
SELECT id, place, round(res, 6) AS residual FROM f WHERE n = 1""",
)
def pivoted_rows(s, d):
    return large_kernels.chosen_rows(vectors(s, d), Kernel("gaussian", (0.7,)), 12).select("id", "place", r6("residual").alias("residual"))


def _thinned_sql(source: str, count: int) -> str:
    """One of the closest pair of ``p`` (i, j, d), again and again."""
    least = "(arg_min({'d': p.d, 'i': i, 'j': j}, {'d': p.d, 'i': i, 'j': j}))"
    return f"""WITH RECURSIVE {source},
e AS (SELECT 0 AS k, -1::BIGINT AS id, -1::BIGINT AS partner, 0.0::DOUBLE AS d, []::BIGINT[] AS gone UNION ALL
  SELECT k + 1, CASE WHEN side = 0 THEN i ELSE j END, CASE WHEN side = 0 THEN j ELSE i END, pd, list_append(gone, CASE WHEN side = 0 THEN i ELSE j END) FROM (
    SELECT *, ('0x' || substr(md5('0:' || i || ':' || j), 1, 2))::INTEGER % 2 AS side FROM (
      SELECT k, gone, {least}.i AS i, {least}.j AS j, min(p.d) AS pd FROM e, p WHERE k < {count} AND NOT list_contains(gone, i) AND NOT list_contains(gone, j) GROUP BY k, gone)))
SELECT id, partner, round(d, 6) AS sqdist FROM e WHERE k > 0"""


@query("thinned_rows", _thinned_sql(f"{VECTORS}, p AS MATERIALIZED (SELECT l.id AS i, r.id AS j, round({L2}, 9) AS d FROM v l JOIN v r ON l.id < r.id)", 40))
def thinned_rows(s, d):
    return large_kernels.thinned(vectors(s, d), count=40).select("id", "partner", r6("sqdist").alias("sqdist"))


@query(
    "nearest_excluded",
    _thinned_sql("n AS (SELECT c_nationkey::BIGINT AS id, avg(c_acctbal)::DOUBLE / 100 AS x FROM customer GROUP BY c_nationkey), p AS MATERIALIZED (SELECT l.id AS i, r.id AS j, round((l.x - r.x) * (l.x - r.x), 6) AS d FROM n l JOIN n r ON l.id < r.id)", 8),
)
def nearest_excluded(s, d):
    n = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array((F.avg("c_acctbal") / 100).cast("double")).alias("x"))
    return large_kernels.thinned(n, count=8, digits=6).select("id", "partner", r6("sqdist").alias("sqdist"))


#: The same system by conjugate gradients in SQL, over one row that holds the kernel.
@query(
    "large_kernel_ridge",
    f"""WITH RECURSIVE {VECTORS}, kk AS (SELECT l.id AS i, r.id AS j, {gauss(0.5)} AS k FROM v l CROSS JOIN v r), my AS (SELECT avg(z) AS my FROM v),
m AS MATERIALIZED (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(k ORDER BY j) AS row FROM kk GROUP BY i)), b AS (SELECT list(z - my ORDER BY id) AS b, list(id ORDER BY id) AS ids FROM v, my),
c AS (SELECT 0 AS k, list_transform(b, lambda x: 0.0::DOUBLE) AS a, b AS r, b AS p, list_dot_product(b, b) AS rr FROM b UNION ALL
  SELECT k + 1, list_transform(list_zip(a, p), lambda t: t[1] + al * t[2]), r2, list_transform(list_zip(r2, p), lambda t: t[1] + rr2 / rr * t[2]), rr2 FROM (SELECT *, list_dot_product(r2, r2) AS rr2 FROM (
    SELECT *, list_transform(list_zip(r, q), lambda t: t[1] - al * t[2]) AS r2 FROM (SELECT *, rr / list_dot_product(p, q) AS al FROM (
      SELECT c.*, list_transform(m, lambda row, i: list_dot_product(row, p) + 0.01 * p[i]) AS q FROM c, m WHERE k < 80 AND rr > 1e-22))))),
e AS (SELECT a FROM c ORDER BY k DESC LIMIT 1)
SELECT unnest(ids) AS id, round(unnest(list_transform(m, lambda row: list_dot_product(row, a))) + my, 6) AS prediction FROM m, e, b, my""",
)
def large_kernel_ridge(s, d):
    rows = vectors(s, d).withColumn("y", F.col("z").cast("double"))
    model = large_kernels.LargeKernelRidge(Kernel("gaussian", (0.5,)), 0.01, landmarks=256).fit(rows)
    return model.predict(rows).select("id", r6("prediction").alias("prediction"))


# Learning curves: each subset of the training rows chooses its own hyperparameters by leave-one-out errors.


def _subsets(rows: str, sizes: list[int], most: int) -> str:
    """CTEs: the rows (id, ..., y) of ``rows`` in disjoint subsets of each size, labels less their mean ``my``."""
    return f"""sk AS (SELECT r.*, size, {SEED.format(k="size || ':' || id")} AS h FROM {rows} r CROSS JOIN (SELECT unnest({sizes}) AS size)),
sr AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY size ORDER BY h, id) - 1) / size) AS BIGINT) AS subset, floor(count(*) OVER (PARTITION BY size) / size) AS most FROM sk),
m AS MATERIALIZED (SELECT * REPLACE (y - avg(y) OVER (PARTITION BY size, subset) AS y), avg(y) OVER (PARTITION BY size, subset) AS my FROM sr WHERE subset < most AND subset < {most})"""


LINES = """t AS (SELECT o_orderkey AS id, [1.0::DOUBLE, n, q, p, r]::DOUBLE[] AS z, (o_totalprice / 10000)::DOUBLE AS y FROM orders
  JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) / 10 AS q, sum(l_extendedprice) / 10000 AS p, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@query(
    "feature_learning_curve",
    f"""WITH RECURSIVE {LINES}, u AS (SELECT * FROM t WHERE id % 4 <> 0), {_subsets('u', [50, 200], 8)},
g AS (SELECT size, subset, a, b, sum(z[a] * z[b]) AS g FROM m, range(1, 6) p(a), range(1, 6) q(b) GROUP BY size, subset, a, b), gr AS (SELECT size, subset, a, sum(z[a] * y) AS r FROM m, range(1, 6) p(a) GROUP BY size, subset, a),
st AS (SELECT size, subset, l2, a, list(g + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM g, (SELECT unnest({PATH}::DOUBLE[]) AS l2) GROUP BY size, subset, l2, a),
s AS (SELECT {{'size': size, 'subset': subset, 'l2': l2}} AS key, list(list_concat(list_concat(row, list_transform(range(1, 6), lambda c: CASE WHEN c = st.a THEN 1.0 ELSE 0.0 END)), [r]) ORDER BY st.a) AS a FROM st JOIN gr USING (size, subset, a) GROUP BY size, subset, l2),
{_keyed('e', 's', 5)}, w AS (SELECT key.size AS size, key.subset AS subset, key.l2 AS l2, list_transform(a, lambda row: row[6:10]) AS inv, list_transform(a, lambda row: row[11]) AS al FROM e_x),
lo AS (SELECT size, subset, l2, any_value(al) AS al, any_value(my) AS my, avg(abs((list_dot_product(z, al) - y) / (1 - list_dot_product(z, list_transform(inv, lambda row: list_dot_product(row, z)))))) AS loss FROM m JOIN w USING (size, subset) GROUP BY size, subset, l2),
best AS (SELECT size, subset, min(loss) AS loss, arg_min({{'l2': l2, 'al': al, 'my': my}}, loss) AS b FROM lo GROUP BY size, subset)
SELECT size::INTEGER AS size, subset, b.l2 AS l2, round(any_value(best.loss), 6) AS training_loss, round(avg(abs(list_dot_product(z, b.al) + b.my - y)), 6) AS loss, count(*) AS n FROM best, t WHERE t.id % 4 = 0 GROUP BY size, subset, b.l2""",
)
def feature_learning_curve(s, d):
    each = [F.count("*").alias("n"), (F.sum("l_quantity") / 10).alias("q"), (F.sum("l_extendedprice") / 10000).alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("r")]
    rows = table(s, d, "orders").join(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*each), "o_orderkey")
    z = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in "nqpr"])
    rows = rows.select(F.col("o_orderkey").alias("id"), z.alias("z"), (F.col("o_totalprice").cast("double") / 10000).alias("y"))
    points = curves.FeatureCurve([50, 200], PATH).run(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"))
    return points.select("size", "subset", "l2", r6("training_loss").alias("training_loss"), r6("loss").alias("loss"), "n")


_KEYED_20 = _keyed("e", "s", 0).replace("k < 0", "k < len(a)").replace("k = 0)", "k = len(a))")


@query(
    "kernel_learning_curve",
    f"""WITH RECURSIVE t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (vec_id % 7 + 3 * embedding[1]::DOUBLE) AS y FROM embeddings), u AS (SELECT * FROM t WHERE id % 4 <> 0), {_subsets('u', [10, 20], 4)},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY size, subset ORDER BY id) AS a FROM m), d AS (SELECT l.size, l.subset, l.a, r.a AS b, list_distance(l.x, r.x) ** 2 AS d2 FROM o l JOIN o r ON l.size = r.size AND l.subset = r.subset),
st AS (SELECT size, subset, sigma, l2, a, list(exp(-d2 / (2 * sigma * sigma)) + CASE WHEN a = b THEN l2 ELSE 0 END ORDER BY b) AS row FROM d, (SELECT unnest([0.5, 1.0]) AS sigma), (SELECT unnest([0.001, 0.1, 1.0]) AS l2) GROUP BY size, subset, sigma, l2, a),
s AS (SELECT {{'size': size, 'subset': subset, 'sigma': sigma, 'l2': l2}} AS key, list(list_concat(list_concat(row, list_transform(range(1, size + 1), lambda c: CASE WHEN c = st.a THEN 1.0 ELSE 0.0 END)), [y]) ORDER BY st.a) AS a FROM st JOIN o USING (size, subset, a) GROUP BY key),
{_KEYED_20}, w AS (SELECT key, list_transform(a, lambda row: row[2 * key.size + 1]) AS al, list_transform(a, lambda row, i: row[key.size + i]) AS dg FROM e_x),
best AS (SELECT key.size AS size, key.subset AS subset, min(loss) AS loss, arg_min({{'sigma': key.sigma, 'l2': key.l2, 'al': al}}, loss) AS b FROM (SELECT *, list_avg(list_transform(list_zip(al, dg), lambda p: abs(p[1] / p[2]))) AS loss FROM w) GROUP BY key.size, key.subset),
p AS (SELECT t.id, size, subset, any_value(b.sigma) AS sigma, any_value(b.l2) AS l2, any_value(best.loss) AS training_loss, abs(sum(b.al[o.a] * exp(-(list_distance(t.x, o.x) ** 2) / (2 * b.sigma * b.sigma))) + any_value(my) - any_value(t.y)) AS err
  FROM best JOIN o USING (size, subset), t WHERE t.id % 4 = 0 GROUP BY t.id, size, subset)
SELECT size::INTEGER AS size, subset, sigma::DOUBLE AS sigma, l2::DOUBLE AS l2, round(any_value(training_loss), 6) AS training_loss, round(avg(err), 6) AS loss, count(*) AS n FROM p GROUP BY size, subset, sigma, l2""",
)
def kernel_learning_curve(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = e.withColumn("y", F.col("id") % 7 + 3 * F.col("x")[0])
    points = curves.KernelCurve(Kernel("gaussian"), [10, 20], [0.5, 1.0], [0.001, 0.1, 1.0], most=4).run(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"))
    return points.select("size", "subset", "sigma", "l2", r6("training_loss").alias("training_loss"), r6("loss").alias("loss"), "n")
