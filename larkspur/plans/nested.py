"""Queries of nested objects, compounds and orbital matrices, with SQL for the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import objects as O
from ..operators import orbitals, representations
from ..sources import compounds, store
from .catalogue import ATOMS, RHO, VECTORS, _weights, atoms, query, r6, table, vectors
from .everyday import SYMBOL, _symbol
from .systems import SUPPLIERS, orbital_rows, supplier_atoms


@query("objects_of_atoms", f"WITH {VECTORS} SELECT mol, row_number() OVER (PARTITION BY mol ORDER BY id) - 1 AS place, z AS element, round(list_sum(x), 6) AS total, CASE WHEN z BETWEEN 1 AND 2 THEN 1.0 WHEN z > 2 THEN 2.0 END AS period FROM v")
def objects_of_atoms(s, d):
    rows = O.with_element(vectors(s, d))
    o = O.checked(O.lists(rows, ["mol"], ["id"]), F.transform(F.col("object"), lambda c: c["representation"]))
    valence = O.lists(O.with_valence_columns(vectors(s, d)), ["mol"], ["id"], "valence")
    both = o.join(valence, "mol").select("mol", F.posexplode(F.arrays_zip("object", "valence")).alias("place", "e"))
    return both.select("mol", F.col("place").cast("long").alias("place"), F.col("e.object.element_id").alias("element"), r6(V.total(F.col("e.object.representation"))).alias("total"), F.get("e.valence", F.lit(0)).alias("period"))


@query("objects_of_molecules", f"WITH {ATOMS} SELECT mol, 0.0 + round(sqrt(sum(pow(0.5 * pow(z, 2.4), 2))), 6) AS diagonal, count(*) AS atoms FROM a GROUP BY mol")
def objects_of_molecules(s, d):
    mols = representations.molecules(atoms(s, d))
    size = max(16, table(s, d, "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0] or 0)  # places for the largest molecule
    rows = representations.represented_many(mols, lambda z, r: representations.coulomb_many(z, r, size), False)
    o = O.checked(O.with_vector(rows), F.array("component"))
    places = [k * (k + 3) // 2 for k in range(size)]  # of the diagonal in a lower triangle by rows
    diagonal = F.array(*[F.get("component", F.lit(p)) for p in places])
    return o.select("mol", r6(V.norm(diagonal)).alias("diagonal"), F.size(F.filter(diagonal, lambda v: v > 0)).cast("long").alias("atoms"))


@query(
    "ensemble_objects",
    f"""WITH {RHO}, r AS (SELECT *, greatest(0, 1 - sum(rho) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING)) AS rest, count(*) OVER (PARTITION BY l_orderkey) AS size FROM s),
k AS (SELECT *, CASE WHEN size = 1 THEN 1 ELSE coalesce(max(CASE WHEN place * rho + rest > 0.1 THEN place END) OVER (PARTITION BY l_orderkey), 1) END AS last FROM r),
x AS (SELECT *, max(CASE WHEN place = last THEN rest END) OVER (PARTITION BY l_orderkey) AS rest_k FROM k), t AS (SELECT *, CASE WHEN size = 1 THEN rho ELSE greatest(0, rho - (0.1 - rest_k) / last) END AS trimmed FROM x WHERE place <= last)
SELECT l_orderkey, (place - 1)::INTEGER AS place, round(trimmed / sum(trimmed) OVER (PARTITION BY l_orderkey), 6) AS rho, round(l_extendedprice, 2) AS price FROM t""",
)
def ensemble_objects(s, d):
    rows = O.with_vector(_weights(s, d).withColumn("x", F.array("l_extendedprice", "l_quantity")))
    return O.flattened(O.ensembles(rows, "l_orderkey", "conf", "l_quantity", 0.1), "l_orderkey").select("l_orderkey", "place", r6("rho").alias("rho"), r6(F.col("component")[0], 2).alias("price"))


@query("process_objects", f"WITH {VECTORS} SELECT id // 2 AS pair, round(list_sum(x) * CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END, 6) + 0.0 AS v, (id % 2)::INTEGER AS place FROM v")
def process_objects(s, d):
    rows = O.with_vector(vectors(s, d).withColumn("pair", F.floor(F.col("id") / 2)).withColumn("w", F.when(F.col("id") % 2 == 0, -1).otherwise(1)))
    return O.flattened(O.weighted_lists(rows, ["pair"], ["id"], "w"), "pair").select("pair", (r6(V.total("component") * F.col("rho")) + 0.0).alias("v"), "place")


@query("mixture_objects", f"WITH {VECTORS}, g AS (SELECT mol, sum(z + 1) AS w FROM v GROUP BY mol) SELECT mol, round(sum((z + 1.0) / w * x[3]), 6) + 0.0 AS v, count(*) AS parts FROM v JOIN g USING (mol) GROUP BY mol")
def mixture_objects(s, d):
    rows = O.with_vector(vectors(s, d).withColumn("w", F.col("z") + 1))
    o = O.flattened(O.weighted_lists(rows, ["mol"], ["id"], "w", normalised=True), "mol")
    return o.groupBy("mol").agg((r6(F.sum(F.col("rho") * F.col("component")[2])) + 0.0).alias("v"), F.count("*").alias("parts"))


@query("orbital_nested", f"WITH {VECTORS} SELECT CAST(floor(id / 40) AS BIGINT) AS mol, CAST(floor(id / 4) AS BIGINT) % 10 AS place, round(sum((z + 1) / 10.0 * x[2]), 6) + 0.0 AS v, sum(z) AS elements, CASE WHEN floor(id / 4) % 2 = 0 THEN -0.5 ELSE 0.5 END AS rho FROM v GROUP BY floor(id / 40), floor(id / 4)")
def orbital_nested(s, d):
    z = vectors(s, d).select(F.col("id").alias("arep"), "z")
    rows = orbital_rows(s, d).join(z, "arep").withColumn("orb_rho", F.when(F.col("orb") % 2 == 0, -F.col("orb_rho")).otherwise(F.col("orb_rho")))
    o = O.flattened(O.orbital_objects(rows, "z"), "mol").withColumnRenamed("component", "object")
    parts = F.zip_with(F.col("object")["components"], F.col("object")["rhos"], lambda c, r: c["representation"][1] * r)
    elements = F.aggregate(F.col("object")["components"], F.lit(0), lambda a, c: a + c["element_id"])
    return o.select("mol", F.col("place").cast("long").alias("place"), (r6(V.total(parts)) + 0.0).alias("v"), elements.cast("decimal(38,0)").cast("double").alias("elements"), "rho")


@query("principal_components", f"WITH {VECTORS}, c AS (SELECT mol, id, z, (x[1] + x[2]) / sqrt(2.0) AS a, (x[1] - x[2]) / sqrt(2.0) AS b, list_dot_product(x, x) AS n FROM v) SELECT mol, round(sum(a), 6) + 0.0 AS a, round(sum(b), 6) + 0.0 AS b, round(sum(sqrt(greatest(0, n - a * a - b * b))), 6) AS rest FROM c GROUP BY mol")
def principal_components(s, d):
    r = 1 / math.sqrt(2)
    basis = [[r, r] + [0.0] * 62, [r, -r] + [0.0] * 62]
    rows = O.with_vector(vectors(s, d).withColumn("w", F.lit(1.0)))
    o = O.flattened(O.principal_components(O.weighted_lists(rows, ["mol"], ["id"], "w"), basis, remainder=True), "mol")
    at = lambda k: r6(F.sum(F.col("component")[k])) + 0.0
    return o.groupBy("mol").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("rest"))


# Compounds.

_PAIRED = f"WITH {SUPPLIERS}, c AS (SELECT mol::VARCHAR AS name, count(*) AS atoms FROM a GROUP BY mol)"


def _bodies(s, d):
    from ..sources import xyz

    return xyz.xyz_text(supplier_atoms(s, d).select(F.col("mol").cast("string").alias("name"), "atom", _symbol().alias("symbol"), "x", "y", "c"))


@query("compound_options", f"{_PAIRED} SELECT name, s.side, atoms, CASE side WHEN 0 THEN 'sto-3g' ELSE 'minao' END AS basis, CASE side WHEN 0 THEN '0' ELSE '1' END AS charge FROM c CROSS JOIN (SELECT unnest([0, 1]) AS side) s")
def compound_options(s, d):
    both = compounds.option_pairs(_bodies(s, d), {"basis": "sto-3g", "charge": 0}, {"basis": "minao", "charge": 1})
    return both.select("name", "side", F.split("body", "\n")[0].cast("long").alias("atoms"), F.col("options")["basis"].alias("basis"), F.col("options")["charge"].alias("charge"))


@query("compound_pairs", f"{_PAIRED} SELECT 'p' || l.name AS pair, 0 AS side, l.name, l.atoms FROM c l JOIN c r ON r.name::BIGINT = l.name::BIGINT + 1 UNION ALL SELECT 'p' || l.name, 1, r.name, r.atoms FROM c l JOIN c r ON r.name::BIGINT = l.name::BIGINT + 1")
def compound_pairs(s, d):
    f = _bodies(s, d)
    n = f.select(F.col("name").cast("long").alias("k"))
    pairs = n.join(n.select((F.col("k") - 1).alias("k")), "k").select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("pair"), F.col("k").cast("string").alias("first"), (F.col("k") + 1).cast("string").alias("second"))
    return compounds.file_pairs(f, pairs, basis="sto-3g").select("pair", "side", "name", F.split("body", "\n")[0].cast("long").alias("atoms"))


@query("compounds_from_files", f"WITH {SUPPLIERS} SELECT count(*) AS atoms, count(DISTINCT mol) AS molecules, 'sto-3g' AS basis FROM a")
def compounds_from_files(s, d):
    from ..sources import xyz

    path = store.scratch(s, "compounds")
    xyz.write_xyz(supplier_atoms(s, d).select(F.col("mol").cast("string").alias("name"), "atom", _symbol().alias("symbol"), "x", "y", "c"), path)
    c = compounds.compounds(s, f"{path}/*", basis="sto-3g")
    return c.agg(F.sum(F.split("body", "\n")[0].cast("long")).alias("atoms"), F.count("*").alias("molecules"), F.max(F.col("options")["basis"]).alias("basis"))


class _Structure:
    def __init__(self, z, r):
        self.z, self.r = z, r

    def get_atomic_numbers(self):
        return self.z

    def get_positions(self):
        return self.r


@query("compounds_from_objects", "SELECT n_nationkey::BIGINT AS name, u.k::BIGINT AS atom, (u.k + 1)::INTEGER AS z, n_regionkey + u.k * 0.5 AS x FROM nation CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) u")
def compounds_from_objects(s, d):
    n = table(s, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()  # nations
    atoms = compounds.atoms_of(s, [_Structure([1, 2, 3], [[r["n_regionkey"] + k * 0.5, 0.0, 0.0] for k in range(3)]) for r in n])
    return atoms.select("name", "atom", "z", "x")


@query("results_by_option", "SELECT event_type AS kind, event_id % 2 AS option, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type, event_id % 2")
def results_by_option(s, d):
    path = store.scratch(s, "options")
    e = table(s, d, "events").select("event_id", "value", F.col("event_type").alias("kind"), (F.col("event_id") % 2).alias("option"))
    for k in (0, 1):
        compounds.save_results(e.filter(F.col("option") == k), path, ["kind", "option"])
    back = store.load_table(s, path).select("value", F.col("kind").cast("string").alias("kind"), F.col("option").cast("long").alias("option"))
    return back.groupBy("kind", "option").agg(r6(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


# Orbitals from matrices of three basis functions a nation: two on the first atom (momenta 0 and 1), one on the second.

_N = "(n_nationkey + 1)"
MATRICES = f"""n AS (SELECT n_nationkey AS mol, [[1.0, 0.1, 0.2], [0.1, 1.0, 0.05 * {_N}], [0.2, 0.05 * {_N}, 1.0]]::DOUBLE[][] AS s, [[0.5, 0.3, 0.01 * {_N}], [0.2, 0.02 * {_N}, 0.4], [0.6, 0.1, 0.3]]::DOUBLE[][] AS c,
  [-1.0, -0.1 * {_N}, 0.5]::DOUBLE[] AS e, [2.0, 2.0, 0.0]::DOUBLE[] AS o FROM nation), ix AS (SELECT unnest([1, 2, 3]) AS i), jx AS (SELECT unnest([1, 2, 3]) AS j), kx AS (SELECT unnest([1, 2, 3]) AS k),
sc AS (SELECT mol, i, k, s[i][1] * c[1][k] + s[i][2] * c[2][k] + s[i][3] * c[3][k] AS v, e[k] AS e, o[k] AS o FROM n, ix, kx)"""


def _matrices(s, d):
    n = (F.col("n_nationkey") + 1).cast("double")
    one = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    overlap = one(1.0, 0.1, 0.2, 0.1, 1.0, 0.05 * n, 0.2, 0.05 * n, 1.0)
    coeff = one(0.5, 0.3, 0.01 * n, 0.2, 0.02 * n, 0.4, 0.6, 0.1, 0.3)
    return table(s, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("mol"), overlap.alias("overlap"), coeff.alias("coeff"), one(-1.0, -0.1 * n, 0.5).alias("energy"), one(2.0, 2.0, 0.0).alias("occ"),
        F.array(F.lit(0), F.lit(1), F.lit(0)).alias("momenta"), F.array(F.lit(0), F.lit(2)).alias("starts"),
    )


def _each(s, d, f, ddl: str):
    """Rows of f(mol, overlap, coeff, energy, occ) for each nation, on the executors."""
    import pyarrow as pa

    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += [(r["mol"], *x) for x in f(np.array(r["overlap"]).reshape(3, 3), np.array(r["coeff"]).reshape(3, 3), np.array(r["energy"]), np.array(r["occ"]))]
            yield pa.RecordBatch.from_pydict({n: [x[i] for x in rows] for i, n in enumerate(names)})

    return _matrices(s, d).mapInArrow(run, ddl)


@query("orbital_propagators", f"WITH {MATRICES}, t AS (SELECT a.mol, a.i, b.i AS j, sum(a.v * cos(a.e * 0.7) * b.v) AS re, sum(a.v * sin(a.e * 0.7) * b.v) AS im FROM sc a JOIN sc b ON a.mol = b.mol AND a.k = b.k GROUP BY a.mol, a.i, b.i) SELECT mol::BIGINT AS mol, (i - 1)::BIGINT AS i, (j - 1)::BIGINT AS j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM t")
def orbital_propagators(s, d):
    def f(overlap, coeff, energy, occ):
        re, im = orbitals.propagators(coeff, energy, overlap, [0.7])
        return [(i, j, float(re[i, j]), float(im[i, j])) for i in range(3) for j in range(3)]

    return _each(s, d, f, "mol long, i long, j long, re double, im double").select("mol", "i", "j", (r6("re") + 0.0).alias("re"), (r6("im") + 0.0).alias("im"))


@query("orbital_rebuilt", f"WITH {MATRICES}, t AS (SELECT a.mol, a.i, b.i AS j, sum(a.v * a.e * b.v) AS f, sum(a.v * a.o * b.v) AS d FROM sc a JOIN sc b ON a.mol = b.mol AND a.k = b.k GROUP BY a.mol, a.i, b.i) SELECT mol::BIGINT AS mol, (i - 1)::BIGINT AS i, (j - 1)::BIGINT AS j, round(f + 1e-8, 6) + 0.0 AS fock, round(d + 1e-8, 6) + 0.0 AS density FROM t")
def orbital_rebuilt(s, d):
    def f(overlap, coeff, energy, occ):
        _, fock, density = orbitals.rebuilt_matrices(coeff, energy, occ, overlap)
        return [(i, j, float(fock[i, j]), float(density[i, j])) for i in range(3) for j in range(3)]

    return _each(s, d, f, "mol long, i long, j long, fock double, density double").select("mol", "i", "j", (r6(F.col("fock") + 1e-8) + 0.0).alias("fock"), (r6(F.col("density") + 1e-8) + 0.0).alias("density"))


# An orbital's populations: functions 1 (momentum 0) and 2 (momentum 1) on the first atom, 3 (momentum 0) on the second; couplings by momenta inside an atom (l <= l') and with the rest.
_POP = f"""{MATRICES}, q AS (SELECT mol, k, [c[1][k], c[2][k], c[3][k]] AS c, s, o[k] AS o FROM n, kx WHERE k <= 2), w AS (SELECT *, c[1] * list_dot_product(s[1], c) AS p0, c[2] * list_dot_product(s[2], c) AS p1, c[3] * list_dot_product(s[3], c) AS q0 FROM q),
r AS (SELECT mol, k, o, 0 AS atom, p0 + p1 AS rho, [p0, p1] AS pops FROM w UNION ALL SELECT mol, k, o, 1, q0, [q0, 0.0] FROM w)"""


@query("orbital_representation", f"WITH {_POP}, u AS (SELECT *, sum(rho) OVER (PARTITION BY mol, k) AS total, max(rho) OVER (PARTITION BY mol, k) AS top FROM r WHERE rho > 1e-12), z AS (SELECT *, top >= 0.95 * total AS alone FROM u) SELECT mol::BIGINT AS mol, (k - 1)::BIGINT AS orb, o AS orb_rho, atom::BIGINT AS arep, round(CASE WHEN alone THEN 1.0 ELSE rho / total END, 6) AS rho, round(pops[1] / rho, 6) + 0.0 AS s_part, round(pops[2] / rho, 6) + 0.0 AS p_part FROM z WHERE NOT alone OR rho = top")
def orbital_representation(s, d):
    rows = orbitals.representation_rows(_matrices(s, d))
    return rows.select("mol", "orb", "orb_rho", "arep", r6("rho").alias("rho"), (r6(F.col("v")[0]) + 0.0).alias("s_part"), (r6(F.col("v")[1]) + 0.0).alias("p_part"))


@query(
    "orbital_couplings",
    f"""WITH {MATRICES}, q AS (SELECT mol, k, [c[1][k], c[2][k], c[3][k]] AS c, s FROM n, kx)
SELECT mol::BIGINT AS mol, (k - 1)::BIGINT AS orb, round(c[1] * s[1][1] * c[1], 6) + 0.0 AS own_ss, round(c[1] * s[1][3] * c[3], 6) + 0.0 AS rest_ss, round(c[1] * s[1][2] * c[2], 6) + 0.0 AS own_sp, round(c[2] * s[2][3] * c[3], 6) + 0.0 AS rest_ps, round(c[2] * s[2][2] * c[2], 6) + 0.0 AS own_pp FROM q""",
)
def orbital_couplings(s, d):
    def f(overlap, coeff, energy, occ):
        out = []
        for k in range(3):
            v = orbitals.angular_couplings(coeff[:, k], [overlap], np.array([0, 1, 0]), (0, 2), 1)  # ss own, ss rest, sp own, sp rest, ps rest, pp own, pp rest
            out.append((k, v[0], v[1], v[2], v[4], v[5]))
        return [(k, *map(float, v)) for k, *v in out]

    names = ("own_ss", "rest_ss", "own_sp", "rest_ps", "own_pp")
    return _each(s, d, f, "mol long, orb long, " + ", ".join(f"{n} double" for n in names)).select("mol", "orb", *[(r6(n) + 0.0).alias(n) for n in names])
