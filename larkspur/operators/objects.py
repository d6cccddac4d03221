"""Nested objects for multilevel models: lists of components with weights, built from rows by one aggregation for each level of nesting.

The types are those of :func:`levels.datatype`: a vector, a vector with an element id, a struct of ``components`` and ``rhos``, and lists of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import period_valence
from ..functions.vector import as_vector, dot, norm_sq


def checked(objects: DataFrame, vectors: Column, nullable: bool = False) -> DataFrame:
    """The same rows; an error where the arrays of vectors (one array a row) are not all of one size, or where one is null and ``nullable`` is not set.

    Sizes are compared by two numbers over all rows, which one aggregation gives.
    """
    sizes = F.transform(vectors, lambda v: F.size(v))
    r = objects.agg(F.min(F.array_min(F.filter(sizes, lambda n: n >= 0))), F.max(F.array_max(sizes)), F.count_if(F.exists(vectors, lambda v: v.isNull()) | vectors.isNull())).first()
    if r[0] != r[1]:
        raise ValueError(f"vectors of {r[0]} to {r[1]} components")
    if r[2] and not nullable:
        raise ValueError(f"{r[2]} objects without a vector")
    return objects


def with_element(rows: DataFrame, vec: str = "x", z: str = "z") -> DataFrame:
    """Column ``component``: the vector and its element."""
    return rows.withColumn("component", F.struct(as_vector(vec).alias("representation"), F.col(z).cast("int").alias("element_id")))


def with_valence_columns(rows: DataFrame, vec: str = "x", z: str = "z", length: int = 4) -> DataFrame:
    """Column ``component``: the vector behind the first ``length`` of period and valence electrons of its element."""
    return rows.withColumn("component", F.concat(F.slice(period_valence(F.col(z)), 1, length), as_vector(vec)))


def with_vector(rows: DataFrame, vec: str = "x") -> DataFrame:
    return rows.withColumn("component", as_vector(vec))


def lists(rows: DataFrame, by: list[str], order: list[str], name: str = "object") -> DataFrame:
    """(by, object): the components of a group in order."""
    s = F.sort_array(F.collect_list(F.struct(*order, F.struct("component").alias("_c"))))
    return rows.groupBy(*by).agg(F.transform(s, lambda t: t["_c"]["component"]).alias(name))


def weighted_lists(rows: DataFrame, by: list[str], order: list[str], weight: str, name: str = "object", normalised: bool = False) -> DataFrame:
    """(by, object) with components and rhos: mixtures, ensembles, or processes whose parts weigh -1 and 1.  ``normalised``: weights over their sum."""
    got = F.sort_array(F.collect_list(F.struct(*order, F.col(weight).cast("double").alias("_w"), F.struct("component").alias("_c"))))
    out = rows.groupBy(*by).agg(got.alias("_l"), F.sum(F.col(weight).cast("double")).alias("_total"))
    rho = (lambda t: t["_w"] / F.col("_total")) if normalised else (lambda t: t["_w"])
    return out.select(*by, F.struct(F.transform("_l", lambda t: t["_c"]["component"]).alias("components"), F.transform("_l", rho).alias("rhos")).alias(name))


def ensembles(conformers: DataFrame, by: str, conformer: str, weight: str, cut: float | None = None) -> DataFrame:
    """(by, object): an ensemble's conformers, heaviest first, weights normalised, those below the cut left out; the rows have ``component``."""
    from .ranking import cut_weights, normalised_weights

    rows = normalised_weights(conformers, [by], weight, [conformer]) if cut is None else cut_weights(conformers, [by], weight, [conformer], cut)
    return weighted_lists(rows, [by], ["place"], "rho")


def orbital_objects(rows: DataFrame, element: str | None = None) -> DataFrame:
    """(mol, object) from orbital rows (mol, orb, orb_rho, arep, rho, v): orbitals with their weights, each of contributions with theirs.

    With ``element``, contributions carry their atom's element.  Pairs of states (:func:`orbitals.determinant_pairs`) come out as one object whose first state weighs negative.
    """
    parts = with_vector(rows, "v") if element is None else with_element(rows, "v", element)
    orbs = weighted_lists(parts, ["mol", "orb", "orb_rho"], ["arep"], "rho", "component")
    return weighted_lists(orbs, ["mol"], ["orb"], "orb_rho")


def flattened(objects: DataFrame, key: str, name: str = "object") -> DataFrame:
    """(key, place, rho, component): the components of weighted lists as rows again."""
    return objects.select(key, F.posexplode(F.arrays_zip(F.col(name)["components"].alias("component"), F.col(name)["rhos"].alias("rho"))).alias("place", "_e")).select(key, "place", "_e.rho", "_e.component")


def principal_components(objects: DataFrame, basis: list[list[float]], name: str = "object", remainder: bool = False) -> DataFrame:
    """All vectors of weighted lists as coordinates along the rows of ``basis``, and the norm of what these leave if ``remainder``; weights stay."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in basis])

    def f(v: Column) -> Column:
        c = F.transform(rows, lambda b: dot(b, v))
        return F.concat(c, F.array(F.sqrt(F.greatest(F.lit(0.0), norm_sq(v) - norm_sq(c))))) if remainder else c

    return objects.withColumn(name, F.struct(F.transform(F.col(name)["components"], f).alias("components"), F.col(name)["rhos"].alias("rhos")))
