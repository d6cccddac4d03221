"""Losses, property shifts, moments and weighted means as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

LN2 = math.log(2.0)


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def mse(e: Column) -> Column:
    return F.avg(e * e)


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def huber_term(e: Column, delta: Column | float) -> Column:
    """e**2 / 4d below 2d, |e| - d beyond."""
    d = F.lit(delta) if isinstance(delta, float) else delta
    return F.when(F.abs(e) < 2 * d, e * e / (4 * d)).otherwise(F.abs(e) - d)


def huber(e: Column, delta: float) -> Column:
    return F.avg(huber_term(e, delta))


def logcosh_term(e: Column, delta: float) -> Column:
    """A smooth |e| - d: (d / ln 2) ln cosh(e ln 2 / d), written so that it does not overflow."""
    x = F.abs(e) * (LN2 / delta)
    return (x + F.log1p(F.exp(-2 * x)) - LN2) * (delta / LN2)


def logcosh(e: Column, delta: float) -> Column:
    return F.avg(logcosh_term(e, delta))


def self_consistent_huber(df: DataFrame, e: str, c: float, by: list[str] | None = None) -> DataFrame:
    """The smallest positive L with L = huber(e; c L), in closed form.

    With |e| ascending and m of n errors in the square part, L solves
    4 c L (n + c (n - m)) L = S2 + 4 c L S1, S2 the sum of squares of the first m and S1 the sum of the rest; the
    m that holds is the one for which 2 c L parts the sorted errors at m.  A group's errors are sorted in one task; without ``by``, for a whole table, use
    :func:`self_consistent`.
    """
    if not by:
        raise ValueError("one task would sort the whole table; use self_consistent")
    part = Window.partitionBy(*by)
    order = part.orderBy("a")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    r = df.select(*by, F.abs(F.col(e)).alias("a")).filter("a is not null")
    r = r.withColumns(
        {
            "m": F.row_number().over(order),
            "n": F.count("*").over(part),
            "s2": F.sum(F.col("a") * F.col("a")).over(run),
            "s1": F.sum("a").over(part) - F.sum("a").over(run),
            "next": F.lead("a").over(order),
        }
    )
    p = 4 * c * (F.col("n") + c * (F.col("n") - F.col("m")))
    q = 4 * c * F.col("s1")
    r = r.withColumn("loss", (q + F.sqrt(q * q + 4 * p * F.col("s2"))) / (2 * p))
    fits = (F.col("a") <= 2 * c * F.col("loss")) & (F.col("next").isNull() | (F.col("next") >= 2 * c * F.col("loss")))
    # below all errors, with m = 0: L = mean - c L
    none = F.avg("a") / (1 + c)
    out = r.groupBy(*by).agg(F.min(F.when(fits & (F.col("loss") > 0), F.col("loss"))).alias("inner"), none.alias("outer"), F.min("a").alias("least"))
    return out.select(*by, F.when((F.col("least") >= 2 * c * F.col("outer")), F.col("outer")).otherwise(F.coalesce("inner", F.lit(0.0))).alias("loss"))


def self_consistent(df: DataFrame, e: str, c: float, term, tol: float = 1e-12, rounds: int = 200) -> float:
    """L = mean term(e; c L) for any loss term, by bisection on aggregates; one number a round."""
    top = df.agg(F.avg(F.abs(F.col(e)))).first()[0] or 0.0
    low, high = 0.0, top
    for _ in range(rounds):
        if high - low <= tol * max(high, 1e-300):
            break
        mid = (low + high) / 2
        if df.agg(F.avg(term(F.col(e), c * mid))).first()[0] > mid:
            low = mid
        else:
            high = mid
    return (low + high) / 2


#: Each term's derivative by the error, for terms with a width d.
DERIVATIVES = {
    "mae": lambda e, d: F.signum(e),
    "mse": lambda e, d: 2 * e,
    "huber": lambda e, d: F.when(F.abs(e) < 2 * d, e / (2 * d)).otherwise(F.signum(e)),
    "logcosh": lambda e, d: F.tanh(e * (LN2 / d)),
}
TERMS = {"mae": lambda e, d: F.abs(e), "mse": lambda e, d: e * e, "huber": huber_term, "logcosh": lambda e, d: logcosh_term(e, d)}


def loss_gradients(df: DataFrame, e: str, kind: str, by: list[str], delta: float | None = None, squared: bool = False) -> DataFrame:
    """All columns, the group's ``loss`` and its derivative by each error, ``gradient``.  kind: mae, mse, rmse, huber or logcosh; squared: of the loss's square."""
    base = "mse" if kind == "rmse" else kind
    err, d = F.col(e), None if delta is None else F.lit(float(delta))
    totals = df.groupBy(*by).agg(F.avg(TERMS[base](err, d)).alias("loss"), F.count(e).alias("_n"))
    out = df.join(totals, by).withColumn("gradient", DERIVATIVES[base](err, d) / F.col("_n"))
    if kind == "rmse":
        out = out.withColumn("loss", F.sqrt("loss")).withColumn("gradient", F.when(F.col("loss") > 0, F.col("gradient") / (2 * F.col("loss"))).otherwise(0.0))
    return _squared(out.drop("_n")) if squared else out.drop("_n")


def _squared(df: DataFrame) -> DataFrame:
    return df.withColumn("gradient", 2 * F.col("loss") * F.col("gradient")).withColumn("loss", F.col("loss") * F.col("loss"))


def self_consistent_gradients(df: DataFrame, e: str, losses: DataFrame, by: list[str], c: float, kind: str = "huber", squared: bool = False) -> DataFrame:
    """The same for L = term(e; c L), from each group's solved ``losses`` (by, loss).

    The mean term f is homogeneous: f(t e; t d) = t f(e; d), so its derivative by d follows from those by the errors, and dL/de_i = L f_i / sum e_j f_j.
    """
    d = F.col("loss") * c
    err = F.col(e)
    at = df.join(losses.select(*by, "loss"), by).withColumn("_f", F.when(F.col("loss") > 0, DERIVATIVES[kind](err, d)).otherwise(0.0))
    sums = written(at.groupBy(*by).agg(F.sum(err * F.col("_f")).alias("_s")), "sums")  # of known size, so that few groups are not dealt to few tasks
    out = at.join(sums, by).withColumn("gradient", F.when(F.col("_s") > 0, F.col("loss") * F.col("_f") / F.col("_s")).otherwise(0.0)).drop("_f", "_s")
    return _squared(out) if squared else out


def self_consistent_by(df: DataFrame, e: str, c: float, by: list[str], kind: str = "logcosh", rounds: int = 60) -> DataFrame:
    """(by, loss) with loss = mean term(e; c loss) in each group, as fine as ``rounds`` bisections: Newton steps of all groups at once, an aggregation each, so no group is gathered.

    For terms within c L below |e| (huber, logcosh).  The mean term f falls and is convex in L, and f(t e; t d) = t f(e; d), so from mean |e| / (1 + c), which is below the solution, steps
    L s / (s + L - f) with s = mean e f_e only rise; errors square in each, so half the digits in the last step are enough.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(e).alias("_e")).filter(" and ".join(["_e is not null", *[f"{k} is not null" for k in keys]]))
    state = written(rows.groupBy(*keys).agg((F.avg(F.abs("_e")) / (1 + c)).alias("_l")), "losses")
    d, term, slope = F.col("_l") * c, TERMS[kind], DERIVATIVES[kind]
    for _ in range(rounds):
        means = rows.join(state.filter("_l > 0"), keys).groupBy(*keys, "_l").agg(F.avg(term(F.col("_e"), d)).alias("_f"), F.avg(F.col("_e") * slope(F.col("_e"), d)).alias("_s"))
        new = F.col("_l") * F.col("_s") / (F.col("_s") + F.col("_l") - F.col("_f"))
        done = written(means.select(*keys, F.when(new.isNotNull(), F.greatest(new, F.col("_l"))).otherwise(F.col("_l")).alias("_l"), F.col("_l").alias("_was")), "losses")
        moved = done.agg(F.max((F.col("_l") - F.col("_was")) / F.col("_l"))).first()[0]
        state = done.drop("_was").unionByName(state.filter("_l <= 0"))
        if moved is None or not moved > 2.0 ** (-rounds / 2):
            break
    return state.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_l").alias("loss"))


def weighted_median(df: DataFrame, a: str, b: str, by: list[str] | None = None, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """x that makes sum |a x - b| least: the median of b / a weighted by |a| (the lower one where two do).  Histograms of all groups are narrowed at once, an aggregation to ``bins`` sums a group in each round;
    a task sorts the different values of the last bin only.  See :func:`weighted_median_of_all` for a whole table."""
    if not by:
        raise ValueError("groups are missing; use weighted_median_of_all")
    r = df.select(*by, (F.col(b) / F.col(a)).alias("x"), F.abs(F.col(a)).alias("w")).filter("w > 0 and x is not null")
    ends, keys = ["_low", "_high", "_all", "_before"], [f"_by{k}" for k in range(len(by))]
    state = r.groupBy(*by).agg(F.min("x").alias("_low"), F.max("x").alias("_high"), F.sum("w").alias("_all")).withColumn("_before", F.lit(0.0))
    part = Window.partitionBy(*by)

    def inside():
        small = written(state, "medians").select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *ends)
        same = (F.col("x") >= F.col("_low")) & (F.col("x") <= F.col("_high"))
        for c, k in zip(by, keys, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(k))
        return r.join(small, same).drop(*keys)

    for _ in range(rounds):
        step = (F.col("_high") - F.col("_low")) / bins
        place = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("_low")) / step))).otherwise(0)
        h = inside().groupBy(*by, "_all", "_before", place.alias("_k")).agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        h = h.withColumn("run", F.col("_before") + F.sum("w").over(part.orderBy("_k"))).filter("2 * run >= _all")
        state = h.groupBy(*by).agg(F.min(F.struct("_k", "lo", "hi", "_all", (F.col("run") - F.col("w")).alias("before"))).alias("m"))
        state = state.select(*by, F.col("m.lo").alias("_low"), F.col("m.hi").alias("_high"), F.col("m._all").alias("_all"), F.col("m.before").alias("_before"))
    left = inside().groupBy(*by, "_all", "_before", "x").agg(F.sum("w").alias("w")).withColumn("run", F.col("_before") + F.sum("w").over(part.orderBy("x")))
    return left.groupBy(*by).agg(F.coalesce(F.min(F.when(2 * F.col("run") >= F.col("_all"), F.col("x"))), F.max("x")).alias("x"))


def weighted_median_of_all(df: DataFrame, a: str, b: str, bins: int = 1024, rounds: int = 12) -> float | None:
    """The same over a whole table, by narrowing histograms: each round is one aggregation to ``bins`` sums, and no task sorts all rows."""
    r = df.select((F.col(b) / F.col(a)).alias("x"), F.abs(F.col(a)).alias("w")).filter("w > 0 and x is not null")
    low, high, total = r.agg(F.min("x"), F.max("x"), F.sum("w")).first()
    if total is None:
        return None
    before = 0.0  # weight below ``low``
    for _ in range(rounds):
        step = (high - low) / bins
        if not step or low + step == low:
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(step))).cast("int")
        got = r.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy(place.alias("k")).agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        for k in sorted(got.collect(), key=lambda k: k["k"]):  # at most ``bins`` rows
            if 2 * (before + k["w"]) >= total:
                low, high = k["lo"], k["hi"]
                break
            before += k["w"]
        if low == high:
            break
    return low if 2 * (before + (r.filter(F.col("x") == low).agg(F.sum("w")).first()[0] or 0.0)) >= total else high


def vector_std(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """sqrt of the sum over components of their population variance."""
    by = by or []
    per = df.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "v")).groupBy(*by, "pos").agg(F.var_pop("v").alias("v"))
    return per.groupBy(*by).agg(F.sqrt(F.sum("v")).alias("vector_std"))


def component_moments(df: DataFrame, vec: str, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """pos, mean and population variance of each component, by weight."""
    by = by or []
    w = F.lit(1.0) if weight is None else weight
    r = df.select(*by, w.alias("w"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "v"))
    r = r.groupBy(*by, "pos").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / F.col("w")
    return r.select(*by, "pos", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") / F.col("w") - mean * mean).alias("variance"))


def vector_sum(df: DataFrame, by: list[str], vec: str, weight: Column | None = None, name: str = "x") -> DataFrame:
    """Component-wise (weighted) sums as arrays."""
    w = F.lit(1.0) if weight is None else weight
    r = df.select(*by, w.alias("_w"), F.posexplode(F.col(vec).cast("array<double>")).alias("_pos", "_v"))
    r = r.groupBy(*by, "_pos").agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"))
    return r.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"]).alias(name))


def element_counts(df: DataFrame, mol: str, z: str, elements: list) -> DataFrame:
    return df.groupBy(mol).agg(*[F.count_if(F.col(z) == e).alias(f"n_{e}") for e in elements])


def shift_mean(df: DataFrame, q: str) -> DataFrame:
    """The quantity less its mean, with the mean for adding it back."""
    return df.crossJoin(df.agg(F.avg(q).alias("shift"))).withColumn("shifted", F.col(q) - F.col("shift"))


def dressed_atoms(df: DataFrame, columns: list[str], q: str, intensive: bool = True):
    """Least-squares contribution of each count column (and a constant last); only the small normal equations reach the driver."""
    from .solvers import normal_equations, symmetric_lstsq

    g, r = normal_equations(df, [F.col(c).cast("double") for c in columns] + ([F.lit(1.0)] if intensive else []), F.col(q))
    return symmetric_lstsq(g, r)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
