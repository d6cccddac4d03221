"""Column expressions over ``array<double>`` vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm_sq(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm_sq(a))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def divided(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def normalised(a: Column) -> Column:
    """v / |v|; the zero vector stays."""
    return F.when(norm_sq(a) > 0, divided(a, norm(a))).otherwise(a)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column) -> Column:
    """Of the whole vector, not of a sample."""
    return F.sqrt(F.greatest(F.lit(0.0), norm_sq(a) / F.size(a) - mean(a) * mean(a)))


def median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def argmin(a: Column) -> Column:
    """The first place, from 0, of the least component."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argsort(a: Column) -> Column:
    """Places, from 0, in the order of the components; equal ones as they stand."""
    return F.transform(F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def cross(a: Column, b: Column) -> Column:
    p = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[p(a, i) * p(b, j) - p(a, j) * p(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def matrix_product(rows: Column, v: Column) -> Column:
    """Of a matrix, an array of rows, and a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def trace(rows: Column) -> Column:
    return total(F.transform(rows, lambda r, i: F.get(r, i)))


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / (n - 1)))


def joined(a: Column, b: Column) -> Column:
    """One after the other; null counts as empty."""
    empty = F.array().cast("array<double>")
    return F.concat(F.coalesce(a, empty), F.coalesce(b, empty))


def masked(a: Column, mask: Column) -> Column:
    """Zero where the mask is true."""
    return F.zip_with(a, mask, lambda x, m: F.when(m, 0.0).otherwise(x))


def padded(a: Column, size: int) -> Column:
    """Zero-padded or cut to ``size``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def ranges_divided(a: Column, by: list[float], bounds: list[int]) -> Column:
    """Divide index ranges [bounds[k], bounds[k+1]) by by[k]."""
    per = F.array(*[F.lit(float(s)) for s, n in zip(by, map(int.__sub__, bounds[1:], bounds[:-1]), strict=True) for _ in range(n)])
    return F.zip_with(a, per, lambda x, s: x / s)


def powers_divided(a: Column, by: float, powers: list[float]) -> Column:
    """Divide component i by ``by ** powers[i]``; powers repeat over the vector."""
    per = F.array(*[F.lit(float(by) ** p) for p in powers])
    return F.transform(a, lambda x, i: x / F.element_at(per, i % len(powers) + 1))


def compressed(a: Column, weights: list[float]) -> Column:
    """Weighted sums of consecutive blocks of len(weights) components."""
    n = len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / n).cast("int") - 1), lambda k: dot(F.slice(a, k * n + 1, F.lit(n)), w))


def hadamard(a: Column, size: int) -> Column:
    """The Walsh-Hadamard transform of a vector of ``size`` = 2**m components, divided by sqrt(size): sums by the parity of common bits."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    signed = lambda j: F.transform(a, lambda x, i: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, x).otherwise(-x))
    return F.transform(places, lambda j: total(signed(j)) / F.lit(float(size) ** 0.5))
