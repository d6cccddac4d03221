"""Scalar expressions and the periodic table."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element symbols in order of nuclear charge.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
CHARGE = {s: i + 1 for i, s in enumerate(SYMBOLS)}
#: Conversion factors.
UNITS = {"hartree_to_ev": 27.211386245988, "hartree_to_kcal_mol": 627.5094740631, "bohr_to_angstrom": 0.529177210903}


def canonical_symbol(c: Column) -> Column:
    return F.initcap(F.trim(c))


def nuclear_charge(symbol: Column) -> Column:
    """Null for an unknown symbol."""
    table = F.create_map(*[F.lit(x) for s, z in CHARGE.items() for x in (s, z)])
    return F.element_at(table, canonical_symbol(symbol))


def symbol_of(z: Column) -> Column:
    return F.when((z >= 1) & (z <= len(SYMBOLS)), F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), z.cast("int")))


def period_valence(z: Column) -> Column:
    """[period, s, p, d valence electrons] for z up to 18; null beyond."""
    period = F.when(z <= 2, 1).when(z <= 10, 2).otherwise(3)
    valence = z - F.when(z <= 2, 0).when(z <= 10, 2).otherwise(10)
    parts = [period, F.least(valence, F.lit(2)), F.greatest(valence - 2, F.lit(0)), F.lit(0)]
    return F.when((z >= 1) & (z <= 18), F.array(*[p.cast("double") for p in parts]))


def cosine_cutoff(r: Column, rcut: float) -> Column:
    return F.when(r < rcut, 0.5 * (F.cos(r * (math.pi / rcut)) + 1)).otherwise(0.0)


def hermite(x: Column, degree: int, a: float = 1.0) -> Column:
    """The polynomial factor of the n-th derivative of exp(-a x**2), degrees 0 and up, by its recurrence."""
    before, now = F.lit(0.0), F.lit(1.0)
    for n in range(degree):
        before, now = now, -2 * a * x * now - 2 * a * n * before
    return now


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)))).cast("long")


def clamped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def negative_inverse(x: Column) -> Column:
    """-1/x; 0 where x is null, not finite or zero."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == 0)
    return F.when(bad, 0.0).otherwise(-1 / x)


def element_place(z: Column, elements: list[int]) -> Column:
    """Where an element stands in the sorted list; an element that is not in it is an error."""
    known = F.array(*[F.lit(int(e)) for e in sorted(elements)])
    at = F.array_position(known, z.cast("int"))
    return F.when(z.isNotNull() & (at == 0), F.raise_error(F.concat(F.lit("unknown element "), z.cast("string"))).cast("long")).otherwise(at - 1).cast("int")


def outside(v: Column, low: float, high: float) -> Column:
    """Whether v lies outside [low, high)."""
    return (v < low) | (v >= high)
