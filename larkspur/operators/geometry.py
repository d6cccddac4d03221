"""Atoms as rows (mol, atom, z, x, y, c): neighbours, periodic images, pair potentials, and vectors built from pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d2(a: str = "l", b: str = "r") -> Column:
    return sum(((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in ("y", "c")), (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))


def pairs(atoms: DataFrame, other: DataFrame | None = None, both: bool = True) -> DataFrame:
    """All pairs of different atoms of a molecule (``both`` orders, or atom > other): (mol, i, j, zi, zj, r)."""
    other = atoms if other is None else other
    cond = (F.col("l.mol") == F.col("r.mol")) & (F.col("l.atom") != F.col("r.atom") if both else F.col("l.atom") > F.col("r.atom"))
    return atoms.alias("l").join(other.alias("r"), cond).select(
        F.col("l.mol").alias("mol"), F.col("l.atom").alias("i"), F.col("r.atom").alias("j"), F.col("l.z").alias("zi"), F.col("r.z").alias("zj"), F.sqrt(_d2()).alias("r")
    )


def neighbours(atoms: DataFrame, rcut: float, small: int = 64) -> DataFrame:
    """(mol, i, j, r) with r < rcut.

    One equi-join over molecule and cell: a molecule of at most ``small`` atoms is one cell; larger ones have cells of edge rcut, where each atom meets its own cell and the 26
    around, so that pairs grow with the atoms and not with their square.
    """
    large = atoms.groupBy("mol").agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select("mol", F.lit(1).alias("_large"))
    big, axes = F.col("_large").isNotNull(), ("x", "y", "c")
    left = atoms.join(large, "mol", "left").select("mol", "atom", *axes, "_large", *[F.when(big, F.floor(F.col(k) / rcut)).otherwise(0).alias(f"c{k}") for k in axes])
    right = left
    for k in axes:
        right = right.withColumn("_s", F.explode(F.when(big, F.array(*[F.lit(t) for t in (-1, 0, 1)])).otherwise(F.array(F.lit(0))))).withColumn(f"c{k}", F.col(f"c{k}") + F.col("_s")).drop("_s")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("mol", "cx", "cy", "cc")]
    near = (F.col("l.atom") != F.col("r.atom")) & (_d2() < rcut * rcut)
    out = [F.col("l.mol").alias("mol"), F.col("l.atom").alias("i"), F.col("r.atom").alias("j"), F.sqrt(_d2()).alias("r")]
    return left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & same[3] & near).select(*out)


def too_close(points: DataFrame, atoms: DataFrame, least: float, small: int = 64) -> DataFrame:
    """The rows of ``points`` that have an atom of their molecule nearer than ``least``: a semi join.  Molecules of at most ``small`` atoms meet whole; larger ones by cells of edge ``least``, each atom in its own and the 26 around."""
    axes = ("x", "y", "c")
    large = atoms.groupBy("mol").agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select("mol", F.lit(1).alias("_large"))
    cell = [F.when(F.col("_large").isNotNull(), F.floor(F.col(k) / least)).otherwise(0).alias(f"c{k}") for k in axes]
    left = points.join(large, "mol", "left").select(*[points[k] for k in points.columns], *cell)
    right = atoms.join(large, "mol", "left").select("mol", *axes, "_large", *cell)
    for k in axes:
        right = right.withColumn("_s", F.explode(F.when(F.col("_large").isNotNull(), F.array(*[F.lit(t) for t in (-1, 0, 1)])).otherwise(F.array(F.lit(0))))).withColumn(f"c{k}", F.col(f"c{k}") + F.col("_s")).drop("_s")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("mol", "cx", "cy", "cc")]
    return left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & same[3] & (_d2() < least * least), "left_semi").drop("cx", "cy", "cc")


def torsions(atoms: DataFrame) -> DataFrame:
    """(mol, atom, angle): the angle of each four atoms in a row about the middle bond, in (-pi, pi]; null where it is not defined."""
    w = Window.partitionBy("mol").orderBy("atom")
    bond = lambda n: [F.lead(k, n + 1).over(w) - (F.lead(k, n).over(w) if n else F.col(k)) for k in ("x", "y", "c")]
    t = atoms.select("mol", "atom", *[v.alias(f"{k}{n}") for n in range(3) for k, v in zip("xyc", bond(n), strict=True)])
    u, v, q = ([F.col(f"{k}{n}") for k in "xyc"] for n in range(3))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    one, two = _cross(u, v), _cross(v, q)
    t = t.filter("x2 is not null").select("mol", "atom", (dot(_cross(one, two), v) / F.sqrt(dot(v, v))).alias("s"), dot(one, two).alias("k"))
    return t.select("mol", "atom", F.when((F.col("s") != 0) | (F.col("k") != 0), F.atan2("s", "k")).alias("angle"))


def periodic_images(atoms: DataFrame, cell: list[list[float]], rcut: float) -> DataFrame:
    """All atoms and those images by whole cell vectors that lie within rcut of an atom of the molecule: (…, na, nb, nc), 0 for the atoms."""
    volume = abs(_det(cell))
    heights = [volume / _norm(_cross(cell[(k + 1) % 3], cell[(k + 2) % 3])) for k in range(3)]
    spans = atoms.groupBy("mol").agg(*[F.min(k).alias(f"lo{k}") for k in "xyc"], *[F.max(k).alias(f"hi{k}") for k in "xyc"])
    reach = F.sqrt(sum(((F.col(f"hi{k}") - F.col(f"lo{k}")) * (F.col(f"hi{k}") - F.col(f"lo{k}")) for k in "yc"), (F.col("hix") - F.col("lox")) * (F.col("hix") - F.col("lox")))) + rcut
    out = atoms.join(spans, "mol")
    for n, h in zip(("na", "nb", "nc"), heights, strict=True):
        k = F.ceil(reach / h).cast("int")
        out = out.withColumn(n, F.explode(F.sequence(-k, k)))
    for i, k in enumerate("xyc"):
        out = out.withColumn(k, F.col(k) + F.col("na") * float(cell[0][i]) + F.col("nb") * float(cell[1][i]) + F.col("nc") * float(cell[2][i]))
    near = None
    for k in "xyc":
        inside = (F.col(k) > F.col(f"lo{k}") - rcut) & (F.col(k) < F.col(f"hi{k}") + rcut)
        near = inside if near is None else near & inside
    names = [*atoms.columns, "na", "nb", "nc"]
    own = (F.col("na") == 0) & (F.col("nb") == 0) & (F.col("nc") == 0)
    images = out.filter(near & ~own).select(*names)
    close = images.alias("l").join(atoms.alias("r"), (F.col("l.mol") == F.col("r.mol")) & (_d2() < rcut * rcut), "left_semi").select(*[F.col(f"l.{n}") for n in names])
    return out.filter(own).select(*names).union(close)


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _norm(a):
    return math.sqrt(sum(x * x for x in a))


def _det(c):
    return sum(x * y for x, y in zip(c[0], _cross(c[1], c[2]), strict=True))


def pair_energy(atoms: DataFrame) -> DataFrame:
    """(mol, energy): sum over pairs of z z' (r**-12 - r**-6)."""
    inv = 1 / (F.col("r") * F.col("r"))
    return pairs(atoms, both=False).groupBy("mol").agg(F.sum((F.pow(inv, F.lit(6)) - F.pow(inv, F.lit(3))) * F.col("zi") * F.col("zj")).alias("energy"))


def pair_forces(atoms: DataFrame) -> DataFrame:
    """(mol, atom, fx, fy, fc) of the same potential."""
    cond = (F.col("l.mol") == F.col("r.mol")) & (F.col("l.atom") != F.col("r.atom"))
    inv = 1 / _d2()
    size = (12 * F.pow(inv, F.lit(7)) - 6 * F.pow(inv, F.lit(4))) * F.col("l.z") * F.col("r.z")
    parts = [F.sum((F.col(f"l.{k}") - F.col(f"r.{k}")) * size).alias(f"f{k}") for k in "xyc"]
    return atoms.alias("l").join(atoms.alias("r"), cond).groupBy(F.col("l.mol").alias("mol"), F.col("l.atom").alias("atom")).agg(*parts)


def dipole(atoms: DataFrame) -> DataFrame:
    """(mol, dipole): the length of the sum of (mean z - z) times position."""
    centred = atoms.withColumn("q", F.avg("z").over(Window.partitionBy("mol")) - F.col("z"))
    sums = centred.groupBy("mol").agg(*[F.sum(F.col("q") * F.col(k)).alias(k) for k in "xyc"])
    return sums.select("mol", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("c") * F.col("c")).alias("dipole"))


def coulomb_matrix(atoms: DataFrame, size: int = 29) -> DataFrame:
    """(mol, x): lower triangle by rows of the matrix with 0.5 z**2.4 on the diagonal and z z'/r beside it, atoms by falling row
    norm (then by atom), zero-padded to size (size + 1) / 2.  One shuffle brings molecules together; triangles are made many at a time and padded in the JVM."""
    from .representations import molecules, represented_many

    n = size * (size + 1) // 2
    return represented_many(molecules(atoms), _tight(size), False).select("mol", F.slice(F.concat("x", F.array_repeat(F.lit(0.0), n)), 1, n).alias("x"))


def _tight(size: int) -> Callable:
    from .representations import coulomb_many

    return lambda z, r: coulomb_many(z, r, min(z.shape[1], size))


def coulomb_entries(atoms: DataFrame, size: int = 29) -> DataFrame:
    """(mol, pos, v): the same without zeros, so nothing is padded."""
    from .representations import entries_many, molecules

    return entries_many(molecules(atoms), _tight(size))


def bags(atoms: DataFrame) -> DataFrame:
    """(z, bag): the largest number of atoms of an element in a molecule."""
    return atoms.groupBy("mol", "z").agg(F.count("*").alias("n")).groupBy("z").agg(F.max("n").alias("bag"))


def bag_slots(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(z, z', slots) in order: for each element its own terms (z, 0), its pairs, then its pairs with each later element."""
    out, elements = [], list(sizes)
    for i, z in enumerate(elements):
        out += [(z, 0, sizes[z]), (z, z, sizes[z] * (sizes[z] - 1) // 2)]
        out += [(z, w, sizes[z] * sizes[w]) for w in elements[i + 1 :]]
    return out


def bag_of_bonds(atoms: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(mol, x): the slots of ``sizes`` (element -> bag, in the order of the dict), each sorted falling and padded with zeros.  One shuffle brings molecules together."""
    from .representations import bags_many, molecules, represented_many

    slots = bag_slots(sizes)
    return represented_many(molecules(atoms), lambda z, r: bags_many(z, r, slots), False)


def bag_entries(atoms: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(mol, pos, v): the same without zeros; padded vectors stay in the tasks that make them."""
    from .representations import bags_many, entries_many, molecules

    slots = bag_slots(sizes)
    return entries_many(molecules(atoms), lambda z, r: bags_many(z, r, slots))


def many_body_types(atoms: DataFrame, periodic: bool = False) -> DataFrame:
    """(z1, z2, z3): one-, two- and three-body types that fit into the largest counts of the data set; absent places are 0.  z2 is
    the middle of a triple, z1 <= z3."""
    b = bags(atoms).select("z", (F.greatest("bag", F.lit(3)) if periodic else F.col("bag")).alias("bag"))
    one = b.select(F.col("z").alias("z1"), F.lit(0).alias("z2"), F.lit(0).alias("z3"))
    l, m, r = b.alias("l"), b.alias("m"), b.alias("r")
    two = l.join(m, F.col("l.z") <= F.col("m.z")).select(F.col("l.z"), F.col("m.z"), F.lit(0))
    three = l.join(r, F.col("l.z") <= F.col("r.z")).crossJoin(m)
    same = (F.col("l.z") == F.col("m.z")).cast("int"), (F.col("r.z") == F.col("m.z")).cast("int"), (F.col("l.z") == F.col("r.z")).cast("int")
    fits = (F.col("l.bag") >= 1 + same[0] + same[2]) & (F.col("r.bag") >= 1 + same[1] + same[2]) & (F.col("m.bag") >= 1 + same[0] + same[1])
    return one.union(two).union(three.filter(fits).select(F.col("l.z"), F.col("m.z"), F.col("r.z")))


def _pair_grids(atoms: DataFrame, both: bool, near: Callable, keys: Callable, terms: Callable, first: int, ddl: str, most: int = 1 << 18) -> DataFrame:
    """(mol, two keys, g, v): sums of terms(r, key, key), (pairs, grid), over the pairs of a molecule with near(r) and the same keys(atom, atom', z, z').  Molecules come together in one shuffle; many of one size are taken at a time."""
    from .representations import molecules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("atoms")
            at, flat = col.offsets.to_numpy(), col.flatten()
            at = at - at[0]
            field = lambda k: flat.field(k).to_numpy(zero_copy_only=False)
            mol, atom, z, x, sizes = b.column("mol").to_numpy(), field("atom"), field("z"), [field(k) for k in "xyc"], np.diff(at)
            for n in np.unique(sizes[sizes > 1]):
                same, step, wide = np.flatnonzero(sizes == n), max(1, most // int(n) ** 2), max(1, most // int(n))
                for lo in range(0, len(same), step):
                    which = same[lo : lo + step]
                    found = []
                    for i0 in range(0, int(n), wide):
                        i, j = (v.ravel() for v in np.meshgrid(np.arange(i0, min(n, i0 + wide)), np.arange(n), indexing="ij"))
                        l, r = (at[which][:, None] + v for v in (i, j))
                        d = np.sqrt(sum((v[l] - v[r]) ** 2 for v in x))
                        use = near(d) & ((atom[l] != atom[r]) if both else (atom[l] > atom[r]))
                        l, r, d = l[use], r[use], d[use]
                        found.append((np.broadcast_to(mol[which][:, None], use.shape)[use], *keys(atom[l], atom[r], z[l], z[r]), d))
                    m, p, q, d = (np.concatenate(v) for v in zip(*found, strict=True))
                    if not len(d):
                        continue
                    order = np.lexsort((q, p, m))
                    m, p, q, d = m[order], p[order], q[order], d[order]
                    new = np.concatenate(([True], (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
                    key, out = np.cumsum(new) - 1, None
                    for c in range(0, len(d), most // 8):
                        part = slice(c, c + most // 8)
                        t, k = terms(d[part], p[part], q[part]), key[part]
                        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                        out = np.zeros((key[-1] + 1, t.shape[1])) if out is None else out
                        out[k[starts]] += np.add.reduceat(t, starts, axis=0)
                    grid = out.shape[1]
                    cols = [np.repeat(v[new], grid) for v in (m, p, q)] + [np.tile(np.arange(first, first + grid, dtype=np.int32), len(out)), out.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in ddl.split(", ")]
    return molecules(atoms).select(F.col("mol").cast("long"), "atoms").mapInArrow(run, ddl)


def slatm_two_body(atoms: DataFrame, rcut: float = 4.8, sigma: float = 0.05, dgrid: float = 0.03, power: int = 6, r0: float = 0.1) -> DataFrame:
    """(mol, z1, z2, g, v): smeared London terms on a grid of distances, whole molecule; grid places without a pair are absent."""
    nx = int((rcut - r0) / dgrid) + 1
    x = r0 + np.arange(nx) * ((rcut - r0) / (nx - 1))
    scale = dgrid / math.sqrt(2 * math.pi * sigma * sigma) / x**power

    def terms(r: np.ndarray, z1: np.ndarray, z2: np.ndarray) -> np.ndarray:
        return (z1.astype(float) * z2)[:, None] * scale * np.exp(-((x - r[:, None]) ** 2) / (2 * sigma * sigma))

    return _pair_grids(atoms, False, lambda r: r < rcut, lambda i, j, zi, zj: (np.minimum(zi, zj), np.maximum(zi, zj)), terms, 0, "mol long, z1 int, z2 int, g int, v double")


def fchl_two_body(atoms: DataFrame, rcut: float = 8.0, n: int = 24, eta: float = 0.32, power: float = 1.8) -> DataFrame:
    """(mol, i, z, g, v): log-normal radial terms of each atom's neighbours of element z."""
    x = np.arange(1, n + 1) * (rcut / n)

    def terms(r: np.ndarray, i: np.ndarray, z: np.ndarray) -> np.ndarray:
        if not r.all():
            raise ValueError("two atoms of a molecule lie in one place")
        s2 = np.log(1 + eta / (r * r))
        mu = np.log(r / np.sqrt(1 + eta / (r * r)))
        cut = np.where(r < rcut, 0.5 * (np.cos(r * (math.pi / rcut)) + 1), 0.0)
        return (cut / np.sqrt(s2) / r**power / math.sqrt(2 * math.pi))[:, None] / x * np.exp(-((np.log(x) - mu[:, None]) ** 2) / (2 * s2)[:, None])

    return _pair_grids(atoms, True, lambda r: r <= rcut, lambda i, j, zi, zj: (i, zj), terms, 1, "mol long, i long, z int, g int, v double")


def toy_representation(atoms: DataFrame, most: int) -> DataFrame:
    """(mol, atom, x): (1/r, z) of the other atoms in order of (z, 1/r), padded to 2 (most - 1); an atom with more than ``most`` - 1 others is an error."""
    n = 2 * (most - 1)
    v = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("zj").cast("double").alias("z"), (1 / F.col("r")).alias("d")))), lambda s: F.array(s["d"], s["z"])))
    return pairs(atoms).groupBy("mol", F.col("i").alias("atom")).agg(v.alias("v")).select(
        "mol", "atom", F.when(F.size("v") > n, F.raise_error(F.lit(f"more than {most} atoms")).cast("array<double>")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0.0), n)), 1, n)).alias("x")
    )
