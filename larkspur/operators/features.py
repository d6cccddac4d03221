"""Structured orthogonal random features: cos of sign flips and Walsh-Hadamard transforms, as map-only projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .statistics import vector_sum


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Along the last axis, whose size is a power of two; divided by the root of the size."""
    n = x.shape[-1]
    y = np.array(x, float)
    step = 1
    while step < n:
        v = y.reshape(*y.shape[:-1], n // (2 * step), 2, step)
        y = np.stack((v[..., 0, :] + v[..., 1, :], v[..., 0, :] - v[..., 1, :]), axis=-2).reshape(y.shape)
        step *= 2
    return y / math.sqrt(n)


@dataclass
class Signs:
    """Parameters of one map: ``stacks`` blocks of ``size`` features (a power of two) after ``transforms`` sign flips."""

    signs: np.ndarray  # (stacks, transforms, size) of +-1
    biases: np.ndarray  # (stacks, size) in [0, 2 pi)

    @classmethod
    def seeded(cls, stacks: int, transforms: int, size: int, seed: int) -> Signs:
        rng = np.random.default_rng(seed)
        return cls(rng.integers(0, 2, (stacks, transforms, size)) * 2.0 - 1.0, rng.uniform(0, 2 * math.pi, (stacks, size)))

    @classmethod
    def by_rule(cls, stacks: int, transforms: int, size: int, species: int = 0) -> Signs:
        """From integer arithmetic, so that any engine can draw the same: sign by bit 4 of a product, bias by a residue."""
        s, t, i = np.ogrid[:stacks, :transforms, :size]
        mixed = (i + 1) * 7919 + (t + 1) * 104729 + (s + 1) * 1299709 + (species + 1) * 15485863
        signs = np.where(mixed * 31 // 16 % 2 == 0, 1.0, -1.0)
        s, i = np.ogrid[:stacks, :size]
        return cls(signs, ((i + 1) * 2654435 + (s + 1) * 40503 + (species + 1) * 971) % 6283 / 1000.0)

    @property
    def features(self) -> int:
        return self.biases.size

    def phases(self, x: np.ndarray, sigma: float) -> np.ndarray:
        """(rows, stacks, size) arguments of the cosines, before the biases."""
        size = self.biases.shape[1]
        z = np.zeros((len(x), 1, size))
        z[:, 0, : x.shape[1]] = x[:, :size] / sigma
        z = np.repeat(z, len(self.signs), axis=1)
        for t in range(self.signs.shape[1]):
            z = walsh_hadamard(z * self.signs[None, :, t, :])
        return z * math.sqrt(size)

    def map(self, x: np.ndarray, sigma: float) -> np.ndarray:
        return (np.cos(self.phases(x, sigma) + self.biases[None]) * math.sqrt(2 / self.features)).reshape(len(x), -1)

    def map_even(self, x: np.ndarray, sigma: float) -> np.ndarray:
        """Even in x: the cosine of the phase times the cosine of the bias."""
        return (np.cos(self.phases(x, sigma)) * np.cos(self.biases)[None] * math.sqrt(2 / self.features)).reshape(len(x), -1)

    def map_extensive(self, x: np.ndarray, sigma: float, p: float) -> np.ndarray:
        """|v| [a(1/p) map(v/|v|) + a(p) v/(|v| sqrt(stacks))] with a(x) = 1/sqrt(1 + 1/x)."""
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        size = self.biases.shape[1]
        wide = np.zeros((len(x), size))
        wide[:, : x.shape[1]] = unit[:, :size]
        linear = np.tile(wide, (1, len(self.signs))) / math.sqrt(len(self.signs))
        a = lambda v: 1 / math.sqrt(1 + 1 / v)
        return n * (a(1 / p) * self.map(unit, sigma) + a(p) * linear)

    def sigma_gradient(self, x: np.ndarray, sigma: float) -> np.ndarray:
        """d map / d sigma: phases are proportional to 1/sigma."""
        ph = self.phases(x, sigma)
        return (np.sin(ph + self.biases[None]) * ph / sigma * math.sqrt(2 / self.features)).reshape(len(x), -1)

    def input_gradient(self, x: np.ndarray, sigma: float, out: np.ndarray) -> np.ndarray:
        """Pull ``out`` (rows, features) back to the inputs; the transform is its own adjoint."""
        size = self.biases.shape[1]
        g = -np.sin(self.phases(x, sigma) + self.biases[None]) * math.sqrt(2 / self.features) * out.reshape(len(x), *self.biases.shape) * math.sqrt(size)
        for t in reversed(range(self.signs.shape[1])):
            g = walsh_hadamard(g) * self.signs[None, :, t, :]
        return g.sum(axis=1)[:, : x.shape[1]] / sigma

    def table(self, spark: SparkSession) -> DataFrame:
        """The parameters as rows, to be kept beside a model: (kind, stack, transform, values)."""
        rows = [("sign", s, t, self.signs[s, t].tolist()) for s in range(len(self.signs)) for t in range(self.signs.shape[1])]
        rows += [("bias", s, 0, b.tolist()) for s, b in enumerate(self.biases)]
        return spark.createDataFrame(rows, "kind string, stack int, transform int, vals array<double>")

    @classmethod
    def of_table(cls, df: DataFrame) -> Signs:
        rows = df.collect()  # parameters: a few numbers for each feature
        got = {(r["kind"], r["stack"], r["transform"]): r["vals"] for r in rows}
        stacks = 1 + max(k[1] for k in got)
        transforms = 1 + max(k[2] for k in got if k[0] == "sign")
        return cls(np.array([[got["sign", s, t] for t in range(transforms)] for s in range(stacks)]), np.array([got["bias", s, 0] for s in range(stacks)]))


def mapped(df: DataFrame, vec: str, f, keep: list[str], name: str = "z") -> DataFrame:
    """``keep`` and a new vector column f(matrix of vectors), batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = b.column("_x")
                out = f(np.asarray(col.flatten(), float).reshape(len(col), -1))
                at = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=[*keep, name])

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), f"`{name}` array<double>"])
    return df.filter(F.col(vec).isNotNull()).select(*keep, F.col(vec).cast("array<double>").alias("_x")).mapInArrow(run, ddl)


def random_features(df: DataFrame, vec: str, params: Signs, sigma: float, keep: list[str], reductor: np.ndarray | None = None) -> DataFrame:
    return mapped(df, vec, lambda x: params.map(x if reductor is None else x @ reductor, sigma), keep)


def local_random_features(df: DataFrame, mol: str, z: str, vec: str, params: dict[int, Signs], sigma: float, reductors: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(mol, z): sums over atoms of maps with parameters of their element; sums are added up within a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("x").flatten(), float).reshape(b.num_rows, -1)
            el, (mols, at) = b.column("e").to_numpy(), np.unique(b.column("m").to_numpy(), return_inverse=True)
            if missing := set(np.unique(el).tolist()) - params.keys():
                raise ValueError(f"no parameters for elements {sorted(missing)}")
            out = np.zeros((len(mols), next(iter(params.values())).features))
            for e in np.unique(el):
                rows = np.flatnonzero(el == e)
                y = x[rows] if reductors is None else x[rows] @ reductors[int(e)]
                np.add.at(out, at[rows], params[int(e)].map(y, sigma))
            yield pa.RecordBatch.from_pydict({"m": mols, "z": list(out)})

    rows = df.select(F.col(mol).cast("long").alias("m"), F.col(z).cast("long").alias("e"), F.col(vec).cast("array<double>").alias("x")).dropna()
    parts = rows.mapInArrow(run, "m long, z array<double>")
    return vector_sum(parts, ["m"], "z", name="z").withColumnRenamed("m", mol)


def reductor(df: DataFrame, vec: str, npcas: int, samples: int | None = 1024) -> np.ndarray:
    """Leading directions of uncentred vectors, from at most ``samples`` in hash order or, with None, from X'X of all; the largest component of each is positive."""
    rows = df.select(F.col(vec).cast("array<double>").alias("x")).filter("x is not null")
    if samples is None:
        from .solvers import gramian

        g, _, _, n = gramian(rows, "x")
    else:
        got = rows.orderBy(F.xxhash64("x")).limit(samples).collect()  # bounded by ``samples``
        x = np.array([r["x"] for r in got])
        g, n = x.T @ x, len(x)
    if n < npcas:
        raise ValueError("fewer vectors than components")
    w, v = np.linalg.eigh(g)
    out = v[:, ::-1][:, :npcas]
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(npcas)])


def reductors_by_element(df: DataFrame, z: str, vec: str, npcas: int, samples: int = 1024) -> dict[int, np.ndarray]:
    elements = [r[0] for r in df.select(z).distinct().collect()]  # elements: some dozens
    return {int(e): reductor(df.filter(F.col(z) == e), vec, npcas, samples) for e in sorted(elements)}


def random_reductor(size: int, npcas: int, seed: int = 0) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, npcas)))
    return q


def projected(df: DataFrame, vec: str, basis: np.ndarray, keep: list[str], sigma: float = 1.0, name: str = "x") -> DataFrame:
    return mapped(df, vec, lambda x: x @ basis / sigma, keep, name)


def projected_with_remainder(df: DataFrame, vec: str, basis: np.ndarray, keep: list[str]) -> DataFrame:
    """Components along the basis, and the norm of what they leave."""

    def f(x):
        c = x @ basis
        return np.concatenate((c, np.sqrt(np.maximum(0, (x * x).sum(axis=1) - (c * c).sum(axis=1)))[:, None]), axis=1)

    return mapped(df, vec, f, keep)
