"""Multilevel pipelines: a list of levels compiled into DataFrame steps over nested objects.

An object is a nested column: ``array<double>`` at the base, lists of objects, and lists of components with weights.  Each
level is a function from Column to Column where the JVM can do it; maps of random features run as Arrow batches over the exploded
components (columns ``id`` and, below it, the path).  The type grammar (base vector, then list, rhos, element_id from the
inside out) gives the schema.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..sources.store import written
from . import solvers
from .features import Signs, mapped
from .statistics import component_moments, vector_sum


def datatype(definition: list[str]) -> T.DataType:
    """The Spark type of a bottom-up definition such as ["array_1D", "element_id", "list", "rhos"]."""
    base = {"array_1D": 1, "array_2D": 2, "array_3D": 3}[definition[0]]
    out: T.DataType = T.DoubleType()
    for _ in range(base):
        out = T.ArrayType(out)
    for step in definition[1:]:
        if step == "list":
            out = T.ArrayType(out)
        elif step == "rhos":
            out = T.StructType([T.StructField("components", out), T.StructField("rhos", T.ArrayType(T.DoubleType()))])
        elif step == "element_id":
            out = T.StructType([T.StructField("representation", out), T.StructField("element_id", T.IntegerType())])
        else:
            raise ValueError(f"unknown step {step}")
    return out


# Levels that are Column expressions of one vector.


class ColumnLevel:
    """A level that is a Column expression when called, and the same over a matrix in :meth:`push`, there with its derivatives.

    ``logs`` are the logarithms of its hyperparameters.
    """

    def logs(self) -> np.ndarray:
        return np.zeros(0)

    def set_logs(self, t: np.ndarray) -> None:
        pass

    def __call__(self, v: Column) -> Column:
        raise NotImplementedError

    def push(self, x: np.ndarray, dx: np.ndarray | None, own: slice, species: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """Rows (n, d) and their derivatives (n, hyperparameters, d), or None; ``own`` are the places of this level's hyperparameters, by whose logarithms the derivatives are."""
        raise NotImplementedError


class _Linear(ColumnLevel):
    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def push(self, x, dx, own, species=0):
        return self.apply(x), None if dx is None else self.apply(dx.reshape(-1, dx.shape[-1])).reshape(*dx.shape[:2], -1)


@dataclass
class Resize(_Linear):
    """Cut, or filled up with zeros."""

    size: int

    def __call__(self, v: Column) -> Column:
        return V.padded(v, self.size)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x[:, : self.size], ((0, 0), (0, max(0, self.size - x.shape[1]))))


@dataclass
class Compress(_Linear):
    """Weighted sums of consecutive components."""

    weights: list[float]

    def __call__(self, v: Column) -> Column:
        return V.compressed(v, self.weights)

    def apply(self, x: np.ndarray) -> np.ndarray:
        n = len(self.weights)
        return x[:, : x.shape[1] // n * n].reshape(len(x), -1, n) @ np.array(self.weights, float)


class Normalise(ColumnLevel):
    """To unit length; a zero vector stays."""

    def __call__(self, v: Column) -> Column:
        return V.normalised(v)

    def push(self, x, dx, own, species=0):
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        if dx is None:
            return unit, None
        rest = dx - unit[:, None] * (dx @ unit[:, :, None])
        return unit, np.divide(rest, n[:, None], out=np.zeros_like(rest), where=n[:, None] > 0)


class _Scaled(ColumnLevel):
    """Components divided by products of powers of the hyperparameters ``sigmas``; ``exponents``: (hyperparameters, d)."""

    sigmas: list[float]

    def exponents(self, d: int) -> np.ndarray:
        raise NotImplementedError

    def logs(self) -> np.ndarray:
        return np.log(np.array(self.sigmas, float))

    def set_logs(self, t: np.ndarray) -> None:
        self.sigmas = [math.exp(v) for v in t]

    def push(self, x, dx, own, species=0):
        powers = self.exponents(x.shape[1])
        by = np.exp(-self.logs() @ powers)
        y = x * by
        if dx is None:
            return y, None
        out = dx * by
        out[:, own] -= powers[None] * y[:, None]
        return y, out


@dataclass
class Rescale(_Scaled):
    """Index ranges [bounds[k], bounds[k + 1]) by sigmas[k]."""

    sigmas: list[float]
    bounds: list[int]

    def __call__(self, v: Column) -> Column:
        return V.ranges_divided(v, self.sigmas, self.bounds)

    def exponents(self, d: int) -> np.ndarray:
        at = np.arange(d)
        return np.array([(at >= a) & (at < b) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)], float)


@dataclass
class FullRescale(_Scaled):
    sigmas: list[float]

    def __call__(self, v: Column) -> Column:
        return V.divided(v, F.lit(float(self.sigmas[0])))

    def exponents(self, d: int) -> np.ndarray:
        return np.ones((1, d))


@dataclass
class PowerRescale(_Scaled):
    """Component i by sigma ** powers[i]; the powers repeat over the vector."""

    sigmas: list[float]
    powers: list[float]

    def __call__(self, v: Column) -> Column:
        return V.powers_divided(v, self.sigmas[0], self.powers)

    def exponents(self, d: int) -> np.ndarray:
        return np.resize(np.array(self.powers, float), d)[None]


def resize(size: int) -> Resize:
    return Resize(size)


def normalise() -> Normalise:
    return Normalise()


def rescale(sigmas: list[float], bounds: list[int]) -> Rescale:
    return Rescale(sigmas, bounds)


def full_rescale(sigma: float) -> FullRescale:
    return FullRescale([float(sigma)])


def power_rescale(sigma: float, powers: list[float]) -> PowerRescale:
    return PowerRescale([float(sigma)], powers)


def compress(weights: list[float]) -> Compress:
    return Compress(weights)


def concatenate(levels: list, parts: list[Column]) -> Column:
    """Different levels for different components, outputs put together."""
    return F.concat(*[f(p) for f, p in zip(levels, parts, strict=True)])


def fork(one, two):
    """Both branches on the same object, outputs put together."""
    return lambda v: F.concat(one(v), two(v))


def component_sum(f=lambda v: v):
    """Over a list of vectors of equal size."""
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    return lambda vs: F.aggregate(F.transform(vs, f), F.array().cast("array<double>"), add)


def weighted_component_sum(f=lambda v: v):
    """Over a struct of components and rhos."""
    return lambda s: component_sum()(F.zip_with(F.transform(s["components"], f), s["rhos"], lambda v, w: F.transform(v, lambda x: x * w)))


def element_switch(choices: dict[int, object]):
    """The level for an element_id of a struct (representation, element_id); unknown ids are an error."""

    def run(s: Column) -> Column:
        out = F.raise_error(F.lit("no level for this element")).cast("array<double>")
        for e, f in choices.items():
            out = F.when(s["element_id"] == e, f(s["representation"])).otherwise(out)
        return out

    return run


def chain(*levels):
    def run(v: Column) -> Column:
        for f in levels:
            v = f(v)
        return v

    return run


# Levels of random features, over rows.


@dataclass
class FeatureLevel:
    """kind: plain, even, extensive.  Element-specific parameters by ``species``.  Hyperparameters: the width, and the mixing of an extensive map."""

    params: dict[int, Signs]
    sigma: float = 1.0
    kind: str = "plain"
    mixing: float = 1.0
    scaled: bool = True  # else the width is no hyperparameter

    def logs(self) -> np.ndarray:
        if not self.scaled:
            return np.zeros(0)
        return np.log([self.sigma, self.mixing] if self.kind == "extensive" else [self.sigma])

    def set_logs(self, t: np.ndarray) -> None:
        if not self.scaled:
            return
        self.sigma = math.exp(t[0])
        if self.kind == "extensive":
            self.mixing = math.exp(t[1])

    def apply(self, x: np.ndarray, species: int = 0) -> np.ndarray:
        p = self.params[species]
        if self.kind == "plain":
            return p.map(x, self.sigma)
        if self.kind == "even":
            return p.map_even(x, self.sigma)
        return p.map_extensive(x, self.sigma, self.mixing)

    def push(self, x: np.ndarray, dx: np.ndarray | None, own: slice, species: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """As :meth:`ColumnLevel.push`: the phases are linear in the input and go with 1 / sigma."""
        if dx is None:
            return self.apply(x, species), None
        p, n, h = self.params[species], *dx.shape[:2]
        if self.kind == "extensive":
            return self._push_extensive(x, dx, own, species)
        z = p.phases(x, self.sigma)
        dz = p.phases(dx.reshape(n * h, -1), self.sigma).reshape(n, h, *z.shape[1:])
        dz[:, own] -= z[:, None]
        root = math.sqrt(2 / p.features)
        if self.kind == "even":
            turn = np.cos(p.biases)[None] * root
            return (np.cos(z) * turn).reshape(n, -1), (-(np.sin(z) * turn)[:, None] * dz).reshape(n, h, -1)
        return (np.cos(z + p.biases) * root).reshape(n, -1), (-(np.sin(z + p.biases) * root)[:, None] * dz).reshape(n, h, -1)

    def _push_extensive(self, x: np.ndarray, dx: np.ndarray, own: slice, species: int) -> tuple[np.ndarray, np.ndarray]:
        """|v| [a map(v / |v|) + b v / |v|]: the product rule over the length, the unit vector and the two weights."""
        p, m, (n, h) = self.params[species], self.mixing, dx.shape[:2]
        stacks, size = p.biases.shape
        length = np.sqrt((x * x).sum(axis=1))
        unit, dunit = Normalise().push(x, dx, slice(0, 0))
        dlength = (dx @ unit[:, :, None])[:, :, 0]
        f, df = FeatureLevel({0: p}, self.sigma).push(unit, dunit, slice(own.start, own.start + 1))
        wide = lambda v: np.tile(np.pad(v[..., :size], [*[(0, 0)] * (v.ndim - 1), (0, max(0, size - v.shape[-1]))]), (1,) * (v.ndim - 1) + (stacks,)) / math.sqrt(stacks)
        a, b = 1 / math.sqrt(1 + m), 1 / math.sqrt(1 + 1 / m)
        line, dline = wide(unit), wide(dunit)
        inner = a * f + b * line
        out = dlength[:, :, None] * inner[:, None] + length[:, None, None] * (a * df + b * dline)
        out[:, own.start + 1] += length[:, None] * (-0.5 * m * a**3 * f + 0.5 / m * b**3 * line)
        return length[:, None] * inner, out


#: Numbers that a fused step makes at a time.
CHUNK = 4 << 20


def fused(df: DataFrame, steps: list[tuple], vec: str, keep: list[str], name: str = "x", places: list[slice] | None = None, hyper: int = 0) -> DataFrame:
    """Neighbouring maps and column levels as one function over batches: steps of (level, species column or None).

    With ``places`` (of each step's hyperparameters, ``hyper`` in all) vectors are dual: the value and then its derivative by each hyperparameter, one after the other.  Each row takes the parameters of its
    species, so the rows are read once however many there are.
    """
    species = list(dict.fromkeys(s for _, s in steps if s is not None))

    def rows(x: np.ndarray, dx: np.ndarray | None, z: dict[str, np.ndarray]) -> np.ndarray:
        for k, (level, sp) in enumerate(steps):
            own = places[k] if places else slice(0, 0)
            if sp is None:
                x, dx = level.push(x, dx, own)
                continue
            if missing := set(np.unique(z[sp]).tolist()) - level.params.keys():
                raise ValueError(f"no parameters for {sorted(missing)}")
            y = dy = None
            for e in np.unique(z[sp]):
                at = np.flatnonzero(z[sp] == e)
                a, da = level.push(x[at], None if dx is None else dx[at], own, int(e))
                if y is None:
                    y, dy = np.empty((len(x), a.shape[1])), None if dx is None else np.empty((len(x), hyper, a.shape[1]))
                y[at] = a
                if dy is not None:
                    dy[at] = da
            x, dx = y, dy
        return x if dx is None else np.concatenate([x, dx.reshape(len(x), -1)], axis=1)

    wide = max([64, *[p.features for level, _ in steps if isinstance(level, FeatureLevel) for p in level.params.values()]]) * (1 + hyper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // wide)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                col = b.column("_x")
                x = np.asarray(col.flatten(), float).reshape(len(col), -1)
                d = x.shape[1] // (1 + hyper)
                out = rows(x[:, :d], x[:, d:].reshape(len(x), hyper, d) if hyper else None, {s: b.column(f"_{s}").to_numpy() for s in species})
                at = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=[*keep, name])

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keep).dtypes), f"`{name}` array<double>"])
    return df.filter(F.col(vec).isNotNull()).select(*keep, *[F.col(s).cast("long").alias(f"_{s}") for s in species], F.col(vec).cast("array<double>").alias("_x")).mapInArrow(run, ddl)


def feature_level(df: DataFrame, level: FeatureLevel, vec: str, keep: list[str], species: str | None = None, name: str = "x") -> DataFrame:
    return fused(df, [(level, species)], vec, keep, name)


def row_sums(df: DataFrame, by: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """``by`` and ``vec`` added up: first the rows of a batch, then across tasks; vectors of dual numbers add up like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = pa.Table.from_batches([b]).select(by).append_column("_n", pa.array(np.arange(b.num_rows)))
            groups = keys.group_by(by, use_threads=False).aggregate([("_n", "list")])
            col = b.column("_v")
            x = np.asarray(col.flatten(), float).reshape(len(col), -1)
            if weight is not None:
                x = x * b.column("_w").to_numpy()[:, None]
            lists = groups.column("_n_list").combine_chunks()
            firsts = lists.offsets.to_numpy()[:-1]
            sums = np.add.reduceat(x[lists.flatten().to_numpy()], firsts, axis=0)
            at = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*[groups.column(c).combine_chunks() for c in by], pa.ListArray.from_arrays(at, pa.array(sums.ravel()))], names=[*by, "_v"])

    ddl = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*by).dtypes), "_v array<double>"])
    rows = df.filter(F.col(vec).isNotNull()).select(*by, F.col(vec).cast("array<double>").alias("_v"), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    return vector_sum(rows.mapInArrow(run, ddl), by, "_v", name=vec)


@dataclass
class Pipeline:
    """Steps over exploded rows: ("map", FeatureLevel), ("column", f), ("sum", keys) and ("weighted_sum", keys, weight).

    The rows have columns ``x`` (vector) and the keys of the nesting; a sum goes up one step.
    """

    steps: list[tuple] = field(default_factory=list)

    def levels(self) -> list:
        """Maps and column levels that have hyperparameters, from the inside out."""
        return [step[1] for step in self.steps if step[0] in ("map", "column") and hasattr(step[1], "logs") and len(step[1].logs())]

    def logs(self) -> np.ndarray:
        """Logarithms of all hyperparameters."""
        return np.concatenate([np.zeros(0), *[level.logs() for level in self.levels()]])

    def set_logs(self, t: np.ndarray) -> None:
        at = 0
        for level in self.levels():
            n = len(level.logs())
            level.set_logs(np.asarray(t[at : at + n]))
            at += n

    def stages(self, until: int | None = None) -> list[list[tuple]]:
        """Neighbouring maps and column levels are one stage; sums are stages of their own."""
        out: list[list[tuple]] = []
        for step in self.steps[:until]:
            if step[0] not in ("map", "column", "sum", "weighted_sum"):
                raise ValueError(step[0])
            joins = step[0] == "map" or isinstance(step[1], ColumnLevel)
            if joins and out and (out[-1][0][0] == "map" or isinstance(out[-1][0][1], ColumnLevel)):
                out[-1].append(step)
            else:
                out.append([step])
        return out

    def run(self, df: DataFrame, until: int | None = None, dual: bool = False) -> DataFrame:
        """The rows after the steps.  ``dual``: x is the value and then the derivative by the logarithm of each hyperparameter, carried through all levels in the same passes."""
        hyper, at = len(self.logs()) if dual else 0, 0
        if hyper:
            df = df.withColumn("x", F.concat(F.col("x").cast("array<double>"), F.array_repeat(F.lit(0.0), F.size("x") * hyper)))
        for stage in self.stages(until):
            kind = stage[0][0]
            keep = [c for c in df.columns if c != "x"]
            if kind in ("sum", "weighted_sum"):
                df = row_sums(df, stage[0][1], "x", stage[0][2] if kind == "weighted_sum" else None)
                continue
            if kind == "column" and (not isinstance(stage[0][1], ColumnLevel) or (len(stage) == 1 and not hyper)):
                if hyper:
                    raise ValueError("a plain function has no derivative; use a ColumnLevel")
                df = df.withColumn("x", stage[0][1](F.col("x")))
                continue
            places = []
            for step in stage:
                n = len(step[1].logs()) if dual else 0
                places.append(slice(at, at + n))
                at += n
            df = fused(df, [(s[1], s[2] if s[0] == "map" and len(s) > 2 else None) for s in stage], "x", keep, places=places if hyper else None, hyper=hyper)
        return df

    def guess_sigmas(self, df: DataFrame) -> Pipeline:
        """For each map from the inside out: sigma is the root of the summed variances of its input over the data set.  Rows are written between maps, so each level runs once."""
        done = 0
        for i, step in enumerate(self.steps):
            if step[0] == "map":
                df = written(Pipeline(self.steps[done:i]).run(df), "level")
                done = i
                step[1].sigma = dispersion(df, "x") or 1.0
        return self

    def maps(self) -> list[FeatureLevel]:
        return [step[1] for step in self.steps if step[0] == "map"]


@dataclass
class MultilevelModel:
    """Ridge regression on the features that a pipeline ends with.

    Objects are the pipeline's base rows; what it leaves is (key, x).  Labels are (key, y).  With ``shift`` the labels' mean is taken off and added again.  Only Z'Z, Z'y and their number are gathered, so rows may come in parts.
    """

    pipeline: Pipeline
    key: str
    ratio: float = 1e-9
    shift: bool = True

    def features(self, objects: DataFrame) -> DataFrame:
        return self.pipeline.run(objects).select(self.key, "x")

    def rows(self, objects: DataFrame, labels: DataFrame) -> DataFrame:
        return self.features(objects).join(labels.select(self.key, "y"), self.key)

    def start(self) -> MultilevelModel:
        self.g = self.r = None
        self.yy, self.n = 0.0, 0
        return self

    def add(self, objects: DataFrame, labels: DataFrame) -> MultilevelModel:
        """More training objects; what was added before stays."""
        z = self.rows(objects, labels).withColumn("z", F.concat("x", F.array(F.lit(1.0))))  # a constant, so that the mean can be taken off at the end
        g, r, yy, n = solvers.gramian(z, "z", "y")
        if n:
            self.g, self.r = (g, r) if self.g is None else (self.g + g, self.r + r)
            self.yy, self.n = self.yy + yy, self.n + n
        return self

    def solve(self) -> MultilevelModel:
        self.mean = float(self.r[-1] / self.n) if self.shift else 0.0
        g, r = self.g[:-1, :-1], self.r[:-1] - self.mean * self.g[:-1, -1]
        self.l2 = solvers.relative_l2(g, self.n, self.ratio)
        self.alphas = solvers.cholesky_solve(g, r, max(self.l2, 1e-12 * float(np.trace(g)) / len(r)))
        return self

    def fit(self, objects: DataFrame, labels: DataFrame) -> MultilevelModel:
        return self.start().add(objects, labels).solve()

    def refit(self, objects: DataFrame, labels: DataFrame) -> MultilevelModel:
        return self.add(objects, labels).solve()

    def predict(self, objects: DataFrame) -> DataFrame:
        """(key, prediction)."""
        p = mapped(self.features(objects), "x", lambda x, a=self.alphas[:, None]: x @ a, [self.key], "p")
        return p.select(self.key, (F.col("p")[0] + F.lit(self.mean)).alias("prediction"))

    def loo(self, objects: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, leverage, err) of the training rows."""
        z = self.rows(objects, labels).withColumn("y", F.col("y") - F.lit(self.mean))
        return solvers.feature_loo_errors(z, "x", "y", self.g[:-1, :-1], self.r[:-1] - self.mean * self.g[:-1, -1], self.l2, [self.key])

    def learning_curve(self, objects: DataFrame, labels: DataFrame, test: DataFrame, test_labels: DataFrame, sizes: list[int], most: int = 8) -> DataFrame:
        """(size, mean, std) of the mean absolute error on the test objects over disjoint training subsets.  Features are made once; each subset adds up its own Gramian."""
        from .ranking import learning_curve, learning_subsets

        spark = objects.sparkSession
        z, t = written(self.rows(objects, labels), "features"), written(self.rows(test, test_labels), "features")
        subsets = written(learning_subsets(labels, self.key, sizes, most), "subsets")
        errors = None
        for size, subset in sorted((r["size"], r["subset"]) for r in subsets.select("size", "subset").distinct().collect()):  # at most ``most`` for each size
            part = z.join(subsets.filter((F.col("size") == size) & (F.col("subset") == subset)).select(self.key), self.key)
            g, r, _, n = solvers.gramian(part.withColumn("z", F.concat("x", F.array(F.lit(1.0)))), "z", "y")
            one = MultilevelModel(self.pipeline, self.key, self.ratio, self.shift)
            one.g, one.r, one.n = g, r, n
            one.solve()
            p = mapped(t, "x", lambda x, a=one.alphas[:, None]: x @ a, ["y"], "p")
            e = p.select(F.lit(size).alias("size"), F.lit(subset).alias("subset"), (F.col("p")[0] + F.lit(one.mean) - F.col("y")).alias("err"))
            errors = e if errors is None else errors.unionByName(e)
        return learning_curve(errors if errors is not None else spark.createDataFrame([], "size int, subset int, err double"))

    def dual_rows(self, objects: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, x, dx, y): features, and after each other their derivatives by the logarithm of each hyperparameter."""
        z = self.pipeline.run(objects, dual=True).join(labels.select(self.key, "y"), self.key)
        d = (F.size("x") / (1 + len(self.pipeline.logs()))).cast("int")
        return z.select(self.key, F.slice("x", F.lit(1), d).alias("x"), F.slice("x", d + 1, F.size("x")).alias("dx"), "y")

    def loss_and_slopes(self, objects: DataFrame, labels: DataFrame, loss: str = "mae", delta: float = 1.0) -> tuple[float, np.ndarray, float]:
        """The mean loss of leave-one-out errors, its derivatives by the logarithms of the pipeline's hyperparameters, and by that of the regularisation ratio.

        The objects go through the levels once, with all derivatives; three sums over the features that this leaves make the rest.
        """
        from .slopes import loo_gradient

        rows = written(self.dual_rows(objects, labels), "dual")
        return loo_gradient(rows, "x", "dx", "y", len(self.pipeline.logs()), self.ratio, self.shift, loss, delta)

    def optimise(self, objects: DataFrame, labels: DataFrame, rounds: int = 20, loss: str = "mae", delta: float = 1.0, shortest: float = 1e-2) -> MultilevelModel:
        """All hyperparameters and the regularisation by normalised steepest descent in their logarithms, along true gradients: each trial is one run of the pipeline over the objects."""
        from .models import descend_along

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            self.pipeline.set_logs(x[:-1])
            self.ratio = math.exp(x[-1])
            v, slopes, by_ratio = self.loss_and_slopes(objects, labels, loss, delta)
            return v, np.append(slopes, by_ratio)

        x, self.history = descend_along(value, np.append(self.pipeline.logs(), math.log(self.ratio)), rounds=rounds, shortest=shortest)
        self.pipeline.set_logs(x[:-1])
        self.ratio = math.exp(x[-1])
        return self.fit(objects, labels)


    def anneal(
        self, objects: DataFrame, labels: DataFrame, coefficients: tuple[float, ...] = (1.0, 0.5, 0.25), starts: int = 4, spread: float = 0.5, rounds: int = 6, seed: int = 0, loss: str = "huber"
    ) -> MultilevelModel:
        """Descents from several starts under losses that sharpen: the first start is the model as it is, the others are moved from it by normal steps of ``spread`` in the logarithms.

        In each cycle a loss is quadratic up to ``coefficient`` times the mean absolute leave-one-out error with which the start enters it (a self-consistent loss, one step at a time), so early cycles see a smooth
        valley and late ones nearly the mean absolute error.  After each cycle the better half of the starts goes on.  ``history`` has (coefficient, start, error before, error after).
        """
        from .models import descend_along

        def at(x: np.ndarray, loss: str, delta: float) -> tuple[float, np.ndarray]:
            self.pipeline.set_logs(x[:-1])
            self.ratio = math.exp(x[-1])
            v, slopes, by_ratio = self.loss_and_slopes(objects, labels, loss, delta)
            return v, np.append(slopes, by_ratio)

        rng, first = np.random.default_rng(seed), np.append(self.pipeline.logs(), math.log(self.ratio))
        points = [first, *[first + spread * rng.normal(size=len(first)) for _ in range(starts - 1)]]
        live = [(at(x, "mae", 1.0)[0], k, x) for k, x in enumerate(points)]
        self.history = []
        for c in coefficients:
            after = []
            for error, k, x in live:
                new, _ = descend_along(lambda t, d=c * error: at(t, loss, d), x, rounds=rounds)
                now = at(new, "mae", 1.0)[0]
                self.history.append((c, k, error, now))
                after.append(min((error, k, x), (now, k, new), key=lambda v: v[0]))
            live = sorted(after, key=lambda v: v[:2])[: max(1, len(after) // 2)]
        self.pipeline.set_logs(live[0][2][:-1])
        self.ratio = math.exp(live[0][2][-1])
        return self.fit(objects, labels)


def dispersion(df: DataFrame, vec: str, weight: str | None = None) -> float:
    m = component_moments(df, vec, None if weight is None else F.abs(F.col(weight)))
    return math.sqrt(m.agg(F.sum("variance")).first()[0] or 0.0)


def guess_range_sigmas(variances: list[float], bounds: list[int]) -> list[float]:
    """A width for each index range: the root of the number of ranges times its summed variance."""
    n = len(bounds) - 1
    return [math.sqrt(n * sum(variances[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
