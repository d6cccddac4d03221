"""Estimators: kernel ridge, local kernel ridge, random-feature ridge, incremental training, and uncertainty.

Kernel models are bounded by their training rows (n x n numbers on the driver); feature models by their number of features, whatever the rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import blocks, solvers
from .features import Signs, local_random_features, mapped, random_features
from .kernels import Kernel, dense, kernel_predictions, local_dense, local_kernel_matrix, local_predictions
from .statistics import dressed_atoms, element_counts
from .tall import TallSVD, keyed_totals


@dataclass
class KernelRidge:
    """Global kernel ridge regression.  l2 = ratio * mean of the kernel's diagonal; labels less their mean if ``shift``."""

    kernel: Kernel
    ratio: float = 1e-9
    shift: bool = True
    solver: str = "cholesky"
    most: int = 10_000  # training rows that the driver may hold a kernel of
    dense: int = 4_000  # with more rows, what Cholesky would solve goes by conjugate gradients on the executors, without a kernel; by blocks if these do not end

    def training(self, df: DataFrame, bounded: bool = True) -> tuple[list[int], np.ndarray, float]:
        rows = df.select("id", "y").orderBy("id")
        rows = (rows.limit(self.most + 1) if bounded else rows).collect()  # two numbers a row
        if bounded and len(rows) > self.most:
            raise ValueError(f"more than {self.most} training rows; use LargeKernelRidge or FeatureRidge")
        y = np.array([r["y"] for r in rows], float)
        mean = float(y.mean()) if self.shift and len(y) else 0.0
        return [r["id"] for r in rows], y - mean, mean

    def fit(self, df: DataFrame) -> KernelRidge:
        """df: id, x, y."""
        self.ids, y, self.mean = self.training(df, self.solver != "cholesky")
        if len(self.ids) > self.dense and self.solver == "cholesky":
            if not self._by_steps(df):
                self._by_blocks(df, y)
        else:
            k = dense(df, self.kernel, self.ids)[0]
            self.l2 = self.ratio * float(np.mean(np.diag(k)))
            self.alphas = solvers.SOLVERS[self.solver](k, y, self.l2)
        self.train = df.select("id", "x")
        return self

    def _by_steps(self, df: DataFrame) -> bool:
        """l2, alphas and mean without n x n numbers anywhere, to a residual of 1e-12 of the labels' norm, which bounds the error of fitted values; False if that is not reached."""
        from .large_kernels import LargeKernelRidge

        model = LargeKernelRidge(self.kernel, self.ratio, self.shift, landmarks=min(512, len(self.ids) // 8), tol=1e-12)
        try:
            model.fit(df)
        except RuntimeError:  # too many steps
            return False
        own = model.tiles.ids()
        self.l2, self.mean, self.rounds, self.alphas = model.l2, float(model.mean[0]), model.rounds, np.zeros(len(self.ids))
        self.alphas[np.searchsorted(self.ids, own)] = model.alphas[:, 0]
        return True

    def _by_blocks(self, df: DataFrame, y: np.ndarray, local: bool = False, z: str | None = None) -> None:
        """l2 and alphas in the order of ``self.ids``, which rise."""
        k, ids = blocks.kernel_blocks(df, self.kernel, local, z)
        sizes, place = [len(i) for i in ids], np.searchsorted(self.ids, np.concatenate(ids))
        self.l2 = self.ratio * blocks.mean_diagonal(k, sizes)
        self.alphas = np.empty(len(y))
        got = blocks.steps(k, sizes, y[place], self.l2) if local else None  # vectors have had their steps
        self.alphas[place] = blocks.solve(k, sizes, y[place], self.l2) if got is None else got

    def alpha_table(self) -> DataFrame:
        return self.train.sparkSession.createDataFrame(list(zip(self.ids, map(float, self.alphas), strict=True)), "id long, alpha double")

    def predict(self, query: DataFrame) -> DataFrame:
        """(id, prediction)."""
        rows = self.train.join(self.alpha_table(), "id")
        return kernel_predictions(rows, query, self.kernel).withColumn("prediction", F.col("prediction") + F.lit(self.mean))

    def loo_errors(self, df: DataFrame) -> np.ndarray:
        ids, y, _ = self.training(df)
        k = dense(df, self.kernel, ids)[0]
        return solvers.kernel_loo_errors(k, y, self.ratio * float(np.mean(np.diag(k))))

    def optimise(self, df: DataFrame, sigma_log: tuple[float, float], ratio_log: tuple[float, float] = (-25.0, 0.0), points: int = 8, loss=None) -> KernelRidge:
        """Widths by a grid, regularisation inside it from one eigen-decomposition each; the loss is of leave-one-out errors."""
        loss = loss or (lambda e: float(np.abs(e).mean()))
        ids, y, _ = self.training(df)
        best = (math.inf, self.kernel.sigmas[0], self.ratio)
        for s in (math.exp(s) for s in np.linspace(*sigma_log, points)):
            k = dense(df, replace(self.kernel, sigmas=(s,)), ids)[0]
            scale = float(np.mean(np.diag(k)))
            w, v = np.linalg.eigh(k)
            vy = v.T @ y

            def value(log_ratio, w=w, v=v, vy=vy, scale=scale):
                inv = 1 / np.maximum(w + math.exp(log_ratio) * scale, 1e-300)
                return loss((v @ (inv * vy)) / ((v * v) @ inv))

            at, got = solvers.grid_minimum(value, *ratio_log, points=24, refine=20)
            best = min(best, (got, s, math.exp(at)))
        self.kernel, self.ratio = replace(self.kernel, sigmas=(best[1],)), best[2]
        return self

    def save(self, path: str) -> None:
        self.train.join(self.alpha_table(), "id").write.parquet(f"{path}/rows")
        head = {"kernel": asdict(self.kernel), "ratio": self.ratio, "mean": self.mean, "solver": self.solver, "shift": self.shift}
        self.train.sparkSession.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.text(f"{path}/head")

    @classmethod
    def load(cls, spark, path: str) -> KernelRidge:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        out = cls(Kernel(**{**head["kernel"], "sigmas": tuple(head["kernel"]["sigmas"])}), head["ratio"], head["shift"], head["solver"])
        rows = spark.read.parquet(f"{path}/rows")
        out.mean, out.train = head["mean"], rows.select("id", "x")
        got = rows.select("id", "alpha").orderBy("id").collect()
        out.ids, out.alphas = [r[0] for r in got], np.array([r[1] for r in got])
        return out


@dataclass
class LocalKernelRidge(KernelRidge):
    """Kernel ridge over molecules of atoms: rows (id, z, x) with labels (id, y) apart; dressed-atom shift."""

    matched: bool = True

    def atom_matrix(self, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        return local_kernel_matrix(a, b, self.kernel, "id", "x", "z" if self.matched else None)

    def _counts(self, atoms: DataFrame) -> DataFrame:
        return atoms.groupBy("id").agg(*[F.count_if(F.col("z") == e).alias(f"n_{e}") for e in self.elements])

    def fit_atoms(self, atoms: DataFrame, labels: DataFrame) -> LocalKernelRidge:
        self.elements = sorted(r[0] for r in atoms.select("z").distinct().collect())
        counts = self._counts(atoms).join(labels, "id")
        names = [f"n_{e}" for e in self.elements]
        self.coefficients = dressed_atoms(counts, names, "y", intensive=False) if self.shift else np.zeros(len(names))
        base = sum((F.col(n) * float(c) for n, c in zip(names, self.coefficients, strict=True)), F.lit(0.0))
        rows = counts.select("id", (F.col("y") - base).alias("y")).orderBy("id")
        by_blocks = self.solver == "cholesky"
        rows = (rows if by_blocks else rows.limit(self.most + 1)).collect()  # two numbers a molecule
        if not by_blocks and len(rows) > self.most:
            raise ValueError(f"more than {self.most} training molecules")
        self.ids, y, self.train = [r[0] for r in rows], np.array([r[1] for r in rows]), atoms
        if by_blocks and len(rows) > self.dense:
            self._by_blocks(atoms, y, True, "z" if self.matched else None)
            return self
        k = local_dense(atoms, self.kernel, self.ids, z="z" if self.matched else None)
        self.l2 = self.ratio * float(np.mean(np.diag(k)))
        self.alphas = solvers.SOLVERS[self.solver](k, y, self.l2)
        return self

    def predict_atoms(self, atoms: DataFrame) -> DataFrame:
        p = local_predictions(self.train.join(self.alpha_table(), "id"), atoms, self.kernel, z="z" if self.matched else None)
        base = sum((F.col(f"n_{e}") * float(c) for e, c in zip(self.elements, self.coefficients, strict=True)), F.lit(0.0))
        return self._counts(atoms).join(p, "id").select("id", (F.col("p") + base).alias("prediction"))


@dataclass
class FeatureRidge:
    """Ridge regression on random features: only Z'Z and Z'y are gathered, so rows may be many and may come in parts."""

    params: Signs
    sigma: float
    ratio: float = 1e-9
    shift: bool = True
    reductor: np.ndarray | None = None

    def features(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return random_features(df, "x", self.params, self.sigma, keep, self.reductor)

    def start(self) -> FeatureRidge:
        d = self.params.features
        # a constant feature is carried along, so the mean of the labels can be taken off at the end
        self.g, self.r, self.yy, self.n = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0.0, 0
        return self

    def add(self, df: DataFrame, weight: str | None = None) -> FeatureRidge:
        """Training rows (x, y), with importances in ``weight``; sums of earlier calls stay."""
        keep = ["y", weight] if weight else ["y"]
        z = self.features(df.select("x", *keep), keep).withColumn("z", F.concat("z", F.array(F.lit(1.0))))
        g, r, yy, n = solvers.gramian(z, "z", "y", weight)
        if n:
            self.g, self.r, self.yy, self.n = self.g + g, self.r + r, self.yy + yy, self.n + n
        return self

    def solve(self) -> FeatureRidge:
        d = self.params.features
        self.mean = float(self.r[d] / self.g[d, d]) if self.shift and self.n else 0.0
        g, r = self.g[:d, :d], self.r[:d] - self.mean * self.g[:d, d]
        self.l2 = solvers.relative_l2(g, self.n, self.ratio)
        self.alphas = solvers.cholesky_solve(g, r, max(self.l2, 1e-12 * float(np.trace(g)) / max(1, d)))
        return self

    def fit(self, df: DataFrame) -> FeatureRidge:
        return self.start().add(df).solve()

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = keep or ["id"]
        a, p = self.alphas[:, None], self
        z = mapped(df, "x", lambda x: p.params.map(x if p.reductor is None else x @ p.reductor, p.sigma) @ a, keep)
        return z.select(*keep, (F.col("z")[0] + F.lit(self.mean)).alias("prediction"))

    def loo(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, leverage, err: leave-one-out errors of the training rows."""
        d = self.params.features
        z = self.features(df.select(*keep, "x", (F.col("y") - F.lit(self.mean)).alias("y")), [*keep, "y"])
        return solvers.feature_loo_errors(z, "z", "y", self.g[:d, :d], self.r[:d] - self.mean * self.g[:d, d], self.l2, keep)

    def optimise_ratio(self, df: DataFrame, low: float = -25.0, high: float = 0.0, points: int = 8) -> FeatureRidge:
        """Regularisation by mean absolute leave-one-out errors: features are made once, then a grid and finer ones around its best point are a pass each, for all their points."""
        self.solve()
        z = written(self.features(df.select("x", (F.col("y") - F.lit(self.mean)).alias("y")), ["y"]), "features")
        svd = TallSVD.fit(z, "z", "y")
        unit = svd.relative_l2(1.0, self.n)
        if unit > 0:
            self.ratio = svd.best_l2(z, "z", "y", (low + math.log(unit), high + math.log(unit)), max(4, points))[0] / unit
        return self.solve()

    def plane_distances(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, d2: l2 z'(Z'Z + l2)^-1 z, how far a row lies from what was trained."""
        d = self.params.features
        inv = np.linalg.inv(self.g[:d, :d] + self.l2 * np.eye(d)) * self.l2
        z = mapped(df, "x", lambda x: (lambda zz: ((zz @ inv) * zz).sum(axis=1)[:, None])(self.params.map(x if self.reductor is None else x @ self.reductor, self.sigma)), keep)
        return z.select(*keep, F.greatest(F.lit(0.0), F.col("z")[0]).alias("d2"))


@dataclass
class LocalFeatureRidge(FeatureRidge):
    """Feature ridge over molecules of atoms, with parameters (and reductors) of each element: rows (id, z, x) with labels (id, y) apart; dressed-atom shift."""

    elements: dict[int, Signs] | None = None
    reductors: dict[int, np.ndarray] | None = None

    def molecule_features(self, atoms: DataFrame) -> DataFrame:
        """(id, z): sums over atoms."""
        return local_random_features(atoms, "id", "z", "x", self.elements, self.sigma, self.reductors)

    def _base(self, counts: DataFrame):
        return sum((F.col(f"n_{e}") * float(c) for e, c in zip(sorted(self.elements), self.coefficients, strict=True)), F.lit(0.0))

    def fit_atoms(self, atoms: DataFrame, labels: DataFrame) -> LocalFeatureRidge:
        counts = element_counts(atoms, "id", "z", sorted(self.elements)).join(labels, "id")
        names = [f"n_{e}" for e in sorted(self.elements)]
        self.coefficients = dressed_atoms(counts, names, "y", intensive=False) if self.shift else np.zeros(len(names))
        rows = self.molecule_features(atoms).join(counts.select("id", (F.col("y") - self._base(counts)).alias("y")), "id")
        self.g, self.r, self.yy, self.n = solvers.gramian(rows, "z", "y")
        self.mean = 0.0
        self.l2 = solvers.relative_l2(self.g, self.n, self.ratio)
        self.alphas = solvers.cholesky_solve(self.g, self.r, max(self.l2, 1e-12 * float(np.trace(self.g)) / max(1, len(self.r))))
        return self

    def predict_atoms(self, atoms: DataFrame) -> DataFrame:
        """(id, prediction)."""
        counts = element_counts(atoms, "id", "z", sorted(self.elements))
        p = mapped(self.molecule_features(atoms), "z", lambda z, a=self.alphas[:, None]: z @ a, ["id"], "p")
        return p.join(counts, "id").select("id", (F.col("p")[0] + self._base(counts)).alias("prediction"))


def fold_objective(k: np.ndarray, y: np.ndarray, ids: list, folds: DataFrame, key: str, ratio: float) -> float:
    """-1 / the mean over folds of the mean absolute error on a fold's test rows (0 where a system is singular), from a training kernel in the order of ``ids``.

    folds: (key, fold, train), as :func:`ranking.folds` draws them.
    """
    from .selection import fold_mae

    return fold_mae(k, y, _fold_places(ids, folds, key), ratio * float(np.mean(np.diag(k))))


def _fold_places(ids: list, folds: DataFrame, key: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in ``ids`` of each fold's training and test rows, on the driver: a number for each row and fold."""
    place = {v: i for i, v in enumerate(ids)}
    got: dict[int, tuple[list[int], list[int]]] = {}
    for r in folds.select(key, "fold", "train").toLocalIterator():
        got.setdefault(r["fold"], ([], []))[0 if r["train"] else 1].append(place[r[key]])
    return [(np.array(sorted(a), int), np.array(sorted(b), int)) for a, b in got.values()]


def local_fold_objective(atoms: DataFrame, labels: DataFrame, kernel: Kernel, folds: DataFrame, ratio: float = 1e-6, matched: bool = True, most: int | None = None, dense: int = 4_000) -> float:
    """The same of a local kernel of molecules (id, z, x) and labels (id, y).  With more than ``dense`` molecules the kernel stays in blocks on the executors, where each fold's system is solved; more than ``most`` are refused, if it is given."""
    rows = labels.select("id", "y").orderBy("id")
    rows = (rows if most is None else rows.limit(most + 1)).collect()  # two numbers a molecule
    if most is not None and len(rows) > most:
        raise ValueError(f"more than {most} training molecules")
    ids, y = [r["id"] for r in rows], np.array([r["y"] for r in rows], float)
    if len(ids) > dense:
        k, own = blocks.kernel_blocks(atoms, kernel, True, "z" if matched else None)
        return _fold_mae_by_blocks(k, own, ids, y, _fold_places(ids, folds, "id"), ratio)
    return fold_objective(local_dense(atoms, kernel, ids, z="z" if matched else None), y, ids, folds, "id", ratio)


def _fold_mae_by_blocks(k: DataFrame, own: list[np.ndarray], ids: list, y: np.ndarray, folds: list[tuple[np.ndarray, np.ndarray]], ratio: float) -> float:
    """:func:`selection.fold_mae` of a kernel in blocks with the ids ``own``."""
    sizes, place = [len(v) for v in own], np.searchsorted(ids, np.concatenate(own))
    l2, cuts, maes = ratio * blocks.mean_diagonal(k, sizes), np.cumsum(sizes)[:-1], []
    for a, b in folds:
        train = np.isin(place, a)
        try:
            alphas = blocks.steps(k, sizes, y[place[train]], l2, train)
            if alphas is None:
                alphas = blocks.solve(*blocks.subset(k, np.split(train, cuts)), y[place[train]], l2)
        except np.linalg.LinAlgError:
            return 0.0
        x, p = np.zeros(len(place)), np.empty(len(ids))
        x[train] = alphas
        p[place] = blocks.products(k, sizes, x)
        maes.append(np.abs(p[b] - y[b]).mean())
    m = float(np.mean(maes))
    return -1 / m if m > 0 and math.isfinite(m) else 0.0


def feature_fold_objective(rows: DataFrame, folds: DataFrame, key: str, ratio: float = 1e-6) -> float:
    """The same of feature rows (key, z, y): the Gramians of all folds' training rows in one aggregation, and one pass for the errors of all folds."""
    part = rows.select(key, F.col("z").cast("array<double>").alias("z"), F.col("y").cast("double").alias("y")).join(folds.select(key, F.col("fold").cast("long").alias("fold"), "train"), key)
    matrix = lambda b: np.asarray(b.column("z").flatten(), float).reshape(b.num_rows, -1)

    def gramians(b) -> dict[int, np.ndarray]:
        x = np.concatenate([matrix(b), b.column("y").to_numpy()[:, None]], axis=1)
        f = b.column("fold").to_numpy()
        return {int(k): np.append(x[f == k].T @ x[f == k], (f == k).sum()) for k in np.unique(f)}

    alphas = {}
    for k, v in keyed_totals(part.filter("train").select("z", "y", "fold"), gramians).items():
        size = math.isqrt(len(v) - 1)
        g = v[:-1].reshape(size, size)
        try:
            alphas[k] = solvers.cholesky_solve(g[:-1, :-1], g[:-1, -1], solvers.relative_l2(g[:-1, :-1], int(v[-1]), ratio))
        except np.linalg.LinAlgError:
            return 0.0

    def errors(b) -> dict[int, np.ndarray]:
        z, y, f = matrix(b), b.column("y").to_numpy(), b.column("fold").to_numpy()
        return {int(k): np.array([np.abs(z[f == k] @ alphas[int(k)] - y[f == k]).sum(), (f == k).sum()]) for k in np.unique(f)}

    means = [v[0] / v[1] for v in keyed_totals(part.filter("not train").select("z", "y", "fold"), errors).values()]
    return -len(means) / sum(means) if means and sum(means) > 0 else 0.0


def uncertainty_targets(errors: DataFrame, logs: bool = False) -> DataFrame:
    """From (err, d2) what a second model is fitted to: |err| / d2, or its logarithm."""
    t = F.abs("err") / F.greatest(F.col("d2"), F.lit(1e-300))
    return errors.withColumn("y", F.log(F.greatest(t, F.lit(1e-300))) if logs else t)


@dataclass
class Uncertainty:
    """A second model of a first one's errors: |err| over the distance from the training plane, or its logarithm, by features; predictions are scaled by the distance again."""

    model: FeatureRidge
    second: FeatureRidge
    logs: bool = False

    def fit(self, df: DataFrame) -> Uncertainty:
        """df: id, x, y, rows the first model knows; its leave-one-out errors are what is learned."""
        errors = self.model.loo(df, ["id"]).select("id", "err").join(self.model.plane_distances(df, ["id"]), "id")
        self.second.fit(uncertainty_targets(errors, self.logs).join(df.select("id", "x"), "id"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, uncertainty)."""
        p = self.second.predict(df).join(self.model.plane_distances(df, ["id"]), "id")
        ratio = F.exp("prediction") if self.logs else F.abs("prediction")
        return p.select("id", (ratio * F.col("d2")).alias("uncertainty"))


def kernel_learning_curve(k: np.ndarray, y: np.ndarray, k_test: np.ndarray, y_test: np.ndarray, subsets: dict[int, list[list[int]]], l2: float) -> dict[int, tuple[float, float]]:
    """Mean and population deviation of the mean absolute error over disjoint subsets, from given kernels (train x train, train x test)."""
    out = {}
    for size, parts in subsets.items():
        maes = []
        for p in parts:
            a = solvers.cholesky_solve(k[np.ix_(p, p)], y[p], l2)
            maes.append(float(np.abs(k_test[p].T @ a - y_test).mean()))
        out[size] = float(np.mean(maes)), float(np.std(maes))
    return out


def descend(value, x0: np.ndarray, step: float = 0.5, shortest: float = 1e-2, rounds: int = 100, delta: float = 1e-3) -> np.ndarray:
    """Normalised steepest descent in the logarithms of hyperparameters; a step that does not help is halved."""
    x = np.array(x0, float)
    f = value(x)
    for _ in range(rounds):
        g = np.array([(value(x + delta * e) - value(x - delta * e)) / (2 * delta) for e in np.eye(len(x))])
        n = np.linalg.norm(g)
        if n == 0 or step < shortest:
            break
        while step >= shortest and value(x - step * g / n) >= f:
            step /= 2
        if step >= shortest:
            x = x - step * g / n
            f = value(x)
    return x


def descend_along(value, x0: np.ndarray, step: float = 0.5, shortest: float = 1e-2, rounds: int = 100) -> tuple[np.ndarray, list[float]]:
    """Normalised steepest descent along given gradients (value returns both); a step that does not help is halved, one that does is kept.  The best point, and the values on the way."""
    x = np.array(x0, float)
    f, g = value(x)
    history = [f]
    for _ in range(rounds):
        n = float(np.linalg.norm(g))
        if n == 0 or not math.isfinite(n) or step < shortest:
            break
        new = x - step * g / n
        v, slope = value(new)
        if math.isfinite(v) and v < f:
            x, f, g = new, v, slope
            history.append(f)
        else:
            step /= 2
    return x, history
