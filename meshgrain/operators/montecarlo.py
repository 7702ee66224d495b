"""Random coefficient fields on a hierarchy, and multilevel Monte Carlo estimates of quantities of interest.

A hierarchy's levels, which are small after coarsening, become numpy arrays that are broadcast; samples are rows of a
DataFrame, and each is drawn, solved and evaluated in its task. Statistics are aggregates. A sample's noise depends on its
number and the seed alone, so that lost tasks are repeated alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra, kernels
from .hierarchy import LOCAL_DOFS, Hierarchy, _local, _vector


@dataclass(frozen=True)
class Level:
    """One level's arrays: element matrices (elements x edofs x edofs would be large: triples), D, W, the constant, and the
    transfers from this level to the next (u, s), None on the last."""

    elem: np.ndarray
    i: np.ndarray
    j: np.ndarray
    v: np.ndarray
    d: np.ndarray
    w: np.ndarray | None
    constant: np.ndarray
    element_of: np.ndarray  # of each vdof
    u: np.ndarray | None
    s: np.ndarray | None

    def mass(self, coefficient: np.ndarray | None = None) -> np.ndarray:
        m = np.zeros((self.d.shape[1],) * 2)
        np.add.at(m, (self.i, self.j), self.v if coefficient is None else self.v / coefficient[self.elem])
        return m

    def solve(self, f: np.ndarray, coefficient: np.ndarray | None = None, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return kernels.mixed_solve(self.mass(coefficient), self.d, self.w, np.zeros(self.d.shape[1]) if g is None else g, f, self.constant)


def levels(h: Hierarchy, elements: list[DataFrame]) -> list[Level]:
    """The hierarchy in arrays; elements are each level's (elem, i, j, v). All levels are to be small."""
    out = []
    for k, (s, el) in enumerate(zip(h.systems, elements)):
        if s.vdofs.count() + s.edofs.count() > LOCAL_DOFS:
            raise ValueError("a level is too large for arrays")
        vd = s.vdofs.toPandas().sort_values("vdof")
        v, e = vd["vdof"].to_numpy(), np.sort(s.edofs.select("edof").toPandas()["edof"].to_numpy())
        t = el.toPandas()
        names = np.unique(vd["vertex"].to_numpy())
        nxt = h.systems[k + 1] if k + 1 < len(h.systems) else None
        cv = np.sort(nxt.vdofs.select("vdof").toPandas()["vdof"].to_numpy()) if nxt else None
        ce = np.sort(nxt.edofs.select("edof").toPandas()["edof"].to_numpy()) if nxt else None
        out.append(Level(
            np.searchsorted(names, t["elem"]), np.searchsorted(e, t["i"]), np.searchsorted(e, t["j"]), t["v"].to_numpy(), _local(s.d, v, e),
            _local(s.w, v, v) if s.w is not None else None, _vector(s.constant, v), np.searchsorted(names, vd["vertex"]),
            _local(h.steps[k].u, v, cv) if nxt else None, _local(h.steps[k].s, e, ce) if nxt else None,
        ))
    return out


@dataclass(frozen=True)
class Field:
    """A Matern field: (kappa^2 - Laplacian) u = white noise, its exponential the coefficient of an element.

    The hierarchy that it is drawn on has W = kappa^2 volume. Smoothness is 1 in two dimensions, 1/2 in three.
    """

    levels: list[Level]
    volume: float
    correlation: float
    dimension: int = 2
    seed: int = 0

    @property
    def kappa(self) -> float:
        return 1 / self.correlation

    def noise(self, sample: int) -> np.ndarray:
        nu = 1.0 if self.dimension == 2 else 0.5
        g = (4 * math.pi) ** (self.dimension / 4) * self.kappa**nu * math.sqrt(math.gamma(nu + self.dimension / 2) / math.gamma(nu))
        n = self.levels[0].d.shape[0]
        return g * math.sqrt(self.volume) * np.random.default_rng([self.seed, sample]).standard_normal(n)

    def logarithm(self, sample: int, level: int) -> np.ndarray:
        """The field by element on a level, from the same noise on all levels."""
        f = self.noise(sample)
        for k in range(level):
            f = self.levels[k].u.T @ f
        at = self.levels[level]
        _, u = at.solve(-f)
        c = at.constant
        share = np.bincount(at.element_of, c * c)
        return np.bincount(at.element_of, u * c) / share

    def coefficient(self, sample: int, level: int) -> np.ndarray:
        return np.exp(self.logarithm(sample, level))


@dataclass(frozen=True)
class Constant:
    """The coefficient 1 + sample everywhere, for tests of what uses it."""

    levels: list[Level]

    def coefficient(self, sample: int, level: int) -> np.ndarray:
        return np.full(self.levels[level].element_of.max() + 1, 1.0 + sample)


def functional(weights: np.ndarray) -> Callable[[list[Level]], Callable]:
    """A linear functional of the potential, restricted to a level by the transfers."""

    def on(ls: list[Level]):
        by = [weights]
        for k in range(len(ls) - 1):
            by.append(ls[k].u.T @ by[-1])
        return lambda level, coefficient, s, u: float(by[level] @ u)

    return on


def likelihood(observe: Callable, data: np.ndarray, sigma: float) -> Callable:
    """exp(-sum (observation - data)^2 / sigma^2) of a solution."""
    return lambda level, coefficient, s, u: float(np.exp(-np.sum((observe(level, coefficient, s, u) - data) ** 2) / sigma**2))


def samples(spark: SparkSession, ls: list[Level], field, quantity: Callable, f: np.ndarray, plan: dict[int, range]) -> DataFrame:
    """(level, sample, q, finer, cost): quantities of the samples that the plan names for each level. Below the coarsest, q
    is the difference to the next coarser level for the same sample, `finer` the quantity itself."""
    by = [f]
    for k in range(len(ls) - 1):
        by.append(ls[k].u.T @ by[-1])
    shared = spark.sparkContext.broadcast((ls, field, by))

    def run(batches):
        import time

        (levels_, field_, rhs), q = shared.value, quantity

        def value(level, sample):
            c = field_.coefficient(sample, level)
            return q(level, c, *levels_[level].solve(rhs[level], c))

        for t in batches:
            rows = []
            for level, sample in zip(t["level"].tolist(), t["sample"].tolist()):
                start = time.process_time()
                fine = value(level, sample)
                rows.append((level, sample, fine - value(level + 1, sample) if level + 1 < len(levels_) else fine, fine, time.process_time() - start))
            yield pd.DataFrame(rows, columns=["level", "sample", "q", "finer", "cost"])

    return _planned(spark, plan).mapInPandas(run, "level int, sample long, q double, finer double, cost double")


def dump(spark: SparkSession, ls: list[Level], field, plan: dict[int, range], path: str, f: np.ndarray | None = None) -> None:
    """Writes the coefficients of the samples that the plan names for each level below path, (i, v) by folders of name, level and
    sample, i a place in the level's arrays; with a right-hand side also the solutions, under the names flux and potential.

    The tasks that draw the samples write them, one at a time; a lost task writes the same again. Folders of other samples stay, and those
    of the plan's are replaced.
    """
    by = [f]
    for k in range(len(ls) - 1):
        by.append(ls[k].u.T @ by[-1] if f is not None else None)
    shared = spark.sparkContext.broadcast((ls, field, by))

    def run(batches):
        levels_, field_, rhs = shared.value
        for t in batches:
            for level, sample in zip(t["level"].tolist(), t["sample"].tolist()):
                c = field_.coefficient(sample, level)
                parts = {"coefficient": c}
                if rhs[level] is not None:
                    parts["flux"], parts["potential"] = levels_[level].solve(rhs[level], c)
                for name, v in parts.items():
                    yield pd.DataFrame({"name": name, "level": level, "sample": sample, "i": np.arange(len(v)), "v": v})

    rows = _planned(spark, plan).mapInPandas(run, "name string, level int, sample long, i long, v double")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "level", "sample").parquet(path)


def dumped(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(level, sample, i, v) of what dump() wrote under a name: coefficient, flux or potential; filters on level and sample choose folders."""
    return spark.read.schema("i long, v double, name string, level int, sample long").parquet(path).filter(F.col("name") == name).select("level", "sample", "i", "v")


def _planned(spark: SparkSession, plan: dict[int, range]) -> DataFrame:
    """(level, sample): the samples of a plan, dealt to all tasks."""
    rows = spark.createDataFrame([], "level int, sample long")
    for k, r in plan.items():
        rows = rows.unionByName(spark.range(r.start, r.stop).select(F.lit(k).alias("level"), F.col("id").alias("sample")))
    return rows.repartition(max(1, spark.sparkContext.defaultParallelism))


def statistics(s: DataFrame, key: str = "level", value: str = "q") -> DataFrame:
    """(key, n, mean, varsum, variance): varsum the sum of squared deviations, as running updates would give it."""
    return s.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("varsum"), F.var_samp(value).alias("variance"),
    )


def white_noise(ids: DataFrame, seed: int) -> DataFrame:
    """(i, v): a standard normal value for each i, from hashes of (i, seed): the same wherever the rows are."""
    u = lambda k: (F.pmod(F.xxhash64("i", F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return ids.select("i", (F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))).alias("v"))


def lognormal(system, volumes: DataFrame, correlation: float, dimension: int = 2, seed: int = 22, **options) -> DataFrame:
    """(i, v): the exponential of a Matern field over a level's vertices, over tables: (kappa^2 - Laplacian) u = white noise,
    with W = kappa^2 volume; options as of hierarchy.solve()."""
    from .hierarchy import solve
    from .spectral import System

    kappa, nu = 1 / correlation, 1.0 if dimension == 2 else 0.5
    g = (4 * math.pi) ** (dimension / 4) * kappa**nu * math.sqrt(math.gamma(nu + dimension / 2) / math.gamma(nu))
    w = volumes.select("i", F.col("i").alias("j"), (F.lit(kappa**2) * F.col("v")).alias("v"))
    noise = white_noise(volumes.select("i"), seed).withColumnRenamed("v", "xi").join(volumes, "i")
    f = noise.select("i", (F.lit(-g) * F.sqrt("v") * F.col("xi")).alias("v"))
    _, u = solve(System(system.vdofs, system.edofs, system.m, system.d, system.constant, w), f, **options)
    return u.select("i", F.exp("v").alias("v"))


def log_likelihoods(observations: DataFrame, data: DataFrame, sigma: float, key: str, place: str, value: str) -> DataFrame:
    """(key, loglik, lik): for each sample `key`, -sum (value - v)^2 / sigma^2 over the places (place, v) with data, and its
    exponential. A sample without an observation at such a place has no row for it, and 0 if it has none at all."""
    z = observations.join(data.select(F.col(place), F.col("v").alias("__data")), place, "left")
    d = F.col(value) - F.col("__data")
    out = z.groupBy(key).agg((-F.coalesce(F.sum(d * d), F.lit(0.0)) / F.lit(sigma * sigma)).alias("loglik"))
    return out.select(key, "loglik", F.exp("loglik").alias("lik"))


def ratio(quantities: DataFrame, likelihoods: DataFrame, key: str, value: str) -> DataFrame:
    """One row: numerator, the mean of quantity times likelihood over samples; denominator, the mean likelihood; their ratio."""
    z = quantities.join(likelihoods, key)
    out = z.agg(F.avg(F.col(value) * F.col("lik")).alias("numerator"), F.avg("lik").alias("denominator"))
    return out.withColumn("ratio", F.col("numerator") / F.col("denominator"))


def floored(coefficient: DataFrame, least: float) -> DataFrame:
    """A coefficient (i, v), none of it below a floor."""
    return coefficient.select("i", F.greatest("v", F.lit(float(least))).alias("v"))


def next_level(n: dict[int, int], variance: dict[int, float], cost: dict[int, float]) -> int:
    """From the coarsest on, the first level whose share of the samples is less than its share of sqrt(variance / cost)."""
    want = {k: math.sqrt(variance[k] / max(cost[k], 1e-12)) for k in n}
    total, drawn = sum(want.values()), sum(n.values())
    for k in sorted(n, reverse=True):
        if total and n[k] / drawn < want[k] / total:
            return k
    return max(n)


def estimate(spark: SparkSession, ls: list[Level], field, quantity: Callable, f: np.ndarray, first: int = 10, more: int = 0, batch: int = 8) -> tuple[float, DataFrame]:
    """The multilevel estimate, a sum of level means, and the statistics: `first` samples on each level, then `more`,
    in batches, where they help most for their measured cost."""
    from ..sources.checkpoints import written

    used = {k: first for k in range(len(ls))}
    drawn = written(samples(spark, ls, field, quantity, f, {k: range(first) for k in used}), "samples")
    for _ in range(0, more, batch):
        t = drawn.groupBy("level").agg(F.var_samp("q").alias("v"), F.avg("cost").alias("c")).collect()
        k = next_level(used, {r.level: r.v or 0.0 for r in t}, {r.level: r.c for r in t})
        drawn = written(drawn.unionByName(samples(spark, ls, field, quantity, f, {k: range(used[k], used[k] + batch)})), "samples")
        used[k] += batch
    s = statistics(drawn)
    return s.agg(F.sum("mean")).first()[0], s


def block_root(w: DataFrame, vdofs: DataFrame) -> DataFrame:
    """(i, j, v): the symmetric square root of a positive semidefinite W whose blocks are the dofs (vdof, vertex) of a vertex, as W is on every
    level. A group is a vertex; ValueError where an entry ties dofs of two vertices."""
    a, b = (vdofs.select(F.col("vdof").alias(k), F.col("vertex").alias(n)) for k, n in (("i", "g"), ("j", "h")))
    placed = w.join(a, "i").join(b, "j")
    if not placed.filter("g <> h and v <> 0").isEmpty():
        raise ValueError("W isn't block diagonal by vertices")

    def kernel(table):
        import pandas as pd

        ids = np.unique(table[["i", "j"]].to_numpy())
        block = np.zeros((len(ids), len(ids)))
        np.add.at(block, (np.searchsorted(ids, table["i"]), np.searchsorted(ids, table["j"])), table["v"])
        values, vectors = np.linalg.eigh(block)
        root = (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T
        return pd.DataFrame({"i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "v": root.ravel()})

    return placed.select("g", "i", "j", "v").groupBy("g").applyInPandas(kernel, "i long, j long, v double")


def level_noise(system, seed: int, scale: float = 1.0) -> DataFrame:
    """(i, v): noise of a level's own, scale * W^(1/2) times independent normals of its dofs, for fields that are sampled on this
    level without a finer one. Its covariance is scale^2 W, that of the restricted finer noise."""
    x = white_noise(system.vdofs.select(F.col("vdof").alias("i")), seed)
    return algebra.matvec(block_root(system.w, system.vdofs), x).select("i", (F.lit(scale) * F.col("v")).alias("v"))
