"""Hierarchies of coarse systems, solves on any level, and upscaled solutions with their errors."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import krylov
from ..sources.checkpoints import Rounds, written
from . import algebra, dofs, kernels, multilevel, partition, spectral, topology
from .elements import assemble, coarse_elements

#: Levels of at most so many dofs are solved densely on the driver; beyond, over tables: by conjugate gradients where M is
#: diagonal, by minimal residuals elsewhere.
LOCAL_DOFS = 6000


@dataclass
class Hierarchy:
    systems: list[spectral.System]
    steps: list[spectral.Coarsening] = field(default_factory=list)
    #: Of each coarsening: its partition, the vertices that it left alone (None: none), and seconds.
    partitions: list[DataFrame] = field(default_factory=list)
    alone: list[DataFrame | None] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)
    #: M by elements, of the levels for which they are known.
    elements: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def build(
        system: spectral.System, partitions: Sequence[DataFrame | None], par: spectral.Parameters = spectral.Parameters(), *, alone: DataFrame | None = None, elements: DataFrame | None = None
    ) -> Hierarchy:
        """One coarsening for each partition (vertex, agg); None makes one with a small cut, by the coarsening factor.

        The vertices `alone` (vertex) are aggregates by themselves on every level: they are taken out before a partition is made, and
        out of a given one. With `elements` (elements.fine_elements), those of all levels are kept, for rescaled().
        """
        h = Hierarchy([system])
        if elements is not None:
            h.elements.append(elements)
        for p in partitions:
            start = time.time()
            s = h.systems[-1]
            if p is None:
                edges = s.edofs.filter("v0 <> v1").groupBy("v0", "v1").agg(F.min("edof").alias("edge"), F.lit(1.0).alias("w"))
                vertices = s.vdofs.select("vertex").distinct()
                if alone is not None:
                    edges, vertices = partition.without_vertices(edges, vertices, alone)
                p = multilevel.cut_parts(edges, vertices, partition.parts_for(vertices.count(), par.coarsening))
                if alone is not None:
                    p = p.unionByName(alone.select("vertex", F.lit(-1).cast("long").alias("agg")))
            if alone is not None:
                p = written(partition.kept_alone(p, alone), "partition")
            h.steps.append(spectral.coarsen(s, p, par))
            h.systems.append(h.steps[-1].coarse)
            h.partitions.append(p)
            h.alone.append(alone)
            if alone is not None:
                alone = p.join(alone.select("vertex"), "vertex", "left_semi").select(F.col("agg").alias("vertex"))
            if elements is not None:
                h.elements.append(written(coarse_elements(h.elements[-1], p, h.steps[-1].s), "elements"))
            h.seconds.append(time.time() - start)
        return h

    def rescaled(self, level: int, coefficient: DataFrame) -> spectral.System:
        """A level's system for another coefficient (i, v), one of each vertex of the level: its elements, divided by theirs and added
        up again. Nothing else is made anew, on this level or on others. Needs a hierarchy that was built with elements."""
        if level >= len(self.elements):
            raise ValueError("build the hierarchy with elements to rescale its levels")
        return dataclasses.replace(self.systems[level], m=written(assemble(self.elements[level], coefficient), "mass"))

    def restrict(self, level: int, x: DataFrame, flux: bool = False) -> DataFrame:
        """Level to level + 1, by the transposed transfer."""
        return algebra.matvec(self.steps[level].s if flux else self.steps[level].u, x, transposed=True)

    def interpolate(self, level: int, x: DataFrame, flux: bool = False) -> DataFrame:
        """Level to level - 1."""
        return algebra.matvec(self.steps[level - 1].s if flux else self.steps[level - 1].u, x)

    def project(self, level: int, x: DataFrame, flux: bool = False) -> DataFrame:
        """Level to level + 1: Q_sigma for fluxes, P_u^T for potentials."""
        return algebra.matvec(self.steps[level].q, x) if flux else self.restrict(level, x)

    def nonzeros(self) -> list[int]:
        """Of each level's block system: M, twice D, and W or the one entry that fixes the potential."""
        return [s.m.filter("v <> 0").count() + 2 * s.d.count() + (s.w.count() if s.w is not None else 1) for s in self.systems]

    def complexity(self) -> float:
        n = self.nonzeros()
        return sum(n) / n[0]

    def solve(self, level: int, f: DataFrame, g: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """sigma and u of the mixed system with right-hand side (g, f) on a level; options as of solve()."""
        return solve(self.systems[level], f, g, **options)

    def average(self, level: int, x: DataFrame, partition: DataFrame) -> DataFrame:
        """Level to level + 1 by piecewise constants: the averages over aggregates, by the vertices' sizes."""
        return dofs.averages(x, partition, self.sizes(level))

    def sizes(self, level: int) -> DataFrame:
        """(i, v): the number of finest vertices in each vertex of a level, as the square of the constant on it."""
        s = self.systems[level]
        c = s.vdofs.join(s.constant, F.col("vdof") == F.col("i"))
        return c.groupBy(F.col("vertex").alias("i")).agg(F.sum(F.col("v") * F.col("v")).alias("v"))

    def info(self) -> DataFrame:
        """(level, vertices, vdofs, edofs, nonzeros, complexity, seconds): complexity is that of the levels up to this one, seconds
        are those that making the level took, 0 for the given one."""
        n = self.nonzeros()
        took = [0.0, *self.seconds]
        rows = [(k, s.vdofs.select("vertex").distinct().count(), s.vdofs.count(), s.edofs.count(), n[k], sum(n[: k + 1]) / n[0], took[k]) for k, s in enumerate(self.systems)]
        return self.systems[0].vdofs.sparkSession.createDataFrame(rows, "level int, vertices long, vdofs long, edofs long, nonzeros long, complexity double, seconds double")

    def upscaled(self, level: int, f: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A fine right-hand side solved on a level, the solution brought back to the finest."""
        for k in range(level):
            f = self.restrict(k, f)
        s, u = self.solve(level, f)
        for k in range(level, 0, -1):
            s, u = self.interpolate(k, s, True), self.interpolate(k, u)
        return s, u

    def errors(self, level: int, f: DataFrame) -> dict[str, float]:
        """vertex, edge (weighted by M's square root) and divergence errors against the fine solution; complexity."""
        fine, coarse = self.solve(0, f), self.upscaled(level, f)
        weight = self.systems[0].m.filter("i = j").select("i", "v")
        return {
            "vertex": algebra.relative_error(coarse[1], fine[1]).first().error,
            "edge": algebra.relative_error(coarse[0], fine[0], weight).first().error,
            "div": algebra.divergence_error(self.systems[0].d, coarse[0], fine[0]).first().error,
            "complexity": self.complexity(),
        }


def _local(a: DataFrame, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    t = a.toPandas()
    out = np.zeros((len(rows), len(columns)))
    np.add.at(out, (np.searchsorted(rows, t["i"]), np.searchsorted(columns, t["j"])), t["v"])
    return out


def _vector(x: DataFrame | None, ids: np.ndarray) -> np.ndarray:
    return np.zeros(len(ids)) if x is None else x.toPandas().groupby("i")["v"].sum().reindex(ids).fillna(0.0).to_numpy()


def _table(spark, ids: np.ndarray, v: np.ndarray) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"i": ids, "v": v}), "i long, v double")


def solve(system: spectral.System, f: DataFrame, g: DataFrame | None = None, *, method: str = "auto", tolerance: float | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sigma and u of [[M, D^T], [D, -W]] (sigma, u) = (g, f). method: dense (on the driver, up to LOCAL_DOFS), cg (over tables,
    for a diagonal M), minres (over tables), or auto, the first of these that can. tolerance and most, the number of
    iterations, are for the iterations over tables; these raise if they don't come down to it."""
    spark = f.sparkSession
    small = system.vdofs.count() + system.edofs.count() <= LOCAL_DOFS if method in ("auto", "dense") else False
    if method == "dense" and not small:
        raise ValueError(f"more than {LOCAL_DOFS} dofs for the driver")
    if not small:
        options = {k: v for k, v in (("tolerance", tolerance), ("most", most)) if v is not None}
        if method == "auto":
            method = "cg" if algebra.is_diagonal(system.m) else "minres"
        return {"cg": conjugate_gradients, "minres": minimal_residuals}[method](system, f, g, **options)
    v = np.sort(system.vdofs.select("vdof").toPandas()["vdof"].to_numpy())
    e = np.sort(system.edofs.select("edof").toPandas()["edof"].to_numpy())
    w = _local(system.w, v, v) if system.w is not None else None
    s, u = kernels.mixed_solve(_local(system.m, e, e), _local(system.d, v, e), w, _vector(g, e), _vector(f, v), _vector(system.constant, v))
    return _table(spark, e, s), _table(spark, v, u)


def _zeros(dofs: DataFrame, dof: str) -> DataFrame:
    return dofs.select(F.col(dof).alias("i"), F.lit(0.0).alias("v")).distinct()


def schur(system: spectral.System) -> DataFrame:
    """D M^-1 D^T + W for a diagonal M, written."""
    minv = system.m.select("i", (1 / F.col("v")).alias("v"))
    a = algebra.congruence(algebra.transpose(system.d), minv)
    return written(algebra.combine((1.0, a), (1.0, system.w)) if system.w is not None else a, "schur")


def coarse_correction(a: DataFrame, transfers: Sequence[DataFrame]):
    """An additive preconditioner of A over the levels below: the diagonal on each level, joined by the transfers P (i, j, v), and
    on the last the inverse, densely where it has LOCAL_DOFS unknowns at most, its diagonal else.

    A function of a residual (i, v), symmetric and positive, for krylov.over_tables. Level operators P^T A P are written once.
    """
    levels = [(a, None)]
    for p in transfers:
        levels.append((written(algebra.galerkin(levels[-1][0], p), "level"), p))
    diagonals = [written(x.filter("i = j").groupBy("i").agg(F.sum("v").alias("v")), "diagonal") for x, _ in levels]
    last, inverse = levels[-1][0], None
    if transfers and diagonals[-1].count() <= LOCAL_DOFS:
        ids = np.sort(diagonals[-1].toPandas()["i"].to_numpy())
        inverse = np.linalg.pinv(_local(last, ids, ids), rcond=1e-12, hermitian=True)

    def apply(r: DataFrame) -> DataFrame:
        down = [r]
        for _, p in levels[1:]:
            down.append(algebra.matvec(p, down[-1], transposed=True))
        z = _table(r.sparkSession, ids, inverse @ _vector(down[-1], ids)) if inverse is not None else algebra.rescale(down[-1], diagonals[-1], inverse=True)
        for (_, p), diagonal, x in zip(levels[:0:-1], diagonals[-2::-1], down[-2::-1]):
            z = algebra.combine((1.0, algebra.rescale(x, diagonal, inverse=True)), (1.0, algebra.matvec(p, z)))
        return z

    return apply


def conjugate_gradients(
    system: spectral.System, f: DataFrame, g: DataFrame | None = None, tolerance: float = 1e-9, most: int = 500, *, transfers: Sequence[DataFrame] = (), history: list[float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same over tables, for a diagonal M: (D M^-1 D^T + W) u = D M^-1 g - f, and sigma = M^-1 (g - D^T u). Preconditioned by the
    diagonal, or, with a hierarchy's transfers of potentials (step.u of its steps, in order), by a correction on all of its levels.
    Each iteration's vectors are written to the shared folder."""
    if not algebra.is_diagonal(system.m):
        raise ValueError("conjugate gradients need a diagonal M; minimal_residuals takes others")
    minv = system.m.select("i", (1 / F.col("v")).alias("v"))
    a = schur(system)
    b = system.constant.select("i", "v") if system.w is None else None
    own = algebra.rescale(g.select("i", "v"), minv) if g is not None else None
    parts = [(1.0, _zeros(system.vdofs, "vdof")), (-1.0, f.select("i", "v"))]
    r = algebra.combine(*parts, *([(1.0, algebra.matvec(system.d, own))] if own is not None else []))
    u = krylov.over_tables(a, algebra.minus_projection(r, b) if b is not None else r, tolerance, most, coarse_correction(a, transfers) if transfers else None, history)
    u = written(algebra.minus_projection(u, b) if b is not None else u, "u")
    parts = [(1.0, _zeros(system.edofs, "edof")), (-1.0, algebra.rescale(algebra.matvec(system.d, u, transposed=True), minv))]
    return algebra.combine(*parts, *([(1.0, own)] if own is not None else [])), u


def minimal_residuals(system: spectral.System, f: DataFrame, g: DataFrame | None = None, tolerance: float = 1e-10, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The same over tables, for any M: both equations as one symmetric system, preconditioned by the diagonals of M and of
    D diag(M)^-1 D^T + W. Edofs are numbered 2 i + 1 and vdofs 2 i in it."""
    edge, vertex = (lambda c: F.col(c) * 2 + 1), (lambda c: F.col(c) * 2)
    block = lambda m, i, j, sign=1.0: m.select(i("i").alias("i"), j("j").alias("j"), (sign * F.col("v")).alias("v"))
    stacked = lambda x, i, sign=1.0: x.select(i("i").alias("i"), (sign * F.col("v")).alias("v"))
    a = block(system.m, edge, edge).unionByName(block(system.d, vertex, edge)).unionByName(block(algebra.transpose(system.d), edge, vertex))
    a = written(a.unionByName(block(system.w, vertex, vertex, -1.0)) if system.w is not None else a, "mixed")
    m = system.m.filter("i = j").groupBy("i").agg(F.sum("v").alias("v"))
    schur = system.d.join(m.select(F.col("i").alias("j"), F.col("v").alias("s")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("v") / F.col("s")).alias("v"))
    schur = algebra.combine((1.0, schur), (1.0, system.w.filter("i = j").select("i", "v"))) if system.w is not None else schur
    scale = stacked(m, edge).unionByName(stacked(schur, vertex)).select("i", F.col("v").alias("d"))
    right = algebra.combine((1.0, _zeros(system.vdofs, "vdof")), (1.0, f.select("i", "v")))
    right = algebra.minus_projection(right, system.constant) if system.w is None else right
    left = algebra.combine((1.0, _zeros(system.edofs, "edof")), *([(1.0, g.select("i", "v"))] if g is not None else []))
    v = stacked(left, edge).unionByName(stacked(right, vertex)).join(scale, "i")
    rounds = Rounds("minres")
    state = rounds(v.select("i", "d", "v", *(F.lit(0.0).alias(c) for c in ("v0", "w", "w0", "x"))))
    norm = lambda t: (t.agg(F.sum(F.col("v") * F.col("v") / F.col("d"))).first()[0] or 0.0) ** 0.5
    old, now = 1.0, norm(state)
    eta, start = now, now
    s0, s1, c0, c1 = 0.0, 0.0, 1.0, 1.0
    for _ in range(most):
        if abs(eta) <= tolerance * start:
            break
        state = state.withColumn("z", F.col("v") / F.col("d") / now)
        az = algebra.matvec(a, state.select("i", F.col("z").alias("v"))).select("i", F.col("v").alias("az"))
        state = rounds(state.join(az, "i"))
        delta = state.agg(F.sum(F.col("az") * F.col("z"))).first()[0]
        state = state.withColumns({"v": F.col("az") - delta / now * F.col("v") - now / old * F.col("v0"), "v0": F.col("v")}).drop("az")
        new = norm(state)
        a0 = c1 * delta - c0 * s1 * now
        a1, a2, a3 = (a0 * a0 + new * new) ** 0.5, s1 * delta + c0 * c1 * now, s0 * now
        s0, s1, c0, c1 = s1, new / a1, c1, a0 / a1
        w = (F.col("z") - a3 * F.col("w0") - a2 * F.col("w")) / a1
        state = state.withColumns({"w": w, "w0": F.col("w"), "x": F.col("x") + c1 * eta * w}).drop("z")
        eta, old, now = -s1 * eta, now, new
    if abs(eta) > tolerance * start:
        raise RuntimeError(f"minimal residuals: residual {abs(eta) / start:.1e} of the first after {most} iterations, above {tolerance:.1e}")
    state = written(state, "solution")
    s = state.filter("i % 2 <> 0").select(((F.col("i") - 1) / 2).cast("long").alias("i"), F.col("x").alias("v"))
    u = state.filter("i % 2 = 0").select((F.col("i") / 2).cast("long").alias("i"), F.col("x").alias("v"))
    return s, algebra.minus_projection(u, system.constant) if system.w is None else u


def fiedler(edges: DataFrame, steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(i, v): the second eigenvector of a connected graph's Laplacian, of length one. Up to LOCAL_DOFS vertices by a dense
    eigenproblem on the driver; beyond, by inverse iteration over tables, a solve by conjugate gradients in each step."""
    vertices = written(topology.incidence(edges).select("vertex").distinct(), "vertices")
    if vertices.count() <= LOCAL_DOFS:
        a = topology.laplacian(edges)
        ids = np.sort(vertices.toPandas()["vertex"].to_numpy())
        _, vectors = kernels.smallest_pairs(_local(a, ids, ids), 2, 1.0)
        return _table(edges.sparkSession, ids, vectors[:, 1])
    return inverse_iteration(spectral.fine_system(written(edges, "edges"), vertices), steps, tolerance)


def inverse_iteration(system: spectral.System, steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(i, v): the eigenvector of D M^-1 D^T with the least eigenvalue but that of the constant, M diagonal, from hashed values."""
    apply = lambda y: conjugate_gradients(system, algebra.minus_mean(y).select("i", (-F.col("v")).alias("v")))[1]
    x = algebra.minus_mean(system.vdofs.select(F.col("vdof").alias("i"), (F.xxhash64("vdof") / F.lit(float(1 << 63))).alias("v")))
    return algebra.power_iterate(apply, written(x, "start"), steps, tolerance, written)[1]
