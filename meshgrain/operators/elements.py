"""Element matrices: the mass matrix M kept as a sum over vertices or aggregates, so that a new coefficient reweights it.

Elements are (elem, i, j, v). On the finest level a vertex's element has the inverse half weights of its edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import krylov
from ..sources.checkpoints import written
from . import algebra, topology
from .spectral import System


def fine_elements(edges: DataFrame) -> DataFrame:
    h = topology.half_weights(edges)
    return h.select(F.col("vertex").alias("elem"), F.col("edge").alias("i"), F.col("edge").alias("j"), (1 / F.col("w")).alias("v"))


def _weighted(elements: DataFrame, coefficient: DataFrame | None) -> DataFrame:
    if coefficient is None:
        return elements
    c = coefficient.select(F.col("i").alias("elem"), F.col("v").alias("c"))
    return elements.join(c, "elem").select("elem", "i", "j", (F.col("v") / F.col("c")).alias("v"))


def assemble(elements: DataFrame, coefficient: DataFrame | None = None) -> DataFrame:
    """M, each element divided by its coefficient (i, v)."""
    return _weighted(elements, coefficient).groupBy("i", "j").agg(F.sum("v").alias("v"))


def apply(elements: DataFrame, x: DataFrame, coefficient: DataFrame | None = None) -> DataFrame:
    """M(coefficient) x without assembling M."""
    y = x.select(F.col("i").alias("j"), F.col("v").alias("u"))
    return _weighted(elements, coefficient).join(y, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("u")).alias("v"))


def coarse_elements(elements: DataFrame, partition: DataFrame, ps: DataFrame) -> DataFrame:
    """P^T M P by aggregate: an aggregate's element is the product over its vertices' elements."""
    own = elements.join(partition.select(F.col("vertex").alias("elem"), "agg"), "elem").groupBy("agg", "i", "j").agg(F.sum("v").alias("v"))
    right = ps.select(F.col("i").alias("j"), F.col("j").alias("cj"), F.col("v").alias("r"))
    half = own.join(right, "j").groupBy("agg", "i", "cj").agg(F.sum(F.col("v") * F.col("r")).alias("v"))
    left = ps.select("i", F.col("j").alias("ci"), F.col("v").alias("l"))
    out = half.join(left, "i").groupBy("agg", "ci", "cj").agg(F.sum(F.col("v") * F.col("l")).alias("v"))
    return out.select(F.col("agg").alias("elem"), F.col("ci").alias("i"), F.col("cj").alias("j"), "v")


def mixed_apply(system: System, elements: DataFrame, x: tuple[DataFrame, DataFrame], coefficient: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(M(coefficient) sigma + D^T u, D sigma)."""
    s, u = x
    top = algebra.combine((1.0, apply(elements, s, coefficient)), (1.0, algebra.matvec(system.d, u, transposed=True)))
    return top, algebra.matvec(system.d, s)


def hybrid_solve(system: System, elements: DataFrame, f: DataFrame, coefficient: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixed solve by hybridization: flux dofs that two elements share are doubled, multipliers tie them.

    Each element condenses its fluxes and potentials; the condensed matrices are added up over multipliers; with these
    solved, each element finds its own fluxes and potentials. A shared flux is the mean of its two copies. Elements are
    the vertices of the system's level. The system of multipliers is solved on the driver up to LOCAL_DOFS of them, beyond by
    conjugate gradients over tables.
    """
    from .hierarchy import _local, _table, LOCAL_DOFS

    spark = f.sparkSession
    e = _weighted(elements, coefficient)
    ends = e.select("elem", F.col("i").alias("dof")).distinct()
    twice = ends.groupBy("dof").agg(F.count(F.lit(1)).alias("n"), F.min("elem").alias("first"))
    sign = ends.join(twice.filter("n = 2"), "dof").select(F.col("elem").alias("g"), F.lit("c").alias("kind"), F.col("dof").alias("i"), F.lit(0).cast("long").alias("j"), F.when(F.col("elem") == F.col("first"), 1.0).otherwise(-1.0).alias("v"))
    v = system.vdofs.select(F.col("vdof").alias("i"), F.col("vertex").alias("g"))
    d = system.d.join(v, "i").join(ends.select(F.col("elem").alias("g"), F.col("dof").alias("j")), ["g", "j"]).select("g", F.lit("d").alias("kind"), "i", "j", "v")
    parts = [
        e.select(F.col("elem").alias("g"), F.lit("m").alias("kind"), "i", "j", "v"), d, sign,
        v.join(f, "i", "left").select("g", F.lit("f").alias("kind"), "i", F.lit(0).cast("long").alias("j"), F.coalesce("v", F.lit(0.0)).alias("v")),
    ]
    if system.w is not None:
        parts.append(system.w.join(v, "i").select("g", F.lit("w").alias("kind"), "i", "j", "v"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def local(table: pd.DataFrame):
        from .spectral import _Group

        g = _Group(table)
        es, vs, cs = g.ids("m"), g.ids("f"), g.ids("c")
        m, dd = g.dense("m", es, es), g.dense("d", vs, es)
        w = g.dense("w", vs, vs)
        c = np.zeros((len(cs), len(es)))
        c[np.arange(len(cs)), np.searchsorted(es, cs)] = g.vector("c", cs)
        inv = np.linalg.inv(np.block([[m, dd.T], [dd, -w]]))
        return es, vs, cs, c, inv, g

    def condense(table: pd.DataFrame) -> pd.DataFrame:
        es, vs, cs, c, inv, g = local(table)
        n = len(es)
        h = c @ inv[:n, :n] @ c.T
        b = c @ inv[:n, n:] @ g.vector("f", vs)
        i, j = np.meshgrid(cs, cs, indexing="ij")
        return pd.DataFrame({"i": np.r_[i.ravel(), cs], "j": np.r_[j.ravel(), np.full(len(cs), -1)], "v": np.r_[h.ravel(), b]})

    made = written(rows.groupBy("g").applyInPandas(condense, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")), "multipliers")
    right = made.filter("j = -1").select("i", "v")
    if right.count() > LOCAL_DOFS:
        back = krylov.over_tables(made.filter("j >= 0"), right, 1e-10, 2000)
    else:
        t = right.toPandas().sort_values("i")
        ids, b = t["i"].to_numpy(), t["v"].to_numpy()
        mu = np.linalg.lstsq(_local(made.filter("j >= 0"), ids, ids), b, rcond=1e-12)[0] if len(ids) else b
        back = _table(spark, ids, mu) if len(ids) else spark.createDataFrame([], "i long, v double")
    of = sign.select("g", "i").join(back, "i").select("g", F.lit("x").alias("kind"), "i", F.lit(0).cast("long").alias("j"), "v")

    def recover(table: pd.DataFrame) -> pd.DataFrame:
        es, vs, cs, c, inv, g = local(table)
        x = inv @ np.r_[-c.T @ g.vector("x", cs), g.vector("f", vs)]
        return pd.DataFrame({"kind": ["s"] * len(es) + ["u"] * len(vs), "i": np.r_[es, vs], "v": x})

    out = rows.unionByName(of).groupBy("g").applyInPandas(recover, "kind string, i long, v double")
    s = out.filter("kind = 's'").groupBy("i").agg(F.avg("v").alias("v"))
    u = out.filter("kind = 'u'").select("i", "v")
    return s, u if system.w is not None else algebra.minus_projection(u, system.constant)


def step_in_time(system: System, u: DataFrame, volumes: DataFrame, dt: float) -> tuple[DataFrame, DataFrame]:
    """A backward Euler step: W = volume / dt, right-hand side -W u."""
    from .hierarchy import solve

    w = algebra.diagonal(volumes.select("i", (F.col("v") / dt).alias("v")))
    f = algebra.rescale(u, volumes.select("i", (-F.col("v") / dt).alias("v")))
    return solve(System(system.vdofs, system.edofs, system.m, system.d, system.constant, w), f)




def coefficient_components(system: System, partition: DataFrame, ps: DataFrame) -> DataFrame:
    """(a, b, i, j, v): the coarse M in parts that don't depend on the coefficient, for a diagonal fine M: a = b for what
    comes from the edofs inside an aggregate, a < b for those of a face."""
    from .spectral import _placed

    _, e = _placed(system, partition)
    m = system.m.filter("i = j").select("i", F.col("v").alias("m")).join(e.select(F.col("edof").alias("i"), "a", "b"), "i")
    x = ps.select("i", F.col("j").alias("ci"), F.col("v").alias("x"))
    y = ps.select("i", F.col("j").alias("cj"), F.col("v").alias("y"))
    out = m.join(x, "i").join(y, "i").groupBy("a", "b", "ci", "cj").agg(F.sum(F.col("m") * F.col("x") * F.col("y")).alias("v"))
    return out.select("a", "b", F.col("ci").alias("i"), F.col("cj").alias("j"), "v")


def assemble_components(components: DataFrame, coefficient: DataFrame) -> DataFrame:
    """M for a coefficient (i = aggregate, v): an inside part divided by the coefficient, a face's by the mean of both sides'."""
    a, b = (coefficient.select(F.col("i").alias(k), F.col("v").alias(f"c{k}")) for k in "ab")
    z = components.join(a, "a").join(b, "b")
    return z.groupBy("i", "j").agg(F.sum(F.col("v") * 2 / (F.col("ca") + F.col("cb"))).alias("v"))


def diagonal_rescaling(h: DataFrame) -> DataFrame:
    """(i, v): 1 / sqrt of a matrix's diagonal, to scale a system of multipliers."""
    return h.filter("i = j").select("i", (1 / F.sqrt("v")).alias("v"))
