"""Whole studies on a graph or a grid: each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra, elements, hierarchy, montecarlo, nonlinear, spectral, topology
from ..sources.checkpoints import written


def upscaling(edges: DataFrame, vertices: DataFrame, partitions: Sequence[DataFrame | None], f: DataFrame, par: spectral.Parameters = spectral.Parameters()) -> DataFrame:
    """(level, vertex, edge, div, complexity): the errors of the solutions on every level."""
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, vertices), partitions, par)
    rows = [(k, *h.errors(k, f).values()) for k in range(1, len(h.systems))]
    return f.sparkSession.createDataFrame(rows, "level int, vertex double, edge double, div double, complexity double")


def inverse_power(h: hierarchy.Hierarchy, level: int, x: DataFrame, steps: int = 30, tolerance: float = 1e-6) -> float:
    """The smallest nonzero eigenvalue of the fine operator, by power iteration with solves on a level as the inverse; steps and tolerance
    as of power_iterate."""

    def apply(y: DataFrame) -> DataFrame:
        return h.upscaled(level, y)[1].select("i", (-F.col("v")).alias("v"))

    value, _ = algebra.power_iterate(lambda y: apply(algebra.minus_mean(y)), x, steps, tolerance, written)
    return 1 / abs(value)


def topology_levels(edges: DataFrame, vertices: DataFrame, partitions: Sequence[DataFrame]) -> DataFrame:
    """(level, vertex, agg): the aggregates of each level brought down to the finest vertices."""
    out = down = None
    for k, p in enumerate(partitions):
        down = p.select("vertex", "agg") if down is None else topology.compose(down, p)
        part = down.select(F.lit(k + 1).alias("level"), "vertex", "agg")
        out = part if out is None else out.unionByName(part)
    return out


def time_steps(system: spectral.System, u: DataFrame, volumes: DataFrame, dt: float, steps: int) -> DataFrame:
    """(step, i, v): backward Euler from u."""
    out = u.select(F.lit(0).alias("step"), "i", "v")
    for k in range(steps):
        u = written(elements.step_in_time(system, u, volumes, dt)[1], "step")
        out = out.unionByName(u.select(F.lit(k + 1).alias("step"), "i", "v"))
    return out


def field_statistics(spark, field: montecarlo.Field, level: int, samples: int) -> DataFrame:
    """(elem, n, mean, varsum, variance) of a random field's logarithm, over samples."""
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        import pandas as pd

        for t in batches:
            for s in t["id"].tolist():
                v = shared.value.logarithm(s, level)
                yield pd.DataFrame({"elem": np.arange(len(v)), "sample": s, "v": v})

    drawn = spark.range(samples).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "elem long, sample long, v double")
    return montecarlo.statistics(drawn, "elem", "v")


def nonlinear_iterations(spark, levels: list[montecarlo.Level], k: nonlinear.Conductivity, f: np.ndarray) -> DataFrame:
    """(method, levels, iterations, residual) of Picard and Newton on the finest level and on all."""
    rows = []
    for name, newton in (("picard", False), ("newton", True)):
        for n in sorted({1, len(levels)}):
            r = nonlinear.solve(levels[:n], k, f, newton=newton)
            rows.append((name, n, r.iterations, r.residual))
    return spark.createDataFrame(rows, "method string, levels int, iterations int, residual double")
