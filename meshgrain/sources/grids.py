"""Generated graphs: paths, rings with rewiring, structured grids with two-point fluxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path(spark: SparkSession, n: int) -> DataFrame:
    """The path of n vertices, unit weights, as edges (edge, v0, v1, w)."""
    return spark.range(n - 1).select(F.col("id").alias("edge"), F.col("id").alias("v0"), (F.col("id") + 1).alias("v1"), F.lit(1.0).alias("w"))


def ring(spark: SparkSession, n: int, degree: int) -> DataFrame:
    """(v0, v1), v0 < v1: each of n vertices with its degree / 2 next ones around a ring."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(degree // 2)))
    e = spark.range(n).select(F.col("id").alias("a"), steps.alias("d")).select("a", F.pmod(F.col("a") + F.col("d"), F.lit(n)).alias("b"))
    return e.select(F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))


def small_world(spark: SparkSession, n: int, degree: int, beta: float, seed: int = 0) -> DataFrame:
    """A ring whose edges are rewired with probability beta; n degree / 2 edges, none double, unit weights.

    Rewiring looks at all edges so far and is sequential; one task holds the graph. Each vertex in turn may trade a
    larger friend for any vertex that is neither itself nor a friend.
    """
    if not 0 <= beta <= 1 or degree % 2 or not degree < n or (seed and not degree > math.log(n)):
        raise ValueError("0 <= beta <= 1, an even degree, ln n < degree < n")
    import numpy as np
    import pandas as pd

    def rewire(table: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        friends: list[set[int]] = [set() for _ in range(n)]
        for a, b in zip(table["v0"].tolist(), table["v1"].tolist()):
            friends[a].add(b)
            friends[b].add(a)
        for a in range(n):
            for b in sorted(x for x in friends[a] if x > a):
                if rng.random() < beta and len(friends[a]) < n - 1:
                    while (c := int(rng.integers(n))) == a or c in friends[a]:
                        pass
                    friends[a].remove(b)
                    friends[b].remove(a)
                    friends[a].add(c)
                    friends[c].add(a)
        pairs = sorted((a, b) for a in range(n) for b in friends[a] if b > a)
        return pd.DataFrame({"edge": range(len(pairs)), "v0": [p[0] for p in pairs], "v1": [p[1] for p in pairs], "w": 1.0})

    return ring(spark, n, degree).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(rewire, "edge long, v0 long, v1 long, w double")


def cells(spark: SparkSession, size: tuple[int, int, int]) -> DataFrame:
    """(cell, ix, iy, iz) of a structured grid, x fastest."""
    nx, ny, nz = size
    c = F.col("id")
    return spark.range(nx * ny * nz).select(c.alias("cell"), F.pmod(c, F.lit(nx)).alias("ix"), F.pmod(F.floor(c / nx), F.lit(ny)).alias("iy"), F.floor(c / (nx * ny)).alias("iz"))


def cell_faces(grid: DataFrame, size: tuple[int, int, int], dimensions: int = 3) -> DataFrame:
    """(face, axis, cell0, cell1, attr): the inner faces, cell0 < cell1, and those of the boundary (cell1 null, attr from 1
    on: low x, high x, low y, ...). `face` is a number from 0 without gaps only within an axis."""
    nx, ny, nz = size
    step = (1, nx, nx * ny)
    out = None
    for axis, (name, n) in enumerate(zip(("ix", "iy", "iz")[:dimensions], size)):
        up = grid.select(F.lit(axis).alias("axis"), F.col("cell").alias("cell0"), F.when(F.col(name) < n - 1, F.col("cell") + step[axis]).alias("cell1"), F.when(F.col(name) == n - 1, F.lit(2 * axis + 2)).alias("attr"))
        down = grid.filter(F.col(name) == 0).select(F.lit(axis).alias("axis"), F.col("cell").alias("cell0"), F.lit(None).cast("long").alias("cell1"), F.lit(2 * axis + 1).alias("attr"))
        part = up.unionByName(down)
        out = part if out is None else out.unionByName(part)
    number = (F.col("cell0") * 2 + F.when(F.col("attr") % 2 == 1, 1).otherwise(0)) * 3 + F.col("axis")
    return out.select(number.cast("long").alias("face"), "axis", "cell0", "cell1", "attr")


def two_point_weights(faces: DataFrame, permeability: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """(edge, v0, v1, w, attr): the graph of cells. permeability is (cell, kx, ky, kz).

    A cell's half weight at a face is area * k / distance, the distance from the cell's centre to the face's; an edge's
    weight is the inverse of the sum of its halves' inverses.
    """
    hx, hy, hz = spacing
    area = F.when(F.col("axis") == 0, hy * hz).when(F.col("axis") == 1, hx * hz).otherwise(hx * hy)
    h = F.when(F.col("axis") == 0, hx).when(F.col("axis") == 1, hy).otherwise(hz)
    k = F.when(F.col("axis") == 0, F.col("kx")).when(F.col("axis") == 1, F.col("ky")).otherwise(F.col("kz"))
    halves = faces.select("face", "axis", "cell0", "cell1", "attr", F.explode(F.array("cell0", "cell1")).alias("cell")).filter("cell is not null")
    halves = halves.join(permeability, "cell").select("face", "cell0", "cell1", "attr", (area * k * 2.0 / h).alias("half"))
    return halves.groupBy("face", "cell0", "cell1", "attr").agg((1 / F.sum(1 / F.col("half"))).alias("w")).select(F.col("face").alias("edge"), F.col("cell0").alias("v0"), F.col("cell1").alias("v1"), "w", "attr")


def reservoir(spark: SparkSession, permeability: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float], plane: str = "none", at: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (edge, v0, v1, w, attr) and cells (cell, ix, iy, iz) of a grid with permeability (ix, iy, iz, kx, ky, kz), or of its
    slice: plane xy, xz or yz, the third index `at`. A slice is a grid of one layer whose axes are the plane's."""
    axes = {"none": "xyz", "xy": "xyz", "xz": "xzy", "yz": "yzx"}[plane]
    place = ["xyz".index(c) for c in axes]
    size, spacing = [size[k] for k in place], [spacing[k] for k in place]
    k = permeability.select(*[F.col(f"i{c}").alias(n) for c, n in zip(axes, ("ix", "iy", "iz"))], *[F.col(f"k{c}").alias(n) for c, n in zip(axes, ("kx", "ky", "kz"))])
    if plane != "none":
        k, size = k.filter(F.col("iz") == at).withColumn("iz", F.lit(0).cast("long")), [*size[:2], 1]
    grid = cells(spark, tuple(size))
    own = grid.join(k, ["ix", "iy", "iz"]).select("cell", "kx", "ky", "kz")
    return two_point_weights(cell_faces(grid, tuple(size), 3 if plane == "none" else 2), own, tuple(spacing)), grid


def half_domain(grid: DataFrame, nx: int, value: float = 1.0) -> DataFrame:
    """(i, v): -value on the low half in x, +value on the high one."""
    return grid.select(F.col("cell").alias("i"), F.when(F.col("ix") < nx / 2, -value).otherwise(value).alias("v"))


def corner_wells(grid: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(i, v): +1 in the first cell, -1 in the last, 0 elsewhere."""
    last = size[0] * size[1] * size[2] - 1
    return grid.select(F.col("cell").alias("i"), F.when(F.col("cell") == 0, 1.0).when(F.col("cell") == last, -1.0).otherwise(0.0).alias("v"))


def wedge(grid: DataFrame, nx: int, width: float = 1.0) -> DataFrame:
    """(i, v): exp(-x / width) of the cells' x index, less its mean, so that nothing is left over."""
    x = grid.select(F.col("cell").alias("i"), F.exp(-F.col("ix") / (nx * width)).alias("v"))
    return x.join(F.broadcast(x.agg(F.avg("v").alias("mean")))).select("i", (F.col("v") - F.col("mean")).alias("v"))


def inflow(faces: DataFrame, attribute: int, value: float = 1.0) -> DataFrame:
    """(i, v): a flux through the boundary faces of an attribute, as a source in their cells; other cells have no row."""
    return faces.filter(F.col("attr") == attribute).groupBy(F.col("cell0").alias("i")).agg((F.lit(float(value)) * F.count(F.lit(1))).alias("v"))


def geometry(grid: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """(cell, volume, z): volumes of the cells and the heights of their centres."""
    hx, hy, hz = spacing
    return grid.select("cell", F.lit(float(hx * hy * hz)).alias("volume"), ((F.col("iz") + 0.5) * hz).alias("z"))


def lookup(points: DataFrame, field: DataFrame, spacing: tuple[float, float, float], plane: str = "none", at: int = 0) -> DataFrame:
    """Points (id, x, y, z) with the coefficient (ix, iy, iz, kx, ky, kz) of the cell that they are in. In a slice, `plane` xy,
    xz or yz, the points' first two coordinates are those of the plane and the third index is `at`. frobenius is the norm of
    the diagonal tensor."""
    index = {"none": "xyz", "xy": "xy", "xz": "xz", "yz": "yz"}[plane]
    named = dict(zip(index, ("x", "y", "z")))
    # a point on a cell's upper edge up to rounding belongs to the cell below it, as a division alone would have it
    place = [F.floor(F.col(named[c]) / F.lit(h) / F.lit(1 + 3e-16)).cast("long") if c in named else F.lit(at).cast("long") for c, h in zip("xyz", spacing)]
    cells_ = points.select("id", *[p.alias(n) for p, n in zip(place, ("ix", "iy", "iz"))])
    k = cells_.join(field, ["ix", "iy", "iz"]).select("id", "kx", "ky", "kz")
    return k.withColumn("frobenius", F.sqrt(F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz")))


def finite_volume_mass(faces: DataFrame, permeability: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """(cell, face, v): h / (2 k area) of each face of each cell; their sums over a face's cells are the inverses of
    two_point_weights."""
    hx, hy, hz = spacing
    axis = lambda *v: F.when(F.col("axis") == 0, v[0]).when(F.col("axis") == 1, v[1]).otherwise(v[2])
    both = faces.select("face", "axis", F.explode(F.array("cell0", "cell1")).alias("cell")).filter("cell is not null")
    k = axis(F.col("kx"), F.col("ky"), F.col("kz"))
    return both.join(permeability, "cell").select("cell", "face", (axis(hx, hy, hz) / (2 * k * axis(hy * hz, hx * hz, hx * hy))).alias("v"))


def numbered(edges: DataFrame) -> DataFrame:
    """Edges renumbered from 0 without gaps in the order of (v0, v1), by quantiles of v0."""
    from ..operators import algebra

    named = algebra.numbered(edges.withColumnRenamed("edge", "old"), "edge", "v0", "v1", "old")
    return named.select("edge", *[c for c in edges.columns if c != "edge"])
