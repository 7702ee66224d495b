"""Degrees of freedom: numbering by prefix sums, and their relations to vertices, edges and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dealing import dealt, shares
from . import algebra
from .algebra import numbered, offsets


def entity_dofs(sizes: DataFrame, entity: str = "id", count: str = "n") -> DataFrame:
    """(id, dof): consecutive numbers, as many for each entity (a number) as its count."""
    start = offsets(sizes.select(F.col(entity).alias("id"), F.col(count).cast("long").alias("n")), "id", "n")
    return start.filter("n > 0").select("id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("dof"))


def vertex_edofs(targets: DataFrame, traces: DataFrame, face_aggs: DataFrame) -> DataFrame:
    """(agg, edof, v): an aggregate's bubbles (2.0, one fewer than its targets, numbered after all traces) and the traces
    of its faces (1.0). targets: (id, n) of aggregates, traces: (id, n) of faces, face_aggs: (face, agg)."""
    of_face = entity_dofs(traces).select(F.col("id").alias("face"), F.col("dof").alias("edof"))
    total = traces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("traces"))
    bubbles = entity_dofs(targets.select("id", (F.col("n") - 1).alias("n"))).join(F.broadcast(total)).select(F.col("id").alias("agg"), (F.col("dof") + F.col("traces")).cast("long").alias("edof"), F.lit(2.0).alias("v"))
    return bubbles.unionByName(face_aggs.join(of_face, "face").select("agg", "edof", F.lit(1.0).alias("v")))


def interior(relation: DataFrame) -> DataFrame:
    """(agg, edof): where the tags add up to 2, a bubble or an edge seen from both sides."""
    return dealt(relation, "agg", "edof").groupBy("agg", "edof").agg(F.sum("v").alias("s")).filter("s >= 1.5").select("agg", "edof")


def true_entities(shares: DataFrame) -> DataFrame:
    """(entity, true, owner): shares are (entity, shared), entities that stand for one shared thing; the least of them owns it
    and gives it its number."""
    return shares.select("entity", "shared", F.min("entity").over(Window.partitionBy("shared")).alias("owner"))


def owned_numbers(owners: DataFrame) -> DataFrame:
    """(edge, owner, number): edges numbered from 0 owner by owner, and by edge within one."""
    return numbered(owners, "number", "owner", "edge").select("edge", "owner", "number")


def essential(edof_attributes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(i): the edofs (edof, attr) on an essential attribute (attr)."""
    return edof_attributes.join(F.broadcast(attributes.select("attr").distinct()), "attr", "left_semi").select(F.col("edof").alias("i")).transform(dealt, "i").distinct()


def averages(x: DataFrame, partition: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(i, v): a vector's average on each aggregate, weighted by the vertices' sizes (i, v) if given."""
    p = partition.select(F.col("vertex").alias("i"), "agg")
    z = x.join(p, "i")
    z = z.join(sizes.select("i", F.col("v").alias("w")), "i") if sizes is not None else z.withColumn("w", F.lit(1.0))
    return z.groupBy(F.col("agg").alias("i")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def piecewise_constant(x: DataFrame, partition: DataFrame) -> DataFrame:
    """(i, v): values of aggregates brought to their vertices."""
    return partition.join(x.select(F.col("i").alias("agg"), "v"), "agg").select(F.col("vertex").alias("i"), "v")


def block_apply(m: DataFrame, d: DataFrame, x: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """A block vector (block, i, v), 0 the fluxes and 1 the potentials, times [[M, D^T], [D, 0]]; rows of the fixed edofs (i)
    give the vector's own value."""
    s, u = algebra.block_vector(x, 0), algebra.block_vector(x, 1)
    n = shares(m, s)
    own = algebra.matvec(dealt(m, "j", parts=n), dealt(s, "i", parts=n), many=True)
    top = algebra.combine((1.0, own), (1.0, algebra.matvec(d, u, transposed=True, many=True)), parts=n)
    if fixed is not None:
        fixed = dealt(fixed.select("i"), "i", parts=n).distinct()
        kept = fixed.join(dealt(s, "i", parts=n), "i")
        top = top.join(fixed, "i", "left_anti").unionByName(kept.select("i", "v"))
    return algebra.stacked(top, algebra.matvec(d, s))
