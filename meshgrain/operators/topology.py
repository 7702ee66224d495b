"""Graphs and their topology under a partition.

A graph is a table of edges (edge, v0, v1, w), v0 < v1; v1 is null for a boundary edge. A partition is (vertex, agg).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dealing import dealt
from .algebra import numbered


def incidence(edges: DataFrame) -> DataFrame:
    """(vertex, edge, ord): the vertices of each edge, in order."""
    both = edges.select("edge", F.posexplode(F.array("v0", "v1")).alias("ord", "vertex"))
    return both.filter("vertex is not null").select("vertex", "edge", "ord")


def degrees(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))


def signed_incidence(edges: DataFrame) -> DataFrame:
    """D as (i = vertex, j = edge, v): +1 at an edge's first vertex, -1 at its second."""
    return incidence(edges).select(F.col("vertex").alias("i"), F.col("edge").alias("j"), F.when(F.col("ord") == 0, 1.0).otherwise(-1.0).alias("v"))


def half_weights(edges: DataFrame) -> DataFrame:
    """(vertex, edge, w): an edge's weight split over its vertices, so that the inverses add up to the inverse."""
    twice = F.when(F.col("v1").isNull(), 1.0).otherwise(2.0) * F.col("w")
    both = edges.select("edge", twice.alias("w"), F.explode(F.array("v0", "v1")).alias("vertex"))
    return both.filter("vertex is not null").select("vertex", "edge", "w")


def laplacian(edges: DataFrame) -> DataFrame:
    """D M^-1 D^T as (i, j, v): each edge's four entries, added up."""
    e = edges.select(F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), (s * F.col("w")).alias("v")) for a, b, s in (("v0", "v0", 1), ("v1", "v1", 1), ("v0", "v1", -1), ("v1", "v0", -1))])).alias("t"))
    return dealt(e.select("t.*").filter("i is not null and j is not null"), "i", "j").groupBy("i", "j").agg(F.sum("v").alias("v"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, v) without the diagonal: weights between neighbours."""
    return laplacian(edges).filter("i <> j").select("i", "j", (-F.col("v")).alias("v"))


def edge_aggregates(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(edge, v0, v1, w, a, b): edges with the aggregates of both ends."""
    a = partition.select(F.col("vertex").alias("v0"), F.col("agg").alias("a"))
    b = partition.select(F.col("vertex").alias("v1"), F.col("agg").alias("b"))
    return edges.join(a, "v0").join(b, "v1", "left").select("edge", "v0", "v1", "w", "a", "b")


def aggregate_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg, edge, ends): the edges of each aggregate; ends = 2 for an edge inside it."""
    e = edge_aggregates(edges, partition).select("edge", F.explode(F.array("a", "b")).alias("agg")).filter("agg is not null")
    return dealt(e, "agg", "edge").groupBy("agg", "edge").agg(F.count(F.lit(1)).alias("ends"))


def interior_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg, n, w): the number and weight of the edges inside each aggregate."""
    return edge_aggregates(edges, partition).filter("a = b").groupBy(F.col("a").alias("agg")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def faces(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg0, agg1, n_edges, w), agg0 < agg1: the interior faces with the number and weight of their edges."""
    e = edge_aggregates(edges, partition).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("agg0"), F.greatest("a", "b").alias("agg1")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"))


def numbered_faces(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(face, agg0, agg1): faces from 0 in the order of their aggregates."""
    return numbered(faces(edges, partition).select("agg0", "agg1"), "face", "agg0", "agg1").select("face", "agg0", "agg1")


def face_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(face, edge): the edges of each interior face."""
    e = edge_aggregates(edges, partition).filter("a <> b").select("edge", F.least("a", "b").alias("agg0"), F.greatest("a", "b").alias("agg1"))
    return e.join(numbered_faces(edges, partition), ["agg0", "agg1"]).select("face", "edge")


def boundary_faces(edge_attributes: DataFrame, edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg, attr, n_edges): a boundary face for each aggregate and attribute of its edges (edge, attr)."""
    return aggregate_edges(edges, partition).join(edge_attributes, "edge").groupBy("agg", "attr").agg(F.count(F.lit(1)).alias("n_edges"))


def marked_edges(edge_attributes: DataFrame, essential: DataFrame) -> DataFrame:
    """(edge): the edges on a boundary attribute (attr) that is marked. Attributes are few, so that edges aren't dealt by them."""
    return edge_attributes.join(F.broadcast(essential.select("attr")), "attr", "left_semi").select("edge").transform(dealt, "edge").distinct()


def coarse_graph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph of aggregates: a face is an edge, with the sum of its edges' weights."""
    return numbered(faces(edges, partition), "edge", "agg0", "agg1").select("edge", F.col("agg0").alias("v0"), F.col("agg1").alias("v1"), "w")


def face_attributes(edge_attributes: DataFrame, edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg0, agg1, attr): the attributes (edge, attr) that a face's edges have."""
    e = edge_aggregates(edges, partition).filter("a <> b").join(edge_attributes, "edge")
    return e.select(F.least("a", "b").alias("agg0"), F.greatest("a", "b").alias("agg1"), "attr").distinct()


def neighbours(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(i, j): aggregates that share an edge, each pair in both orders, and each with itself if it has an edge."""
    e = aggregate_edges(edges, partition)
    return e.select(F.col("agg").alias("i"), "edge").join(e.select(F.col("agg").alias("j"), "edge"), "edge").select("i", "j").distinct()


def sizes(partition: DataFrame, fine: DataFrame | None = None) -> DataFrame:
    """(i, v): how many finest vertices each aggregate has; fine (i, v) are the vertices' own sizes, 1 without."""
    if fine is None:
        return partition.groupBy(F.col("agg").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    x = fine.select(F.col("i").alias("vertex"), "v")
    return partition.join(x, "vertex").groupBy(F.col("agg").alias("i")).agg(F.sum("v").alias("v"))


def extended_aggregates(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(agg, vertex): each aggregate with the neighbours of its vertices."""
    e = edge_aggregates(edges, partition).filter("v1 is not null")
    out = e.select(F.col("a").alias("agg"), F.col("v1").alias("vertex")).unionByName(e.select(F.col("b").alias("agg"), F.col("v0").alias("vertex")))
    return dealt(out.unionByName(partition.select("agg", "vertex")), "agg", "vertex").distinct()


def compose(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(vertex, agg): a partition of a partition's aggregates, brought down to the vertices."""
    return fine.select("vertex", F.col("agg").alias("mid")).join(coarse.select(F.col("vertex").alias("mid"), "agg"), "mid").select("vertex", "agg")


def edge_owner(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(edge, owner): the lowest part that has an end of the edge."""
    return edge_aggregates(edges, partition).select("edge", F.least("a", "b").alias("owner"))
