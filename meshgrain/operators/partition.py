"""Partitions of a graph's vertices: made, repaired, and taken apart into connected parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import Rounds, written
from ..sources.dealing import dealt
from .algebra import numbered


def parts_for(n: int, coarsening: float) -> int:
    """The number of parts for a coarsening factor."""
    return int(max(1, n / coarsening + 0.5))


def weight_bucket(w: Column, least: Column) -> Column:
    """An edge weight as a small integer: its binary logarithm over the least weight."""
    return (F.floor(F.log2(F.abs(w) / least)) + 1).cast("long")


def without_gaps(partition: DataFrame) -> DataFrame:
    """Part numbers from 0 without gaps, in order."""
    new = numbered(partition.select("agg").distinct(), "new", "agg")
    return partition.join(new, "agg").select("vertex", F.col("new").alias("agg"))


def isolate(partition: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each of the given vertices in a part of its own, numbered after all others in their order."""
    top = partition.agg((F.max("agg") + 1).alias("top"))
    own = numbered(vertices.select("vertex").distinct(), "k", "vertex")
    own = own.join(F.broadcast(top)).select("vertex", (F.col("top") + F.col("k")).cast("long").alias("alone"))
    return partition.join(own, "vertex", "left").select("vertex", F.coalesce("alone", "agg").alias("agg"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges with both ends among the vertices."""
    a, b = (vertices.select(F.col("vertex").alias(k)).distinct() for k in ("v0", "v1"))
    return edges.join(a, "v0", "left_semi").join(b, "v1", "left_semi")


def component_labels(edges: DataFrame, vertices: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, label): the least vertex of each vertex's component, by hooking and jumping of labels.

    Each round a vertex takes the least label among its neighbours' and then its label's label, so that long paths take
    a number of rounds in the order of their logarithm. A round's table is written to the shared folder.
    """
    e = edges.filter("v1 is not null").select("v0", "v1")
    both = written(e.unionByName(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"))).distinct(), "neighbours")
    table = Rounds("labels")
    at = table(vertices.select("vertex", F.col("vertex").alias("label")).distinct())
    for _ in range(rounds):
        near = both.join(at.select(F.col("vertex").alias("v1"), "label"), "v1").groupBy(F.col("v0").alias("vertex")).agg(F.min("label").alias("near"))
        step = at.join(near, "vertex", "left").select("vertex", "label", F.least("label", "near").alias("new"))
        # the label's own vertex follows as well: the least that any of its vertices has seen
        hook = step.groupBy("label").agg(F.min("new").alias("hook"))
        new = step.join(hook, "label").select("vertex", F.col("label").alias("old"), F.least("new", "hook").alias("label"))
        jump = new.select(F.col("vertex").alias("label"), F.col("label").alias("to"))
        new = table(new.join(jump, "label", "left").select("vertex", "old", F.least("label", "to").alias("label")))
        if new.filter("old <> label").isEmpty():
            return new.select("vertex", "label")
        at = new.select("vertex", "label")
    raise RuntimeError("labels still change")


def connected_parts(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(vertex, agg): parts split into connected components, numbered by (part, least vertex)."""
    from .topology import edge_aggregates

    inside = edge_aggregates(edges, partition).filter("a = b")
    labels = component_labels(inside, partition.select("vertex")).join(partition, "vertex")
    number = numbered(labels.select("agg", "label").distinct(), "new", "agg", "label")
    return labels.join(number, ["agg", "label"]).select("vertex", F.col("new").alias("agg"))


def cartesian(cells: DataFrame, blocks: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(vertex, agg) of a structured grid (cell, ix, iy, iz) in blocks of `blocks` cells; `size` is the grid's."""
    n = [-(-s // b) for s, b in zip(size, blocks)]
    x, y, z = (F.floor(F.col(c) / F.lit(b)).cast("long") for c, b in zip(("ix", "iy", "iz"), blocks))
    return cells.select(F.col("cell").alias("vertex"), (x + n[0] * (y + n[1] * z)).alias("agg"))


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """A diag(1 / M) A^T with A the unsigned incidence, M = 1 / w: what a partitioner with weights cuts."""
    e = edges.select(F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a in ("v0", "v1") for b in ("v0", "v1")])).alias("t"), "w")
    return dealt(e.select("t.*", "w").filter("i is not null and j is not null"), "i", "j").groupBy("i", "j").agg(F.sum("w").alias("v"))


def without_vertices(edges: DataFrame, vertices: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and vertices that are left for a partitioner when some vertices are isolated before."""
    rest = vertices.select("vertex").distinct().join(alone.select("vertex"), "vertex", "left_anti")
    return induced(edges, rest), rest


def kept_alone(partition: DataFrame, vertices: DataFrame) -> DataFrame:
    """A partition with vertices alone on their level; their parts are (agg) of the result for these, to be kept alone on the
    next."""
    return without_gaps(isolate(partition, vertices))


def grow(edges: DataFrame, vertices: DataFrame, parts: int, rounds: int | None = None, seed: int = 1, balance: float = 2.0) -> DataFrame:
    """(vertex, agg): about `parts` parts by label propagation from hashed seeds; connected by construction.

    Seeds are the vertices of least hash. In each round a vertex without a part takes that of the neighbour with the
    largest weight towards it, and a part takes at most so many, the heaviest first, that it stays within `balance` times the
    mean size; a vertex that is turned away goes on asking the others. It ends when nothing changes, or after `rounds`.
    What is left, as it isn't reached or its neighbours' parts are full, makes a part for each connected component.
    """
    v = written(vertices.select("vertex").distinct(), "vertices")
    most = max(1, int(balance * v.count() / max(1, parts)))
    seeds = v.orderBy(F.xxhash64("vertex", F.lit(seed)), "vertex").limit(parts)
    table = Rounds("parts")
    at = table(numbered(seeds, "agg", "vertex").select("vertex", "agg"))
    e = edges.filter("v1 is not null").select("v0", "v1", "w")
    both = written(e.unionByName(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"), "w")), "neighbours")
    for _ in range(rounds if rounds is not None else 1000):
        room = at.groupBy("agg").agg((F.lit(most) - F.count(F.lit(1))).alias("room")).filter("room > 0")
        pull = both.join(at.select(F.col("vertex").alias("v1"), "agg"), "v1").join(at.select(F.col("vertex").alias("v0")), "v0", "left_anti")
        best = pull.groupBy("v0", "agg").agg(F.sum("w").alias("w")).join(room, "agg").groupBy("v0").agg(F.max(F.struct("w", -F.col("agg"), "room")).alias("m"))
        new = best.select(F.col("v0").alias("vertex"), (-F.col("m.col2")).cast("long").alias("agg"), "m.w", "m.room")
        rank = F.row_number().over(Window.partitionBy("agg").orderBy(F.desc("w"), "vertex"))
        now = table(new.withColumn("rank", rank).filter("rank <= room").select("vertex", "agg", F.lit(True).alias("new")).unionByName(at.withColumn("new", F.lit(False))))
        at = now.select("vertex", "agg")
        if now.filter("new").isEmpty():
            break
    rest = v.join(at, "vertex", "left_anti")
    if rest.isEmpty():
        return at
    lost = component_labels(induced(edges, rest), rest)
    number = numbered(lost.select("label").distinct(), "k", "label").select("label", (F.col("k") + parts).alias("agg"))
    return at.unionByName(lost.join(number, "label").select("vertex", "agg"))


def colours(adjacency: DataFrame, seed: int | None = None, rounds: int = 1000) -> DataFrame:
    """(vertex, colour): different colours for the neighbours of a graph (i, j), each the least that is free.

    In a round, each vertex without a colour whose uncoloured neighbours all come later takes the least colour that none of
    its neighbours has: what a greedy pass gives in that order. The order is that of the vertices, or, with a seed, of
    a hash, by which the rounds of a sparse graph are few. Vertices without neighbours aren't in the graph.
    """
    e = adjacency.filter("i <> j").select("i", "j")
    both = written(e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "neighbours")
    table = Rounds("colours")
    at = table(both.select(F.col("i").alias("vertex")).distinct().withColumn("colour", F.lit(None).cast("long")))
    place = lambda c: F.col(c) if seed is None else F.struct(F.xxhash64(c, F.lit(seed)), F.col(c))
    for _ in range(rounds):
        if at.filter("colour is null").isEmpty():
            return at
        near = both.join(at.select(F.col("vertex").alias("j"), "colour"), "j").join(at.filter("colour is null").select(F.col("vertex").alias("i")), "i", "left_semi")
        waits = F.max(F.col("colour").isNull() & (place("j") < place("i")))
        told = near.groupBy("i").agg(waits.alias("waits"), F.collect_set("colour").alias("taken")).filter("not waits")
        free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("taken").cast("long")), "taken"))
        new = told.select(F.col("i").alias("vertex"), free.alias("new"))
        at = table(at.join(new, "vertex", "left").select("vertex", F.coalesce("colour", "new").alias("colour")))
    raise RuntimeError(f"vertices without a colour after {rounds} rounds")
