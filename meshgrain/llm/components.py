"""Connected components of a table of links, by alternating large and small stars.

A large star links every larger neighbour of a vertex to the least of its neighbourhood, a small star every
smaller one; both keep the components, and after O(log n) rounds each is one star about its least vertex. Minima are
pre-aggregated before the shuffle and joined back, so that a vertex with many links stays spread. Each round is
written to the shared folder; only the number of vertices that aren't in a star yet comes to the driver, so that links
which are stars already take no round. Components that grow by a few links are taken again over these alone (`grown`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:  # a row for each link at most: the small star's distinct() is enough
        return out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _apart(at: DataFrame) -> int:
    """Of links (a, b) with a > b, the number of vertices by which they aren't stars about their least vertices."""
    ends = at.select(F.col("a").alias("v"), F.lit(1).alias("n")).unionByName(at.select(F.col("b").alias("v"), F.lit(0).alias("n")))
    return ends.groupBy("v").agg(F.sum("n").alias("n"), F.min("n").alias("low")).filter("n > 1 or (n = 1 and low = 0)").agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) in any orderable type to (vertex, component): every vertex that has a link, with the least vertex that it
    reaches. Self-links, repeated links and nulls are ignored; without links the result is empty."""
    at = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for k in range(rounds + 1):
        if not _apart(at):
            return at.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        if k < rounds:
            at = written(_star(_star(at, True), False), "links")
    raise RuntimeError(f"links still change after {rounds} rounds")


def grown(labels: DataFrame, vertex: str, label: str, links: DataFrame) -> DataFrame:
    """(vertex, label) of all vertices, the label the least vertex of each one's component, with further links (a, b) between
    vertices of the table: the components of both."""
    end = lambda c, n: labels.select(F.col(vertex).alias(c), F.col(label).alias(n))
    between = links.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    to = components(between).select(F.col("vertex").alias(label), "component")
    return labels.join(to, label, "left").select(vertex, F.coalesce("component", label).alias(label))
