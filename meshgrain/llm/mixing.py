"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Targets: every source asks for its weight's share of the mix. A source holds at most `epochs` times its
size; what a full source leaves goes to the others by weight, until none is above. The end of that
process is the water level L with sum(min(weight * L, cap)) = mix, found here in one pass over the table
of sources: in the order of cap / weight, the first source that L doesn't fill.

Sampling: a source with target t and size s takes each document floor(t / s) times whole, and the
rest, a fraction of one epoch, from its documents in the order of a seeded hash until it is filled; the
document at the end of it is taken in part. So each source takes its target to the word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: White space as in [^\x20\x09-\x0D]+.
GAPS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, take `weights` in turn. The mix has share x all sizes; where
    that is over epochs x all sizes, every source is full. The table has a row for each source; its windows
    run over sources, never over documents.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select(
        "source", "source_size", "weight", "cap",
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("mix"),
        F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("thirst"),
    )
    t = t.withColumn("level", (F.col("mix") - F.col("filled")) / F.col("thirst"))
    t = t.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """(id, size, source_size, target, whole, part, taken) for every document, and the columns `carry`.

    whole: the document's whole repetitions; part: words of one more, fractional, repetition (at most one
    document of a source has 0 < part < size); taken = whole x size + part. A null source is a source; a
    null or empty text has size 0 and takes nothing, though `whole` is its source's. Repeated rows are
    documents each. Documents whose id and text agree are filled in any order: they're alike. Reruns with
    a seed agree. Of a source, only the documents of one of 256 hash buckets meet in a task; their sizes
    are added up in buckets before.
    """
    text = F.col(f"`{text_col}`")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__src"), word_count(text).alias("size"), key.alias("__key"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)])
    d = d.withColumn("__bucket", F.substring("__key", 1, 2))
    if not carry:  # words are counted and texts hashed once; with columns to carry, reading them twice is the less
        d = written(d, "sizes")
    by_bucket = d.groupBy("__src", "__bucket").agg(F.sum("size").alias("n"))
    sizes = by_bucket.groupBy(F.col("__src").alias("source")).agg(F.sum("n").alias("source_size"))
    goal = targets(sizes, weights, share, epochs)
    before = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = by_bucket.select(F.col("__src").alias("s"), F.col("__bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    start = start.join(goal, F.col("s").eqNullSafe(F.col("source")))
    own = Window.partitionBy("__src", "__bucket").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.join(start, F.col("__src").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    room = F.col("target") - F.col("whole") * F.col("source_size") - F.col("start") - F.col("__own")
    d = d.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.round(room).cast("long"))).cast("long"))
    return d.select(F.col("__id").alias(id_col), "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents; weights 3, 1, 2 in turn, 150 % of all words, two epochs at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
