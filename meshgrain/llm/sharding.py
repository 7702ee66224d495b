"""Hierarchical weighted hash tree: region, rack and shard are chosen level by level with weighted hash draws.

A key draws an exponential variate for every child of the node that it stands at, with the child's weight
as its rate, and goes down to the child with the least draw. A child is so chosen in proportion to its
weight, and a change of one child's weight moves keys only between that child and its siblings: nothing
moves inside a subtree whose weights stay as they are. The draws are column expressions; assigning is a
projection, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textio import free


class Shard(NamedTuple):
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def planned(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Shard]:
    """A full tree, shards numbered from 0 in tree order."""
    return [Shard((r * racks + k) * shards + s, r, r * racks + k) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region and rack of its own.

    All other weights at every level stay, so that keys move into the new shard and nowhere else.
    """
    return [*tree, Shard(max(s.shard for s in tree) + 1, max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, weight)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}{child}")), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.least(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in weights.items()])["c"]


def _inside(parent: Column, choices: dict[int, Column]) -> Column:
    out = None
    for p, c in choices.items():
        out = F.when(parent == p, c) if out is None else out.when(parent == p, c)
    return out


def assign(df: DataFrame, key: str, tree: Sequence[Shard], prefix: str = "") -> DataFrame:
    """Adds region, rack and shard (names after `prefix`) to every row, as its last columns.

    Key: any column that hashes; rows with equal keys share a shard, null is a key like any other. Weights
    are positive; a shard number occurs once. Every row gets a shard; an empty table stays empty. A column of df that
    has one of the three names keeps its values: the added one gets an underscore before its name.
    """
    if not tree or any(s.weight <= 0 for s in tree) or len({s.shard for s in tree}) < len(tree):
        raise ValueError("a tree has shards of positive weights, each number once")
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[int, dict[int, float]] = defaultdict(dict)
    for s in tree:
        regions[s.region] += s.weight
        racks[s.region][s.rack] += s.weight
        shards[s.rack][s.shard] = s.weight
    k = F.col(f"`{key}`")
    r, a, n = (free(f"{prefix}{x}", df.columns) for x in ("region", "rack", "shard"))
    df = df.withColumn(r, _least(k, "region", regions))
    df = df.withColumn(a, _inside(F.col(r), {x: _least(k, "rack", w) for x, w in racks.items()}))
    return df.withColumn(n, _inside(F.col(a), {x: _least(k, "shard", w) for x, w in shards.items()}))


def slots(df: DataFrame, shard: str, key: Sequence[str], buckets: int = 512) -> DataFrame:
    """Adds slot, the place of each row in its shard, gapless from 0.

    A shard's rows are numbered in the order of (hash bucket of the key columns, key columns). Only one
    bucket of a shard meets in a task, and bucket sizes are added up in a table of shards x buckets rows.
    Rows that agree in all key columns take their places in any order; nulls are values like others. A column `slot`
    of df keeps its values: the added one gets an underscore before its name.
    """
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int"))
    count = cut.groupBy(F.col(shard).alias("__s"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(shard, "__bucket").orderBy(*key)
    ranked = cut.withColumn("__own", F.row_number().over(own) - 1)
    # the table of counts has shards x buckets rows, whatever the input
    out = ranked.join(F.broadcast(count), (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn(free("slot", df.columns), (F.col("__before") + F.col("__own")).cast("long")).drop("__bucket", "__s", "__b", "__before", "__own")


def op1_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of 2 regions and 3 racks, law `key`, and where they'd be with a 25th."""
    tree = planned()
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(assign(docs, "doc_id", tree), "doc_id", grown(tree), "grown_")
    out = slots(out, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
