"""The trade graph of the star tables: customers and suppliers, an edge where they have line items in common.

Vertices: customers keep their key, suppliers are numbered from SUPPLIERS on. Edges are (edge, v0, v1, w) with
v0 < v1; `edge` is v0 * SUPPLIERS + the supplier's key, a number that needs no global count; w counts line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dealing import dealt, shares

#: Above any customer key.
SUPPLIERS = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = shares(orders, items)
    both = dealt(orders, "o_orderkey", parts=n).join(dealt(items, "l_orderkey", parts=n), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = dealt(both, "o_custkey", "l_suppkey", parts=n).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    c, s = F.col("o_custkey").cast("long"), F.col("l_suppkey").cast("long")
    return pairs.select((c * SUPPLIERS + s).alias("edge"), c.alias("v0"), (s + SUPPLIERS).alias("v1"), "w")


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vertex, agg): every customer and supplier in its nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("vertex"), F.col("c_nationkey").cast("long").alias("agg"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") + SUPPLIERS).alias("vertex"), F.col("s_nationkey").cast("long").alias("agg"))
    return c.unionByName(s)
