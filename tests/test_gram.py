"""Products of a matrix with itself against the plain product."""

import pytest
from pyspark.sql import functions as F

from meshgrain.operators import algebra


@pytest.mark.parametrize("row", [1024, 3])
def test_gram_is_the_product(spark, monkeypatch, row):
    monkeypatch.setattr(algebra, "ROW", row)
    a = spark.createDataFrame([(k % 7, (k * k) % 11, float(k % 5 - 2)) for k in range(60)] + [(50, 3, 1.0), (3, None, 2.0)], "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    d = spark.range(7).select(F.col("id").alias("i"), (F.col("id") - 2.0).alias("v"))
    rows = lambda t: sorted(map(repr, map(tuple, t.select("i", "j", "v").collect())))
    assert rows(algebra.gram(a)) == rows(algebra.multiply(algebra.transpose(a), a))
    assert rows(algebra.gram(a, d).withColumn("v", F.col("v") + 0.0)) == rows(algebra.multiply(algebra.transpose(a), algebra.scale_rows(a, d)).withColumn("v", F.col("v") + 0.0))


def test_products_shuffle_lists(spark):
    a = spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double")
    assert "collect_list" in algebra.times_own_transpose(a)._jdf.queryExecution().toString()


@pytest.mark.parametrize("row,size", [(1024, 1 << 21), (4, 50)])
def test_odd_columns_and_values(spark, monkeypatch, row, size):
    """Columns from one end of 64 bits to the other and null, values null, and more of them than are sent by number; entries twice."""
    monkeypatch.setattr(algebra, "ROW", row)
    monkeypatch.setattr(algebra.terms, "TERMS", size)
    far = [-(1 << 63), -(1 << 63) + 1, -5, 0, 7, (1 << 63) - 1, None]
    rows = [(k % 9, far[k % 7] if k % 3 else k * k * 1000003 % 499, float(k % 53) if k % 11 else None) for k in range(400)]
    a = spark.createDataFrame(rows, "i long, j long, v double")
    d = spark.range(8).select(F.col("id").alias("i"), F.when(F.col("id") != 2, F.col("id") - 3.0).alias("v"))
    found = lambda t: sorted(map(repr, map(tuple, t.select("i", "j", (F.col("v") + 0.0).alias("v")).collect())))
    assert found(algebra.gram(a)) == found(algebra.multiply(algebra.transpose(a), a))
    assert found(algebra.gram(a, d)) == found(algebra.multiply(algebra.transpose(a), algebra.scale_rows(a, d)))


def test_a_term_is_shuffled_as_few_bytes(spark):
    a = spark.range(40 * 500).select(F.expr("id % 500").alias("i"), F.pmod(F.xxhash64("id"), F.lit(10000)).alias("j"), F.lit(1.0).alias("v"))
    assert "FlatMapGroupsInArrow" in algebra.times_own_transpose(a)._jdf.queryExecution().toString()
    lists = a.groupBy("i").agg(F.collect_list("j").alias("js"), F.collect_list("v").alias("ws")).select("js", "ws", F.col("js").alias("ks"), F.col("ws").alias("vs"))
    bytes_ = sum(len(b) for r in lists.toArrow().to_batches() for t in algebra.terms.spread([r], 4) for b in t["blob"].to_pylist())
    assert bytes_ < 3 * 500 * 40 * 41 / 2


def test_weights_are_sent_by_number(spark):
    """As many bytes with five weights as without, but for one an entry."""
    a = spark.range(40 * 500).select(F.expr("id % 500").alias("i"), F.pmod(F.xxhash64("id"), F.lit(10000)).alias("j"), F.lit(1.0).alias("v"))
    lists = a.groupBy("i").agg(F.collect_list("j").alias("js"), F.collect_list(F.col("i") % 5 + F.col("v")).alias("ws"), F.collect_list("v").alias("vs")).select("js", "ws", F.col("js").alias("ks"), "vs")
    assert sum(len(b) for r in lists.toArrow().to_batches() for t in algebra.terms.spread([r], 4) for b in t["blob"].to_pylist()) < 3 * 500 * 40 * 41 / 2
