"""Distances inside groups against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from meshgrain.operators import algebra


@pytest.mark.parametrize("block", [2048, 5])
@pytest.mark.parametrize("weights", [None, [1.0, 2.0, 3.0]])
def test_distances(spark, monkeypatch, block, weights):
    monkeypatch.setattr(algebra, "BLOCK", block)
    monkeypatch.setattr(algebra, "STRIP", 4)
    data = [(k, k % 2, [math.sin(k), math.cos(3 * k), 1e3 * k]) for k in range(40)]
    data += [(3, 1, [1.0, 2.0, 3.0]), (60, 0, None), (61, 0, [1.0, None, 2.0]), (62, 0, [1.0, 2.0]), (63, 0, []), (64, 1, [math.inf, 0.0, 0.0]), (65, None, [0.0, 0.0, 0.0]), (None, 0, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    single = {r.vec_id: r.embedding for r in v.filter("vec_id >= 60").collect()}
    got = sorted(map(repr, map(tuple, algebra.squared_distances(v, F.col("label"), "vec_id", "embedding", weights).collect())))
    rows = [(r.vec_id, r.label, r.embedding) for r in v.collect()]

    def distance(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y or weights and len(x) != len(weights):
            return None
        total = 0.0
        for p, q, w in zip(x, y, weights or [1.0] * len(x)):
            total += (p - q) * (p - q) * w
        return total

    want = [(k, m, distance(x, y)) for k, g, x in rows for m, h, y in rows if g is not None and g == h and k is not None and m is not None and k > m]
    assert single and got == sorted(map(repr, want))


def test_pairs_of_blocks_are_the_tasks(spark):
    v = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [3.0])], "vec_id long, label int, embedding array<float>")
    plan = algebra.squared_distances(v, F.col("label"), "vec_id", "embedding")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_a_block_is_shuffled_once(spark, monkeypatch):
    """However many others it is compared with."""
    monkeypatch.setattr(algebra, "BLOCK", 2)
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array(F.col("id").cast("float")).alias("embedding"))
    out = algebra.squared_distances(v, F.col("label"), "vec_id", "embedding")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    assert {(r.k, r.l, r.v) for r in out.collect()} == {(k, m, float(k - m) ** 2) for k in range(40) for m in range(k)}
