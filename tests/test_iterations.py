"""Numbering by whole keys, the tables of iterations, and iterations that raise or converge."""

import os

import pytest
from pyspark.sql import functions as F

from meshgrain.operators import algebra, elements, nonlinear, spectral
from meshgrain.sources import checkpoints, grids


def test_numbers_of_a_two_valued_key_are_dealt_evenly(spark):
    df = spark.range(0, 40000, 1, 8).select((F.col("id") % 2).alias("a"), F.xxhash64("id").alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = checkpoints.written(algebra.numbered(df, "n", "a", "b"))
        dealt = [r[0] for r in algebra._ranged(df, ["a", "b"]).groupBy("__p").count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) == 4 and max(dealt) < 2 * 40000 / 4
    want = sorted((r.a, r.b) for r in df.collect())
    assert [(r.a, r.b) for r in out.orderBy("n").collect()] == want and out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (0, 39999, 40000)


def test_numbers_of_nulls_texts_and_nothing(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", None), ("a", 0)], "k string, v int")
    assert [(r.k, r.v) for r in algebra.numbered(df, "n", "k", "v").orderBy("n").collect()] == [(None, 2), ("a", None), ("a", 0), ("b", 1)]
    assert algebra.numbered(df.limit(0), "n", "k").count() == 0
    sizes = spark.range(1000).select("id", (F.col("id") % 7).alias("s"))
    got = {r.id: r.start for r in algebra.offsets(sizes, "id", "s").collect()}
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 7


def test_rounds_keep_two_tables(spark):
    table = checkpoints.Rounds("r")
    x = table(spark.range(3).toDF("i"))
    for _ in range(4):
        x = table(x.select((F.col("i") + 1).alias("i")))
    assert sorted(r.i for r in x.collect()) == [4, 5, 6] and len(table.paths) == 2
    assert all(os.path.isdir(p.removeprefix("file://")) for p in table.paths)


def test_power_iteration_says_when_it_has_not_converged(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0001), (0, 1, 0.0)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 1.0), (1, -0.2)], "i long, v double")
    with pytest.raises(RuntimeError, match="still changes"):
        algebra.power_iterate(a, x, 2, 1e-14)
    assert 1 <= algebra.power_iterate(a, x, 2, 0.0)[0] <= 1.0001


@pytest.mark.parametrize("w", [None, 1.0])
def test_picard_with_and_without_w(spark, w):
    edges = grids.path(spark, 6)
    v = spark.range(6).select(F.col("id").alias("vertex"))
    system = spectral.fine_system(edges, v, v.select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), F.lit(w).alias("v")) if w else None)
    f = v.select(F.col("vertex").alias("i"), F.when(F.col("vertex") < 3, 0.3).otherwise(-0.3).alias("v"))
    x, history = nonlinear.picard(system, elements.fine_elements(edges), nonlinear.Conductivity(0.5), f, relative=1e-7)
    assert history[-1] < 1e-6 and len(history) < 20
    u = {r.i: r.v for r in algebra.block_vector(x, 1).collect()}
    if w:  # the equations by hand: D sigma - W u = f with sigma = -k (u0 - u1)
        s = {r.i: r.v for r in algebra.block_vector(x, 0).collect()}
        d = {(r.i, r.j): r.v for r in system.d.collect()}
        for i in range(6):
            assert abs(sum(c * s[j] for (k, j), c in d.items() if k == i) - w * u[i] - (0.3 if i < 3 else -0.3)) < 1e-6
