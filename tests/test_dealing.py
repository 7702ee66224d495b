"""Groups are dealt by the size of the input, not by what the session packs into a task."""

import pytest
from pyspark.sql import functions as F

from meshgrain.plans import catalog, invariants, relations  # noqa: F401  they fill the catalog
from meshgrain.sources import dealing, trade

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_shares(monkeypatch):
    monkeypatch.setattr(dealing, "SHARE", 4096)


def largest(df):
    return max(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.mark.parametrize("name", ["laplacian", "aggregate_edges", "interior_edofs", "extended_aggregates", "marked_edges", "essential_edofs", "mixed_matvec", "added_block", "weighted_adjacency"])
def test_rows_of_a_task_are_bounded(spark, small_shares, name):
    df = catalog.QUERIES[name](spark, SF)
    df = df.filter("block = 0") if "block" in df.columns else df  # fluxes; potentials are few
    n = dealing.shares(*(trade.table(spark, SF, t) for t in ("orders", "lineitem")))
    assert n > dealing.FEW and largest(df) <= 2 * df.count() / n + 20


@pytest.mark.parametrize("name", ["laplacian", "marked_edges", "mixed_matvec", "added_block", "interior_edofs", "shifted_laplacian", "energy", "weighted_adjacency"])
def test_dealing_changes_no_rows(spark, monkeypatch, name):
    plain = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(dealing, "SHARE", 4096)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == plain


def test_input_bytes_are_those_of_the_files(spark, tmp_path):
    import os

    path = str(tmp_path / "a b=c%")
    spark.range(1000).repartition(3).write.parquet(path)
    want = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
    assert dealing.input_bytes(spark.read.parquet(path)) == want and dealing.input_bytes(spark.range(5)) == 0
