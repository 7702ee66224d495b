"""Every catalogued query with SQL gives DuckDB's rows on the small tables; readers on written files."""

import collections
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from meshgrain.operators import partition, topology
from meshgrain.plans import catalog, invariants, relations  # noqa: F401  they fill the catalog
from meshgrain.sources import files, grids
from meshgrain.streaming import statistics

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = collections.Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    assert collections.Counter(tuple(plain(x[c]) for c in columns) for x in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_text_graph(spark, tmp_path):
    (tmp_path / "g.txt").write_text("6\n7\n0\n2\n4\n7\n10\n12\n14\n" + "\n".join("0 1 0 2 1 2 3 3 4 5 4 6 5 6".split()) + "\n" + "1\n" * 14)
    (tmp_path / "w.txt").write_text("".join(f"{k}\n" for k in range(1, 8)))
    e = files.edges_of(files.read_graph(spark, str(tmp_path / "g.txt")), files.read_vector(spark, str(tmp_path / "w.txt")))
    got = {(r.edge, r.v0, r.v1, r.w) for r in e.collect()}
    assert got == {(0, 0, 1, 1.0), (1, 0, 2, 2.0), (2, 1, 2, 3.0), (3, 2, 3, 4.0), (4, 3, 4, 5.0), (5, 3, 5, 6.0), (6, 4, 5, 7.0)}


def test_text_matrix_vector_and_partition(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2 2\n0 0 1.5\n0 1 2\n0 0 0.5\n")
    assert sorted(map(tuple, files.read_coordinates(spark, str(tmp_path / "m.txt")).collect())) == [(0, 0, 2.0), (0, 1, 2.0)]
    x = spark.createDataFrame([(k, math.sqrt(k)) for k in range(20)], "i long, v double")
    files.write_vector(x, str(tmp_path / "v"))
    lines = [s for p in sorted((tmp_path / "v").glob("part-*")) for s in p.read_text().split()]
    assert [float(s) for s in lines] == [math.sqrt(k) for k in range(20)] and "e" in lines[0]
    (tmp_path / "p.txt").write_text("0\n0\n1\n")
    assert [tuple(r) for r in files.read_partition(spark, str(tmp_path / "p.txt")).sort("vertex").collect()] == [(0, 0), (1, 0), (2, 1)]
    (tmp_path / "k.txt").write_text(" ".join(str(float(c * 8 + p + 1)) for c in range(3) for p in range(8)))
    k = {r.cell: (r.kx, r.kz) for r in files.read_permeability(spark, str(tmp_path / "k.txt"), (2, 2, 2), (1, 2, 2)).collect()}
    assert k == {0: (1, 1 / 17), 1: (1 / 3, 1 / 19), 2: (1 / 5, 1 / 21), 3: (1 / 7, 1 / 23)}


def test_json_round_trip(spark, tmp_path):
    j = files.to_json(spark.createDataFrame([(0.5, 1.25)], "vertex double, edge double")).first().json
    (tmp_path / "o.txt").write_text("noise\n{\"vertex\": 1}\n" + j + "\nend\n")
    r = files.last_json(spark, str(tmp_path / "o.txt"), "vertex double, edge double").first()
    assert (r.vertex, r.edge) == (0.5, 1.25)


def test_small_world(spark):
    e = grids.small_world(spark, 100, 20, 0.15, 1).toPandas()
    assert len(e) == 1000 and len(set(zip(e.v0, e.v1))) == 1000 and (e.v0 < e.v1).all() and e.v1.max() == 99
    assert len(grids.small_world(spark, 50, 4, 0.0).toPandas()) == 100
    with pytest.raises(ValueError):
        grids.small_world(spark, 10, 3, 0.1)


def test_parts_grow_connected(spark):
    e = grids.path(spark, 60)
    v = spark.range(60).withColumnRenamed("id", "vertex")
    p = partition.connected_parts(e, partition.grow(e, v, 5, rounds=40))
    t = p.toPandas()
    assert len(t) == 60 and sorted(t["agg"].unique()) == list(range(t["agg"].nunique())) and t["agg"].nunique() >= 5
    assert (t.groupby("agg").vertex.agg(lambda x: x.max() - x.min() + 1) == t.groupby("agg").size()).all()


def test_colours(spark):
    e = topology.adjacency(grids.path(spark, 9))
    c = {r.vertex: r.colour for r in partition.colours(e).collect()}
    assert len(c) == 9 and all(c[k] != c[k + 1] for k in range(8)) and max(c.values()) == 1


def test_streamed_statistics(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    time = next(f.name for f in events.schema if f.dataType.simpleString().startswith("timestamp"))
    key = next(f.name for f in events.schema if f.dataType.simpleString() == "string")
    value = next(f.name for f in events.schema if f.dataType.simpleString() == "double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = statistics.windowed(stream, time, key, value, late="1 second").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    a = {(r["start"], r[key]): (r.n, r["mean"]) for r in spark.table("stats").collect()}
    b = {(r["start"], r[key]): (r.n, r["mean"]) for r in statistics.windowed(events, time, key, value).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1]) for k in a)


def test_boundary_edges_stand_alone(spark):
    cells = grids.cells(spark, (3, 2, 1))
    f = grids.cell_faces(cells, (3, 2, 1), 2)
    assert f.filter("cell1 is null").count() == 10 and f.filter("cell1 is not null").count() == 7 and f.select("face").distinct().count() == 17
    e = grids.two_point_weights(f, cells.select("cell", *[F.lit(2.0).alias(k) for k in ("kx", "ky", "kz")]), (1.0, 1.0, 1.0))
    d = topology.signed_incidence(e).groupBy("j").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect()
    assert sorted((r.n, r.s) for r in d) == [(1, 1.0)] * 10 + [(2, 0.0)] * 7
    assert {r.w for r in e.filter("v1 is not null").collect()} == {2.0} and {r.w for r in e.filter("v1 is null").collect()} == {4.0}
