"""Text files of graphs, vectors and matrices, read and written by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fields
from .checkpoints import written


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(pos, x): the whitespace-separated fields of one file, in order: through fields.numbers(), or, where that can't open it, by lines.

    Then the file is read by blocks. Fields are counted by block, and a field's place is the sum over the blocks before, the
    lines before in its block, and its place in the line. Only the table of blocks meets in one task.
    """
    if fields.readable(path):
        return fields.numbers(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parts = lines.withColumn("f", F.filter(F.split("value", r"\s+"), lambda s: s != "")).select("file", "block", "line", "f")
    parts = written(parts.filter(F.size("f") > 0), "lines")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("file", "block").agg(F.sum(F.size("f")).alias("n"))
    start = blocks.select("file", "block", before(Window.orderBy("file", "block")).alias("start"))
    own = parts.withColumn("n", F.size("f")).withColumn("own", before(Window.partitionBy("file", "block").orderBy("line")))
    return own.join(F.broadcast(start), ["file", "block"]).select((F.col("start") + F.col("own")).alias("base"), F.posexplode("f").alias("k", "x")).select((F.col("base") + F.col("k")).alias("pos"), "x")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, edge, ord) of a compressed-row file: vertex and edge counts, row starts, column ids. Values that follow are
    not read: all are one."""
    found = _numbers(spark, path)
    head = found.filter("pos < 2").agg(F.max(F.when(F.col("pos") == 0, F.col("x"))).cast("long").alias("nv"), F.max(F.when(F.col("pos") == 1, F.col("x"))).cast("long").alias("ne")).first()
    nv, ne = head.nv, head.ne
    starts = found.filter(F.col("pos").between(2, 2 + nv)).select((F.col("pos") - 2).cast("long").alias("vertex"), F.col("x").cast("long").alias("start"))
    ends = starts.select((F.col("vertex") - 1).alias("vertex"), F.col("start").alias("end"))
    spans = starts.join(ends, "vertex")
    spans = spans.select("vertex", F.explode(F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("k"))
    columns = found.filter(F.col("pos") >= 3 + nv).select((F.col("pos") - 3 - nv).cast("long").alias("k"), F.col("x")).filter(F.col("k") < 2 * ne)
    rows = spans.join(columns, "k").select("vertex", F.col("x").cast("double").cast("long").alias("edge"))
    return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("edge").orderBy("vertex")) - 1).cast("int"))


def edges_of(incidence: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(edge, v0, v1, w) of an incidence table; weights (i, v), 1 where there are none."""
    e = incidence.groupBy("edge").agg(F.min("vertex").alias("v0"), F.when(F.count(F.lit(1)) > 1, F.max("vertex")).alias("v1"))
    if weights is None:
        return e.withColumn("w", F.lit(1.0))
    w = weights.select(F.col("i").alias("edge"), F.col("v").alias("w"))
    return e.join(w, "edge", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of lines `i j v` after a line of counts; repeated places are added up."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 3)
    return lines.groupBy(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j")).agg(F.sum(F.col("f")[2].cast("double")).alias("v"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, v): a number a line."""
    return _numbers(spark, path).select(F.col("pos").cast("long").alias("i"), F.col("x").cast("double").alias("v"))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    return read_vector(spark, path).select(F.col("i").alias("vertex"), F.col("v").cast("long").alias("agg"))


def write_vector(x: DataFrame, path: str) -> None:
    """A number a line in the order of i, 16 digits; range partitions become files in order."""
    x.sort("i").select(F.format_string("%.16e", "v").alias("value")).write.mode("overwrite").text(path)


def read_permeability(spark: SparkSession, path: str, size: tuple[int, int, int], box: tuple[int, int, int]) -> DataFrame:
    """(cell, kx, ky, kz) of a file of three components over a grid of `size`, x fastest: the inverses of the cells in the
    box at the origin, renumbered by the box."""
    nx, ny, nz = size
    n = nx * ny * nz
    f = _numbers(spark, path).select(F.floor(F.col("pos") / n).alias("c"), F.pmod("pos", F.lit(n)).alias("p"), (1 / F.col("x").cast("double")).alias("v"))
    f = f.select("c", F.pmod("p", F.lit(nx)).alias("ix"), F.pmod(F.floor(F.col("p") / nx), F.lit(ny)).alias("iy"), F.floor(F.col("p") / (nx * ny)).alias("iz"), "v")
    f = f.filter((F.col("ix") < box[0]) & (F.col("iy") < box[1]) & (F.col("iz") < box[2]))
    cell = (F.col("ix") + box[0] * (F.col("iy") + box[1] * F.col("iz"))).cast("long")
    return f.groupBy(cell.alias("cell")).agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n_) for k, n_ in enumerate(("kx", "ky", "kz"))])


def to_json(metrics: DataFrame) -> DataFrame:
    """(json): a row of metrics as an object."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("json"))


def last_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last line of a text that is a JSON object, as columns: (block, line) orders the lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    last = lines.filter(F.trim("value").startswith("{")).agg(F.max_by("value", F.struct("block", "line")).alias("x"))
    return last.select(F.from_json("x", schema).alias("o")).select("o.*")


def flattened(df: DataFrame, separator: str = "-") -> DataFrame:
    """Nested structures as columns of their own, named by the path to them."""
    from pyspark.sql.types import StructType

    def leaves(fields, path):
        for f in fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType.fields, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*[F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)) for at in leaves(df.schema.fields, [])])


def write_levels(tables: dict[str, list[DataFrame]], path: str) -> None:
    """Matrices or samples of each level as Parquet, a folder for each name, partitioned by level."""
    for name, levels in tables.items():
        out = None
        for k, t in enumerate(levels):
            part = t.withColumn("level", F.lit(k))
            out = part if out is None else out.unionByName(part)
        out.write.mode("overwrite").partitionBy("level").parquet(f"{path}/{name}")
