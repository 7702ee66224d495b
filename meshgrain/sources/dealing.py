"""Partitions by the size of a query's input. Adaptive execution packs shuffled rows by their compressed bytes, so that millions of rows of
few bytes meet in one task, whose hash tables and sorts then grow with the input; these shares don't."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for each partition, and up to how many partitions the session's own are left to be.
SHARE, FEW = 6 << 20, 8


def input_bytes(df: DataFrame) -> int:
    """The size of the files that df is computed from; 0 for tables without files."""
    sc = df.sparkSession.sparkContext
    folders: dict[str, set[str]] = {}
    for f in df.inputFiles():
        folder, _, name = f.rpartition("/")
        folders.setdefault(folder, set()).add(name)
    total = 0
    for folder, names in folders.items():
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        for s in fs.listStatus(path):
            if s.isFile() and s.getPath().toUri().getRawPath().rpartition("/")[2] in names:
                total += s.getLen()
    return total


def shares(*tables: DataFrame) -> int:
    """The number of partitions for what is computed from the tables; 0 where their input is small."""
    n = sum(map(input_bytes, tables)) // SHARE
    return n if n > FEW else 0


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df dealt by its keys into as many partitions as its input asks for, or `parts`; as it is where that is small. For groups of
    about as many keys as rows: nothing is added up before the shuffle."""
    n = shares(df) if parts is None else parts
    return df.repartition(n, *keys) if n else df
