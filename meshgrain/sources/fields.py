"""Text files of whitespace-separated fields as a Spark data source: spark.read.format("fields").load(path) after register(spark).

Partitions are ranges of bytes; a field belongs to the range in which it starts, however long it is and wherever lines end. Options:
`blockbytes`, the bytes of a range (4 MB), and `counts`, for one row a range with its number of fields. Files are opened by pyarrow in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Schemes of paths that pyarrow opens; a path without one is local.
SCHEMES = ("file", "hdfs", "s3", "gs")
#: Bytes that are read at once.
CHUNK = 1 << 20
SPACE = b" \t\n\r\x0b\x0c"


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def chunks(f, start: int, end: int, size: int = CHUNK) -> Iterator[list[bytes]]:
    """Lists of the fields that start at the bytes from start to end of an open file, in order; a field is held whole."""
    f.seek(max(0, start - 1))
    skipping = start > 0 and f.read(1) not in SPACE
    rest, at = b"", start
    while at < end or rest or skipping:
        data = f.read(min(size, end - at) if at < end else size)
        at += len(data)
        last = not data
        if skipping:
            # the field before this range ends here
            cut = next((k for k, b in enumerate(data) if b in SPACE), len(data))
            skipping = cut == len(data) and not last
            # it may go on beyond the range, which then has none
            if at - len(data) + cut >= end:
                return
            data = data[cut:]
        if at > end:
            # only what is left of the last field counts beyond the end
            inside = len(data) - (at - end) if at - len(data) < end else 0
            stop = next((k for k in range(inside, len(data)) if data[k] in SPACE), None)
            found = (rest + data[:stop]).split()
            if stop is not None or last:
                yield found
                return
            rest = rest + data
            continue
        data = rest + data
        found = data.split()
        # the last field may go on
        rest = found.pop() if found and data[-1] not in SPACE and not last else b""
        yield found
        if last:
            return


class FieldsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.counts = options["path"], int(options.get("blockbytes", 4 << 20)), options.get("counts", "false").lower() == "true"
        if self.size < 1:
            raise ValueError("blockbytes is 1 or more")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, path = _opened(self.path)
        found = files.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [found] if found.is_file else [x for x in files.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [Range(prefix + x.path, s, min(s + self.size, x.size)) for x in sorted(every, key=lambda x: x.path) for s in range(0, x.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        import pyarrow as pa

        if not partition.file:
            return
        files, path = _opened(partition.file)
        n = 0
        with files.open_input_file(path) as f:
            for x in chunks(f, partition.start, partition.end):
                if x and not self.counts:
                    k = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * k), pa.array([partition.start] * k, pa.int64()), pa.array(range(n, n + k), pa.int64()), pa.array(x, pa.binary()).cast(pa.string())], names=["file", "start", "k", "x"])
                n += len(x)
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([partition.start], pa.int64()), pa.array([n], pa.int64())], names=["file", "start", "n"])


class FieldsSource(DataSource):
    """(file, start, k, x): field k, from 0, of the range at byte `start`; with counts (file, start, n)."""

    @classmethod
    def name(cls) -> str:
        return "fields"

    def schema(self) -> str:
        return "file string, start long, n long" if self.options.get("counts", "false").lower() == "true" else "file string, start long, k long, x string"

    def reader(self, schema) -> DataSourceReader:
        return FieldsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FieldsSource)


def readable(path: str) -> bool:
    """Whether pyarrow opens a path; compressed files and patterns aren't read by ranges."""
    scheme = path.split(":", 1)[0] if ":/" in path else "file"
    return scheme in SCHEMES and not any(c in path for c in "*?[{") and not path.endswith((".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate"))


def numbers(spark: SparkSession, path: str, blockbytes: int = 4 << 20) -> DataFrame:
    """(pos, x): the fields of a file, or of a folder's files by name, in order from 0. The files are read twice, once for the numbers of
    fields by range, and nothing is written; only the table of ranges meets in one task."""
    register(spark)
    read = spark.read.format("fields").option("blockbytes", str(blockbytes))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    base = read.option("counts", "true").load(path).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    fields = spark.read.format("fields").option("blockbytes", str(blockbytes)).load(path)
    return fields.join(F.broadcast(base), ["file", "start"]).select((F.col("base") + F.col("k")).alias("pos"), "x")
