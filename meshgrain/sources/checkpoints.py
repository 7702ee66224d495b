"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local session, as in tests, gets a temporary folder;
    any other raises, as executors on other machines wouldn't see one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='meshgrain-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back."""
    return _write(df, name)[0]


class Rounds:
    """The tables of an iteration: a call writes one as written() does, and deletes the one before the last, so that an
    iteration holds two at a time. For iterations in which a table depends on the last one alone; the last two stay."""

    def __init__(self, name: str):
        self.name, self.paths = name, []

    def __call__(self, df: DataFrame, name: str | None = None) -> DataFrame:
        out, path = _write(df, name or self.name)
        self.paths.append(path)
        if len(self.paths) > 2:
            jvm = df.sparkSession.sparkContext._jvm
            old = jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            old.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return out
