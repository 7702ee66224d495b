"""Running statistics of a stream: an extension, as the model has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, mean, varsum) of each window, batch or stream; rows later than `late` are let go by a stream."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    out = e.groupBy(F.window(time, width).alias("t"), F.col(key)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("varsum"))
    return out.select(F.col("t.start").alias("start"), key, "n", "mean", "varsum")
