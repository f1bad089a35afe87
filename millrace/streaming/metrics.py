"""A metric buffer as a stream.  An extension: the reference has batches only (its buffer is flushed every k steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flushed(stream: DataFrame, time: str, window: str, values: list[str], late: str = "10 minutes") -> DataFrame:
    """Means by window of event time; rows later than ``late`` no longer count."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window)).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))
