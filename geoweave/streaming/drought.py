"""Yearly drought statistics as a stream (an extension: the batch operator is ``yearly_statistics``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("pixel",), value: str = "z", window: str = "30 days", late: str = "7 days") -> DataFrame:
    """Statistics of a value by key and event-time window; events later than the watermark are dropped by Spark.

    State is one small row for each key and open window."""
    v = F.col(value)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), *keys)
        .agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v < -1.5).alias("n_severe_drought"), F.count_if((v >= -1.5) & (v < -1.0)).alias("n_moderate_drought"), F.count_if(v > 1.5).alias("n_wet"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "min", "max", "n_severe_drought", "n_moderate_drought", "n_wet")
    )
