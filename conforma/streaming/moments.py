"""Running moments of feature streams, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(rep: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("ensemble",), window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, keys, n, mean, sd, lo, hi) per event-time window of a batch or stream with columns time, keys and value."""
    rows = rep.withWatermark(time, delay) if rep.isStreaming else rep
    got = rows.groupBy(F.window(time, window), *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return got.select(F.col("window.start").alias("window_start"), *keys, "n", "mean", "sd", "lo", "hi")
