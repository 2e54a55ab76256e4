"""An extension beyond batch analytics: windows over a stream of events, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_spread(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, run, n, spread = (max - min) / mean of a stream or table of (ts, run, hpwl)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "run")
    r = w.agg(F.count("*").alias("n"), F.min("hpwl").alias("lo"), F.max("hpwl").alias("hi"), F.avg("hpwl").alias("mean"))
    return r.select("window", "run", "n", F.try_divide(F.col("hi") - F.col("lo"), F.col("mean")).alias("spread"))
