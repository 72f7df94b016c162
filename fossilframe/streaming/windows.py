"""Windowed statistics over streams, by sums that Spark's state can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, taxon: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each taxon in tumbling windows; state is dropped once the watermark passes a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(taxon).alias("taxon")).agg(F.count("*").alias("abundance")).select(F.col("w.start").alias("sample"), "taxon", "abundance")


def windowed_directional(events: DataFrame, time: str, angle: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """n, mean direction and resultant length of each window, from sums of sines and cosines."""
    a = F.radians(angle)
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    return g.select(F.col("w.start").alias("start"), "n", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean_direction"), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("r"))
