"""The batch operators over streams: an extension, the reference has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(stream: DataFrame, keys: list[str], at: str, lateness: str = "30 days") -> DataFrame:
    """The first row of every key as the stream brings it; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Rows per window and ``by``; a row later than ``lateness`` is left out."""
    g = stream.withWatermark(at, lateness).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")
