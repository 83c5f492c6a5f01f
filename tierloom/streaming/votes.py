"""Ratings as they come: running level counts in windows of event time. An extension, not part of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.functions import labels


def windowed_histogram(ratings: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(ts, film, level), a stream or not, to start, film, bucket, n for each window; rows later than ``late`` are left out of a stream."""
    counted = ratings.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "film", labels.bucket_of(F.col("level")).alias("bucket"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "film", "bucket", "n")
