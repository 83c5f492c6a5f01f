"""From ratings to shares of three buckets, and the words for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels


def level_histogram(ratings: DataFrame) -> DataFrame:
    """(film, level) rows to film, level, bucket, n."""
    return ratings.groupBy("film", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", labels.bucket_of(F.col("level")))


def rating_distribution(histogram: DataFrame) -> DataFrame:
    """film, bucket, n_ratings, n_total, share_real; every bucket of a film with ratings, 0 where it has none.

    Shares are rounded one by one, halves to even, so they need not add up to 100.
    """
    sums = [F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in config.BUCKETS]
    wide = histogram.groupBy("film").agg(*sums, F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).alias("n_total")).filter("n_total > 0")
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n_ratings")) for b in config.BUCKETS)))
    long = wide.select("film", "n_total", pairs.alias("p")).select("film", "p.bucket", "p.n_ratings", "n_total")
    return long.withColumn("share_real", labels.percent(F.col("n_ratings"), F.col("n_total")))


def weight_labels(distribution: DataFrame) -> DataFrame:
    """Adds label, phrase, the film's dominant share and the perspective marking."""
    share = F.col("share_real")
    dominant = F.max(share).over(Window.partitionBy("film"))
    return distribution.select(
        "film", "bucket", "n_ratings", "n_total", "share_real", labels.weight_label(share).alias("weight_label"), labels.weight_phrase(share).alias("weight_phrase"), dominant.alias("dominant")
    ).withColumn("marking", labels.perspective_marking(share, F.col("dominant")))


def histogram_pivot(histogram: DataFrame) -> DataFrame:
    """One row per film with a column for each level."""
    cells = [F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias("n_" + str(x).replace(".", "_")) for x in config.LEVELS]
    return histogram.groupBy("film").agg(*cells)


def complete_films(histogram: DataFrame) -> DataFrame:
    """Films whose histogram has just the ten levels."""
    levels = F.array_sort(F.collect_set("level"))
    return histogram.groupBy("film").agg(F.sum("n").alias("n_total"), levels.alias("levels")).filter(F.col("levels") == F.array(*map(F.lit, sorted(config.LEVELS)))).drop("levels")


def totals_rollup(histogram: DataFrame) -> DataFrame:
    """Sums for each film, bucket and level, and for the rows above them (null where rolled up)."""
    return histogram.rollup("film", "bucket", "level").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("depth"))
