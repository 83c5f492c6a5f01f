"""Collection per rating level: dedup, early stop, adaptive length cascade, quota, counters, bucket roll-up.

Reviews are rows of film, level, page, pos, review_id, rating, text, n_chars, spoiler, truncated and
full_text_url. All films and levels go through one plan; nothing loops over them. Only ``n_chars``, the
length of the visible text, is looked at before completion, so windows and joins do not carry texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels


def eligible() -> Column:
    """Rated and no spoiler: what the length thresholds are applied to."""
    return F.col("rating").isNotNull() & ~F.col("spoiler")


def passes(least: int | Column) -> Column:
    return eligible() & (F.col("n_chars") >= least)


def first_seen(rows: DataFrame, keys: list[str], identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity within ``keys``; rows with a null or empty identity all stay."""
    known = F.lit(True)
    for c in identity:
        known = known & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    first = Window.partitionBy(*keys, *identity).orderBy(*order)
    kept = rows.filter(known).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return kept.unionByName(rows.filter(~known))


def seen_marked(reviews: DataFrame, max_pages: int = config.MAX_PAGES) -> DataFrame:
    """Rows of the pages that may be read at all, with ``first``: whether a row is the first of its id in its level.

    Later pages are never looked at, whatever they hold, so their rows go before anything is shuffled. Rows
    with a null or empty id are all first.
    """
    order = Window.partitionBy("film", "level", "review_id").orderBy("page", "pos")
    anonymous = F.coalesce(F.col("review_id").cast("string"), F.lit("")) == ""
    return reviews.filter(F.col("page") <= max_pages).withColumn("first", anonymous | (F.row_number().over(order) == 1))


def read_pages(marked: DataFrame, quota: int = config.QUOTA_PER_LEVEL) -> DataFrame:
    """Of rows with ``first`` (:func:`seen_marked`) one row per page: film, level, page, n_rows, n_first, n_valid, kept.

    A page is read while the pages before it have fewer than ``quota`` first-seen rows that pass the first
    length threshold and none of them is missing. A page is there if it has any row, be they all repeats.
    """
    first = F.col("first")
    pages = marked.groupBy("film", "level", "page").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(first).alias("n_first"), F.count_if(first & passes(config.LENGTH_CASCADE[0])).alias("n_valid"))
    order = Window.partitionBy("film", "level").orderBy("page")
    seen = F.coalesce(F.sum("n_valid").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("kept", (seen < quota) & (F.row_number().over(order) == F.col("page")))


def kept_rows(reviews: DataFrame) -> DataFrame:
    """First-seen rows of the pages that are read."""
    marked = seen_marked(reviews)
    pages = read_pages(marked).filter("kept").select("film", "level", "page")
    return marked.filter("first").drop("first").join(pages, ["film", "level", "page"], "left_semi")


def with_threshold(rows: DataFrame) -> DataFrame:
    """Adds ``threshold``: the largest of the cascade that leaves the level a row, 0 where none does."""
    level = Window.partitionBy("film", "level")
    found = F.lit(0)
    for least in sorted(config.LENGTH_CASCADE):
        found = F.when(F.max(F.when(passes(least), 1).otherwise(0)).over(level) == 1, least).otherwise(found)
    return rows.withColumn("threshold", found)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a row in source order among those of its level that pass its threshold; null for others."""
    passing = passes(F.col("threshold"))
    order = Window.partitionBy("film", "level", passing).orderBy("page", "pos")
    return rows.withColumn("rank", F.when(passing, F.row_number().over(order)))


def level_quota(rows: DataFrame, quota: int = config.QUOTA_PER_LEVEL) -> DataFrame:
    """The first ``quota`` rows of each level, in source order, that pass its threshold."""
    return ranked(rows).filter(F.col("rank") <= quota)


def completion(rows: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Adds full_text and status: complete, completed, no_url, spoiler_in_full or fetch_failed.

    Full texts are looked for by ``full_text_url`` and only for truncated rows that have one.
    """
    spoiled = F.contains(F.col("fetched_text"), F.lit(config.SPOILER_PLACEHOLDER))
    found = full_texts.withColumn("fetched_spoiler", spoiled).withColumnRenamed("full_text_url", "__url")
    joined = rows.join(found, F.col("truncated") & (F.col("full_text_url") == F.col("__url")), "left").drop("__url")
    status = (
        F.when(~F.col("truncated"), "complete").when(F.col("full_text_url").isNull(), "no_url")
        .when(~F.coalesce(F.col("fetch_ok"), F.lit(False)), "fetch_failed")
        .when(F.col("fetched_spoiler"), "spoiler_in_full").otherwise("completed")
    )
    done = joined.withColumn("status", status)
    full = F.when(F.col("status") == "complete", F.col("text")).when(F.col("status") == "completed", F.col("fetched_text"))
    return done.withColumn("full_text", full)


def level_metadata(rows: DataFrame, full_texts: DataFrame, quota: int = config.QUOTA_PER_LEVEL) -> DataFrame:
    """Counters of each level, from one grouping of rows that have ``threshold``.

    A spoiler found in a full text counts as a truncation discard and as a spoiler. Rows beyond the quota are in
    no counter of discards.
    """
    done, taken = completion(ranked(rows), full_texts), F.coalesce(F.col("rank") <= quota, F.lit(False))
    whole, late = F.col("status").isin("complete", "completed"), F.col("status") == "spoiler_in_full"
    return done.groupBy("film", "level").agg(
        F.max("threshold").alias("threshold"), F.count_distinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("rating").isNull()).alias("n_unrated"),
        F.count_if((F.col("rating").isNotNull() & F.col("spoiler")) | (taken & late)).alias("n_spoiler"), F.count_if(eligible() & (F.col("n_chars") < F.col("threshold"))).alias("n_short"),
        F.count_if(taken & ~whole).alias("n_truncation"), F.count_if(taken & whole).alias("n_valid"),
    )


def bucket_assembly(metadata: DataFrame) -> DataFrame:
    """film, bucket, target, n_raw, n_valid, mode."""
    sums = metadata.withColumn("bucket", labels.bucket_of(F.col("level"))).groupBy("film", "bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_valid").alias("n_valid"))
    target = labels.bucket_target(F.col("bucket"))
    return sums.select("film", "bucket", target.alias("target"), "n_raw", "n_valid", labels.bucket_mode(F.col("n_valid"), target).alias("mode"))
