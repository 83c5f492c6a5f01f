"""The standard test tables read as reviews and ratings.

There are no film reviews among those tables, so films, levels and flags are analogues: a
document's language is its film, its level follows from its id, and an order line is one rating of
its supplier. Each reader says what it takes for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions.labels import bucket_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film := supplier, level := quantity in steps of five, halved: the ten levels."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("film"), (F.ceil(F.col("l_quantity") / 5) / 2).alias("level"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film := lang, level from doc_id, every eleventh unrated, every thirteenth without an id, spoiler := toxic, every seventh truncated.

    Pages follow from ids, so no window numbers the corpus: a level's ids stand ``PAGE_ROWS`` to a page over all
    films, and a film's page has those of its language. Some pages are then missing. Listings shift while they
    are read: every fifth row stands on the next page too, and the whole first page of "de" is its second page again.
    """
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    level, at = (F.col("doc_id") % 10 + 1) / 2, F.floor(F.col("doc_id") / 10)
    page = (F.floor(at / config.PAGE_ROWS) + 1).cast("int")
    german = F.col("lang") == "de"
    own = page + F.when(german & (page > 1), 1).otherwise(0)
    pages = F.when((german & (page == 1)) | (F.col("doc_id") % 5 == 0), F.array(own, own + 1)).otherwise(F.array(own))
    return d.select(
        F.col("lang").alias("film"), level.alias("level"), F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")).alias("review_id"), F.when(F.col("doc_id") % 11 != 0, level).alias("rating"), "text", F.length("text").alias("n_chars"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("spoiler"), (F.col("doc_id") % 7 == 0).alias("truncated"),
        F.when(F.col("doc_id") % 21 != 0, F.concat(F.lit("/full/"), F.col("doc_id").cast("string"))).alias("full_text_url"), F.posexplode(pages).alias("again", "page"), (at % config.PAGE_ROWS).cast("int").alias("pos"),
    ).withColumn("pos", F.col("pos") + F.col("again") * config.PAGE_ROWS).drop("again")


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched texts of truncated reviews: every fourteenth fails, every fifteenth is a spoiler."""
    d = table(spark, sf_dir, "documents").withColumn("truncated", F.col("doc_id") % 7 == 0).filter("truncated")
    fetched = F.when(F.col("doc_id") % 15 == 0, F.lit(config.SPOILER_PLACEHOLDER)).otherwise(F.col("text"))
    return d.select(F.concat(F.lit("/full/"), F.col("doc_id").cast("string")).alias("full_text_url"), fetched.alias("fetched_text"), (F.col("doc_id") % 14 != 0).alias("fetch_ok"))


#: The keyword dimension that stands in for a model's theme assignment: short, fixed.
THEMES = {"pacing": ("tion", "ción"), "acting": ("sch", "ung"), "visuals": ("eaux", "oi"), "script": ("ent", "mente"), "sound": ("ing", "ado"), "ending": ("licen", "stupid"), "mood": ("ou",), "humor": ("wh",)}


def bucketed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """film, bucket, review_id, text of every document."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("film"), bucket_of((F.col("doc_id") % 10 + 1) / 2).alias("bucket"), F.col("doc_id").alias("review_id"), "text")
