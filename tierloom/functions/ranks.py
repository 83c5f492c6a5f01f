"""Numbers of rows within large groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block of ids; a window sorts the rows of one block.
BLOCK_IDS = 8192


def numbered(rows: DataFrame, keys: list[str], place: str, name: str, width: int = BLOCK_IDS) -> DataFrame:
    """Adds ``name``: the row's number from 0 within ``keys`` by ascending ``place``, a whole number; nulls come first.

    Ranges of ``width`` ids are counted first; a row's number is what lies in the ranges before its own and its
    number within its own. Only counts of ranges meet in one window for each key. Rows that share a place are
    numbered in any order.
    """
    tagged = rows.withColumn("__block", F.coalesce(F.floor(F.col(place) / width), F.lit(-(1 << 62))))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    ahead = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__block").alias("__other"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(place)) - 1
    same = F.col("__block") == F.col("__other")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return tagged.withColumn("__within", within).join(ahead, same).select(*rows.columns, (F.col("__within") + F.col("__ahead")).alias(name))
