"""Backward as-of join: each row with the last row of another table at or before its time.

Both tables are put together and sorted by time within a key and a block of time, so that no window holds a whole key. What a
block hands on to later ones is a single row for each key, carried over the blocks in a second, small window.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows of both tables share a block of time; there are at most ``MOST_BLOCKS`` blocks.
PER_BLOCK, MOST_BLOCKS = 1_000_000, 1000


def time_blocks(rows: DataFrame, at: str, name: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Adds ``name``: the block of a time (a timestamp or number), of about equally many rows; null times have block -1."""
    number = F.col(at).cast("double")
    n = rows.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // per_block)))
    if blocks == 1:
        return rows.withColumn(name, F.when(F.col(at).isNull(), -1).otherwise(0))
    steps = [k / blocks for k in range(1, blocks)]
    cuts = sorted(set(rows.select(number.alias("t")).approxQuantile("t", steps, 0.25 / blocks)))
    tagged = rows.withColumn("__number", number)
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__number", outputCol="__bucket", handleInvalid="keep").transform(tagged)
    return cut.withColumn(name, F.when(F.col(at).isNull(), -1).otherwise(F.col("__bucket").cast("int"))).drop("__number", "__bucket")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str, per_block: int = PER_BLOCK) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with the same keys and a time ``at`` that is not later; null without one.

    Of rows of ``right`` at one time the one with the largest ``tie`` counts. Null keys and times meet nothing. All rows of
    ``left`` stay, repeated ones too.
    """
    known = F.lit(True)
    for c in (*keys, at):
        known = known & F.col(c).isNotNull()
    given = right.filter(known).select(*keys, F.col(at), F.lit(None).cast(left.schema.simpleString()).alias("__row"), F.struct(*values).alias("__value"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"))
    tie_type = dict(given.dtypes)["__tie"]
    asked = left.select(*keys, F.col(at), F.struct(*left.columns).alias("__row"), F.lit(None).cast(dict(given.dtypes)["__value"]).alias("__value"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"))
    rows = time_blocks(given.unionByName(asked), at, "__block", per_block)

    within = Window.partitionBy(*keys, "__block").orderBy(at, "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("__here", F.last("__value", ignorenulls=True).over(within)).filter("__side = 1")
    newest = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(at, F.struct(F.col("__tie").isNotNull(), "__tie"))))
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "__block").agg(newest.alias("__last")).withColumn("__before", F.last("__last", ignorenulls=True).over(over)).drop("__last").filter(F.col("__before").isNotNull())
    found = here.join(carried, [*keys, "__block"], "left")
    value = F.when(F.col(at).isNotNull(), F.coalesce("__here", "__before"))
    told = found.withColumn("__found", value)
    return told.select("__row.*", *(F.col("__found")[v].alias(v) for v in values))
