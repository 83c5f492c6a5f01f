"""Aggregates kept as mergeable sketches: distinct values and quantiles of a group, rolled up without reading its rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers (2 to this power) of a sketch of distinct values, and its relative error at three standard deviations.
REGISTERS, DISTINCT_ERROR = 12, 0.05
#: Items of a level of a quantile sketch, and the error of a rank.
ITEMS, RANK_ERROR = 200, 0.033
#: Rows of a task that holds a key's exact values, on average.
TASK_ROWS = 500_000


def sketched(rows: DataFrame, keys: list[str], distinct: str, measure: str) -> DataFrame:
    """keys, n, distinct_sketch, quantile_sketch: a row for each group, to be stored. Null values are in n alone."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct), REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measure).cast("double"), ITEMS).alias("quantile_sketch"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups: what was stored is merged, the rows behind it are not needed."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch", ITEMS).alias("quantile_sketch"))


def merged(stored: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches with those of new rows added."""
    return rolled_up(stored.unionByName(more), keys)


def n_distinct() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile(share: float) -> Column:
    """The value at a share of the ranks; null for a group without values."""
    held = F.kll_sketch_get_n_double("quantile_sketch") > 0
    return F.when(held, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(share)))


def dealt(rows: DataFrame, told: DataFrame, key: str, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows and what was told of their keys, dealt alike to tasks whose number grows with the rows, so that what a task keeps in memory does not.

    Both are dealt: where one side's number comes from the session, a join deals the other one again by that.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-rows.count() // task_rows))
    return rows.repartition(tasks, key), told.repartition(tasks, key)
