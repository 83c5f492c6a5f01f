"""Counters taken while rows pass on to where they are written: no second job reads them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and what its next action will have counted: aggregates by name, a fixed few."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


def write_with_counters(rows: DataFrame, write, name: str, **counters: Column) -> dict:
    """Let ``write`` write the rows (a function of a DataFrame) and return the counters of that one job.

    An action on rows that are written again, as after the loss of an executor, counts the rows of the result once.
    """
    told, seen = observed(rows, name, **counters)
    write(told)
    return seen.get


def origin_counters() -> dict[str, Column]:
    """Requests answered by the network and by the cache."""
    return {"n_network": F.count_if(F.col("origin") == "network"), "n_cache": F.count_if(F.col("origin") == "cache")}
