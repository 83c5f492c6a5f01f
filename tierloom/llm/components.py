"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins and aggregations over edges and ends with a table written to the shared
folder; the driver only sees a count and a checksum. A node with very many neighbours is a partial
minimum and a join, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import adopt, drop_table, write_table

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with u <> v to (node, root): every node that is not the smallest of its component.

    Rounds grow with the logarithm of the longest path; a graph that is still changing after ``MAX_ROUNDS``
    is refused. Repeated edges and loops change nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    now, path = write_table(ordered.distinct(), "edges")
    seen = _fingerprint(now)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        after, after_path = write_table(_small_star(_large_star(now)), "edges")
        drop_table(spark, path)
        now, path, before, seen = after, after_path, seen, _fingerprint(after)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    adopt(path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
