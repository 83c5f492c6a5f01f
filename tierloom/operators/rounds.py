"""Calls of a model in rounds: rows whose reply fails a check are asked again, a bounded number of times.

Checks are columns, so only the calls themselves run in Python. Each round ends with a checkpoint:
whatever is done with the result and whichever executor is lost afterwards, no call is made again. A task that fails before
its round's checkpoint is retried, and its calls with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions import text
from tierloom.sources.shared import shared_dir

Model = Callable[[str, str], str]
Check = Callable[[DataFrame], DataFrame]
#: The fault of a reply that cannot be used at all.
UNUSABLE = "sem_resposta"
TASK_ROWS = 50_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder named in spark.checkpoint.dir."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def replies(rows: DataFrame, model: Model) -> DataFrame:
    """Adds reply: one call of ``model(system, message)`` for each row; null where nothing came back."""

    @F.pandas_udf("string")
    def call(system: pd.Series, message: pd.Series) -> pd.Series:
        return pd.Series([model(s or "", m or "") or None for s, m in zip(system, message, strict=True)], dtype=object)

    return rows.withColumn("reply", call.asNondeterministic()("system", "message"))


def spread(rows: DataFrame) -> DataFrame:
    """Kept rows dealt evenly over all cores, and in tasks of at most ``TASK_ROWS``.

    Messages are few bytes, so the sizes that tables and shuffles are cut by say nothing of what calls and checks cost.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)))


def _names(*xs: str) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def in_rounds(rows: DataFrame, model: Model, check: Check, system: str = "", reinforcements: dict[str, str] | None = None, retries: int = 1, repairs: int = 1, most_calls: int | None = None) -> DataFrame:
    """Rows with ``message`` get answer, faults (of the answer), n_calls and history (the faults of every reply, in order).

    ``check`` adds ``found``, an array of faults, to rows with ``reply`` (fences removed); a fault ``UNUSABLE`` means
    that the reply can't be used and the answer before it stays. A row is asked again after a usable reply with
    faults up to ``retries`` times, after an unusable one up to ``repairs`` times, and never more than ``most_calls`` times in all.
    What ``reinforcements`` says about a fault is added to the row's system text once, and stays there.
    """
    most = most_calls or 1 + retries + repairs
    state = {
        "system": F.lit(system), "answer": F.lit(None).cast("string"), "faults": _names(UNUSABLE), "n_calls": F.lit(0), "n_bad": F.lit(0), "n_unusable": F.lit(0), "history": _names(),
    }
    asking, done = settled(rows.withColumns(state)), []
    for _ in range(most):
        asked = settled(replies(spread(asking), model)).withColumn("reply", F.nullif(text.stripped(text.without_fences(F.col("reply"))), F.lit("")))
        found = F.when(F.col("reply").isNull(), _names(UNUSABLE)).otherwise(F.col("found"))
        judged = check(asked).withColumn("found", found).withColumn("usable", ~F.array_contains("found", UNUSABLE))
        bad = F.size("found") > 0
        added = F.col("system")
        for fault, words in (reinforcements or {}).items():
            added = F.when(F.array_contains("found", fault) & ~F.contains(added, F.lit(words)), F.concat(added, F.lit(words))).otherwise(added)
        judged = judged.withColumns(
            {
                "answer": F.when(F.col("usable"), F.col("reply")).otherwise(F.col("answer")), "faults": F.when(F.col("usable"), F.col("found")).otherwise(F.col("faults")), "n_calls": F.col("n_calls") + 1,
                "n_bad": F.col("n_bad") + (bad & F.col("usable")).cast("int"), "n_unusable": F.col("n_unusable") + (~F.col("usable")).cast("int"),
                "history": F.when(bad, F.array_append("history", F.array_join("found", ", "))).otherwise(F.col("history")), "system": added,
            }
        )
        again = bad & F.when(F.col("usable"), F.col("n_bad") <= retries).otherwise(F.col("n_unusable") <= repairs)
        table = settled(judged.select(*rows.columns, *state, again.alias("again")))
        done.append(table.filter("NOT again").drop("again"))
        asking = table.filter("again").drop("again")
        if asking.isEmpty():
            break
    else:
        done.append(asking)
    return reduce(DataFrame.unionByName, done).drop("system", "n_bad", "n_unusable")
