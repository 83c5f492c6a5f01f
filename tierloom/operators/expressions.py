"""Many expressions looked for in texts at once: one automaton for all of them, one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of expressions that are sent to the workers together; a larger table is dealt into slices, each with its own pass.
SLICE_BYTES = 1 << 20


def expression_places(texts: DataFrame, key: str, text: str, expressions: DataFrame, column: str = "expression", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """key, expression, at: every place (characters before it) where a lower-cased text has a lower-cased expression.

    Expressions may overlap, contain each other and be part of words. Empty and null ones are not looked for, repeated ones count
    once; null texts have no places. Only the expressions of one slice, of about ``slice_bytes``, pass through the driver at a time.
    """
    spark = texts.sparkSession
    wanted = expressions.select(F.lower(F.col(column)).alias("e")).filter("e <> ''").distinct()
    total = wanted.agg(F.sum(F.octet_length("e"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    low = texts.select(F.col(key), F.lower(F.col(text)).alias("__text")).filter(F.col("__text").isNotNull())
    kind = low.schema[key].dataType.simpleString()

    def places(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for e in sent.value:
                automaton.add_word(e, e)
            automaton.make_automaton()
            for batch in batches:
                rows, found, starts = [], [], []
                for row, words in enumerate(batch["__text"]):
                    for end, e in automaton.iter(words.as_py()):
                        rows.append(row)
                        found.append(e)
                        starts.append(end + 1 - len(e))
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], [key, "expression", "at"])

        return low.mapInArrow(search, f"`{key}` {kind}, expression string, at long")

    parts = []
    for k in range(slices):
        held = [r["e"] for r in wanted.filter(F.pmod(F.xxhash64("e"), F.lit(slices)) == k).collect()]
        if held:
            parts.append(places(spark.sparkContext.broadcast(held)))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], f"`{key}` {kind}, expression string, at long")


def themes_by_expressions(reviews: DataFrame, key: str, text: str, themes: DataFrame) -> DataFrame:
    """key, theme_ids (sorted) of the reviews that have an expression of a theme; ``themes``: theme_id, expression.

    Each expression counts for every theme that lists it.
    """
    found = expression_places(reviews, key, text, themes).select(key, "expression").distinct()
    listed = themes.select("theme_id", F.lower("expression").alias("expression")).distinct()
    return found.join(listed, "expression").groupBy(key).agg(F.array_sort(F.collect_set("theme_id")).alias("theme_ids"))
