import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierloom.operators import collect
from tierloom.streaming import early_stop

SCHEMA = "film string, level double, page int, pos int, review_id long, rating double, spoiler boolean, n_chars int, at long"
COLUMNS = ["film", "level", "page", "n_rows", "n_first", "n_valid", "kept"]
START = 1_700_000_000


def reviews(seed):
    """Levels with missing pages, repeated and missing ids, short texts, and pages beyond the last that may be read."""
    rng, rows = random.Random(seed), []
    for film in ("a", "b"):
        for level in (0.5, 3.0, 5.0):
            for page in range(1, 9):
                if rng.random() < 0.15:
                    continue
                rows += [(film, level, page, i, rng.choice([None, *range(40)]), rng.choice([None, level, level, level]), rng.random() < 0.1, rng.choice([20, 200, 300]), START + rng.randrange(600)) for i in range(5)]
    return rows


def streamed(spark, folder, files):
    """The stream's result for files that arrive in this order, one a batch."""
    early_stop.use_state_store(spark)
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
        told = early_stop.read_pages_of_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        told.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(str, map(tuple, spark.read.schema(early_stop.RESULT).parquet(f"{folder}/out").filter("film <> '~'").select(*COLUMNS).collect())))


def batch(spark, rows):
    return sorted(map(str, map(tuple, collect.read_pages(collect.seen_marked(spark.createDataFrame(rows, SCHEMA))).select(*COLUMNS).collect())))


def later(hours, film="~"):
    return [(film, 1.0, 1, 0, 1, 1.0, False, 200, START + hours * 3600)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_s_rows(spark, tmp_path, seed):
    rows = reviews(seed)
    mixed = random.Random(seed).sample(rows, len(rows))
    assert streamed(spark, tmp_path, [mixed[::2], mixed[1::2], later(10)]) == batch(spark, rows)


def test_pages_that_come_much_later_count_with_those_before(spark, tmp_path):
    rows = [("a", 1.0, p, i, p * 10 + i // 2, 1.0, False, 200, START + (p > 2) * 36000 + p) for p in range(1, 5) for i in range(6)]
    found = streamed(spark, tmp_path, [[r for r in rows if r[2] <= 2], later(5), [r for r in rows if r[2] > 2], later(20)])
    assert found == batch(spark, rows)


def test_pages_of_one_level():
    rows = pd.DataFrame([(2, 0, "x", True), (1, 0, "x", True), (1, 1, None, True), (1, 2, None, False), (4, 0, "y", True)], columns=["page", "pos", "review_id", "ok"])
    pages = early_stop.decided(rows, 2)
    assert pages.values.tolist() == [[1, 3, 3, 2, True], [2, 1, 0, 0, False], [4, 1, 1, 1, False]]
