"""How filters of a corpus overlap: what each removes at every place of every order.

1. One pass over the texts gives each row its part, the filters that it fails by itself (a mask), and a 64-bit hash.
2. Duplicates are looked for behind a counting Bloom filter. Each task counts its texts' cells in a sketch of its own,
   kept sparse (the cells that it touched, by bucket of ``CELLS`` cells); sketches of a bucket merge by adding up to two. A text
   one of whose cells counts one is guaranteed to be the only one of its kind. The merged sketch has one bit a cell left,
   whether it counts two, and at most ``MAX_BUCKETS`` buckets of 4 KB, so it can be broadcast at any scale.
3. Only rows that the sketch does not clear shuffle their texts, grouped by the text (partly before the shuffle), for
   the smallest id of each. Where rows outnumber what ``MAX_BUCKETS`` buckets tell apart, SHA-256 digests stand for the texts.
4. Masks of equal part meet in counts that add up; all orders are read from the at most 32 counts of a part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import lasting, scratch, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "#$%&*|"

CELLS = 32768
HASHES = 3
#: Cells for each row, as far as there are buckets for them.
CELLS_PER_ROW = 8
MAX_BUCKETS = 16384
#: A task hands on its sketch after so many rows.
ROWS_PER_SKETCH = 1 << 20

CAPITALS = bytes(range(65, 91))
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]".encode())
ROW_SCHEMA = "doc_id long, part string, fails int, h long"
SKETCH_SCHEMA = "bucket int, once binary, twice binary"


def own_failures(text: bytes, points: int) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at space, tab, newline, vertical tab, form feed, carriage return
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points
    return few | repeated << 1 | loud << 2 | (_SYMBOL.search(text) is not None) << 3


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (A to D) and the text's hash of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            points = pc.utf8_length(texts).to_pylist()
            # one text's bytes at a time
            fails = [own_failures(texts[i].as_buffer().to_pybytes(), n) for i, n in enumerate(points)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(fails, pa.int32()), batch["h"]], ["doc_id", "part", "fails", "h"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_hash().alias("h"))
    return named.mapInArrow(measure, ROW_SCHEMA)


def bucket_of(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def cells_of(h: Column) -> list[Column]:
    """A text's cells within its bucket."""
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(CELLS)).cast("int") for k in range(HASHES)]


def task_sketches(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, and the cells of it that a task touched once and more often."""

    def sketch(keys: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(keys), return_counts=True)
        own = cells // CELLS
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(own))
        offsets, once = (cells % CELLS).astype("<u2"), counts == 1
        pick = lambda what: pa.array([offsets[a:b][what[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(own[starts], pa.int32()), pick(once), pick(~once)], ["bucket", "once", "twice"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bucket = batch["bucket"].to_numpy().astype(np.int64) * CELLS
            held += [bucket + batch[f"c{k}"].to_numpy() for k in range(HASHES)]
            n += batch.num_rows
            if n >= ROWS_PER_SKETCH:
                yield sketch(held)
                held, n = [], 0
        if n:
            yield sketch(held)

    cells = [c.alias(f"c{k}") for k, c in enumerate(cells_of(F.col("h")))]
    return rows.select(bucket_of(F.col("h"), buckets).alias("bucket"), *cells).mapInArrow(sketches, SKETCH_SCHEMA)


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """bucket, shared: a bit for each cell that all tasks' sketches together count twice or more."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint8)
        for batch in batches:
            for name, least in (("once", 1), ("twice", 2)):
                for piece in batch[name]:
                    cells = np.frombuffer(piece.as_buffer(), "<u2")
                    counts[cells] = np.minimum(counts[cells] + least, 2)
        bits = np.packbits(counts > 1, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], ["bucket", "shared"])

    return sketches.groupBy("bucket").applyInArrow(merge, "bucket int, shared binary")


def possible_repeats(rows: DataFrame, sketch: DataFrame, buckets: int) -> DataFrame:
    """The rows, with their hash in ``h``, that the sketch does not clear."""
    held = rows.withColumn("bucket", bucket_of(F.col("h"), buckets)).join(F.broadcast(sketch), "bucket")
    for cell in cells_of(F.col("h")):
        octet = F.conv(F.hex(F.substring(F.col("shared"), F.floor(cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held.filter(octet.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), F.pmod(cell, F.lit(8)) + 1)) != 0)
    return held.drop("bucket", "shared")


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, h of the rows whose text a row of a smaller id has too; ``rows``: doc_id and h of all rows."""
    n = rows.count()
    wanted = -(-n * CELLS_PER_ROW // CELLS)
    buckets = max(1, min(MAX_BUCKETS, wanted))
    sketch = written(merged_sketch(task_sketches(rows, buckets)), "audit-sketch")
    identified = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("h")).filter("doc_id IS NOT NULL")
    by = F.col("text") if wanted <= MAX_BUCKETS else F.unhex(F.sha2("text", 256))
    firsts = possible_repeats(identified, sketch, buckets).select("doc_id", "h", by.alias("same")).groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h")).select("doc_id", "h")
    candidates = possible_repeats(rows.select("doc_id", "h").filter("doc_id IS NOT NULL"), sketch, buckets)
    return candidates.join(firsts, ["doc_id", "h"], "left_anti").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of a part fail just the filters of the mask."""
    rows = written(measured(docs), "audit-rows")
    late = repeats(docs, rows).withColumn("late", F.lit(1 << FILTERS.index("E")))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    marks = marks.filter("doc_id IS NOT NULL AND (g OR t)").groupBy("doc_id").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    flagged = rows.join(late, ["doc_id", "h"], "left").join(marks, "doc_id", "left")
    mask = F.col("fails").bitwiseOR(F.coalesce("late", F.lit(0))).alias("mask")
    return flagged.groupBy("part", mask).agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("good"), F.count_if("t").alias("toxic"))


def orders() -> list[tuple]:
    """A row for each order of the filters and step: order's number, order, step, masks of the filters before it and its own."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    ranked = enumerate(map("".join, permutations(FILTERS)))
    return [(k, order, step + 1, sum(bit[f] for f in order[:step]), bit[order[step]]) for k, order in ranked for step in range(len(order))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part, order and step.

    Null texts count as empty, null languages as the part "". Among equal texts all but those of the smallest id fail E;
    a row without an id fails E never and makes none fail it, and rows that share both id and text fail it together or not at all.
    A document is good or toxic if any of its label rows says 1. Other columns are not looked at; texts are measured whole,
    one at a time. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark):
        counts = written(mask_counts(docs, labels), "audit-masks")
        # at most 32 masks in a part
        parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
        plan = orders()
        numbers = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(plan[-1][0]))).alias("k"))
        steps = numbers.join(F.broadcast(spark.createDataFrame(plan, "k int, filter_order string, step int, before int, own int")), "k")
        has = lambda m, bits: m["mask"].bitwiseAND(F.col(bits)) != 0

        def total(what: str, which) -> Column:
            return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda s, m: s + m[what])

        removed = lambda m: has(m, "own") & ~has(m, "before")
        share = lambda m: (F.lit(len(plan) // len(FILTERS)) / F.bit_count(m["mask"])).cast("long") * m["n"]
        shapley = F.aggregate(F.filter("masks", lambda m: has(m, "own")), F.lit(0).cast("long"), lambda s, m: s + share(m))
        return lasting(
            steps.select(
                "part", "filter_order", "step", total("n", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"), total("n", removed).alias("removed"),
                total("n", lambda m: has(m, "own") & has(m, "before")).alias("redundant"), total("n", lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
                total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
            ),
            "audit",
        )


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < {LEAST_WORDS} AS INT) AS a, CAST(100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS INT) AS b,
    CAST(100 * len(regexp_extract_all(x, '[A-Z]')) > {MOST_CAPITALS} * length(x) AS INT) AS c, CAST(regexp_matches(x, '[{SYMBOLS}]') AS INT) AS d, CAST(coalesce(doc_id > first, false) AS INT) AS e
  FROM w LEFT JOIN marks USING (doc_id)),
grown AS (SELECT '' AS o UNION ALL SELECT o || s FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s) WHERE NOT contains(o, s)),
orders AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM grown WHERE length(o) = 5),
failed AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda s, i: [a, b, c, d, e][i] = 1) AS fails FROM f),
steps AS (
  SELECT part, filter_order, step, good, toxic, list_contains(fails, substr(filter_order, step, 1)) AS own, len(list_filter(fails, lambda s: contains(substr(filter_order, 1, step - 1), s))) > 0 AS before, len(fails) AS n_fails
  FROM failed, orders),
counted AS (
  SELECT part, filter_order, step, count(*) FILTER (NOT own AND NOT before) AS kept, count(*) FILTER (own AND NOT before) AS removed, count(*) FILTER (own AND before) AS redundant,
    count(*) FILTER (own AND n_fails = 1) AS unique_fails, CAST(coalesce(sum(good) FILTER (own AND NOT before), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY ALL),
totals AS (SELECT part, substr(filter_order, step, 1) AS s, CAST(sum(removed) AS BIGINT) AS shapley FROM counted GROUP BY ALL)
SELECT c.*, shapley FROM counted c JOIN totals t ON c.part = t.part AND substr(c.filter_order, c.step, 1) = t.s
"""
