"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table of frequent units and their lengths in tokens, gathered from a sample
of about ``SAMPLE_ROWS`` rows and broadcast; it has at most ``TABLE_UNITS`` units of at most 64
characters, so its size is bounded. Tier two is each worker's cache of what it had to encode. The
table only saves time: any unit that it lacks is encoded, so counts do not depend on the sample.
Nothing is shuffled: a task of the sample sends the driver at most ``UNITS_PER_ROW`` units for each row that it has.

A unit is a run between isolated spaces: one pre-token, or several where marks or other white space stand between them.
The pre-tokenizer joins nothing across such a space, so a unit's length is the sum of its pre-tokens' lengths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.byte_bpe import CACHED_UNIT_CHARS, Tokenizer, units_of

SAMPLE_ROWS = 10_000
UNITS_PER_ROW = 64
TABLE_UNITS = 100_000
LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = Counter(), 0
    for batch in batches:
        rows += batch.num_rows
        for text in batch["text"].to_pylist():
            found.update(x for x in units_of(text or "")[1:] if len(x) <= CACHED_UNIT_CHARS and " " not in x)
    top = found.most_common(UNITS_PER_ROW * rows)
    yield pa.RecordBatch.from_pydict({"unit": pa.array([x for x, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_lengths(docs: DataFrame, path: str, rows: int, sample_rows: int = SAMPLE_ROWS, units: int = TABLE_UNITS) -> tuple[str, bytes]:
    """The table: the units, joined by spaces (no unit of the table has one), and a byte for each one's length."""
    share, total = min(1.0, sample_rows / max(1, rows)), Counter()
    sampled = docs.select("text").sample(fraction=share, seed=11).mapInArrow(_unit_counts, "unit string, n long")
    for batch in sampled.toArrow().to_batches():  # bounded by the sample
        total.update(dict(zip(batch["unit"].to_pylist(), batch["n"].to_pylist(), strict=True)))
    tokenizer = Tokenizer(path)
    top = sorted((x for x in total.items() if x[1] > 2), key=lambda x: (-x[1], x[0]))[:units]
    lengths = {x: n for x, _ in top if (n := tokenizer._count(" " + x)) <= 255}  # rare scripts have longer units: these are always encoded
    return " ".join(lengths), bytes(lengths.values())


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty: no bytes, no tokens. Repeated rows, and rows without an id, are counted each for itself.
    Whole texts are counted, however long; other columns are not looked at. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, docs.count(), sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, lengths = table.value
        frequent = dict(zip(units.split(" "), lengths, strict=True)) if lengths else {}
        tokenizer = Tokenizer(path, frequent)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            n = np.fromiter(map(tokenizer.count, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}
            )

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
