"""Packing documents into sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left over is packed best
fit decreasing, the longest pieces first, each into the open window with the least sufficient room.
Lengths are whole numbers up to the window's size, so the order of events only depends on how many
pieces have each length: that histogram (at most one row for each length) is all that the driver
sees. There a segment tree over remaining capacities finds the tightest open windows, and pieces of
one length go into windows of one capacity many at a time, which gives the very placement that one
piece after another would. The plan is a list of runs "pieces with ranks a to b of length L go to
windows from w on, at offset o"; pieces get their rank within their length from counts of hash
blocks, so no task sees all pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.byte_bpe import Tokenizer
from tierloom.llm.durable import hash_blocks, lasting, scratch, written

WINDOW = 1024
#: Id that ends every document.
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PER_BLOCK = 8192

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A segment tree over capacities 0..n-1: which is the least one, from a bound on, that has windows?"""

    def __init__(self, n: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, has: bool) -> None:
        i = capacity + self.size
        self.any[i] = has
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least_from(self, bound: int) -> int | None:
        i = bound + self.size
        if self.any[i]:
            return bound
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_runs(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first window, pieces in each window, offset), ranks ascending per length."""
    tree = CapacityTree(window + 1)
    open_windows: dict[int, deque] = defaultdict(deque)  # remaining capacity: intervals [first window, how many]
    runs, windows = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_windows[capacity].append([first, n])
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.least_from(length)
            if capacity is None:  # new windows, as many as these pieces fill
                capacity = window
                first, n = windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_windows[capacity].popleft()
                if not open_windows[capacity]:
                    tree.set(capacity, False)
            each = capacity // length  # a window that took a piece is the tightest one for the next
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, window - capacity))
                add(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                runs.append((length, rank, first, left, window - capacity))
                add(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n and capacity < window:
                open_windows[capacity].appendleft([first, n])
                tree.set(capacity, True)
    return runs


def cut_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens. Every document has one piece at least.

    A null text counts as empty: its end id alone. Rows without an id and rows that share one are cut each for itself; whole texts
    are encoded, however long; other columns are not looked at. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokenizer.encode(text or "") + end
                n = len(ids) // 4
                rows += [(doc_id, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def place(pieces: DataFrame, window: int = WINDOW, per_block: int = PER_BLOCK) -> DataFrame:
    """``pieces`` (any table with doc_id, start, length, ids_crc32) with sequence_id and offset.

    Lengths are from 1 to ``window``. Null and repeated ids do not matter: every row is a piece of its own, and rows alike in all four
    columns take the places of their kind in any order. Extra columns pass through. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = hash_blocks(sum(counts.values()), per_block)
    by_length = defaultdict(list)
    for length, *run in plan_runs(counts, window):
        by_length[length].append(run)
    plan = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in by_length.items()})

    tagged = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = tagged.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("ahead"))

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            first_rank, first_window, each, base = plan.value[int(n)]
            run = np.searchsorted(first_rank, ranks[at], side="right") - 1
            k = ranks[at] - first_rank[run]
            sequence[at] = first_window[run] + k // each[run]
            offset[at] = base[run] + k % each[run] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("spot", spot("length", "rank")).select(*pieces.columns, "spot.sequence_id", "spot.offset")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, per_block: int = PER_BLOCK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Each document is its ids and the end id; a null text is empty and is the end id alone. Rows with
    a repeated doc_id, or none, are packed each for itself. Whole texts are encoded, however long; other columns are not
    looked at. An empty table gives no rows. Sequences are to be padded to ``window``.
    """
    with scratch(docs.sparkSession):
        return lasting(place(written(cut_pieces(docs, path, window), "pieces"), window, per_block), "packed")
