"""Resharding that moves the fewest bytes: a minimum-cost flow, then block transfers.

Old shards hold bytes, new shards have capacities; the new shard with an old one's number is where
that shard's files already lie. A minimum-cost flow on this small graph (its size is the number of
shards, whatever the data) says how many bytes go from where to where: bytes that stay cost nothing,
bytes that move cost one each. It is carried out on documents in classes of size, large ones first: within an
old shard and class, documents stand in blocks (by a hash of their id), every block has its place on
a line of bytes, and each new shard takes a stretch of that line. What a cut through a large document
gets wrong is put right by the classes of smaller ones, so that shards end within about one small document of
their capacities. Only blocks that a cut goes through are split; the others move or stay whole.

The driver sees sums for each old shard, class and new shard. Offsets within blocks come from windows
over one block, and block offsets from a window over block sums, so no task holds a shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.durable import drop_table, hash_blocks, lasting, scratch, written

SHARDS, OLD_SHARDS = 40, 32
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of these sizes or more are dealt before smaller ones.
SIZE_CLASSES = (65536, 16384, 4096, 1024, 256, 64, 0)
PER_BLOCK = 1024
#: A column that tells rows apart whatever their ids; carried through placement where rows have it.
ROW_KEY = "__row_key"


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Whole-number flows (old, new) of least total cost; capacities must hold all supplies.

    Successive cheapest augmenting paths with potentials.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, size: int, each: int) -> None:
        for x, y, s, p in ((a, b, size, each), (b, a, 0, -each)):
            out[x].append(len(to))
            to.append(y)
            room.append(s)
            price.append(p)

    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supply[i], capacity[j]), int(cost[i, j]))
    for i in range(n):
        edge(source, i, supply[i], 0)
    for j in range(m):
        edge(n + j, sink, capacity[j], 0)
    potential = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        far, via = [None] * (n + m + 2), [-1] * (n + m + 2)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e]:
                    y, nd = to[e], d + price[e] + potential[x] - potential[to[e]]
                    if far[y] is None or nd < far[y]:
                        far[y], via[y] = nd, e
                        heapq.heappush(heap, (nd, y))
        if far[sink] is None:
            raise ValueError("the capacities cannot hold the supplies")
        potential = [p + (d if d is not None else far[sink]) for p, d in zip(potential, far, strict=True)]
        push, x = left, sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        left -= push
    return np.array([[room[2 * (i * m + j) + 1] for j in range(m)] for i in range(n)], dtype=np.int64).reshape(n, m)


def stretches(want: np.ndarray, supply: int) -> np.ndarray:
    """Ends of the new shards' stretches on a line of ``supply`` bytes, in proportion to ``want``."""
    want = np.maximum(want, 0).astype(float)
    if want.sum() <= 0:
        want = np.ones(len(want))
    return np.round(np.cumsum(want) / want.sum() * supply).astype(np.int64)


def row_sizes(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size, text_crc32 and old_shard of every row, and its key where it has one."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"), *_key_of(docs))


def _key_of(rows: DataFrame) -> list[str]:
    return [ROW_KEY] if ROW_KEY in rows.columns else []


def _on_lines(rows: DataFrame, keys: list[str], blocks: int, what: Column, name: str) -> DataFrame:
    """``rows`` with what lies before each of them on its keys' line, ordered by block, doc_id and text."""
    # ids may be null or repeated: text and, where rows have one, their key spread such rows
    tagged = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", *_key_of(rows)), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy(*keys, "block").agg(F.sum(what).alias("s")).select(*keys, "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*keys, "block").orderBy("doc_id", "text_crc32", "size", *_key_of(rows)).rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged.withColumn(name, F.coalesce(F.sum(what).over(within), F.lit(0))).join(sums, [*keys, "block"])
    return placed.withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def plan_and_assign(rows: DataFrame, capacities: list[int] | None = None, shards: int = SHARDS, old_shards: int = OLD_SHARDS, per_block: int = PER_BLOCK) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, old_shard) with shard and slot; equal capacities unless given."""
    kind = F.lit(len(SIZE_CLASSES) - 1)
    for k in range(len(SIZE_CLASSES) - 2, -1, -1):
        kind = F.when(F.col("size") >= SIZE_CLASSES[k], k).otherwise(kind)
    rows = written(rows.withColumn("kind", kind.cast("int")), "sizes")
    supply = np.zeros((old_shards, len(SIZE_CLASSES)), np.int64)
    n = 0
    for r in rows.groupBy("old_shard", "kind").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        supply[r.old_shard, r.kind] = r.s
        n += r.n
    total = int(supply.sum())
    blocks = hash_blocks(n, per_block)
    if capacities is None:
        capacities = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    cost = 1 - np.eye(old_shards, shards, dtype=np.int64)
    flow = min_cost_flow(supply.sum(axis=1).tolist(), capacities, cost)
    lined = written(_on_lines(rows, ["old_shard", "kind"], blocks, F.col("size"), "at"), "lines")

    left, target, cuts = flow.astype(np.int64), np.array(capacities), np.zeros((len(SIZE_CLASSES), old_shards, shards), np.int64)
    placed = np.zeros(shards, np.int64)
    for k in range(len(SIZE_CLASSES)):
        if not supply[:, k].any():
            continue
        rest = supply[:, k:].sum(axis=1)
        # what a shard still lacks, over all old shards, corrects what each of them has left for it
        gap = (target - placed) - left.sum(axis=0)
        share = left / np.maximum(left.sum(axis=0), 1)
        wants = np.maximum(left + share * gap, 0)
        for i in range(old_shards):
            cuts[k, i] = stretches(wants[i], int(supply[i, k]))
        done = lined.filter(F.col("kind") == k).withColumn("shard", _shard_of(cuts)).groupBy("old_shard", "shard").agg(F.sum("size").alias("s"))
        for r in done.collect():
            left[r.old_shard, r.shard] -= r.s
            placed[r.shard] += r.s
        left = np.maximum(left, 0)
        scale = (rest - supply[:, k]) / np.maximum(left.sum(axis=1), 1)
        left = left * scale[:, None]

    assigned = written(lined.withColumn("shard", _shard_of(cuts)).select("doc_id", "size", "text_crc32", "old_shard", "shard", *_key_of(rows)), "assigned")
    return _on_lines(assigned, ["shard"], blocks, F.lit(1), "slot").drop("block")


def _shard_of(cuts: np.ndarray) -> Column:
    """The shard whose stretch holds a row's middle byte; ``cuts``: ends of stretches for each class and old shard."""
    ends = cuts.copy()

    @F.pandas_udf("int")
    def find(kind: pd.Series, old: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        found = np.zeros(len(old), np.int32)
        middle = start.to_numpy() + length.to_numpy() // 2
        line = kind.to_numpy() * ends.shape[1] + old.to_numpy()
        for i in np.unique(line):
            here = line == i
            found[here] = np.minimum(np.searchsorted(ends[i // ends.shape[1], i % ends.shape[1]], middle[here], side="right"), ends.shape[2] - 1)
        return pd.Series(found)

    return find("kind", "old_shard", "at", "size")


def reshard(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS, old_shards: int = OLD_SHARDS, capacities: list[int] | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved of every row.

    The law is ``bytes``: shards are near equal in bytes (or near ``capacities``). Slots count from 0
    in each shard without gaps. Old shards are by source, unless ``old_shard`` says otherwise; rows
    without a source are one more source. Null texts have no bytes; rows without an id or with a
    repeated one are dealt like others; rows that are the same in id, size and text stand in one block unless
    they have a ``ROW_KEY``, a column that is kept. An empty table gives no rows.
    """
    if old_shard is None:
        old_shard = F.pmod(F.xxhash64("source"), F.lit(old_shards))
    placed = plan_and_assign(row_sizes(docs, old_shard), capacities, shards, old_shards, per_block)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"), *_key_of(placed),
    )


def reshard_files(docs: DataFrame, path: str, key: Column | None = None, **how) -> DataFrame:
    """:func:`reshard`, with the affected shards written as ``path/shard=N``; returns what ``reshard`` returns.

    ``key`` differs for every row and is the same in every reading of ``docs``, such as the file and row that
    Parquet gives. Without it, rows get a number of their own in a copy of ``docs`` in the shared folder.
    """
    with scratch(docs.sparkSession):
        keyed = docs.withColumn(ROW_KEY, F.monotonically_increasing_id() if key is None else key)
        keyed = written(keyed, "keyed") if key is None else keyed
        placed = lasting(reshard(keyed, **how), "placed")
        rewrite_affected(keyed, placed, path)
    return placed.drop(ROW_KEY)


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose rows, as ``path/shard=N``; returns their numbers.

    Shards that keep just the rows that they had are left as they are; folders of affected shards that
    have no rows any more are removed. Rows meet their shard by ``ROW_KEY``; where that is missing, by
    doc_id, and ids that are null or repeated are refused. Columns shard and slot of ``docs`` give way to the new ones.
    """
    by = ROW_KEY if _key_of(docs) and _key_of(placed) else "doc_id"
    if by == "doc_id" and placed.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count():
        raise ValueError(f"ids are null or repeated: rows need a {ROW_KEY}")
    moved = placed.filter("moved")
    gains = moved.select(F.col("shard").alias("s")).union(moved.select(F.col("old_shard").alias("s"))).distinct()
    affected = sorted(r.s for r in gains.collect())  # at most one row for each shard
    there = placed.filter(F.col("shard").isin(affected)).select(by, "shard", "slot")
    rows = docs.drop("shard", "slot").join(there, by).drop(ROW_KEY)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for emptied in set(affected) - {r.shard for r in there.select("shard").distinct().collect()}:
        drop_table(docs.sparkSession, f"{path}/shard={emptied}")
    return affected
