"""Exact dedup by a minimal perfect hash over historical digests.

The history's distinct SHA-256 digests are dealt into buckets of about ``PER_BUCKET`` keys. Each
bucket is one index row: a minimal perfect hash (levels of bit arrays in which a key's bit is set
when it alone falls there), and for each slot the full 32-byte digest, the winner's doc_id and the
number of rows. A batch is grouped by digest first, so a text with very many copies is one probe.
A probe goes to the slot that the hash names and compares all 32 bytes: equal means a repeat of
that slot's group, anything else is a nonmember, which forms a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import hash_blocks, joined_where_hot, lasting, scratch, written

PER_BUCKET = 4096
#: Bits for each key of a level.
GAMMA = 2
MAX_LEVELS = 100

INDEX_SCHEMA = "bucket int, level_bits array<int>, bits binary, digests binary, winners binary, winner_known binary, counts binary"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest (four 64-bit words) for one level."""
    salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        h = words[:, level % 4] ^ salt
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h ^= words[:, (level + 1) % 4]
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _digest_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the concatenated bits of a minimal perfect hash of distinct digests."""
    left, sizes, levels = np.arange(len(words)), [], []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("the digests of a bucket are not distinct")
        size = GAMMA * len(left) + 1
        at = (_mixed(words[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level takes it (such a digest is no member)."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    slots, left, base = np.full(len(words), -1), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slots


def _build_bucket(table: pa.Table) -> pa.Table:
    digests = table["digest"].to_pylist()
    words = _digest_words(digests)
    sizes, bits = build_hash(words)
    order = np.argsort(slots_of(words, sizes, bits))
    known = np.array([x is not None for x in table["winner"].to_pylist()], dtype=np.uint8)
    winners = table["winner"].fill_null(0).to_numpy().astype("<i8")
    counts = table["n"].to_numpy().astype("<i8")
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
            "level_bits": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digests": pa.array([words[order].tobytes()], pa.binary()),
            "winners": pa.array([winners[order].tobytes()], pa.binary()),
            "winner_known": pa.array([known[order].tobytes()], pa.binary()),
            "counts": pa.array([counts[order].tobytes()], pa.binary()),
        }
    )


def grouped_digests(digests: DataFrame) -> DataFrame:
    """(doc_id, digest) to (digest, winner, n); partial sums keep hot digests out of the shuffle."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index rows of a history of (doc_id, digest)."""
    return _bucketed(grouped_digests(history), buckets).groupBy("bucket").applyInArrow(_build_bucket, INDEX_SCHEMA)


def _probe_bucket(batch: pa.Table, index: pa.Table) -> pa.Table:
    """Each historical slot with what the batch adds to it, and the batch's nonmembers."""
    digests, keep, sizes_out = [], [], []
    asked = batch["digest"].to_pylist() if batch.num_rows else []
    asked_winner = batch["winner"].to_pylist() if batch.num_rows else []
    asked_n = batch["n"].to_pylist() if batch.num_rows else []
    repeated = [False] * len(asked)
    members = 0
    if index.num_rows:
        row = {k: index[k][0].as_py() for k in ("level_bits", "bits", "digests", "winners", "winner_known", "counts")}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["level_bits"])).astype(bool)
        held = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
        known = np.frombuffer(row["winner_known"], np.uint8)
        winners = [int(w) if k else None for w, k in zip(np.frombuffer(row["winners"], "<i8"), known, strict=True)]
        counts = np.frombuffer(row["counts"], "<i8").copy()
        if asked:
            for i, slot in enumerate(slots_of(_digest_words(asked), row["level_bits"], bits)):
                if slot >= 0 and held[slot] == asked[i]:
                    repeated[i] = True
                    counts[slot] += asked_n[i]
                    both = [w for w in (winners[slot], asked_winner[i]) if w is not None]
                    winners[slot] = max(both, default=None)
        digests, keep, sizes_out, members = held, winners, counts.tolist(), len(held)
    fresh = [i for i, again in enumerate(repeated) if not again]
    return pa.table(
        {
            "digest": pa.array(digests + [asked[i] for i in fresh], pa.binary()),
            "keep_id": pa.array(keep + [asked_winner[i] for i in fresh], pa.int64()),
            "group_size": pa.array(sizes_out + [asked_n[i] for i in fresh], pa.int64()),
            "member": pa.array([True] * members + [False] * len(fresh), pa.bool_()),
        }
    )


def resolve(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """All groups of history and batch: digest, keep_id, group_size, member (of the history)."""
    probes = _bucketed(grouped_digests(batch), buckets).groupBy("bucket")
    return probes.cogroup(index.groupBy("bucket")).applyInArrow(_probe_bucket, GROUP_SCHEMA)


def exact_groups(docs: DataFrame, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, digest) of every row, the groups of equal texts, and the number of rows.

    The history is the half of the rows with the smaller ids (split at the middle of the id range),
    the batch is the rest. The row with the largest doc_id of a group stays.

    Null texts count as empty. Rows without an id are in the batch and lose against any id; a group
    of only such rows has keep_id null. Rows that share id and text are one document delivered twice.
    """
    digests = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    rows, low, high = digests.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    buckets = hash_blocks(rows, per_bucket)
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    index = build_index(digests.filter(old), buckets)
    return digests, written(resolve(digests.filter(~old), index, buckets), "groups"), rows


def mark_duplicates(docs: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    Nulls and repeated rows as in :func:`exact_groups`; whole texts are hashed, however long, and other columns
    are not looked at. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        digests, groups, rows = exact_groups(docs, per_bucket)
        marked = joined_where_hot(digests, groups, "digest", "group_size", rows)
        return lasting(
            marked.select(
                "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history")
            ),
            "marked",
        )


def drop_duplicates(docs: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a row delivered twice stays once.

    Of a group without ids one row stays. Nulls, long texts and empty tables as in :func:`mark_duplicates`; of
    several rows with one id and one text the one whose columns have the smallest hash stays.
    """
    own = "__tierloom_digest"
    with scratch(docs.sparkSession):
        digests, groups, _ = exact_groups(docs, per_bucket)
        stays = lasting(groups.select(F.col("digest").alias("__tierloom_other"), F.col("keep_id").alias("__tierloom_keep")), "stays")
        repeated = digests.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    tagged = docs.withColumn(own, text_digest(F.col("text")))
    kept = tagged.join(stays, tagged["doc_id"].cast("long").eqNullSafe(F.col("__tierloom_keep")) & (tagged[own] == F.col("__tierloom_other")), "left_semi")
    # only rows delivered twice need a second shuffle of the texts
    if repeated:
        hashed = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
        first = F.min_by(F.struct(*docs.columns), hashed).alias("__tierloom_first")
        return kept.groupBy("doc_id", own).agg(first).select("__tierloom_first.*")
    return kept.drop(own)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
middle AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS m FROM documents),
g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size,
    coalesce(bool_or(doc_id <= (SELECT m FROM middle)), false) AS in_history
  FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, in_history
FROM d JOIN g USING (text_sha256)
"""
