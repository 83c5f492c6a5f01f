"""Nearest neighbours by counting collisions in sorted projections.

Vectors are scaled to length one, so that the nearest by cosine is the nearest by distance. They are
dealt into blocks of about ``PER_BLOCK`` by a hash of their id; a block's index is ``PROJECTIONS``
arrays, each the block's vectors sorted by one random projection. A query looks at a window centred
on its own projection in each array. Windows of radius ``RADIUS``, then of radii ``GROWTH`` times the last
(virtual rehashing: the arrays stay as they are), count in how many arrays a vector collides with the
query; a vector that collides in ``SHARE`` of the arrays or more is verified by its exact cosine. The first windows
hold most of an array, so what lies outside them is counted, and taken from all. A query ends in a block once more
than a share of the block's vectors, and ``k`` at least, are verified: ``VERIFIED`` where there are ``VERIFIED_AT``
vectors in all, and less with the square root of their number, since the nearest of more vectors are nearer.
The best ``k`` of every block compete for the answer.

Every row is indexed; no sample is taken. Queries are dealt into groups of about ``PER_GROUP`` rows and
groups into slices of about ``PER_SLICE``. A task holds one block's index at a time while the groups of
a slice go past it, so each block is sent once for each slice, and each group once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.durable import hash_blocks, lasting, scratch, written

PROJECTIONS = 64
SHARE = 0.875
RADIUS, GROWTH = 1.5, 1.05
VERIFIED, VERIFIED_AT = 0.35, 500
PER_BLOCK, PER_GROUP = 8192, 256
#: Groups of queries that one copy of a block's index serves.
PER_SLICE = 32
NEIGHBOURS = 5
SEED = 5

PACKED_SCHEMA = "part int, ids binary, vectors binary, norms binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, scaled by a power of two; cosines do not change, and other rows not at all."""
    square = (vectors * vectors).sum(axis=1)
    odd = ~((square > 1e-280) & (square < 1e280))
    if odd.any():
        vectors = vectors.copy()
        _, power = np.frexp(np.abs(vectors[odd]).max(axis=1))
        vectors[odd] = np.ldexp(vectors[odd], -power[:, None])
    return vectors


def _pack(table: pa.Table) -> pa.Table:
    """A block or group as one row, by ascending id."""
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
    with np.errstate(over="ignore", under="ignore"):
        vectors = _in_range(flat.reshape(len(order), -1)[order])
    return pa.table(
        {
            "part": table["part"][:1].cast(pa.int32()),
            "ids": pa.array([table["vec_id"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "norms": pa.array([np.sqrt((vectors * vectors).sum(axis=1)).tobytes()], pa.binary()),
        }
    )


def _packed(vectors: DataFrame, sizes: DataFrame, first: str, parts: str) -> DataFrame:
    """Rows in parts of one vector length: ``parts`` of them, numbered from ``first``, as ``sizes`` says for each length."""
    dealt = vectors.withColumn("length", F.size("v")).join(F.broadcast(sizes), "length")
    part = F.col(first) + F.pmod(F.xxhash64("vec_id", "v"), F.col(parts))
    return dealt.select("vec_id", "v", part.cast("int").alias("part")).groupBy("part").applyInArrow(_pack, PACKED_SCHEMA)


def _unpacked(ids: bytes, vectors: bytes, norms: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<f8").reshape(len(i), -1), np.frombuffer(norms, "<f8")


def directions(length: int) -> np.ndarray:
    """(length, PROJECTIONS) random directions, orthogonal within each ``length`` of them."""
    rng, found = np.random.default_rng(SEED), []
    for _ in range(-(-PROJECTIONS // length)):
        found.append(np.linalg.qr(rng.standard_normal((length, length)))[0])
    return np.hstack(found)[:, :PROJECTIONS] * np.sqrt(length)


class SortedProjections:
    """The index of one block. The arrays lie one after another, ``STRIDE`` apart, so that one search finds all window ends."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray):
        self.n, self.directions = len(vectors), directions(vectors.shape[1])
        # in units of the spread of the projections of unit vectors, so none is beyond half a stride
        at = ((vectors / norms[:, None]) @ self.directions).T
        self.stride = 4 * np.sqrt(vectors.shape[1])
        self.shift = np.arange(PROJECTIONS) * self.stride
        order = np.argsort(at, axis=1)
        self.at = (np.take_along_axis(at, order, axis=1) + self.shift[:, None]).ravel()
        self.order = order.ravel()
        self.first = np.arange(PROJECTIONS) * self.n

    def candidates(self, query: np.ndarray, k: int, share: float) -> np.ndarray:
        """Numbers of the vectors to verify for a query of length one."""
        own = query @ self.directions + self.shift
        least, enough = max(1, round(SHARE * PROJECTIONS)), max(k, share * self.n)
        counts, lows, highs, radius = None, None, None, RADIUS
        while True:
            reach = min(radius, self.stride / 2)
            lo = np.maximum(np.searchsorted(self.at, own - reach), self.first)
            hi = np.minimum(np.searchsorted(self.at, own + reach, side="right"), self.first + self.n)
            if counts is None:
                counts = PROJECTIONS - self._hits(self.first, lo, hi, self.first + self.n)
            else:
                counts += self._hits(lo, lows, highs, hi)
            lows, highs = lo, hi
            found = np.flatnonzero(counts >= least)
            if len(found) > enough or len(found) == self.n:
                return found
            radius *= GROWTH

    def _hits(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How often each vector stands in the stretches from a to b and from c to d of the arrays."""
        ends = zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)
        return np.bincount(np.concatenate([self.order[x:y] for w in ends for x, y in (w[:2], w[2:])]), minlength=self.n)


def verified_share(n: int) -> float:
    """Of a block's vectors, what a query verifies at least, where there are ``n`` vectors in all."""
    return min(1.0, VERIFIED * (VERIFIED_AT / max(n, 1)) ** 0.5)


def _searcher(k: int, shares: dict[int, float]):
    """Rows sorted so that each slice's block comes first: one index is held at a time, groups of queries go past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, index = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch["part"][row].as_py(), batch["slice"][row].as_py()
                packed = _unpacked(*(batch[c][row].as_py() for c in ("ids", "vectors", "norms")))
                if not batch["asks"][row].as_py():
                    held, block, index = key, packed, SortedProjections(packed[1], packed[2])
                    continue
                if key != held:
                    continue
                out: list[tuple[int, int, float]] = []
                ids, vectors, norms = block
                for q, v, norm in zip(*packed, strict=True):
                    found = index.candidates(v / norm, k + 1, shares[len(v)])
                    found = found[ids[found] != q]
                    # a sum for each row, so that equal vectors have equal scores in every block
                    score = (vectors[found] * v).sum(axis=1) / (norms[found] * norm)
                    best = np.lexsort((ids[found], -score))[:k]
                    out += zip([int(q)] * len(best), ids[found][best].tolist(), score[best].tolist(), strict=True)
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, per_block: int = PER_BLOCK, per_group: int = PER_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found among all other rows.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on its rows. Rows whose id is
    null or whose vector is null, empty, zero or has null or non-finite components take no part.
    Vectors of another length than a query's are not compared with it. A repeated id is a row of its
    own as a candidate, and asks once. Ties go to the smaller vec_id. Components so large or small that their squares
    leave the range of doubles are handled. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    with scratch(spark):
        rows = written(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))), "vectors")
        asking = written(rows.filter(queries).dropDuplicates(["vec_id"]), "asking")
        by_length = lambda df, name: df.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias(name))
        # a row for each length of vectors that a query has
        counts = by_length(asking, "asks").join(by_length(rows, "n"), "length").orderBy("length").collect()
        plan, block, group, shares = [], 0, 0, {r.length: verified_share(r.n) for r in counts}
        for r in counts:
            blocks, groups = hash_blocks(r.n, per_block), hash_blocks(r.asks, per_group)
            plan.append((r.length, block, blocks, group, groups, hash_blocks(groups, PER_SLICE)))
            block, group = block + blocks, group + groups
        sizes = spark.createDataFrame(plan, "length int, first_block int, blocks int, first_group int, groups int, slices int")
        index = written(_packed(rows, sizes, "first_block", "blocks"), "ann-blocks")
        asked = written(_packed(asking, sizes, "first_group", "groups").withColumnRenamed("part", "grp"), "ann-queries")
        up_to = lambda first, n: F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1))
        packed = ["ids", "vectors", "norms"]
        blocks_of = F.broadcast(sizes.select(up_to("first_block", "blocks").alias("part"), "slices"))
        held = index.join(blocks_of, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"), *packed)
        groups_of = F.broadcast(sizes.select(up_to("first_group", "groups").alias("grp"), "first_block", "blocks", "slices"))
        passing = asked.join(groups_of, "grp").select(up_to("first_block", "blocks").alias("part"), (F.col("grp") % F.col("slices")).alias("slice"), F.lit(True).alias("asks"), *packed)
        met = held.union(passing).repartition("part", "slice").sortWithinPartitions("part", "slice", "asks").mapInArrow(_searcher(k, shares), FOUND_SCHEMA)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return lasting(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
