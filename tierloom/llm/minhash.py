"""Near-duplicate groups by b-bit MinHash.

1. Each text gives its shingle set's size and digest, ``HASHES`` minima, of which ``BITS`` low bits
   each are packed into 64-bit words, and ``BANDS`` band keys, each a hash of ``ROWS`` full minima.
   Texts with the same set are one class, known by its smallest doc_id.
2. Classes that share a band key are candidates. Each key's centre is the class whose keys have the most
   members in all, the smallest of equals. Centres are
   compared with the key's other classes: first the similarity that equal bits suggest, corrected for
   chance collisions, against ``THRESHOLD - SLACK``; then exactly, on the full sets of both texts.
3. Confirmed links give components. A key whose classes are then still apart has the classes that are
   apart from their centre joined with all its classes, in tiles of about ``PER_TILE`` by ``PER_TILE``:
   pairs within a component, or with too few equal bits, never leave that join, and a pair only does at
   the first such key that both have. The rest is compared exactly in the same way.
4. The second links join the components of the first.

A pair of similarity 0.75 shares no band key with probability (1 - 0.75^4)^32 = 5e-6; the estimate
loses a pair of just 0.75 that shares one with about 3e-6. Nothing is capped. A group of thousands of near copies
is decided by its links to a few centres, and the members of one centre are compared in slices
of about ``PER_SLICE``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.components import components
from tierloom.llm.durable import joined_where_hot, lasting, scratch, written
from tierloom.llm.shingles import mixed, shingle_sets

HASHES, BITS = 1024, 2
#: The first ``BANDS * ROWS`` minima make the band keys.
BANDS, ROWS = 32, 4
#: Of a hundred.
THRESHOLD = 75
#: Four and a half standard deviations of the estimate at the threshold.
SLACK = 0.073
PER_SLICE = 64
#: Of one band key's classes, so many of either side meet in one task.
PER_TILE = 1024
#: Up to so many ids (8 bytes each) are broadcast to pick texts where they lie; more are joined.
BROADCAST_IDS = 1_000_000

_WORDS = HASHES * BITS // 64
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(_WORDS))
_SIGNATURE = [f"s{i}" for i in range(_WORDS)]
#: How many words of a signature are looked at first, and then; the last look is at all.
LOOKS = (_WORDS // 16, _WORDS // 4, _WORDS)

_RNG = np.random.default_rng(31)
_FACTORS = _RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND_PLACE = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) minima of nonempty sets."""
    short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    found = np.empty((len(sets), HASHES), np.uint32)
    work = np.empty_like(short)
    for k in range(HASHES):
        np.multiply(short, _FACTORS[k], out=work)
        work += _ADDENDS[k]
        found[:, k] = np.minimum.reduceat(work, starts)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = found[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS).astype(np.uint64) * _BAND_PLACE
        return mixed(rows.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def packed_bits(found: np.ndarray) -> np.ndarray:
    """The ``BITS`` low bits of every minimum, once it is mixed, in 64-bit words."""
    per_word = 64 // BITS
    with np.errstate(over="ignore"):
        low = (mixed(found.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(found), _WORDS, per_word)
        return (low << (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and packed bits of every row; no bands without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for sets in shingle_sets(batch["text"].to_pylist()):
                n = len(sets)
                full = np.array([i for i, x in enumerate(sets) if len(x)], dtype=np.int64)
                bits, bands = np.zeros((n, _WORDS), np.int64), [[]] * n
                if len(full):
                    found = minima([sets[i] for i in full])
                    bits[full] = packed_bits(found)
                    for i, keys in zip(full, band_keys(found), strict=True):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())), *(pa.array(bits[:, k]) for k in range(_WORDS)),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", *_SIGNATURE],
                )
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNATURE_SCHEMA)


def estimated_similarity(left: str, right: str, words: int = _WORDS) -> Column:
    """From the first packed words of two aliases: the share of equal minima, less what equal bits by chance give."""
    differ = F.lit(0)
    lanes = sum(1 << (BITS * i) for i in range(64 // BITS))
    for s in _SIGNATURE[:words]:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(lanes)))
    by_chance = 1 / (1 << BITS)
    return (1 - differ / (words * 64 // BITS) - by_chance) / (1 - by_chance)


def may_be_near(left: str, right: str) -> Column:
    """What a pair must pass before its sets are compared: sizes that allow the similarity, and bits that suggest it.

    A part of the bits, with slack that grows as the part shrinks, spares most pairs the full count.
    """
    sizes = [F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")]
    passed = F.least(*sizes) * 100 >= F.greatest(*sizes) * THRESHOLD
    for n in LOOKS:
        passed = passed & (estimated_similarity(left, right, n) >= THRESHOLD / 100 - SLACK * (_WORDS / n) ** 0.5)
    return passed


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each slice's centre comes first; one set of a centre is held at a time."""
    slice_key, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, slices, ids, is_centre = (batch[c].to_pylist() for c in ("a", "slice", "id", "is_centre"))
        at, out = 0, []
        for sets in shingle_sets(batch["text"].to_pylist()):
            for own in sets:
                if is_centre[at]:
                    slice_key, centre = (a[at], slices[at]), own
                elif slice_key == (a[at], slices[at]) and len(own) and len(centre):
                    where = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    both = int((centre[where] == own).sum())
                    if 100 * both >= THRESHOLD * (len(own) + len(centre) - both):
                        out.append((a[at], ids[at]))
                at += 1
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, as (u, v); ``texts`` has doc_id and text.

    Texts travel to the slices of their centres: each wanted text once for each slice that it is in.
    """
    pairs = written(pairs, "pairs")
    slices = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).withColumn("slices", F.ceil(F.col("size") / PER_SLICE).cast("int")), "centres")
    n_pairs = slices.agg(F.sum("size")).first()[0] or 0
    members = joined_where_hot(pairs, slices, "a", "size", n_pairs).select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.col("b").alias("id"), F.lit(0).alias("is_centre"))
    centres = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("a").alias("id"), F.lit(1).alias("is_centre"))
    wanted = written(members.union(centres), "slices")
    ids = written(wanted.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    picked = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text")
    dealt = wanted.join(picked, "id").repartition("a", "slice").sortWithinPartitions("a", "slice", F.desc("is_centre"))
    return written(dealt.select("a", "slice", "id", "is_centre", "text").mapInArrow(_compare, "u long, v long"), "links")


def _with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be near, by their packed bits."""
    own = ["n_shingles", *_SIGNATURE]
    left = classes.select(F.col("rep").alias("a"), F.struct(*own).alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.struct(*own).alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(may_be_near("x", "y")).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row.

    Null and wordless texts have no shingles and are linked with nothing. Every row's own text is compared,
    whatever its id: rows without an id can be linked, and rows that share one but not a text are linked
    each for itself. class_id and component_id are the smallest doc_id among rows with the same set and among
    linked rows; null where none of them has an id, and then the first row of the component is kept.
    Very long texts are hashed alone; other columns are not looked at. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return lasting(_placed(docs)[0], "near")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Result rows, and where ids are null or repeated, (doc_id, text_key) of the texts that stay."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = ids.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return _linked(written(signatures(ids), "signatures"), ids), None
    # rows get numbers of their own
    keyed = written(ids.withColumnRenamed("doc_id", "own_id").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    found = written(_linked(written(signatures(keyed), "signatures"), keyed), "linked")
    rows = found.join(keyed.select("doc_id", "own_id", F.xxhash64("text").alias("text_key")), "doc_id")
    tops = rows.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("missing"), "own_id", "doc_id", "text_key")).alias("top"))
    firsts = rows.groupBy("class_id").agg(F.min("own_id").alias("first"))
    both = rows.join(tops, "component_id").join(firsts, "class_id")
    kept = F.when(F.col("top.missing"), F.col("doc_id") == F.col("top.doc_id")).otherwise(F.col("own_id").eqNullSafe(F.col("top.own_id")))
    result = both.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("first").alias("class_id"), F.col("top.own_id").alias("component_id"), kept.alias("kept"))
    return result, tops.select(F.col("top.own_id").alias("doc_id"), F.col("top.text_key").alias("text_key"))


def _linked(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Classes, links and components of signatures with distinct ids."""
    usable = signed.filter("n_shingles > 0")
    reps = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    first = F.col("doc_id") == F.col("rep")
    n_rows = reps.agg(F.sum("copies")).first()[0] or 0
    classed = written(joined_where_hot(usable, reps, "digest", "copies", n_rows).select("doc_id", "n_shingles", "rep", *(F.when(first, F.col(c)).alias(c) for c in ("bands", *_SIGNATURE))), "classes")
    classes = classed.filter(first)

    keyed = classed.filter(first).select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    n_keyed = reps.count() * BANDS
    shared = written(joined_where_hot(keyed, sizes, "key", "size", n_keyed), "shared-keys")
    # the text that an edited group came from shares more keys with its copies than they do among themselves
    mass = shared.groupBy("rep").agg(F.sum("size").alias("mass"))
    centres = shared.join(mass, "rep").groupBy("key").agg(F.max(F.struct("mass", (-F.col("rep")).alias("minus"))).alias("m"), F.first("size").alias("size"))
    centres = written(centres.select("key", (-F.col("m.minus")).alias("centre"), "size"), "key-centres")
    members = written(joined_where_hot(shared.drop("size"), centres, "key", "size", n_keyed), "members")
    stars = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(_with_signatures(stars, classes), texts)
    roots = components(links)

    own = written(members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "centre", "size", F.coalesce("root", "rep").alias("root")), "own")
    # a key's centre is one of its members
    heads = written(own.filter("rep = centre").groupBy("key").agg(F.first("root").alias("centre_root"), F.first("size").alias("size")), "heads")
    own = joined_where_hot(own.drop("size"), heads, "key", "size", n_keyed).withColumn("apart", F.col("root") != F.col("centre_root")).drop("centre_root", "size")
    more = confirmed(_pairs_within(own, classes), texts)
    root_of = roots.select(F.col("node"), F.col("root"))
    at_roots = more.join(root_of.toDF("u", "ru"), "u", "left").join(root_of.toDF("v", "rv"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    tops = components(at_roots).toDF("mid", "top")

    placed = classed.select("doc_id", "n_shingles", "rep").join(roots.toDF("rep", "root"), "rep", "left").withColumn("mid", F.coalesce("root", "rep"))
    placed = placed.join(tops, "mid", "left").select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("top", "mid").alias("component_id"))
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _where_few(keys: DataFrame) -> DataFrame:
    """A table of keys, broadcast if it has few: then the rows of a hot key stay where they lie."""
    held = written(keys, "keys")
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


def _pairs_within(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of one key, of which one at least is apart from the key's centre, that may be near by their bits.

    ``own``: key, rep, centre, root, apart. A key's classes meet in tiles, so that a hot key is spread over tasks.
    """
    open_keys = _where_few(own.filter("apart").select("key").distinct())
    met = own.filter("rep <> centre").join(open_keys, "key", "left_semi").drop("centre")
    every_key = met.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # BANDS at most
    rest = written(met.join(every_key, "rep").join(classes.select("rep", "n_shingles", *_SIGNATURE), "rep"), "rest")
    wide = rest.groupBy("key").agg(F.ceil(F.count_if("apart") / PER_TILE).alias("xs"), F.ceil(F.count(F.lit(1)) / PER_TILE).alias("ys")).filter("ys > 1")
    tiled = rest.join(_where_few(wide), "key", "left").withColumn("xs", F.coalesce("xs", F.lit(1))).withColumn("ys", F.coalesce("ys", F.lit(1)))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = tiled.filter("apart").withColumn("tx", place("xs")).withColumn("ty", every("ys")).alias("x")
    y = tiled.withColumn("ty", place("ys")).withColumn("tx", every("xs")).alias("y")
    same_tile = (F.col("x.key") == F.col("y.key")) & (F.col("x.tx") == F.col("y.tx")) & (F.col("x.ty") == F.col("y.ty"))
    apart = (F.col("x.root") != F.col("y.root")) & (~F.col("y.apart") | (F.col("x.rep") < F.col("y.rep")))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, same_tile & apart & may_be_near("x", "y") & first).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one text of each component, with all their columns.

    Nulls, repeated ids, empty and long texts as in :func:`near_components`: a row of an id that has
    several texts stays or goes by its own text. Rows with the same id and the same text stay or go together.
    """
    own = "__tierloom_text_key"
    with scratch(docs.sparkSession):
        result, stays = _placed(docs)
        if stays is None:
            kept = lasting(result.filter("kept").select(F.col("doc_id").alias("__tierloom_kept")), "kept")
            return docs.join(kept, docs["doc_id"].cast("long") == F.col("__tierloom_kept"), "left_semi")
        kept = lasting(stays.toDF("__tierloom_kept", "__tierloom_key"), "kept")
    tagged = docs.withColumn(own, F.xxhash64("text"))
    same = tagged["doc_id"].cast("long").eqNullSafe(F.col("__tierloom_kept")) & (tagged[own] == F.col("__tierloom_key"))
    return tagged.join(kept, same, "left_semi").drop(own)
