"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. A row's size is its number of words. Sources, in the order of their names, weigh ``WEIGHTS`` in turn and share
   ``TOTAL`` times all words; no target passes ``REPEATS`` times its source. The level at which every open source gets weight times
   level is found by running sums over the sources, in the order in which they are filled.
2. All targets together are so many blocks of equal length. Sources get them by highest quotients, target over 1, 3, 5, ...:
   every source's quota lies within bounds that the sources' number gives, so only quotients between those are ranked,
   about two for a source.
3. Rows alike in id, source and size are counted together, in lots of up to ``PER_LOT``, so that no hot id lands in one place. A source's
   lots are dealt by a seeded hash to shards of about ``PER_SHARD``, and its blocks to its shards in proportion
   to their words, rounded along the running sum: integer quotas that add up to the source's.
4. A shard's rows, in seeded order, lie on a circle of words. A quota's blocks are taken one after another from a
   block that the seed picks, so every row is taken whole, again or not at all, but for those at the two ends.

Everything is DataFrame functions. A source, however large, is spread over its shards; one row of each source, and one for every
``PER_SHARD`` lots of a source, meet in a window. The SQL takes ids for distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.durable import lasting, scratch, written

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the corpus, and how often a source's words may be repeated.
TOTAL, REPEATS = 1.5, 2
#: Words of a block; fewer where the corpus has less than ``LEAST_BLOCKS`` such blocks.
BLOCK_WORDS, LEAST_BLOCKS = 16, 4096
PER_SHARD, PER_LOT = 1024, 64
SEED = "13"
#: Up to so many sources are broadcast to the rows.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Each word becomes one letter, and what lies between them nothing."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACE, "")).cast("long")


def _digits(digest: Column, start: int, size: int = 12) -> Column:
    """A whole number from hexadecimal digits."""
    return F.conv(F.substring(digest, start, size), 16, 10).cast("long")


def lots(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, lot, copies: rows alike in the first three, up to ``PER_LOT`` in a lot, and their seeded key."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    dealt = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PER_LOT))).alias("lot"))
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return dealt.select("doc_id", "source", "size", "lot", F.least(F.lit(PER_LOT), F.col("n") - F.col("lot") * PER_LOT).alias("copies"), key.alias("key"))


def with_targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """Adds source_no (from 0, by name, null last), weight, target and all (the sum of targets); ``sources``: source, source_size."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))) + 1)
    weighed = sources.withColumn("source_no", number).withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    # the first to be full is the one with least room for its weight
    filling = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    sofar, every = filling.rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held, later = F.sum("most").over(sofar), F.sum("weight").over(every) - F.sum("weight").over(sofar)
    wanted = F.sum("source_size").over(every) * total
    full = (held + F.col("most") / F.col("weight") * later) <= wanted
    filled = weighed.withColumn("wanted", wanted).withColumn("full", full)
    rest = F.col("wanted") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(every)
    level = rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("most").cast("double")))
    # what all targets come to, from whole numbers: the same in every run
    every_target = F.least(F.col("wanted"), F.sum("most").over(every))
    return filled.withColumn("target", target).withColumn("all", every_target).drop("wanted", "full", "most")


def with_quotas(sources: DataFrame) -> DataFrame:
    """Adds block (words of one) and quota (blocks of a source) by highest quotients; equal quotients go to the earlier source."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words, count = F.sum("source_size").over(every), F.count(F.lit(1)).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(words / LEAST_BLOCKS)))
    wide = sources.withColumn("block", block.cast("long")).withColumn("half", count / 2 + 1)
    wide = wide.withColumn("blocks", F.floor(F.col("all") / F.col("block") + 0.5))
    # the divisor that rounds all targets to the blocks lies between the sum of targets by blocks more or less half a block a source
    at = lambda n: F.coalesce(F.floor(F.try_divide(F.col("target") * F.greatest(n, F.lit(0.0)), F.col("all")) + 0.5), F.lit(0))
    bounded = wide.withColumn("sure", at(F.col("blocks") - F.col("half"))).withColumn("top", at(F.col("blocks") + F.col("half")))
    bounded = bounded.withColumn("open", F.col("blocks") - F.sum("sure").over(every))
    raised = bounded.filter("top > sure").select("source_no", "open", F.explode(F.sequence(F.col("sure") + 1, F.col("top"))).alias("seat"), "target")
    quotient = F.col("target") / (2 * F.col("seat") - 1)
    placed = raised.withColumn("place", F.row_number().over(Window.orderBy(quotient.desc(), "source_no", "seat"))).filter("place <= open")
    more = placed.groupBy("source_no").agg(F.count(F.lit(1)).alias("more"))
    return bounded.join(more, "source_no", "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop("all", "half", "blocks", "sure", "top", "open", "more")


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken are the words the mix takes of it, repeats counted.

    Null texts have no words; a null source is one of its own, the last. Rows that share an id have the same key; those without
    an id are hashed as an id without digits. Of rows alike in id, source and size any may be the one that is taken. A source without words has target 0. Whole texts are counted, however long; other columns are not looked at.
    An empty table gives no rows, and reruns give the same rows.
    """
    with scratch(docs.sparkSession):
        rows = written(lots(docs), "mix-lots")
        grouped = written(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "mix-sources")
        sources = written(with_quotas(with_targets(grouped, weights, total, repeats)), "mix-quotas").withColumn("shards", F.ceil(F.col("n_rows") / per_shard))
        held = sources.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "shards")
        known = F.broadcast(held) if held.count() <= BROADCAST_SOURCES else held
        numbered = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
        # lots of one id, or of none, are dealt by their size and number too
        shard = F.pmod(_digits(F.col("key"), 1) + F.col("size") + F.col("lot"), F.col("shards"))
        dealt = written(numbered.withColumn("shard", shard).withColumn("all_words", F.col("size") * F.col("copies")), "mix-shards")

        sizes = dealt.groupBy("source_no", "shard").agg(F.sum("all_words").alias("words"))
        along = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        cut = lambda upto: F.coalesce(F.floor(F.try_divide(F.col("quota") * upto, F.col("source_size")) + 0.5), F.lit(0))
        running = sizes.join(sources.select("source_no", "source_size", "quota", "block"), "source_no").withColumn("upto", F.sum("words").over(along))
        blocks = cut(F.col("upto")) - cut(F.col("upto") - F.col("words"))
        start = F.pmod(_digits(F.md5(F.concat_ws(":", F.lit(SEED), "source_no", "shard").cast("binary")), 1), F.greatest(F.ceil(F.col("words") / F.col("block")), F.lit(1))) * F.col("block")
        taken_words = F.least(blocks * F.col("block"), F.col("words") * repeats)
        shards = written(running.select("source_no", "shard", "words", taken_words.alias("part"), start.alias("start")), "mix-quotas-of-shards")

        before = F.coalesce(F.sum("all_words").over(Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size", "lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
        placed = dealt.withColumn("at", before).join(shards, ["source_no", "shard"]).select("*", copy).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
        whole = F.coalesce(F.floor(F.try_divide(F.col("part"), F.col("words"))), F.lit(0))
        end = F.col("start") + F.coalesce(F.try_mod("part", "words"), F.lit(0))
        meet = lambda low, high: F.greatest(F.least(F.col("at") + F.col("size"), high) - F.greatest("at", low), F.lit(0))
        # what passes the circle's end goes on at its start
        taken = whole * F.col("size") + meet(F.col("start"), end) + meet(F.lit(0), end - F.col("words"))
        return lasting(placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")), "mix")


def _oracle() -> str:
    turns = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    number = lambda digest, start: f"CAST(CAST('0x' || substr({digest}, {start}, 12) AS UBIGINT) AS BIGINT)"
    every = "OVER ()"
    return rf"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM r GROUP BY source),
w AS (SELECT *, CASE source_no % {len(WEIGHTS)} {turns} END AS weight, {REPEATS} * source_size AS most, sum(source_size) {every} * {TOTAL} AS wanted FROM s),
-- full are the sources whose room is used up when the level reaches it
level AS (
  SELECT a.source_no, sum(least(b.most, b.weight * (a.most / a.weight))) <= any_value(a.wanted) AS is_full FROM w a JOIN w b ON true GROUP BY a.source_no),
t AS (
  SELECT w.*, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE weight * ((wanted - coalesce(sum(most) FILTER (is_full) {every}, 0)) / sum(weight) FILTER (NOT is_full) {every}) END AS target
  FROM w JOIN level USING (source_no)),
b AS (SELECT *, CAST(greatest(1, least({BLOCK_WORDS}, sum(source_size) {every} // {LEAST_BLOCKS})) AS BIGINT) AS block FROM t),
n AS (SELECT *, CAST(floor(least(wanted, sum(most) {every}) / block + 0.5) AS BIGINT) AS blocks FROM b),
seats AS (SELECT source_no, blocks, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source_no, seat) AS place FROM (SELECT *, unnest(range(1, blocks + 1)) AS seat FROM n)),
q AS (SELECT source_no, count(*) AS quota FROM seats WHERE place <= blocks GROUP BY source_no),
d AS (
  SELECT r.*, b.source_no, b.source_size, b.target, b.block, coalesce(quota, 0) AS quota,
    ({number("key", 1)} + size) % CAST(ceil(n_rows / {PER_SHARD}) AS BIGINT) AS shard
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN q ON b.source_no = q.source_no),
z AS (SELECT source_no, shard, any_value(source_size) AS source_size, any_value(quota) AS quota, any_value(block) AS block, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source_no, shard),
u AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source_no ORDER BY shard) AS BIGINT) AS upto FROM z),
p AS (
  SELECT source_no, shard, words,
    least(block * CAST(floor(quota * upto / source_size + 0.5) - floor(quota * (upto - words) / source_size + 0.5) AS BIGINT), {REPEATS} * words) AS part,
    {number(f"md5('{SEED}:' || source_no || ':' || shard)", 1)} % greatest(CAST(ceil(words / block) AS BIGINT), 1) * block AS start
  FROM u WHERE words > 0),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos FROM d)
SELECT doc_id, size, source_size, target, CAST(coalesce(part // words * size + greatest(least(pos + size, start + part % words) - greatest(pos, start), 0) + greatest(least(pos + size, start + part % words - words) - pos, 0), 0) AS BIGINT) AS taken
FROM o LEFT JOIN p USING (source_no, shard)
"""


ORACLE_SQL = _oracle()
