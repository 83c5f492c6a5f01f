"""URL verdicts: a short rule list, then a Bloom filter cascade.

The cascade answers membership exactly for every key of its universe (all hosts of the corpus).
Level 0 encodes the listed keys; level 1 encodes those unlisted keys that level 0 lets pass
wrongly; level 2 the listed keys that level 1 lets pass wrongly; and so on until a level has no
false positive. The first level that does not hold a key decides. Keys are dealt into shards of
about ``PER_SHARD``; each shard has a cascade of its own. While all shards together stay within
``BROADCAST_BYTES`` (summed before anything is collected) they are broadcast and rows are judged
where they lie, without a join or shuffle; beyond it distinct hosts meet their shard instead and
the answers are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import hash_blocks, joined_where_hot, lasting, scratch, written

PER_SHARD = 50_000
BROADCAST_BYTES = 64 << 20
MAX_LEVELS = 64
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

CASCADE_SCHEMA = "shard int, sizes array<int>, probes array<int>, bits binary"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The list is short and fixed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = rule_fits(host, path, rule_host, rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int, probes: int) -> np.ndarray:
    """(keys, probes) bit numbers."""
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64((level * 0xD6E8FEB86659FD93 + 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xE7037ED1A0B428DB)
        a ^= a >> np.uint64(32)
        b = (h2 + np.uint64(level)) * np.uint64(0x8EBC6AF09C88C6E3) | np.uint64(1)
        return (((a[:, None] + np.arange(probes, dtype=np.uint64) * b[:, None]) >> np.uint64(11)) % np.uint64(size)).astype(np.int64)


def _holds(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, probes: int) -> np.ndarray:
    return bits[_positions(h1, h2, level, len(bits), probes)].all(axis=1)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The levels (number of probes, bits) for a universe of distinct keys."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys share both hashes")
        # the first level lets about |listed| / |unlisted| pass, the others a half
        rate = 0.5 if levels else min(0.5, max(1e-6, len(inside) / max(1, len(outside)) / 2))
        probes = max(1, round(-np.log2(rate)))
        bits = np.zeros(max(8, int(np.ceil(len(inside) * probes / np.log(2)))), bool)
        bits[_positions(h1[inside], h2[inside], len(levels), len(bits), probes)] = True
        wrong = outside[_holds(bits, h1[outside], h2[outside], len(levels), probes)]
        levels.append((probes, bits))
        inside, outside = wrong, inside
    return levels


def is_listed(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for every key of the universe that the cascade was built for."""
    answer, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for level, (probes, bits) in enumerate(levels):
        holds = _holds(bits, h1[left], h2[left], level, probes)
        left = left[holds]
        answer[left] = level % 2 == 0
    return answer


def _key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _build_shard(table: pa.Table) -> pa.Table:
    h1, h2 = (table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    levels = build_cascade(h1, h2, table["listed"].to_numpy().astype(bool))
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "sizes": pa.array([[len(b) for _, b in levels]], pa.list_(pa.int32())),
            "probes": pa.array([[p for p, _ in levels]], pa.list_(pa.int32())),
            "bits": pa.array([b"".join(np.packbits(b).tobytes() for _, b in levels)], pa.binary()),
        }
    )


def _levels(sizes: list[int], probes: list[int], bits: bytes) -> list[tuple[int, np.ndarray]]:
    out, at = [], 0
    for size, k in zip(sizes, probes, strict=True):
        n = (size + 7) // 8
        out.append((k, np.unpackbits(np.frombuffer(bits, np.uint8, n, at), count=size).astype(bool)))
        at += n
    return out


def _judge(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, cascades: dict[int, list]) -> np.ndarray:
    found = np.zeros(len(h1), bool)
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        found[at] = is_listed(cascades.get(int(s), []), h1[at], h2[at])
    return found


def with_membership(df: DataFrame, key: str, listed: DataFrame, name: str, per_shard: int = PER_SHARD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a boolean column ``name``: whether the row's key is listed, by the cascade.

    ``listed`` is a table of keys, in a column of the same name; repeated and null ones, and those that ``df`` lacks, do no harm.
    Rows are not joined with it: the corpus's distinct keys and the list are put together and grouped, and the cascade is built
    from that. A null key counts as the empty one. Extra columns of ``df`` pass through.
    """
    with scratch(df.sparkSession):
        return _with_membership(df, key, listed, name, per_shard, broadcast_bytes)


def _with_membership(df: DataFrame, key: str, listed: DataFrame, name: str, per_shard: int, broadcast_bytes: int) -> DataFrame:
    spark = df.sparkSession
    keyed = df.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    both = keyed.select(key, F.lit(True).alias("here"), F.lit(False).alias("listed")).unionByName(listed.filter(F.col(key).isNotNull()).select(key, F.lit(False).alias("here"), F.lit(True).alias("listed")))
    found = both.groupBy(key).agg(F.count_if("here").alias("n"), F.bool_or("listed").alias("listed")).filter("n > 0")
    universe = written(found.select(key, *_key_hashes(F.col(key)), "listed", "n"), "url-universe")
    n_keys, n_rows = universe.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = hash_blocks(n_keys, per_shard)
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
    cascades = written(universe.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard, CASCADE_SCHEMA), "url-cascade")
    if (cascades.agg(F.sum(F.length("bits"))).first()[0] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([(r.shard, list(r.sizes), list(r.probes), bytes(r.bits)) for r in cascades.collect()])

        @F.pandas_udf("boolean")
        def listed_here(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            held = {s: _levels(sizes, probes, bits) for s, sizes, probes, bits in sent.value}
            for h1, h2 in batches:
                a, b = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)
                yield pd.Series(_judge(a, b, (h1.to_numpy() % shards).astype(np.int32), held))

        return keyed.withColumn(name, listed_here(*_key_hashes(F.col(key))))

    def probe_shard(keys: pa.Table, cascade: pa.Table) -> pa.Table:
        h1, h2 = (keys[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        levels = _levels(*(cascade[c][0].as_py() for c in ("sizes", "probes", "bits"))) if cascade.num_rows else []
        return pa.table({key: keys[key], "__n": keys["n"], name: pa.array(is_listed(levels, h1, h2), pa.bool_())})

    asked = universe.withColumn("shard", shard).groupBy("shard")
    answers = lasting(asked.cogroup(cascades.groupBy("shard")).applyInArrow(probe_shard, f"`{key}` string, `__n` long, `{name}` boolean"), "url-answers")
    return joined_where_hot(keyed, answers, key, "__n", n_rows).drop("__n")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, per_shard: int = PER_SHARD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page; ``listed`` is a table of hosts (column host).

    Null urls and urls without ``://`` have empty host and path; no rule fits those, and they are allowed unless the
    list has the empty host. Repeated rows are judged alike; urls are read whole, however long; other columns are not
    looked at. An empty table gives no rows, an empty list blocks nothing by itself.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = with_membership(parts, "host", listed, "listed", per_shard, broadcast_bytes)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def stand_in_list(pages: DataFrame) -> DataFrame:
    """A table of listed hosts for data that come with none: hosts whose MD5 starts with 0, a sixteenth of them."""
    host = url_host(F.col("url"))
    return pages.select(host.alias("host")).filter((F.col("host") != "") & F.md5(F.col("host").cast("binary")).startswith("0")).distinct()


ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, said) AS (VALUES {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL),
judged AS (
  SELECT *, host <> '' AND starts_with(md5(host), '0') AS listed FROM best)
SELECT parts.page_id, parts.host, parts.path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM parts JOIN judged USING (page_id, host, path)
"""
