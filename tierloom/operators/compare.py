"""Comparisons between runs: by position, against a gold list, the later of two, and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.functions import text


def positional_parity(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arrays ``value`` of two runs compared place by place: n_left, n_right, n_same, n_differ (places that one lacks differ)."""
    a = left.select(*keys, F.posexplode(value).alias("place", "a"))
    b = right.select(*keys, F.posexplode(value).alias("place", "b"))
    both = a.join(b, [*keys, "place"], "full_outer")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return both.groupBy(*keys).agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_differ"))


#: Hashes of so many runs (with their texts, up to about 100 MB) are broadcast; more are joined by a shuffle.
BROADCAST_RUNS = 500_000
#: Bits for each run of a bitmap that clears most hashes before that shuffle, in pieces of 4 KB, and how many pieces are broadcast at most.
BITS_PER_RUN, PIECE_BITS, MOST_PIECES = 8, 32768, 16384


def _possible(hashed: DataFrame, own: DataFrame, n_runs: int) -> DataFrame:
    """The rows whose hash ``h`` may be among those of ``own``: looked up in a bitmap, which is broadcast."""
    pieces = max(1, min(MOST_PIECES, -(-n_runs * BITS_PER_RUN // PIECE_BITS)))
    piece = lambda h: F.pmod(h, F.lit(pieces))
    bit = lambda h: F.pmod(F.xxhash64(h), F.lit(PIECE_BITS))
    bits = own.select(piece(F.col("h")).alias("__piece"), bit(F.col("h")).alias("bit")).groupBy("__piece").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    held = hashed.withColumn("__piece", piece(F.col("h"))).join(F.broadcast(bits), "__piece").withColumn("__bit", bit(F.col("h")))
    octet = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), F.pmod("__bit", F.lit(8)).cast("int") + 1)
    return held.filter(octet.bitwiseAND(mask) != 0).drop("__piece", "__bits", "__bit")


def shared_runs(docs: DataFrame, key: str, items: DataFrame, item_key: str, samples: int = 5) -> DataFrame:
    """key, item_key, n_shared, samples: runs of eight masked words that a document and an item share.

    Documents only send 64-bit hashes of their runs; where one meets an item's, the document's words are looked up
    again and the run itself is confirmed. ``samples`` has the first few in order. Null texts share nothing.
    """
    words = text.masked_words(F.col("text"))
    own = items.select(F.col(item_key).alias("__item"), words.alias("w")).select("__item", F.explode(text.word_runs(F.col("w"))).alias("run"))
    own = own.withColumn("hw", text.word_hashes(F.split("run", " "))).select("__item", "run", text.run_hash(F.col("hw"), 0).alias("h"))
    worded = docs.select(F.col(key).alias("__key"), words.alias("w")).select("__key", text.word_hashes(F.col("w")).alias("hw"))
    hashed = worded.select("__key", F.explode(text.word_run_hashes(F.col("hw"))).alias("h"))
    n_runs = own.count()
    met = hashed.join(F.broadcast(own), "h") if n_runs <= BROADCAST_RUNS else _possible(hashed, own, n_runs).join(own, "h")
    runs = met.groupBy("__key", "__item").agg(F.collect_set("run").alias("runs"))
    there = runs.join(docs.select(F.col(key).alias("__key"), "text"), "__key")
    # as an array's one element the text is put together once, not once for each run
    whole = F.array(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    held = F.element_at(F.transform(whole, lambda t: F.filter("runs", lambda r: F.contains(t, F.concat(F.lit(" "), r, F.lit(" "))))), 1)
    found = there.withColumn("held", held).filter(F.size("held") > 0)
    return found.select(F.col("__key").alias(key), F.col("__item").alias(item_key), F.size("held").cast("long").alias("n_shared"), F.slice(F.array_sort("held"), 1, samples).alias("samples"))


def recall_of(gold: DataFrame, predicted: DataFrame, group: list[str], item: str) -> DataFrame:
    """How many gold items a prediction has: n_gold, n_found, recall."""
    hits = gold.select(*group, item).distinct().join(predicted.select(*group, item, F.lit(1).alias("hit")).distinct(), [*group, item], "left")
    counted = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_found"))
    return counted.withColumn("recall", F.try_divide("n_found", "n_gold"))


def later_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of two runs; the second run's where both have one."""
    rows = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    order = Window.partitionBy(*keys).orderBy(F.desc("run"))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def yield_rate(rows: DataFrame, keys: list[str], valid: Column, wanted: int = 20, least: float = 0.05) -> DataFrame:
    """n_rows, n_valid, rate, and the raw rows that ``wanted`` valid ones would take."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid")).withColumn("rate", F.col("n_valid") / F.col("n_rows"))
    return counted.withColumn("rows_needed", F.ceil(wanted / F.greatest(F.col("rate"), F.lit(least))).cast("long"))


def in_catalogue_order(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Documents of the films that the catalogue lists, with its place; films without one are left out."""
    return catalogue.select("film", "place").join(documents, "film")


def bundle(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per film of the catalogue: place, film, and the document as JSON without nulls."""
    rows = in_catalogue_order(documents, catalogue)
    held = [c for c in documents.columns if c != "film"]
    return rows.select("place", "film", F.to_json(F.struct("film", *held)).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder of JSON for each film."""
    documents.write.mode("overwrite").partitionBy("film").json(path)


def bar_width(part: Column, whole: Column) -> Column:
    """Percent of a bar, one decimal, kept within 0 and 100."""
    return F.coalesce(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(part * 100.0, whole))), 1), F.lit(0.0))


def star_band(low: Column, high: Column) -> Column:
    """Two levels as "0,5–2,5"."""
    comma = lambda x: F.replace(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("."), F.lit(","))
    return F.concat(comma(low), F.lit("–"), comma(high))


def grouped_digits(n: Column) -> Column:
    """12345678 as "12.345.678"."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1.")


def token_estimate(prose: Column) -> Column:
    return F.bround(F.length(prose) / 3.5, 0).cast("long")


def split_in_proportion(total: Column, part: Column, rest: Column) -> Column:
    """The share of ``total`` that falls to ``part`` by its size."""
    return F.coalesce(F.bround(F.try_divide(total * part, part + rest), 0), F.lit(0)).cast("long")


def version_at_least(name: Column, major: int, minor: int) -> Column:
    """Whether the first "N.N" in a name is that version or later; false without one."""
    a, b = (F.nullif(F.regexp_extract(name, r"(\d+)\.(\d+)", k), F.lit("")).cast("int") for k in (1, 2))
    return F.coalesce((a > major) | ((a == major) & (b >= minor)), F.lit(False))


def batch_messages(rows: DataFrame) -> DataFrame:
    """A numbered message for each batch (of bounded size): rows of film, bucket, batch, place, text."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return rows.groupBy("film", "bucket", "batch").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("message"), F.count(F.lit(1)).alias("n_rows"))
