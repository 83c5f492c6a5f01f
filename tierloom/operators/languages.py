"""Language labels from word lists kept as a table: language and word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.functions import text
from tierloom.operators.rounds import settled

UNKNOWN, MIXED = "indeterminado", "misto/ambíguo"
#: A table of up to so many words is broadcast to the texts' words; a larger one is joined by the word.
BROADCAST_WORDS = 1_000_000
#: Every language adds a column while texts are counted.
MOST_LANGUAGES = 200


def word_lists(docs: DataFrame, language: str, prose: str, words: int = 40) -> DataFrame:
    """language, word: a language's most widespread words, without those that another language has among its own.

    Widespread is what many texts have; equally widespread words are taken in order. Texts without a language are left out.
    """
    seen = docs.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(F.array_distinct(text.bare_words(F.col(prose)))).alias("word")).filter("word <> ''")
    counts = seen.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= words)
    return top.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("word"))).filter("shared = 1").select("language", "word")


def language_counts(texts: DataFrame, key: str, prose: str, lists: DataFrame) -> tuple[DataFrame, list[str]]:
    """key and a column n_<language> for each language of the lists, and the languages.

    Each word of a text is looked up once in the table of all lists; a word may be in several. Every text has a row, null and empty
    ones count nothing; texts that share a key are counted together. The lists are kept first: they are looked at three times, and
    making them may mean reading all texts.
    """
    listed = settled(lists.select("language", "word").filter("language IS NOT NULL AND word <> ''").distinct())
    languages = sorted(r["language"] for r in listed.select("language").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    by_word = listed.groupBy("word").agg(F.collect_set("language").alias("languages"))
    held = F.broadcast(by_word) if by_word.count() <= BROADCAST_WORDS else by_word
    words = texts.select(F.col(key), F.explode_outer(text.bare_words(F.col(prose))).alias("word"))
    told = words.join(held, "word", "left")
    return told.groupBy(key).agg(*(F.count_if(F.array_contains("languages", one)).alias(f"n_{one}") for one in languages)), languages


def language_of(languages: list[str]) -> Column:
    """The language with most words; MIXED where two have equally many, UNKNOWN where none has any."""
    most = F.greatest(F.lit(0), F.lit(0), *(F.col(f"n_{one}") for one in languages))
    best = F.filter(F.array(*(F.when(F.col(f"n_{one}") == most, F.lit(one)) for one in languages)).cast("array<string>"), lambda x: x.isNotNull())
    return F.when(most == 0, UNKNOWN).when(F.size(best) == 1, F.get(best, F.lit(0))).otherwise(MIXED)
