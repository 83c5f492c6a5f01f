"""Themes: assignment to reviews, counting, clamping, ranking, wording, and checks of declared claims.

The assignment itself is pluggable: any table of (film, bucket, review_id, theme_ids) will do, with
null for a failed classification and an empty array for none. :func:`assign_by_keywords` is the
offline default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels, text
from tierloom.functions.ranks import numbered


def assign_by_keywords(reviews: DataFrame, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds ``theme_ids``: themes with a keyword in the text, in the order of ``keywords``; null for a null text."""

    def found(low: Column) -> Column:
        ids = []
        for theme, words in keywords.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            ids.append(F.when(hit, F.lit(theme)))
        return F.array_compact(F.array(*ids))

    # as an array's one element the text is lower-cased once, not once for each keyword
    once = F.element_at(F.transform(F.array(F.lower("text")), found), 1)
    return reviews.withColumn("theme_ids", F.when(F.col("text").isNotNull(), once))


def counted(assigned: DataFrame) -> DataFrame:
    """film, bucket, theme_id, mentions in one pass: every listed id counts, and the id "" counts the bucket's reviews."""
    listed = F.concat(F.coalesce("theme_ids", F.array().cast("array<string>")), F.array(F.lit("")))
    return assigned.select("film", "bucket", F.explode(listed).alias("theme_id")).groupBy("film", "bucket", "theme_id").agg(F.count(F.lit(1)).alias("mentions"))


def mentions(assigned: DataFrame, known: list[str] | None = None) -> DataFrame:
    """film, bucket, theme_id, mentions: every listed id counts, if it is known."""
    rows = counted(assigned).filter("theme_id <> ''")
    return rows if known is None else rows.filter(F.col("theme_id").isin(known))


def sized(assigned: DataFrame, known: list[str]) -> DataFrame:
    """``mentions`` of known ids with the number of reviews of their bucket, from one grouping of the reviews."""
    n = F.max(F.when(F.col("theme_id") == "", F.col("mentions"))).over(Window.partitionBy("film", "bucket"))
    return counted(assigned).withColumn("n_reviews", n).filter(F.col("theme_id").isin(known))


def coverage(assigned: DataFrame) -> DataFrame:
    """Reviews without a theme, without a classification and with themes, and the mean number of themes."""
    n = F.coalesce(F.size("theme_ids"), F.lit(0))
    classified = F.count_if(F.col("theme_ids").isNotNull())
    counts = assigned.groupBy("film", "bucket").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.size("theme_ids") == 0).alias("n_no_theme"), F.count_if(F.col("theme_ids").isNull()).alias("n_unclassified"),
        F.count_if(F.size("theme_ids") > 0).alias("n_with_theme"), F.sum(F.when(F.col("theme_ids").isNotNull(), n)).alias("n_assigned"), classified.alias("n_classified"),
    )
    return counts.withColumn("mean_themes", F.coalesce(F.bround(F.try_divide(F.col("n_assigned") * 1000, "n_classified"), 0) / 1000, F.lit(0.0))).drop("n_assigned")


def batches(reviews: DataFrame, size: int) -> DataFrame:
    """Adds batch and place: reviews of a film and bucket in source order (by review_id, a whole number), ``size`` to a batch."""
    at = F.col("__at")
    rows = numbered(reviews, ["film", "bucket"], "review_id", "__at")
    return rows.withColumn("batch", F.floor(at / size).cast("int")).withColumn("place", (at % size + 1).cast("int")).drop("__at")


def clamped(raw: DataFrame) -> DataFrame:
    """Proposed themes with mentions made whole and kept within 0 and the number of reviews, and examples without quotes.

    ``raw``: film, bucket, ord, theme, mentions (text), n_reviews, example.
    """
    told = F.coalesce(F.expr("try_cast(mentions AS int)"), F.lit(0))
    inside = F.greatest(F.lit(0), F.least(told, F.col("n_reviews").cast("int")))
    example, had = text.strip_quotes(F.coalesce(F.col("example"), F.lit("")))
    return raw.select("film", "bucket", "ord", "theme", inside.alias("mentions"), "n_reviews", (inside != told).alias("clamped"), F.when(inside != told, told).alias("original"), example.alias("example"), had.alias("quotes_removed"))


def first_then_ranked(themes: DataFrame, most: int = config.MAX_THEMES) -> DataFrame:
    """The first ``most`` proposed themes, then by mentions; ties keep their order."""
    order = Window.partitionBy("film", "bucket").orderBy(F.desc("mentions"), "ord")
    return themes.filter(F.col("ord") <= most).withColumn("rank", F.row_number().over(order))


def ranked_then_first(themes: DataFrame, most: int = config.MAX_THEMES) -> DataFrame:
    """All themes by mentions, then the first ``most``."""
    order = Window.partitionBy("film", "bucket").orderBy(F.desc("mentions"), "ord")
    return themes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def both_rankings(themes: DataFrame, most: int = config.MAX_THEMES) -> DataFrame:
    """The two rankings of one table, a row for each variant ("first", "ranked") that a theme is in."""
    early = (F.col("ord") <= most).cast("int")
    by_size = [F.desc("mentions"), F.col("ord")]
    ranked = themes.withColumn("__ranked", F.row_number().over(Window.partitionBy("film", "bucket").orderBy(*by_size)))
    ranked = ranked.withColumn("__first", F.sum(early).over(Window.partitionBy("film", "bucket").orderBy(*by_size)).cast("int"))
    places = F.array(
        F.when(F.col("ord") <= most, F.struct(F.lit("first").alias("variant"), F.col("__first").alias("rank"))), F.when(F.col("__ranked") <= most, F.struct(F.lit("ranked").alias("variant"), F.col("__ranked").alias("rank")))
    )
    return ranked.withColumn("__place", F.explode(F.array_compact(places))).select(*themes.columns, "__place.variant", "__place.rank")


def with_quantifiers(themes: DataFrame) -> DataFrame:
    """Adds pct of the bucket's reviews, its label and the label's force."""
    pct = labels.percent(F.col("mentions"), F.col("n_reviews"))
    return themes.withColumn("pct", pct).withColumn("quantifier", labels.quantifier_label(F.col("pct"))).withColumn("force", labels.quantifier_force(F.col("pct")))


def check_quantifiers(claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Declared (film, claim, quantifier, theme) pairs with a verdict: ok, unknown_theme or too_strong.

    A theme name that several buckets have counts with its greatest force; a phrase that is not
    known is ignored.
    """
    force = themes.groupBy("film", "theme").agg(F.max("force").alias("force"))
    joined = claims.join(force, ["film", "theme"], "left").withColumn("declared", labels.declared_force(F.col("quantifier")))
    verdict = F.when(F.col("force").isNull(), "unknown_theme").when(F.col("declared") > F.col("force"), "too_strong").otherwise("ok")
    return joined.select("film", "claim", "quantifier", "theme", "declared", "force", verdict.alias("verdict"))


def check_consensus(consensus: DataFrame, themes: DataFrame) -> DataFrame:
    """Declared (film, item, groups, themes) with ``valid``: groups exist, and every theme is one of theirs."""
    present = themes.groupBy("film").agg(F.collect_set("bucket").alias("present"))
    offered = consensus.select("film", "item", F.explode("groups").alias("bucket")).join(themes.select("film", "bucket", "theme").distinct(), ["film", "bucket"])
    offered = offered.groupBy("film", "item").agg(F.collect_set("theme").alias("offered"))
    none = F.array().cast("array<string>")
    joined = consensus.join(present, "film", "left").join(offered, ["film", "item"], "left")
    known = F.size(F.array_except("groups", F.array_intersect(F.coalesce("present", none), F.array(*map(F.lit, config.BUCKETS))))) == 0
    return joined.select("film", "item", (known & (F.size(F.array_except("themes", F.coalesce("offered", none))) == 0)).alias("valid"))


def strong_phrase_without_support(prose: DataFrame, themes: DataFrame, least: int = 80) -> DataFrame:
    """film, strong, max_pct, ok: a text with a strong phrase needs some theme of at least ``least`` percent."""
    best = themes.groupBy("film").agg(F.max("pct").alias("max_pct"))
    strong = text.has_any(F.col("text"), text.STRONG_PHRASES)
    return prose.join(best, "film", "left").select("film", strong.alias("strong"), F.coalesce("max_pct", F.lit(0)).alias("max_pct"), (~strong | (F.coalesce("max_pct", F.lit(0)) >= least)).alias("ok"))


def invalid_ids(assigned: DataFrame, known: DataFrame) -> DataFrame:
    """film, bucket, n_listed, n_invalid: listed ids that ``known`` (theme_id) lacks."""
    rows = assigned.select("film", "bucket", F.explode("theme_ids").alias("theme_id"))
    checked = rows.join(known.select("theme_id", F.lit(True).alias("real")), "theme_id", "left")
    return checked.groupBy("film", "bucket").agg(F.count(F.lit(1)).alias("n_listed"), F.count_if(F.col("real").isNull()).alias("n_invalid"))


def valid_answers(answers: DataFrame, known: list[str]) -> DataFrame:
    """film, bucket, batch, place, theme_ids, n_invalid of a batch's answer (place to ids), for every place of the batch.

    ``answers``: film, bucket, batch, n_rows, answer (JSON text, null where classification failed). Keys that are no place of the
    batch are ignored, ids that are not known are counted and left out; a place without a key has no theme, and one of
    a failed batch has null.
    """
    places = answers.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("place")).withColumn("__told", F.from_json("answer", "map<string,array<string>>"))
    listed = F.coalesce(F.try_element_at("__told", F.col("place").cast("string")), F.array().cast("array<string>"))
    good = F.filter(listed, lambda x: x.isin(known))
    # a repeated id counts each time
    return places.select("film", "bucket", "batch", "place", F.when(F.col("answer").isNotNull(), good).alias("theme_ids"), (F.size(listed) - F.size(good)).alias("n_invalid"))


def mention_ratios(themes: DataFrame) -> DataFrame:
    """film, bucket, ratio (mentions for each review), largest (share of the most frequent theme in reviews)."""
    return themes.groupBy("film", "bucket").agg(F.try_divide(F.sum("mentions"), F.max("n_reviews")).alias("ratio"), F.max(F.try_divide("mentions", "n_reviews")).alias("largest"))


def first_of_name(names: DataFrame, themes: DataFrame) -> DataFrame:
    """(film, theme) to pct and quantifier of the film's first theme of that name, by bucket order and then rank; null without one."""
    order = Window.partitionBy("film", "theme").orderBy(F.array_position(F.array(*map(F.lit, config.BUCKETS)), F.col("bucket")), "ord")
    first = themes.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("film", "theme", "bucket", "pct", "quantifier")
    return names.join(first, ["film", "theme"], "left")


def named_proposals(proposed: DataFrame) -> DataFrame:
    """Proposed (film, bucket, ord, id, theme) with a name; a missing id is "t" and the place."""
    kept = proposed.filter(F.trim(F.coalesce("theme", F.lit(""))) != "")
    return kept.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("t"), F.col("ord").cast("string"))))


def declared_by_group(spans: DataFrame) -> DataFrame:
    """(film, group, ord, snippet) to one row per film and group, snippets in order of declaration."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "snippet")))
    return spans.groupBy("film", "group").agg(F.transform(listed, lambda x: x["snippet"]).alias("snippets"))
