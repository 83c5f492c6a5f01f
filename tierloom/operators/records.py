"""Film records, nested documents, reports and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import text


def page_addresses(slug: Column, level: Column, page: Column, path: Column, viewing: Column, title: Column) -> dict[str, Column]:
    """Addresses of a film's pages and the names under which they are cached, by what they are of."""
    site, named = F.lit(config.SITE), level_path(level)
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    # the same in the address of a search and the name of its page, but for the slash, which an address keeps
    asked = text.url_quoted(title)
    return {
        "level_url": join(site, "/film/", slug, "/reviews/rated/", named, "/by/activity/page/", page.cast("string"), "/"),
        "level_key": join(slug, "/pages/rated_", F.replace(named, F.lit("."), F.lit("_")), "_page_", page.cast("string"), ".html"),
        "full_text_url": join(site, path), "full_text_key": join(slug, "/fulltext/", F.replace(viewing, F.lit(":"), F.lit("_")), ".html"),
        "histogram_url": join(site, "/csi/film/", slug, "/rating-histogram/"), "histogram_key": join("_histograma/", slug, ".html"),
        "film_url": join(site, "/film/", slug, "/"), "film_key": join(slug, "/film_page.html"), "reviews_url": reviews_url(slug),
        "search_url": join(site, "/s/search/films/", F.replace(asked, F.lit("%2F"), F.lit("/")), "/"), "search_key": join("_search/", F.replace(asked, F.lit("%"), F.lit("_")), ".html"),
    }


def with_origin(requests: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requests with ``origin``: cache where an earlier run holds the key, network where it does not.

    Of several requests for one key that is not held, in order of ``at``, the first goes to the network.
    """
    held = requests.join(cached.select(key, F.lit(True).alias("__held")).distinct(), key, "left")
    firsts = requests.groupBy(key).agg(F.min("at").alias("__first")).withColumnRenamed(key, "__key")
    # requests meet the first time by key and time, so that a key that is asked for very often does not land in one place
    met = held.join(firsts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("at") == F.col("__first")), "left")
    first = F.col("__first").isNotNull() & (F.row_number().over(Window.partitionBy(key, "at").orderBy("at")) == 1)
    return met.withColumn("origin", F.when(F.col("__held").isNull() & first, "network").otherwise("cache")).drop("__held", "__first", "__key")


def origin_counts(requests: DataFrame, keys: list[str]) -> DataFrame:
    """n_network and n_cache of requests with ``origin``."""
    return requests.groupBy(*keys).agg(F.count_if(F.col("origin") == "network").alias("n_network"), F.count_if(F.col("origin") == "cache").alias("n_cache"))


def with_negatives(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """What is cached of a lookup: found records, and for keys without one a row that says not_found, so that they are not asked again."""
    return asked.select(key).distinct().join(found.withColumn("__found", F.lit(True)), key, "left").withColumn("not_found", F.col("__found").isNull()).drop("__found")


def shown_title(title: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), slug)


def paragraphs(prose: Column) -> Column:
    """Parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(prose, r"\n{2,}"), text.stripped), lambda p: p != "")


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's candidates the most popular one of the wanted year, the first on ties; else the first of all.

    ``candidates``: keys, year, rank, id, release_date, popularity.
    """
    same = (F.substring("release_date", 1, 4) == F.col("year").cast("string")) & F.col("year").isNotNull()
    chosen = candidates.withColumn("same_year", F.coalesce(same, F.lit(False)))
    popular = F.when(F.col("same_year"), F.coalesce("popularity", F.lit(0.0)))
    # the least of (another year, less popular, later): one struct a key, no key's rows in one place
    first = F.min_by(F.struct(*chosen.columns), F.struct(~F.col("same_year"), -popular, F.col("rank")))
    return chosen.groupBy(*keys).agg(first.alias("__first")).select("__first.*")


def year_guard(records: DataFrame) -> DataFrame:
    """Adds ``accepted``: the year found is within one of the year expected, or either is unknown."""
    return records.withColumn("accepted", F.coalesce(F.abs(F.col("year_found") - F.col("year_expected")) <= 1, F.lit(True)))


def slug_title(slug: Column) -> Column:
    return F.replace(F.when(slug_year(slug).isNotNull(), F.regexp_extract(slug, r"^(.*)-(\d{4})$", 1)).otherwise(slug), F.lit("-"), F.lit(" "))


def slug_year(slug: Column) -> Column:
    return F.nullif(F.regexp_extract(slug, r"^(.*)-(\d{4})$", 2), F.lit("")).cast("int")


def record_key(title: Column, year: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(key, F.lit("_"), year.cast("string"))).otherwise(key)


def level_path(level: Column) -> Column:
    """3.0 as "3", 3.5 as "3.5"."""
    return F.when(level == F.floor(level), level.cast("int").cast("string")).otherwise(level.cast("string"))


def is_latin(name: Column) -> Column:
    """All letters are Latin; a name without letters is not."""
    return (F.regexp_count(name, F.lit(r"\p{L}")) > 0) & (F.regexp_count(name, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")) == 0)


def director(crew: Column) -> Column:
    """The first crew member with that job."""
    return F.try_element_at(F.filter(crew, lambda c: c["job"] == "Director"), F.lit(1))["name"]


def call_metrics(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key's calls: the number, whether one was repeated, whether one backed off, the sum of seconds and the last outcome.

    ``calls``: keys, order columns, kind (call or backoff), seconds, outcome.
    """
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"), (F.count_if(F.col("kind") == "call") > 1).alias("retried"), F.bool_or(F.col("kind") == "backoff").alias("backed_off"),
        F.sum("seconds").alias("seconds"), F.max_by("outcome", F.struct(*order)).alias("last_outcome"),
    )


def bucket_metrics(calls: DataFrame, themes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """:func:`call_metrics` and, from themes with ``clamped``, their number, the number of clamped ones and the sum of mentions."""
    counted = themes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_themes"), F.count_if("clamped").alias("n_clamped"), F.sum("mentions").alias("n_mentions"))
    return call_metrics(calls, keys, order).join(counted, keys, "left").fillna(0, ["n_themes", "n_clamped", "n_mentions"])


def film_documents(buckets: DataFrame, themes: DataFrame, shares: DataFrame) -> DataFrame:
    """One nested row per film: buckets in fixed order, each with its themes by rank and its share if there is one."""
    nested = themes.groupBy("film", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "theme", "mentions", "n_reviews"))).alias("themes"))
    order = F.array_position(F.array(*map(F.lit, config.BUCKETS)), F.col("bucket"))
    rows = buckets.join(nested, ["film", "bucket"], "left").join(shares.select("film", "bucket", "share_real"), ["film", "bucket"], "left")
    one = F.struct(order.alias("ord"), F.col("bucket"), F.col("mode"), F.col("n_valid"), F.col("share_real"), F.coalesce("themes", F.array().cast("array<struct<rank:int,theme:string,mentions:int,n_reviews:bigint>>")).alias("themes"))
    return rows.groupBy("film").agg(F.array_sort(F.collect_list(one)).alias("buckets"), F.sum("n_raw").alias("total_reviews"))


def apply_distribution(documents: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Documents with every bucket's share replaced; without ``shares`` all shares go."""
    if shares is None:
        return documents.withColumn("buckets", F.transform("buckets", lambda b: b.withField("share_real", F.lit(None).cast("int"))))
    held = shares.groupBy("film").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "share_real"))).alias("held"))
    joined = documents.join(held, "film", "left")
    return joined.withColumn("buckets", F.transform("buckets", lambda b: b.withField("share_real", F.try_element_at("held", b["bucket"])))).drop("held")


TONES = ("estruturado", "narrativo", "ambos")


def reviews_url(slug: Column) -> Column:
    """The public page of a film's reviews."""
    return F.concat(F.lit(f"{config.SITE}/film/"), slug, F.lit("/reviews/"))


def disclaimer(has_shares: Column) -> Column:
    """What sizes of groups mean, by whether there is a distribution."""
    return F.when(F.coalesce(has_shares, F.lit(False)), config.DISCLAIMER_SHARES).otherwise(config.DISCLAIMER_QUOTAS)


def report_lines(buckets: DataFrame, themes: DataFrame, shares: DataFrame, prose: DataFrame | None = None, tone: str = "estruturado") -> DataFrame:
    """film, ord, line of a report in one of three tones.

    Every tone has the disclaimer, a heading for each bucket, its warnings and the total of rows. "estruturado" and "ambos" have a line
    and an example (where ``themes`` has one) for each theme; "narrativo" and "ambos" end with the film's prose (``prose``: film, text). Where a
    bucket's mode is sem_analise, the number of reviews and their page stand for its themes.
    """
    if tone not in TONES:
        raise ValueError(f"tone is one of {TONES}")
    order = F.array_position(F.array(*map(F.lit, config.BUCKETS)), F.col("bucket")) * 100
    example = [F.col("example") if "example" in themes.columns else F.lit(None).cast("string").alias("example")]
    nested = themes.select("film", "bucket", F.struct("rank", "theme", "mentions", "n_reviews", *example).alias("t")).groupBy("film", "bucket").agg(F.array_sort(F.collect_list("t")).alias("themes"))
    rows = buckets.join(shares.select("film", "bucket", "share_real"), ["film", "bucket"], "left").join(nested, ["film", "bucket"], "left")
    share = F.coalesce(F.concat(F.lit(" · ~"), F.col("share_real").cast("string"), F.lit("% das notas")), F.lit(""))
    title = F.concat(F.upper("bucket"), F.lit(" "), F.col("n_valid").cast("string"), F.lit("/"), F.col("target").cast("string"), F.lit(" modo="), F.col("mode"), share)
    line = lambda ord, text: F.struct(ord.cast("long").alias("ord"), text.alias("line"))
    none = F.array().cast("array<struct<ord:bigint,line:string>>")
    only_count = F.concat(F.col("n_valid").cast("string"), F.lit(" disponíveis em "), reviews_url(F.col("film").cast("string")))
    warnings = F.when(F.col("mode") == "reduzido", F.array(line(order + 1, F.lit("aviso: modo reduzido")))).when(F.col("mode") == "sem_analise", F.array(line(order + 1, F.lit("aviso: sem analise")), line(order + 2, only_count))).otherwise(none)
    told = lambda t: F.array(
        line(order + 1 + 2 * t["rank"], F.concat(t["theme"], F.lit(": ~"), t["mentions"].cast("string"), F.lit(" de "), t["n_reviews"].cast("string"))),
        line(order + 2 + 2 * t["rank"], F.concat(F.lit("ex.: "), t["example"])),
    )
    shown = F.when(F.col("mode") == "sem_analise", none).otherwise(F.filter(F.flatten(F.coalesce(F.transform("themes", told), F.array(none))), lambda x: x["line"].isNotNull()))
    body = F.concat(F.array(line(order, title)), warnings, *([shown] if tone != "narrativo" else []))
    sums = rows.groupBy("film").agg(F.flatten(F.collect_list(body)).alias("body"), F.sum("n_raw").alias("n_raw"), F.bool_or(F.col("share_real").isNotNull()).alias("known"))
    ends = F.array(line(F.lit(0), disclaimer(F.col("known"))), line(F.lit(1000), F.concat(F.lit("total de reviews: "), F.col("n_raw").cast("string"))))
    if tone != "estruturado":
        sums = sums.join(prose.select("film", "text"), "film", "left")
        ends = F.concat(ends, F.array(line(F.lit(999), F.coalesce(F.nullif("text", F.lit("")), F.lit("(narrativa não gerada)")))))
    return sums.select("film", F.explode(F.concat("body", ends)).alias("l")).select("film", "l.ord", "l.line")


def narrator_message(buckets: DataFrame, themes: DataFrame, shares: DataFrame, films: DataFrame) -> DataFrame:
    """film, message: all that a narrator is told, from named fields only; texts of reviews are not among them.

    ``buckets``: film, bucket, mode, n_raw, n_valid, observation; ``themes``: film, bucket, rank, theme, mentions, n_reviews, pct, quantifier,
    example; ``shares``: film, bucket, share_real, weight_phrase, marking; ``films``: film, title, year, director, genres, synopsis (a film
    may lack a row). Labels come computed, none is left to the reader.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = F.array_position(F.array(*map(F.lit, config.BUCKETS)), F.col("bucket"))
    told = F.concat(F.lit("- "), cell("theme"), F.lit(": ~"), cell("mentions"), F.lit(" de "), cell("n_reviews"), F.lit(" ("), cell("pct"), F.lit("%, "), cell("quantifier"), F.lit("). ex.: "), cell("example"))
    nested = themes.groupBy("film", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", told.alias("line")))).alias("t"))
    rows = buckets.join(shares.select("film", "bucket", "share_real", "weight_phrase", "marking"), ["film", "bucket"], "left").join(nested, ["film", "bucket"], "left")
    weight = F.when(F.col("share_real").isNotNull(), F.concat(F.lit(" · peso: "), cell("weight_phrase"), F.lit(" · marcação: "), cell("marking"))).otherwise("")
    head = F.concat(F.upper("bucket"), F.lit(": "), cell("n_valid"), F.lit(" reviews · modo="), cell("mode"), weight)
    seen = F.when(cell("observation") != "", F.concat(F.lit("observação: "), cell("observation")))
    lines = F.array_compact(F.concat(F.array(head, seen), F.coalesce(F.transform("t", lambda x: x["line"]), F.array(F.lit("(sem temas)")))))
    bodies = rows.groupBy("film").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("l")))).alias("b"), F.sum("n_raw").alias("n"))
    details = F.concat_ws("; ", F.concat(F.lit("título: "), cell("title")), F.concat(F.lit("ano: "), cell("year")), F.concat(F.lit("diretor: "), cell("director")), F.concat(F.lit("gêneros: "), F.concat_ws(", ", "genres")), F.concat(F.lit("sinopse: "), cell("synopsis")))
    known = films.select("film", details.alias("details"))
    opening = F.array_compact(F.array(F.concat(F.lit("total de reviews: "), F.col("n").cast("string")), F.col("details")))
    return bodies.join(known, "film", "left").select("film", F.array_join(F.concat(opening, F.flatten(F.transform("b", lambda x: x["l"]))), "\n").alias("message"))


def repeated_neighbours(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """How often a row has the same value as the one before it."""
    same = F.col(value) == F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__same", same).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("__same").alias("n_repeated"))


def fluency(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rhythm of a text: sentences, mean and shortest length in words, variation, repeated openings, report verbs, intensifiers."""
    worded = docs.select(key, "text", F.transform(text.sentences(F.coalesce("text", F.lit(""))), text.letters).alias("s"))
    cut = worded.withColumn("lengths", F.transform("s", F.size)).withColumn("opening", F.transform("s", lambda x: F.lower(F.coalesce(F.get(x, F.lit(0)), F.lit("")))))
    n, total = F.size("s"), F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    sized = cut.select(key, "text", "s", "lengths", "opening", n.alias("n_sentences"), F.try_divide(total.cast("double"), n).alias("mean"))
    spread = F.sqrt(F.try_divide(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))), F.col("n_sentences")))
    pairs = F.zip_with(F.slice("opening", F.lit(1), F.greatest(F.col("n_sentences") - 1, F.lit(0))), F.slice("opening", F.lit(2), F.greatest(F.col("n_sentences") - 1, F.lit(0))), lambda a, b: (a == b) & (a != ""))
    # a run of letters never crosses the end of a sentence
    intensifiers = F.aggregate("s", F.lit(0), lambda a, x: a + text.count_among(F.transform(x, F.lower), text.INTENSIFIERS))
    return sized.select(
        key, "n_sentences", F.coalesce(F.bround("mean", 1), F.lit(0.0)).alias("mean_words"), F.coalesce(F.bround(F.try_divide(spread, F.when(F.col("mean") > 0, F.col("mean"))), 2), F.lit(0.0)).alias("length_cv"),
        F.coalesce(F.array_min("lengths"), F.lit(0)).alias("shortest"), F.size(F.filter(pairs, lambda x: x)).alias("repeated_openings"),
        text.report_verbs(F.coalesce("text", F.lit(""))).alias("report_verbs"), intensifiers.alias("intensifiers"),
    )


def next_place(rows: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Adds the next greater place of the same keys: repeated places share theirs; null for the last."""
    order = Window.partitionBy(*keys).orderBy(place)
    following = rows.select(*keys, place).distinct().withColumn(name, F.lead(place).over(order))
    return rows.join(following, [*keys, place])


def film_records(details: DataFrame) -> DataFrame:
    """film, title, genres, director, transliterated, synopsis, fallback, year from local and English details.

    ``details``: film, title, original_title, overview, overview_en, genres (array of names in structs),
    crew and crew_en (arrays of job and name), release_date. An empty synopsis and a director's name that
    is not in Latin script fall back to the English ones, and say so.
    """
    own, english = director(F.col("crew")), director(F.col("crew_en"))
    swapped = F.coalesce(~is_latin(own) & is_latin(english), F.lit(False))
    empty = F.coalesce(F.col("overview"), F.lit("")) == ""
    year = F.nullif(F.regexp_extract(F.coalesce("release_date", F.lit("")), r"^(\d{4})", 1), F.lit("")).cast("int")
    return details.select(
        "film", F.coalesce(F.nullif("title", F.lit("")), "original_title", F.lit("")).alias("title"), F.transform("genres", lambda g: g["name"]).alias("genres"),
        F.when(swapped, english).otherwise(own).alias("director"), swapped.alias("transliterated"), F.when(empty, F.coalesce("overview_en", F.lit(""))).otherwise(F.col("overview")).alias("synopsis"),
        empty.alias("fallback"), year.alias("year"),
    )


#: Where a film's page tells its year, the surer place first (fixed values).
YEAR_PLACES = (r"/films/year/(\d{4})/", r'og:title"\s+content="[^"]*\((\d{4})\)')


def page_year(page: Column) -> Column:
    """The year that a film's page tells; null without one."""
    return text.first_match(page, list(YEAR_PLACES)).cast("int")
