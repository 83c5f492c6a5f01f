"""Queries of joins in time, many expressions, word lists, sketches, kept tables, observed counters, sources and sinks, and whole reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels
from tierloom.operators import asof, calls, collect, expressions, languages, observed, records, reports, sketches, themes
from tierloom.plans import catalogue, more, sql
from tierloom.plans.catalogue import ORACLES, query
from tierloom.sources import films, pages, tables
from tierloom.sources.shared import fresh_path, upsert
from tierloom.streaming import early_stop

_ACTOR, _HOUR = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END", "date_trunc('hour', ts)"


@query(f"""WITH e AS (SELECT event_id, event_type, {_ACTOR} AS actor, {_HOUR} AS hour, value FROM events),
v AS (SELECT actor, hour, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM e WHERE event_type = 'view' GROUP BY actor, hour)
SELECT event_id, view_id, view_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.actor = v.actor AND p.hour >= v.hour""")
def last_view_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of its actor, by the hour; a third of the users act as one."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_ACTOR).alias("actor"), F.expr(_HOUR).alias("at"), "value")
    views = events.filter("event_type = 'view'").select("actor", "at", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"), "event_id")
    found = asof.asof_backward(events.filter("event_type = 'purchase'").select("event_id", "actor", "at"), views, ["actor"], "at", ["view_id", "view_value"], "event_id")
    return found.select("event_id", "view_id", "view_value")


@query(f"""WITH b AS (SELECT string_split_regex(lower(text), '\\s+') AS w FROM benchmark WHERE text IS NOT NULL),
e AS (SELECT DISTINCT e FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS e FROM b) WHERE e <> ''),
d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, e, unnest(list_filter(range(length(t)), lambda i: substring(t, i + 1, length(e)) = e)) AS place FROM d JOIN e ON contains(t, e))
SELECT doc_id, e AS expression, count(*) AS n_places, min(place) AS first_at, max(place) AS last_at, sum(place)::BIGINT AS sum_at FROM p GROUP BY ALL""")
def expression_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in the documents of every run of three words that a benchmark item has."""
    words = F.split(F.lower("text"), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))
    wanted = tables.table(spark, sf_dir, "benchmark").filter(F.size(words) > 2).select(F.explode(runs).alias("expression"))
    found = expressions.expression_places(tables.table(spark, sf_dir, "documents"), "doc_id", "text", wanted)
    return found.groupBy("doc_id", "expression").agg(F.count(F.lit(1)).alias("n_places"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("at").alias("sum_at"))


_LISTS = f"""seen AS (SELECT lang, doc_id, unnest({sql.bare_words("text")}) AS word FROM documents),
counts AS (SELECT lang, word, count(DISTINCT doc_id) AS n FROM seen WHERE word <> '' AND lang IS NOT NULL GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counts),
lists AS (SELECT any_value(lang) AS lang, word FROM top WHERE place <= 40 GROUP BY word HAVING count(*) = 1)"""


@query(f"""WITH {_LISTS},
hits AS (SELECT doc_id, lists.lang, count(*) AS n FROM seen JOIN lists USING (word) GROUP BY ALL),
best AS (SELECT doc_id, max(n) AS most, arg_max(lang, n) AS lang, sum(n)::BIGINT AS n_words FROM hits GROUP BY doc_id),
ties AS (SELECT doc_id, count(*) AS n_best FROM hits JOIN best USING (doc_id) WHERE n = most GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN most IS NULL THEN '{languages.UNKNOWN}' WHEN n_best > 1 THEN '{languages.MIXED}' ELSE best.lang END AS label, coalesce(most, 0) AS most, coalesce(n_words, 0) AS n_words
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN ties USING (doc_id)""")
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' languages by lists of words that are widespread in one language alone."""
    docs = tables.table(spark, sf_dir, "documents")
    counts, known = languages.language_counts(docs, "doc_id", "text", languages.word_lists(docs, "lang", "text"))
    n = [F.col(f"n_{one}") for one in known]
    return counts.select("doc_id", languages.language_of(known).alias("label"), F.greatest(F.lit(0), *n).alias("most"), sum(n, F.lit(0)).alias("n_words"))


@query("SELECT l_suppkey AS film, count(*) AS n, true AS distinct_ok, true AS median_ok FROM lineitem GROUP BY 1")
def rolled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by film and level rolled up to films, and whether they keep within their error of the exact figures."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("film"), (F.ceil(F.col("l_quantity") / 5) / 2).alias("level"), "l_orderkey", "l_extendedprice")
    films = sketches.rolled_up(sketches.sketched(rows, ["film", "level"], "l_orderkey", "l_extendedprice"), ["film"])
    told = films.select("film", "n", sketches.n_distinct().alias("about"), sketches.quantile(0.5).alias("median"))
    # one pass for all: figures of the sketches go along as keys, and their few rows are what is hashed
    every, few = sketches.dealt(rows, told, "film")
    exact = every.join(few.hint("shuffle_hash"), "film").groupBy(*told.columns).agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("upto"), F.count_if(F.col("l_extendedprice") < F.col("median")).alias("below"),
    )
    near = F.abs(F.col("about") - F.col("orders")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("orders"))
    error = sketches.RANK_ERROR * F.col("n") + 1
    inside = (F.col("below") - error <= F.col("n") / 2) & (F.col("upto") + error >= F.col("n") / 2)
    return exact.select("film", "n", near.alias("distinct_ok"), inside.alias("median_ok"))


@query("""WITH runs AS (SELECT o_custkey AS customer, 1 AS run, o_orderkey % 3 = 0 AS found, o_orderkey FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, 2, o_orderkey % 5 < 2, o_orderkey FROM orders WHERE o_orderkey % 2 = 1),
best AS (SELECT customer, max(CAST(found AS INT) * 4 + run) AS top FROM runs GROUP BY customer)
SELECT customer, top < 4 AS not_found, CASE WHEN top >= 4 THEN top - 4 ELSE top END AS run FROM best""")
def kept_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of lookups merged into a kept table: what was found once stays, a later answer replaces an earlier one of its kind."""
    orders = tables.table(spark, sf_dir, "orders")
    path = fresh_path(spark, "lookups")
    found = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0).otherwise(F.col("o_orderkey") % 5 < 2)
    rows = orders.select(F.col("o_custkey").alias("customer"), (~found).alias("not_found"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("run"))
    order = [~F.col("not_found"), F.col("run")]
    upsert(rows.filter("run = 1"), path, "customer", order)
    return upsert(rows.filter("run = 2"), path, "customer", order)


@query("""WITH h AS (SELECT event_id, user_id, user_id % 3 = 0 AS held, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events)
SELECT count(*) FILTER (NOT held AND nr = 1) AS n_network, count(*) FILTER (held OR nr > 1) AS n_cache FROM h""")
def observed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where requests were answered from, counted while they are written."""
    requests = tables.table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    told = records.with_origin(requests, requests.filter("user_id % 3 = 0").select("user_id"), "user_id")
    path = fresh_path(spark, "requests")
    found = observed.write_with_counters(told, lambda rows: rows.write.mode("overwrite").parquet(path), "origins", **observed.origin_counters())
    return spark.createDataFrame([(found["n_network"], found["n_cache"])], "n_network long, n_cache long")


@query(f"WITH {sql.PAGES} SELECT film, level, page, n_rows, n_first, n_valid, kept FROM pages_read WHERE film IN ('de', 'en')")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two films read through the page source, which opens their levels alone and leaves out later pages."""
    path = fresh_path(spark, "pages")
    tables.reviews(spark, sf_dir).write.mode("overwrite").partitionBy("film", "level").parquet(path)
    pages.register(spark)
    stored = spark.read.format("review_pages").load(path)
    return collect.read_pages(collect.seen_marked(stored.filter("film IN ('de', 'en')")))


@query(ORACLES["film_document"])
def film_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents written as a file for each film and read back."""
    path = fresh_path(spark, "films")
    documents = more._documents(spark, sf_dir)
    films.write_films(documents, path)
    return more._flat(films.read_films(spark, path, documents.schema))


@query(ORACLES["early_stop_pages"])
def streamed_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stop on a stream of rows that are fetched in any order within ten minutes; a row of a later hour lets the last pages be told."""
    at, later = 1_700_000_000, F.timestamp_seconds(F.lit(1_700_100_000))
    path = fresh_path(spark, "stream")
    reviews = tables.reviews(spark, sf_dir).withColumn("fetched_at", F.timestamp_seconds(at + F.pmod(F.xxhash64("review_id", "page"), F.lit(600))))
    reviews.write.parquet(f"{path}/rows")
    spark.createDataFrame([("", 0.0, 1, 0)], "film string, level double, page int, pos int").withColumn("fetched_at", later).write.mode("append").parquet(f"{path}/rows")
    early_stop.use_state_store(spark)
    told = early_stop.read_pages_of_stream(spark.readStream.schema(reviews.schema).parquet(f"{path}/rows"))
    running = told.writeStream.format("parquet").option("path", f"{path}/pages").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(early_stop.RESULT).parquet(f"{path}/pages").filter("film <> ''")


# reports

#: What stands in for parts of a document that the tables do not have, for Spark and for SQL alike: by film and by bucket's place.
_PARTS = {
    "title": "concat('Filme ', film)", "director": "CASE WHEN film <> 'de' THEN 'D. Irigida' END", "minutes": "CASE WHEN film <> 'fr' THEN 90 + length(film) END", "in_english": "film = 'es'",
    "narrative": "CASE WHEN film <> 'de' THEN concat('Prosa de ', film, '.') END", "observation": "CASE WHEN ord <> 2 THEN concat('o grupo ', bucket) ELSE '' END", "language_doubtful": "film = 'en' AND ord = 1", "scope_doubtful": "ord = 3",
    "example": "concat('um exemplo de ', theme)", "reported": "CASE WHEN rank % 3 = 0 THEN mentions + 1000 END", "quotes_removed": "rank % 2 = 0", "verdict": "CASE WHEN film = 'en' THEN 'aceita' ELSE 'regressao' END",
}
_FAULTS_OF = {"en": ("escopo", "aspas"), "es": tuple(reports.FAULT_LINES)}


def _report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name: F.expr(_PARTS[name]).alias(name)
    levels = catalogue.level_metadata(spark, sf_dir).select("film", labels.bucket_of(F.col("level")).alias("bucket"), F.struct("level", "n_valid", "threshold").alias("x"))
    levels = levels.groupBy("film", "bucket").agg(F.array_sort(F.collect_list("x")).alias("levels"))
    ranked = themes.first_then_ranked(catalogue._themes(spark, sf_dir)).select("film", "bucket", "rank", "theme", "mentions", "n_reviews", part("example"), part("reported"), part("quotes_removed"))
    listed = ranked.groupBy("film", "bucket").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ranked.columns if c not in ("film", "bucket")]))).alias("themes"))
    of_film = ["film", "bucket"]
    rows = catalogue.bucket_assembly(spark, sf_dir).join(catalogue._shares(spark, sf_dir).select(*of_film, "share_real"), of_film, "left").join(levels, of_film, "left").join(listed, of_film, "left")
    rows = rows.withColumn("ord", F.array_position(F.array(*map(F.lit, config.BUCKETS)), F.col("bucket")))
    own = ["bucket", "target", "mode", "n_raw", "n_valid", "share_real", "levels", part("language_doubtful"), part("scope_doubtful"), part("observation"), F.transform("themes", lambda t: t.dropFields("rank")).alias("themes")]
    films_ = rows.groupBy("film").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*own).alias("b")))), lambda x: x["b"]).alias("buckets"))
    text = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    faults = F.lit(None).cast("array<string>")
    for film, names in _FAULTS_OF.items():
        faults = F.when(F.col("film") == film, text(*names)).otherwise(faults)
    card = F.struct(part("title"), F.lit(2001).alias("year"), part("director"), text("drama", "humor").alias("genres"), part("minutes"), part("in_english").alias("synopsis_in_english"))
    edit = F.struct(part("verdict"), F.lit(4).alias("n_protected"), text("~3%").alias("lost"), text("regressao", "regressao").alias("attempts"), F.lit(True).alias("case_mended"), F.lit(0.5).alias("similarity"))
    pair = lambda a, b, x, y: F.struct(F.lit(x).alias(a), F.lit(y).alias(b))
    return films_.select(
        "film", F.lit("2").alias("version"), card.alias("card"), (F.length("film") * 617283).cast("long").alias("n_ratings"), "buckets", part("narrative"), faults.alias("faults"),
        F.array(F.struct(F.lit("belo").alias("property"), text("negativas", "medianas").alias("groups"), text("pacing").alias("themes"))).alias("consensus"),
        F.array(pair("phrase", "theme", "quase todos", "pacing"), pair("phrase", "theme", "muitos", "nada")).alias("quantifiers"), F.array(pair("bucket", "passage", "negativas", "para eles")).alias("markers"), edit.alias("edit"),
        F.array(pair("name", "value", "n_frases", "3"), pair("name", "value", "cv", "0.5")).alias("fluency"),
    )


def _report_sql(tone: str) -> str:
    """Lines with places (a, b), numbered at the end."""
    line = lambda where, a, b, text, source: f"SELECT film, {a} AS a, {b} AS b, {text} AS line FROM {source} WHERE {where}"
    p = _PARTS
    parts = [
        line("true", 0, 0, "'relatório de ' || film || ' · versão 2'", "f"), line("true", 0, 1, f"'filme: ' || {p['title']} || ' (2001) · direção: ' || coalesce({p['director']}, '?') || ' · drama, humor · ' || coalesce(({p['minutes']})::VARCHAR, '?') || ' min'", "f"),
        line(p["in_english"], 0, 2, "'aviso: sinopse em inglês'", "f"), line("true", 0, 3, "'notas reais: ' || replace(format('{:,}', length(film) * 617283), ',', '.')", "f"), line("true", 0, 4, f"'{config.DISCLAIMER_SHARES}'", "f"),
        line("true", "ord", 0, "upper(bucket) || ' ' || n_valid || '/' || target || ' [' || by_level || '] modo=' || mode || coalesce(' · ~' || share_real || '% das notas', '')", "b"),
        line("true", "ord", 1, "'  filtro (caracteres): ' || filters", "b"), line(f"mode = 'sem_analise' AND {p['observation']} <> ''", "ord", 2, f"'  aviso: ' || {p['observation']}", "b"),
        line("mode = 'sem_analise'", "ord", 3, f"'  ' || n_valid || ' disponíveis em {config.SITE}/film/' || film || '/reviews/'", "b"), line("mode = 'reduzido'", "ord", 2, "'  aviso: modo reduzido, ' || n_valid || ' de ' || target", "b"),
        line(f"mode <> 'sem_analise' AND {p['language_doubtful']}", "ord", 3, "'  aviso: idioma não confirmado como pt-BR'", "b"), line(f"mode <> 'sem_analise' AND {p['scope_doubtful']}", "ord", 4, "'  aviso: a observação generaliza o recorte'", "b"),
        line("true", 99, 0, "'total de reviews: ' || sum(n_raw)::BIGINT", "b") + " GROUP BY film",
    ]
    if tone != "narrativo":
        parts += [
            line("true", "ord", "10 * rank", "'  ' || theme || ': ~' || mentions || ' de ' || n_reviews", "t"), line("true", "ord", "10 * rank + 1", f"'    ex.: ' || {p['example']}", "t"),
            line("rank % 3 = 0", "ord", "10 * rank + 2", f"'    aviso: o modelo disse ' || {p['reported']} || ', fora de 0 a ' || n_reviews", "t"), line(p["quotes_removed"], "ord", "10 * rank + 3", "'    aviso: aspas removidas do exemplo'", "t"),
            line(f"mode <> 'sem_analise' AND {p['observation']} <> ''", "ord", 1000, f"'  » ' || {p['observation']}", "b"),
        ]
    if tone != "estruturado":
        parts += [line("true", 10, 0, "'narrativa'", "f"), line("true", 10, 1, f"coalesce({p['narrative']}, '(narrativa não gerada)')", "f")]
        parts += [line(f"film = '{film}'", 11, k, f"'aviso: narrativa: {text}'", "f") for film, names in _FAULTS_OF.items() for k, (name, text) in enumerate(reports.FAULT_LINES.items()) if name in names]
        fixed = ["consensos", "  belo · grupos: negativas, medianas · temas: pacing", "quantificadores"]
        parts += [line("true", 12, k, f"'{x}'", "f") for k, x in enumerate(fixed)]
        pct = sql.percent("mentions", "n_reviews")
        parts += [f"SELECT film, 13, 0, '  quase todos · tema: pacing (' || coalesce((SELECT 'fração real ' || {pct} || '%, ' || {sql.band(pct, labels.QUANTIFIER_BANDS)} FROM ranked x WHERE x.film = f.film AND theme = 'pacing' ORDER BY list_position({sql.quoted(config.BUCKETS)}, bucket) LIMIT 1), 'tema inexistente') || ')' FROM f"]
        ends = ["  muitos · tema: nada (tema inexistente)", "marcadores", "  negativas: para eles"]
        parts += [line("true", 14, k, f"'{x}'", "f") for k, x in enumerate(ends)]
        taken, dropped = ["edição aplicada · 4 trechos protegidos · 2 tentativa(s)", "  maiúsculas de rótulos ajustadas"], ["aviso: edição descartada (regressao) · 2 tentativa(s)", "  trecho perdido: ~3%", "  tentativa 1: regressao", "  tentativa 2: regressao"]
        parts += [line(f"(film = 'en') = {same}", 15, k, f"'{x}'", "f") for same, xs in (("true", taken), ("false", dropped)) for k, x in enumerate(xs)]
        parts += [line("true", 16, k, f"'{x}'", "f") for k, x in enumerate(["  semelhança: 0.500", "fluência: n_frases=3 · cv=0.5"])]
    union = " UNION ALL ".join(parts)
    return f"""WITH {more._LISTED},
levels AS (SELECT film, {sql.bucket("level")} AS bucket, string_agg(level || '★ ' || n_valid, ' · ' ORDER BY level) AS by_level, array_to_string(list_sort(list_distinct(list(threshold))), ', ') AS filters FROM metadata GROUP BY ALL),
b AS (SELECT *, list_position({sql.quoted(config.BUCKETS)}, bucket) AS ord FROM buckets LEFT JOIN shares USING (film, bucket) LEFT JOIN levels USING (film, bucket)),
t AS (SELECT b.film, b.bucket, b.ord, rank, theme, mentions, n_reviews FROM b JOIN ranked USING (film, bucket) WHERE mode <> 'sem_analise'),
f AS (SELECT DISTINCT film FROM b),
l AS ({union})
SELECT film, row_number() OVER (PARTITION BY film ORDER BY a, b) - 1 AS ord, line FROM l"""


@query(_report_sql("estruturado"))
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.full_report(_report_documents(spark, sf_dir))


@query(_report_sql("narrativo"))
def full_report_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.full_report(_report_documents(spark, sf_dir), "narrativo")


@query(_report_sql("ambos"))
def full_report_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.full_report(_report_documents(spark, sf_dir), "ambos")


# narratives

_TOLD = "A grande maioria das notas (~80%) gosta. Uma minoria das notas (~15%) hesita, quem ficou no meio. Uma pequena minoria das notas (~5%) recusa. Para eles, é lento."


def scripted_narrator(system: str, user: str) -> str:
    """By the last digit of what it is asked: good at once, or with one fault until it is told so, or for good, or no JSON at first."""
    kind, told = int(user[-1]), "!" in system
    reply = {"narrativa": _TOLD, "quantificadores_usados": [{"quantificador": "muitos", "tema": "ritmo"}], "consensos_usados": [{"propriedade": "p", "grupos_de_origem": ["negativas"], "temas_de_origem": ["ritmo"]}]}
    if kind == 1 and not told:
        reply["quantificadores_usados"] = [{"quantificador": "quase todos", "tema": "ritmo"}]
    elif kind == 2:
        reply["consensos_usados"] = [{"grupos_de_origem": ["negativas"], "temas_de_origem": ["x"]}]
    elif kind == 3 and not told:
        reply["narrativa"] += " Quase todos concordam."
    elif kind == 4 and not told:
        reply["narrativa"] = _TOLD.replace("Para eles, ", "")
    elif kind == 5:
        reply["narrativa"] += " Uma minoria do público ri."
    elif kind == 6:
        return "isto não é JSON"
    return json.dumps(reply, ensure_ascii=False)


@query(f"""WITH k AS (SELECT c_custkey AS film, c_custkey % 7 AS kind FROM customer)
SELECT film, CASE WHEN kind = 0 THEN 1 ELSE 2 END AS n_calls, CASE kind WHEN 2 THEN 'consenso' WHEN 5 THEN 'vocabulario_peso' WHEN 6 THEN 'sem_resposta' ELSE '' END AS faults,
  CASE WHEN kind = 6 THEN 0 ELSE 1 END AS n_quantifiers, CASE kind WHEN 6 THEN '' WHEN 5 THEN '{_TOLD} Uma minoria do público ri.' ELSE '{_TOLD}' END AS text FROM k""")
def narrated_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives by a scripted model, each checked and asked again with what failed."""
    asked = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("film"), F.concat(F.lit("conte "), (F.col("c_custkey") % 7).cast("string")).alias("message"), F.lit(5).alias("neg"), F.lit(15).alias("med"), F.lit(80).alias("pos"))
    known = asked.select("film", F.lit("negativas").alias("bucket"), F.lit("ritmo").alias("theme"), F.lit(40).alias("pct"), F.lit(2).alias("force"))
    words = dict.fromkeys(("quantificador", "consenso", "perspectiva_nao_marcada", "vocabulario_peso"), " !")
    done = calls.narrated(asked, scripted_narrator, known, {"negativas": "neg", "medianas": "med", "positivas": "pos"}, "narre.", words)
    return done.select("film", "n_calls", F.array_join("faults", "|").alias("faults"), F.greatest(F.size("quantificadores_usados"), F.lit(0)).alias("n_quantifiers"), F.coalesce("text", F.lit("")).alias("text"))
