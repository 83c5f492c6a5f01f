"""More queries over the standard tables: pages read by the real parser, documents and their sinks, model flows, addresses and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels, spans, text
from tierloom.operators import calls, compare, distribution, edits, records, themes
from tierloom.plans import catalogue, sql
from tierloom.plans.catalogue import _NAMES, _PROSE, _PROSE_EDITS, _SHARE, query
from tierloom.sources import html, tables


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


# pages


def _review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with one review for each document: stars, a class or no rating, a link to the full text, an id in JSON, a collapsed text."""
    d, k = tables.table(spark, sf_dir, "documents"), F.col("doc_id")
    body = text.html_escaped(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^!-~]+", " ")))
    half = F.when(k % 2 == 0, "½").otherwise("")
    rating = F.when(k % 3 == 0, _joined('<span class="rating rated-', (k % 10 + 1).cast("string"), '"></span>')).when(k % 3 == 1, _joined('<span class="rating">', F.repeat(F.lit("★"), (k % 5 + 1).cast("int")), half, "</span>")).otherwise("")
    url = F.when(k % 4 == 0, _joined('<div data-full-text-url="/s/full-text/viewing:', k.cast("string"), '/"></div>')).otherwise("")
    uid = F.when(k % 5 == 0, _joined('<div data-likeable-identifier="{&quot;uid&quot;: &quot;u', k.cast("string"), '&quot;}"></div>')).otherwise("")
    collapsed = F.when(k % 6 == 0, '<div class="collapsed-text"></div>').otherwise("")
    page = _joined('<html><body><script>x</script><article class="production-viewing">', rating, '<div class="body-text" lang="', F.coalesce("lang", F.lit("")), '"><p>', body, "</p></div>", url, uid, collapsed, "</article></body></html>")
    return d.select("doc_id", page.alias("html"))


_REVIEW_TEXT = "trim(regexp_replace(coalesce(text, ''), '[^!-~]+', ' ', 'g'))"


@query(f"""SELECT doc_id, 0 AS pos, CASE WHEN doc_id % 5 = 0 THEN 'u' || doc_id WHEN doc_id % 4 = 0 THEN 'viewing:' || doc_id END AS review_id,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10 + 1) / 2 WHEN doc_id % 3 = 1 THEN doc_id % 5 + 1 + CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS rating, md5({_REVIEW_TEXT}) AS text_md5,
  contains({_REVIEW_TEXT}, '{config.SPOILER_PLACEHOLDER}') AS spoiler, doc_id % 6 = 0 OR ends_with({_REVIEW_TEXT}, '...') AS truncated,
  CASE WHEN doc_id % 4 = 0 THEN '/s/full-text/viewing:' || doc_id || '/' END AS full_text_url, coalesce(lang, '') AS lang FROM documents""")
def page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.read_reviews(_review_pages(spark, sf_dir))
    return rows.select("doc_id", "pos", "review_id", "rating", F.md5(F.col("text").cast("binary")).alias("text_md5"), "spoiler", "truncated", "full_text_url", "lang")


@query(f"SELECT doc_id, md5('x' || CASE WHEN {_REVIEW_TEXT} = '' THEN '' ELSE {_REVIEW_TEXT} END) AS text_md5 FROM documents")
def page_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a fragment; what scripts hold is no text."""
    return _review_pages(spark, sf_dir).filter("html IS NOT NULL").select("doc_id", F.md5(_joined("x", F.regexp_replace(html.page_text("html"), "^[★½]+ ?", "")).cast("binary")).alias("text_md5"))


@query(f"WITH {sql.HISTOGRAM}, l(level) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in config.LEVELS)}), f AS (SELECT DISTINCT film FROM histogram) SELECT film, level, coalesce(n, 0)::BIGINT AS n FROM f CROSS JOIN l LEFT JOIN histogram USING (film, level)")
def page_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = catalogue.histogram_pivot(spark, sf_dir)
    rows = []
    for x in config.LEVELS:
        name = "half-★" if x == 0.5 else "★" * int(x) + ("½" if x % 1 else "")
        count = F.regexp_replace(F.col("n_" + str(x).replace(".", "_")).cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
        rows += [f"<tr><th>{name}</th><td><span class='barcolumn' title='", count, f" {name} ratings (5%)'></span></td></tr>"]
    page = _joined("<table class='chart'><tbody>", *rows, "</tbody></table>")
    return html.read_histograms(wide.select("film", page.alias("html")))


@query("""SELECT s_suppkey, rank, CASE WHEN rank = 0 THEN lower(replace(s_name, '#', '-')) ELSE 'other-' || s_suppkey END AS slug, CASE WHEN rank = 0 THEN s_name || ' (1987)' ELSE 'Other' END AS name,
  CASE WHEN rank = 1 THEN NULL WHEN s_suppkey % 2 = 0 THEN 1990 + s_suppkey % 30 ELSE 1987 END::INTEGER AS year FROM supplier, (VALUES (0), (1)) r(rank)""")
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    told = F.when(k % 2 == 0, _joined(' data-film-release-year="', (1990 + k % 30).cast("string"), '"')).otherwise("")
    first = _joined('<li data-film-slug="', F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), '" data-film-name="', F.col("s_name"), ' (1987)"', told, "></li>")
    page = _joined("<ul>", first, '<li data-item-slug="other-', k.cast("string"), '">Other</li></ul>')
    return html.read_search(tables.table(spark, sf_dir, "supplier").select("s_suppkey", page.alias("html")))


# documents and sinks

_LISTED = f"""{sql.BUCKETS}, {sql.THEMES}, {_SHARE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY film, bucket ORDER BY mentions DESC, ord) AS rank FROM themes WHERE ord <= 6),
flat AS (SELECT b.film, list_position({sql.quoted(config.BUCKETS)}, b.bucket)::INTEGER AS ord, b.bucket, mode, n_raw, n_valid, share_real, rank, theme, mentions, n_reviews
  FROM buckets b LEFT JOIN shares USING (film, bucket) LEFT JOIN ranked USING (film, bucket))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = themes.first_then_ranked(catalogue._themes(spark, sf_dir))
    return records.film_documents(catalogue.bucket_assembly(spark, sf_dir), ranked, catalogue._shares(spark, sf_dir))


_READ = "array<struct<ord:int,bucket:string,mode:string,n_valid:bigint,share_real:int,themes:array<struct<rank:int,theme:string,mentions:int,n_reviews:bigint>>>>"


def _flat(documents: DataFrame) -> DataFrame:
    """A nested document back to a row for each theme (one at least for each bucket)."""
    rows = documents.select("film", "total_reviews", F.explode("buckets").alias("b"))
    return rows.select("film", "total_reviews", "b.ord", "b.bucket", "b.mode", "b.n_valid", "b.share_real", F.explode_outer("b.themes").alias("t")).select("*", "t.rank", "t.theme", "t.mentions", "t.n_reviews").drop("t")


@query(f"WITH {_LISTED} SELECT film, (SELECT sum(n_raw)::BIGINT FROM buckets x WHERE x.film = flat.film) AS total_reviews, ord, bucket, mode, n_valid, share_real, rank, theme, mentions, n_reviews FROM flat")
def film_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents through their JSON text, taken apart again so that SQL can compare every field."""
    told = _documents(spark, sf_dir).select("film", "total_reviews", F.to_json("buckets", {"ignoreNullFields": "false"}).alias("buckets"))
    return _flat(told.withColumn("buckets", F.from_json("buckets", _READ)))


@query(f"WITH {_LISTED} SELECT DISTINCT film, ord, bucket, CASE WHEN film = 'en' AND bucket = 'negativas' THEN 77 END AS share_real FROM flat")
def distribution_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares replaced by another distribution, which knows one bucket only."""
    other = spark.createDataFrame([("en", "negativas", 77)], "film string, bucket string, share_real int")
    return records.apply_distribution(_documents(spark, sf_dir), other).select("film", F.explode("buckets").alias("b")).select("film", "b.ord", "b.bucket", "b.share_real")


@query(f"WITH {_LISTED} SELECT DISTINCT c.place, film, (SELECT sum(n_raw)::BIGINT FROM buckets x WHERE x.film = flat.film) AS total_reviews, ord, bucket, n_valid FROM flat JOIN (VALUES (1, 'es'), (2, 'nowhere'), (3, 'de')) c(place, film) USING (film)")
def site_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(1, "es"), (2, "nowhere"), (3, "de")], "place int, film string")
    told = compare.bundle(_documents(spark, sf_dir), listed)
    read = F.from_json("document", f"film string, total_reviews bigint, buckets {_READ}")
    rows = told.select("place", read.alias("d")).select("place", "d.film", "d.total_reviews", F.explode("d.buckets").alias("b"))
    return rows.select("place", "film", "total_reviews", "b.ord", "b.bucket", "b.n_valid")


# addresses, origins, lookups

_ADDRESSES = {
    "level_url": "'{site}/film/' || slug || '/reviews/rated/' || shown || '/by/activity/page/' || page || '/'", "level_key": "slug || '/pages/rated_' || replace(shown, '.', '_') || '_page_' || page || '.html'",
    "full_text_url": "'{site}' || path", "full_text_key": "slug || '/fulltext/viewing_' || page_id || '.html'", "histogram_url": "'{site}/csi/film/' || slug || '/rating-histogram/'", "histogram_key": "'_histograma/' || slug || '.html'",
    "film_url": "'{site}/film/' || slug || '/'", "film_key": "slug || '/film_page.html'", "reviews_url": "'{site}/film/' || slug || '/reviews/'",
    "search_url": "'{site}/s/search/films/' || replace(url_encode(title), '%2F', '/') || '/'", "search_key": "'_search/' || replace(url_encode(title), '%', '_') || '.html'",
}


@query(f"""WITH p AS (SELECT page_id, replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '-') AS slug, (page_id % 10 + 1) / 2 AS level, (page_id % 6 + 1)::VARCHAR AS page, '/s/' || page_id AS path, 'é / ' || url AS title FROM pages),
s AS (SELECT *, CASE WHEN level = floor(level) THEN level::INTEGER::VARCHAR ELSE level::VARCHAR END AS shown FROM p)
SELECT page_id, {", ".join(f"{x.replace('{site}', config.SITE)} AS {name}" for name, x in _ADDRESSES.items())} FROM s""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    slug = F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("."), F.lit("-"))
    found = records.page_addresses(slug, (k % 10 + 1) / 2, (k % 6 + 1).cast("int"), _joined("/s/", k.cast("string")), _joined("viewing:", k.cast("string")), _joined("é / ", F.col("url")))
    return tables.table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in found.items()))


@query("""WITH r AS (SELECT *, user_id % 3 = 0 AS held, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT event_type, count_if(NOT held AND n = 1) AS n_network, count_if(held OR n > 1) AS n_cache FROM r GROUP BY event_type""")
def request_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for their users' pages, of which an earlier run has every third."""
    requests = tables.table(spark, sf_dir, "events").withColumn("at", F.col("event_id"))
    held = requests.filter("user_id % 3 = 0").select("user_id")
    return records.origin_counts(records.with_origin(requests, held, "user_id"), ["event_type"])


@query("SELECT DISTINCT c_nationkey AS n_nationkey, CASE WHEN n_regionkey < 3 THEN n_name END AS n_name, n_regionkey >= 3 AS not_found FROM customer JOIN nation ON c_nationkey = n_nationkey")
def negative_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return records.with_negatives(asked, tables.table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name"), "n_nationkey")


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n{{2,}}'), lambda x: {sql.stripped("x")}), lambda x: x <> '') AS p, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS title FROM documents)
SELECT doc_id, len(p) AS n_paragraphs, md5(array_to_string(p, '|')) AS paragraphs_md5, coalesce(nullif(title, ''), 'slug-' || doc_id) AS title FROM p""")
def shown_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = records.paragraphs(F.coalesce("text", F.lit("")))
    title = records.shown_title(F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(""), _joined("slug-", F.col("doc_id").cast("string")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n_paragraphs"), F.md5(F.array_join(parts, "|").cast("binary")).alias("paragraphs_md5"), title.alias("title"))


@query(f"""WITH {sql.THEMES}, n(theme) AS (VALUES ('pacing'), ('mood'), ('humor'), ('nothing')),
f AS (SELECT *, row_number() OVER (PARTITION BY film, theme ORDER BY list_position({sql.quoted(config.BUCKETS)}, bucket), ord) AS nr FROM themes)
SELECT x.film, theme, bucket, pct, {sql.band("pct", labels.QUANTIFIER_BANDS)} AS quantifier FROM (SELECT DISTINCT film FROM themes) x CROSS JOIN n LEFT JOIN (SELECT * FROM f WHERE nr = 1) y USING (film, theme)""")
def theme_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme names against a film's themes: the first bucket that has one tells."""
    found = catalogue._themes(spark, sf_dir)
    names = found.select("film").distinct().select("film", F.explode(F.array(*map(F.lit, ("pacing", "mood", "humor", "nothing")))).alias("theme"))
    return themes.first_of_name(names, found)


@query(f"WITH {sql.THEMES} SELECT film, bucket, sum(mentions) / max(n_reviews) AS ratio, max(mentions / n_reviews) AS largest FROM themes GROUP BY ALL")
def mention_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.mention_ratios(catalogue._themes(spark, sf_dir))


_ANSWER = """'{"' || (event_id % 4) || '": ["mood", "' || event_type || '", "mood"], "9": ["mood"], "x": []}'"""


@query("""WITH e AS (SELECT event_id, event_type, unnest(range(1, 4)) AS place FROM events)
SELECT 'f' AS film, 'b' AS bucket, event_id AS batch, place::INTEGER AS place, CASE WHEN event_id % 100 = 0 THEN NULL WHEN event_id % 4 <> place THEN '' WHEN event_type = 'click' THEN 'mood,click,mood' ELSE 'mood,mood' END AS theme_ids,
  (event_id % 100 <> 0 AND event_id % 4 = place AND event_type <> 'click')::INTEGER AS n_invalid FROM e""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about batches of three: some failed, some name places or themes that are not there."""
    answer = F.when(F.col("event_id") % 100 != 0, F.expr(_ANSWER))
    rows = tables.table(spark, sf_dir, "events").select(F.lit("f").alias("film"), F.lit("b").alias("bucket"), F.col("event_id").alias("batch"), F.lit(3).alias("n_rows"), answer.alias("answer"))
    return themes.valid_answers(rows, ["mood", "click"]).withColumn("theme_ids", F.array_join("theme_ids", ","))


@query("""WITH c AS (SELECT user_id, count(*) AS n_entries, count_if(event_type <> 'error') > 1 AS retried, bool_or(event_type = 'error') AS backed_off, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS last_outcome FROM events GROUP BY user_id),
t AS (SELECT user_id, count(*) AS n_themes, count_if(value > 50) AS n_clamped, sum(event_id % 7)::BIGINT AS n_mentions FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT c.*, coalesce(n_themes, 0) AS n_themes, coalesce(n_clamped, 0) AS n_clamped, coalesce(n_mentions, 0) AS n_mentions FROM c LEFT JOIN t USING (user_id)""")
def bucket_call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "backoff").otherwise("call")
    log = events.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("value").alias("seconds"), F.col("event_type").alias("outcome"))
    found = events.filter("event_type = 'click'").select("user_id", (F.col("value") > 50).alias("clamped"), (F.col("event_id") % 7).alias("mentions"))
    return records.bucket_metrics(log, found, ["user_id"], ["ts", "event_id"]).drop("seconds")


# declarations, messages and flows

_LIST = """'{"quantificadores_usados": [{"quantificador": "alguns", "tema": "' || event_type || '"}, 7, "x", {"tema": ' || event_id || '}, null]}'"""


@query("SELECT event_id, 2 AS n, 'alguns:' || event_type || '|:' || event_id AS told FROM events")
def declared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as a model might declare them, with entries that are no objects."""
    rows = tables.table(spark, sf_dir, "events").select("event_id", calls.declared(F.expr(_LIST), "quantificadores_usados").alias("q"))
    return rows.select("event_id", F.size("q").alias("n"), F.array_join(F.transform("q", lambda x: F.concat_ws(":", x["quantificador"], x["tema"])), "|").alias("told"))


_MARKERS = (("negativas", "Para eles"), ("medianas", "quem ficou no meio"), ("negativas", "nunca dito"))


@query(f"""WITH {_PROSE}, m(grupo, trecho) AS (VALUES {", ".join(f"('{g}', '{t}')" for g, t in _MARKERS)}),
j AS (SELECT *, CASE grupo WHEN 'negativas' THEN neg ELSE med END AS share, greatest(neg, med, pos) AS dominant, {sql.sentence_bounds("text")} AS bounds FROM prose, m),
k AS (SELECT *, CASE WHEN dominant > 0 AND share <= dominant / 10 THEN 'antecipada' WHEN dominant > 0 AND share <= dominant / 3 THEN 'simples' ELSE 'nenhuma' END AS marking,
  CASE grupo WHEN 'negativas' THEN {sql.anchor_place("text", "neg")} ELSE {sql.anchor_place("text", "med")} END AS anchor, nullif(instr(text, trecho), 0) AS place FROM j),
s AS (SELECT *, CASE WHEN marking = 'antecipada' THEN {sql.sentence_at("bounds", "anchor")} END AS anchor_sentence, {sql.sentence_at("bounds", "place")} AS marker_sentence FROM k)
SELECT film, grupo, trecho, marking, anchor_sentence, marker_sentence, marking <> 'antecipada' OR coalesce(marker_sentence - anchor_sentence IN (0, 1), false) AS placed FROM s""")
def marker_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*(F.struct(F.lit(g).alias("grupo"), F.lit(t).alias("trecho")) for g, t in _MARKERS))
    rows = spans.diagnosed_markers(catalogue._prose(spark, sf_dir).withColumn("said", said), "text", _NAMES, "said")
    return rows.select("film", "grupo", "trecho", "marking", "anchor_sentence", "marker_sentence", "placed")


_HEAD = "upper(b.bucket) || ': ' || b.n_valid || ' reviews · modo=' || b.mode || coalesce(' · peso: ' || weight_phrase || ' · marcação: ' || marking, '') || CASE WHEN b.bucket = 'medianas' THEN chr(10) || 'observação: notas do meio' ELSE '' END"
_THEME_LINE = f"""'- ' || theme || ': ~' || mentions || ' de ' || n_reviews || ' (' || pct || '%, ' || {sql.band("pct", labels.QUANTIFIER_BANDS)} || '). ex.: um exemplo'"""


@query(f"""WITH {sql.BUCKETS}, {sql.THEMES}, {_SHARE},
weighed AS (SELECT *, {sql.band("share_real", labels.WEIGHT_BANDS)} || ' das notas (~' || share_real || '%)' AS weight_phrase, max(share_real) OVER (PARTITION BY film) AS dominant FROM shares),
w AS (SELECT film, bucket, weight_phrase, CASE WHEN dominant = 0 THEN 'nenhuma' WHEN share_real <= dominant / 10 THEN 'antecipada' WHEN share_real <= dominant / 3 THEN 'simples' ELSE 'nenhuma' END AS marking FROM weighed),
t AS (SELECT film, bucket, string_agg({_THEME_LINE}, chr(10) ORDER BY mentions DESC, ord) AS lines FROM themes WHERE ord <= 6 GROUP BY film, bucket),
l AS (SELECT b.film, list_position({sql.quoted(config.BUCKETS)}, b.bucket) AS place, b.n_raw, {_HEAD} || chr(10) || coalesce(lines, '(sem temas)') AS part FROM buckets b LEFT JOIN w USING (film, bucket) LEFT JOIN t USING (film, bucket))
SELECT film, md5('total de reviews: ' || sum(n_raw)::BIGINT || CASE WHEN film = 'en' THEN chr(10) || 'título: Um; ano: 1997; diretor: Ela; gêneros: drama, crime; sinopse: Breve.' ELSE '' END || chr(10) || string_agg(part, chr(10) ORDER BY place)) AS message_md5 FROM l GROUP BY film""")
def narrator_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = catalogue.bucket_assembly(spark, sf_dir).withColumn("observation", F.when(F.col("bucket") == "medianas", "notas do meio").otherwise(""))
    ranked = themes.first_then_ranked(catalogue._themes(spark, sf_dir)).withColumn("example", F.lit("um exemplo"))
    films = spark.createDataFrame([("en", "Um", 1997, "Ela", ["drama", "crime"], "Breve.")], "film string, title string, year int, director string, genres array<string>, synopsis string")
    told = records.narrator_message(buckets, ranked, distribution.weight_labels(catalogue._shares(spark, sf_dir)), films)
    return told.select("film", F.md5(F.col("message").cast("binary")).alias("message_md5"))


_TAIL = " Nada mais a dizer sobre isso tudo, nem hoje nem nunca, e assim fica a conversa."


def scripted_editor(system: str, user: str) -> str:
    """Edits by the length of the text it gets: never, at once, or once it is told what was wrong."""
    raw = user.split("\n", 1)[1].split("\n\nTRECHOS", 1)[0]
    if len(raw) % 3 == 0:
        return raw
    if len(raw) % 3 == 1 or "formato" in system:
        return raw + _TAIL
    return "{ text: " + raw + " }"


@query(f"""WITH {_PROSE}, e AS (SELECT film, text AS raw, length(text) % 3 AS kind FROM prose)
SELECT film, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END AS n_calls, kind = 0 AS discarded, CASE kind WHEN 0 THEN 'edicao_nula|edicao_nula|edicao_nula|edicao_nula' WHEN 1 THEN '' ELSE 'formato_invalido' END AS history,
  md5(CASE WHEN kind = 0 THEN raw ELSE {sql.labels_lowered(f"raw || '{_TAIL}'")} END) AS text_md5 FROM e""")
def editor_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue._prose(spark, sf_dir).withColumnRenamed("text", "raw").withColumn("protected", edits.protected_spans(F.col("raw"), [F.col(x) for x in _NAMES.values()]))
    done = calls.edited(rows, scripted_editor, _NAMES, "edite.", {"formato_invalido": " formato", "edicao_nula": " mude"})
    return done.select("film", "n_calls", "discarded", F.array_join("history", "|").alias("history"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_HEADING = "'TEXTO A EDITAR:' || chr(10) || raw || chr(10) || chr(10) || 'TRECHOS PROTEGIDOS (reproduza cada um EXATAMENTE):'"


@query(f"WITH {_PROSE_EDITS} SELECT film, md5({_HEADING} || chr(10) || '- ') AS head_md5, length({_HEADING}) + list_sum(list_transform(spans, lambda x: length(x) + 3))::INTEGER AS n_chars FROM kept")
def editor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one length may stand in any order in SQL, so the head and the length are compared."""
    rows = catalogue._prose_edits(spark, sf_dir)
    told = rows.withColumn("message", calls.editor_message(F.col("raw"), edits.protected_spans(F.col("raw"), [F.col(x) for x in _NAMES.values()])))
    head = F.regexp_extract("message", r"^(?s:.*?)\(reproduza cada um EXATAMENTE\):\n- ", 0)
    return told.select("film", F.md5(head.cast("binary")).alias("head_md5"), F.length("message").alias("n_chars"))


def scripted_synthesis(system: str, user: str) -> str:
    """No JSON at first for one kind, English for another, else a good answer."""
    good = '```json\n{"temas": [{"tema": "o ritmo", "mencoes_aproximadas": 3, "exemplo_parafraseado": "é lento"}], "observacao_geral": "Uma leitura comum."}\n```'
    if user.endswith("0"):
        return "isto não é JSON"
    if user.endswith("1") and "reforço" not in system:
        return '{"temas": [], "observacao_geral": "This is the view of the group and it is what it was."}'
    return good


@query(f"""WITH {sql.BUCKETS}, m AS (SELECT *, n_raw % 3 AS kind FROM buckets)
SELECT film, bucket, CASE WHEN mode = 'sem_analise' THEN 0 WHEN kind = 2 THEN 1 ELSE 2 END AS n_calls, CASE WHEN mode = 'sem_analise' OR kind = 0 THEN 0 ELSE 1 END AS n_themes,
  CASE WHEN mode = 'sem_analise' THEN 'sem análise temática: ' || n_valid || ' válidas (piso {config.FLOOR_PER_BUCKET})' WHEN kind = 0 THEN 'sem JSON válido' ELSE 'Uma leitura comum.' END AS observation, false AS language_invalid FROM m""")
def synthesis_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = catalogue.bucket_assembly(spark, sf_dir).withColumn("message", (F.col("n_raw") % 3).cast("string"))
    done = calls.synthesized(buckets, scripted_synthesis, "resuma.", " reforço")
    return done.select("film", "bucket", "n_calls", F.size("themes").alias("n_themes"), "observation", "language_invalid")
