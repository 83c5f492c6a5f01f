import json
import resource

import duckdb
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions.ranks import numbered
from tierloom.operators import calls, collect, compare, distribution, edits, records, rounds, themes
from tierloom.plans import catalogue
from tierloom.sources import html
from tierloom.streaming import votes

REVIEW = "film string, level double, page int, pos int, review_id string, rating double, text string, spoiler boolean, truncated boolean, full_text_url string"


def reviews(spark, lengths, level=3.0, page_rows=12, **flags):
    rows = [("f", level, i // page_rows + 1, i % page_rows, f"v{i}", flags.get("rating", {}).get(i, level), "x" * n, i in flags.get("spoilers", ()), i in flags.get("truncated", {}), flags.get("truncated", {}).get(i)) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, REVIEW).withColumn("n_chars", F.length("text"))


@pytest.mark.parametrize(("lengths", "threshold", "kept"), [([200] * 3, 150, 3), ([80] * 4, 50, 4), ([20] * 2, 0, 2), ([200, 80, 20], 150, 1)])
def test_cascade(spark, lengths, threshold, kept):
    rows = collect.with_threshold(reviews(spark, lengths))
    assert {r.threshold for r in rows.collect()} == {threshold}
    assert collect.level_quota(rows).count() == kept


def test_cascade_without_eligible_rows(spark):
    rows = collect.with_threshold(reviews(spark, [300, 300], spoilers={0}, rating={1: None}))
    assert {r.threshold for r in rows.collect()} == {0} and collect.level_quota(rows).count() == 0


def test_pages_stop_at_quota_gap_and_cap(spark):
    kept = lambda df: [r.page for r in collect.read_pages(collect.seen_marked(df)).filter("kept").orderBy("page").collect()]
    assert kept(reviews(spark, [200] * 30)) == [1]
    assert kept(reviews(spark, [20] * 100)) == [1, 2, 3, 4, 5, 6]
    assert kept(reviews(spark, [20] * 12 + [200] * 24)) == [1, 2]
    assert kept(reviews(spark, [20] * 60).filter("page <> 2")) == [1]
    assert kept(reviews(spark, [20] * 12)) == [1]


def test_a_page_of_repeats_does_not_end_a_level(spark):
    """Page 2 repeats page 1; page 3 is read, and repeats count once towards the quota."""
    once = reviews(spark, [200] * 12).filter("pos < 8")
    again = once.withColumn("page", F.lit(2))
    last = once.withColumn("page", F.lit(3)).withColumn("review_id", F.concat(F.lit("w"), "review_id"))
    rows = once.unionByName(again).unionByName(last)
    pages = collect.read_pages(collect.seen_marked(rows)).orderBy("page").collect()
    assert [(r.page, r.n_rows, r.n_first, r.n_valid, r.kept) for r in pages] == [(1, 8, 8, 8, True), (2, 8, 0, 0, True), (3, 8, 8, 8, True)]
    assert collect.kept_rows(rows).count() == 16
    # rows without an id are no repeats of each other
    anonymous = rows.withColumn("review_id", F.lit(None).cast("string"))
    assert collect.kept_rows(anonymous).count() == 16


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_numbers_within_groups(spark, width):
    rows = spark.createDataFrame([("a", i * 7 % 23) for i in range(23)] + [("b", 5), ("b", None), (None, 4), (None, 9)], "g string, i long")
    found = {(r.g, r.i): r.n for r in numbered(rows, ["g"], "i", "n", width).collect()}
    assert found == {("a", i): i for i in range(23)} | {("b", None): 0, ("b", 5): 1, (None, 4): 0, (None, 9): 1}


def test_first_seen_keeps_anonymous_rows(spark):
    rows = spark.createDataFrame([("f", "a", 1), ("f", "a", 2), ("f", None, 3), ("f", None, 4), ("f", "", 5), ("g", "a", 6)], "film string, id string, n int")
    assert sorted(r.n for r in collect.first_seen(rows, ["film"], ["id"], ["n"]).collect()) == [1, 3, 4, 5, 6]


def test_completion_and_counters(spark):
    rows = reviews(spark, [200] * 6 + [20, 200, 200], truncated={0: "/a", 1: None, 2: "/c", 3: "/d"}, spoilers={7}, rating={8: None})
    full = spark.createDataFrame([("/a", "full", True), ("/c", config.SPOILER_PLACEHOLDER, True), ("/d", None, False), ("/e", "other", True)], "full_text_url string, fetched_text string, fetch_ok boolean")
    cascade = collect.with_threshold(rows)
    done = collect.completion(collect.level_quota(cascade), full)
    assert {r.review_id: (r.status, r.full_text) for r in done.collect() if r.review_id < "v5"} == {
        "v0": ("completed", "full"), "v1": ("no_url", None), "v2": ("spoiler_in_full", None), "v3": ("fetch_failed", None), "v4": ("complete", "x" * 200),
    }
    m = collect.level_metadata(cascade, full).first()
    assert (m.n_raw, m.n_unrated, m.n_spoiler, m.n_short, m.n_truncation, m.n_valid, m.threshold) == (9, 1, 2, 1, 3, 3, 150)
    b = collect.bucket_assembly(collect.level_metadata(cascade, full)).first()
    assert (b.bucket, b.target, b.n_valid, b["mode"]) == ("medianas", 20, 3, "reduzido")


HISTOGRAMS = {
    "A": (456, 1037, 989, 4251, 6214, 23371, 41371, 110990, 87357, 99242), "B": (1, 2, 0, 2, 2, 8, 1, 4, 0, 6), "C": (10,) * 10, "D": (0,) * 10,
}


def test_shares(spark):
    rows = [(f, x, n) for f, ns in HISTOGRAMS.items() for x, n in zip(sorted(config.LEVELS), ns, strict=True)]
    from tierloom.functions.labels import bucket_of

    histogram = spark.createDataFrame(rows, "film string, level double, n long").withColumn("bucket", bucket_of(F.col("level")))
    found = distribution.weight_labels(distribution.rating_distribution(histogram)).collect()
    shares = {(r.film, r.bucket): (r.share_real, r.n_total, r.marking) for r in found}
    for film, total, wanted in (("A", 375278, (3, 17, 79)), ("B", 26, (27, 35, 38)), ("C", 100, (50, 20, 30))):
        assert [shares[film, b][0] for b in config.BUCKETS] == list(wanted) and shares[film, "medianas"][1] == total
    assert [shares["A", b][2] for b in config.BUCKETS] == ["antecipada", "simples", "nenhuma"]
    assert not any(f == "D" for f, _ in shares)
    assert {r.film for r in distribution.complete_films(histogram.filter("n > 0")).collect()} == {"A", "C"}


def test_theme_clamping_and_ranking(spark):
    raw = [("f", "b", i, f"t{i}", m, 20, 'said "so"' if i == 1 else "plain") for i, m in enumerate(["5", "99", "-3", "x", "7", "7", "20"], 1)]
    found = themes.clamped(spark.createDataFrame(raw, "film string, bucket string, ord int, theme string, mentions string, n_reviews int, example string"))
    rows = {r.theme: r for r in found.collect()}
    assert (rows["t2"].mentions, rows["t2"].clamped, rows["t2"].original) == (20, True, 99)
    assert (rows["t3"].mentions, rows["t3"].original, rows["t4"].mentions, rows["t4"].clamped) == (0, -3, 0, False)
    assert rows["t1"].example == "said so" and rows["t1"].quotes_removed and not rows["t2"].quotes_removed
    order = lambda df: [r.theme for r in df.orderBy("rank").collect()]
    assert order(themes.first_then_ranked(found)) == ["t2", "t5", "t6", "t1", "t3", "t4"]
    assert order(themes.ranked_then_first(found)) == ["t2", "t7", "t5", "t6", "t1", "t3"]


def test_coverage_tells_null_from_empty(spark):
    rows = spark.createDataFrame([("f", "b", ["a", "b"]), ("f", "b", []), ("f", "b", None), ("f", "b", ["a", "zz"])], "film string, bucket string, theme_ids array<string>")
    c = themes.coverage(rows).first()
    assert (c.n_reviews, c.n_no_theme, c.n_unclassified, c.n_with_theme, c.mean_themes) == (4, 1, 1, 2, 1.333)
    assert {r.theme_id: r.mentions for r in themes.mentions(rows, ["a", "b"]).collect()} == {"a": 2, "b": 1}


def test_claims(spark):
    known = spark.createDataFrame([("f", "negativas", "x", 67, 4), ("f", "positivas", "x", 20, 1), ("f", "positivas", "y", 90, 5)], "film string, bucket string, theme string, pct int, force int")
    claims = spark.createDataFrame([("f", 1, "quase todos", "x"), ("f", 2, "a maioria", "x"), ("f", 3, "muitos", "z"), ("f", 4, "uns", "x")], "film string, claim int, quantifier string, theme string")
    assert {r.claim: r.verdict for r in themes.check_quantifiers(claims, known).collect()} == {1: "too_strong", 2: "ok", 3: "unknown_theme", 4: "ok"}
    items = [("f", 1, ["negativas"], ["x"]), ("f", 2, ["negativas"], ["y"]), ("f", 3, ["outras"], []), ("f", 4, [], []), ("f", 5, ["medianas"], []), ("f", 6, ["negativas", "positivas"], ["x", "y"])]
    found = themes.check_consensus(spark.createDataFrame(items, "film string, item int, groups array<string>, themes array<string>"), known)
    assert {r.item: r.valid for r in found.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_edit_verdicts(spark):
    raw = "A grande maioria das notas (~79%) gostou do filme, que é de 1997 e tem ritmo lento mas muito bom."
    edited = {
        "same": raw, "wrapped": '{ text: "' + raw + '" }', "lost": raw.replace("~79%", "79 por cento"), "number": raw.replace("ritmo", "2 ritmos"),
        "moved": "O filme, que é de 1997 e não envelhece, agrada: para a grande maioria das notas (~79%), que gostou, o ritmo lento não atrapalha em nada.", "english": "The film is of 1997 and the mood of it was for A grande maioria das notas (~79%) and that is that.",
    }
    rows = spark.createDataFrame([(k, raw, v) for k, v in edited.items()], "edit_id string, raw string, edited string").withColumn("protected", edits.protected_spans(F.col("raw"), [F.lit(79)]))
    assert rows.first().protected == ["A grande maioria das notas (~79%)", "~79%", "1997"]
    assert {r.edit_id: r.verdict for r in edits.edit_verdicts(rows).collect()} == {
        "same": "edicao_nula", "wrapped": "formato_invalido", "lost": "protegidos_perdidos", "number": "numeros_alterados", "moved": "aceita", "english": "regressao",
    }


def test_edits_that_lose_weights_or_whose_opinion_it_is(spark):
    shares = {"negativas": "neg", "medianas": "med", "positivas": "pos"}
    raw = "A grande maioria das notas (~79%) gostou. Uma minoria das notas (~17%) hesita, quem ficou no meio. Uma fração mínima das notas (~3%) discorda. Para eles, é lento."
    edited = {
        "unmarked": raw.replace("Para eles, é", "É"), "noun": raw + " Uma minoria do público, aliás.", "late": raw.replace("Para eles, é lento", "É lento. É mesmo. Para eles"), "quoted": raw.replace("lento", '"lento"') + " Nada mais a dizer sobre isso tudo, nem hoje nem nunca.",
        "shares": raw.replace("Uma minoria das notas (~17%)", "Das notas, 17%,"),
    }
    rows = spark.createDataFrame([(k, raw, v, 3, 17, 79) for k, v in edited.items()], "edit_id string, raw string, edited string, neg int, med int, pos int")
    rows = rows.withColumn("protected", edits.protected_spans(F.col("raw"), [F.col(c) for c in shares.values()]))
    assert rows.first().protected[:3] == ["Uma fração mínima das notas (~3%)", "A grande maioria das notas (~79%)", "Uma minoria das notas (~17%)"]
    found = {r.edit_id: r for r in edits.edit_verdicts(rows, shares).collect()}
    assert {k: (r.verdict, r.regressions) for k, r in found.items()} == {
        "unmarked": ("regressao", ["perspectiva_nao_marcada"]), "noun": ("regressao", ["vocabulario_peso"]), "late": ("regressao", ["perspectiva_nao_marcada"]), "quoted": ("aceita", []), "shares": ("protegidos_perdidos", []),
    }
    assert '"' not in found["quoted"].published


def test_candidates_and_years(spark):
    rows = [("q", 1997, 1, 10, "1997-01-01", 0.28), ("q", 1997, 2, 11, "1997-05-01", 3.79), ("q", 1997, 3, 12, "1990-01-01", 99.0), ("p", None, 1, 20, "2000-01-01", 1.0), ("p", None, 2, 21, "2001-01-01", 9.0), ("t", 1997, 1, 30, "1997-01-01", 1.0), ("t", 1997, 2, 31, "1997-01-01", 1.0)]
    best = records.best_candidate(spark.createDataFrame(rows, "k string, year int, rank int, id int, release_date string, popularity double"), ["k"])
    assert {r.k: r.id for r in best.collect()} == {"q": 11, "p": 20, "t": 30}
    guard = records.year_guard(spark.createDataFrame([(1, 1997, 1998), (2, 1997, 1999), (3, None, 1999)], "i int, year_found int, year_expected int"))
    assert {r.i: r.accepted for r in guard.collect()} == {1: True, 2: False, 3: True}


def test_documents_and_shares(spark):
    buckets = spark.createDataFrame([("f", b, 10, 20, 5, m) for b, m in (("positivas", "completo"), ("negativas", "sem_analise"))], "film string, bucket string, target int, n_raw long, n_valid long, mode string")
    ranked = spark.createDataFrame([("f", "positivas", 1, "x", 5, 9), ("f", "negativas", 1, "y", 1, 2)], "film string, bucket string, rank int, theme string, mentions int, n_reviews long")
    shares = spark.createDataFrame([("f", "positivas", 79)], "film string, bucket string, share_real int")
    docs = records.film_documents(buckets, ranked, shares)
    row = docs.first()
    assert [(b.bucket, b.share_real) for b in row.buckets] == [("negativas", None), ("positivas", 79)] and row.total_reviews == 40
    assert [b.share_real for b in records.apply_distribution(docs, None).first().buckets] == [None, None]
    assert records.apply_distribution(docs, shares).first().buckets == row.buckets
    lines = [r.line for r in records.report_lines(buckets, ranked, shares).orderBy("ord").collect()]
    body = ["NEGATIVAS 5/10 modo=sem_analise", "aviso: sem analise", f"5 disponíveis em {config.SITE}/film/f/reviews/", "POSITIVAS 5/10 modo=completo · ~79% das notas"]
    assert lines == [config.DISCLAIMER_SHARES, *body, "x: ~5 de 9", "total de reviews: 40"]
    told = lambda tone, **more: [r.line for r in records.report_lines(buckets, ranked, shares.filter("share_real > 90"), spark.createDataFrame([("f", "Prosa.")], "film string, text string"), tone).orderBy("ord").collect()]
    plain = [x.replace(" · ~79% das notas", "") for x in body]
    assert told("narrativo") == [config.DISCLAIMER_QUOTAS, *plain, "Prosa.", "total de reviews: 40"]
    assert told("ambos") == [config.DISCLAIMER_QUOTAS, *plain, "x: ~5 de 9", "Prosa.", "total de reviews: 40"]
    with pytest.raises(ValueError):
        records.report_lines(buckets, ranked, shares, tone="other")
    listed = spark.createDataFrame([(1, "zz"), (2, "f")], "place int, film string")
    assert [json.loads(r.document)["film"] for r in compare.bundle(docs, listed).collect()] == ["f"]


def test_documents_are_written_and_read_again(spark, tmp_path):
    docs = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "film string, levels array<int>")
    compare.write_documents(docs, str(tmp_path / "d"))
    back = spark.read.schema("levels array<int>, film string").json(str(tmp_path / "d"))
    assert {(r.film, tuple(r.levels)) for r in back.collect()} == {("a", (1, 2)), ("b", (3,))}


def test_fluency(spark):
    rows = [(1, "O filme é bom. O filme destaca. Curto! Elogiam intensamente o elenco todo hoje."), (2, ""), (3, None)]
    found = {r.doc_id: r for r in records.fluency(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    r = found[1]
    assert (r.n_sentences, r.shortest, r.repeated_openings, r.report_verbs, r.intensifiers) == (4, 1, 1, 2, 1)
    assert r.mean_words == 3.5 and r.length_cv == 0.52
    assert all((found[k].n_sentences, found[k].mean_words, found[k].shortest) == (0, 0.0, 0) for k in (2, 3))


PAGE = """<article class="production-viewing"><span class="inline-rating">★★★½</span><p data-likeable-identifier='{"uid": "viewing:1"}'></p><div class="body-text" lang="en">Good<br>film &amp; more</div></article>
<article class="production-viewing"><span class="rating rated-4"></span><div class="js-review-body collapsed-text" data-full-text-url="/s/full-text/viewing:22/">Cut…</div></article>
<article class="production-viewing"><div class="body-text">This review may contain spoilers. I can handle the truth.</div><p data-likeable-identifier="{bad"></p></article>
<article class="production-viewing"><span class="rating">½</span><div class="body-text">short...</div></article>"""
TITLES = ["456 half-★ ratings (0%)", "1,037 ★ ratings", "No ★½ ratings"]


def test_html(spark):
    found = html.read_reviews(spark.createDataFrame([("f", 1, PAGE), ("f", 2, None)], "film string, page int, html string")).orderBy("pos").collect()
    assert [(r.rating, r.review_id, r.truncated, r.spoiler) for r in found] == [(3.5, "viewing:1", False, False), (2.0, "viewing:22", True, False), (None, None, False, True), (0.5, None, True, False)]
    assert found[0].text == "Good film & more" and found[0].lang == "en"
    names = ["half-★", "★", "★½", "★★", "★★½", "★★★", "★★★½", "★★★★", "★★★★½", "★★★★★"]
    table = lambda ns: '<table class="chart"><tbody>' + "".join(f'<tr><th>{n}</th><td><span class="barcolumn" title="{TITLES[i % 3]}"></span></td></tr>' for i, n in enumerate(ns)) + "</tbody></table>"
    pages = spark.createDataFrame([("ok", table(names)), ("few", table(names[:9])), ("none", "<p>"), ("twice", table([*names, "★"]))], "film string, html string")
    rows = html.read_histograms(pages).collect()
    assert {r.film for r in rows} == {"ok", "twice"} and {r.level: r.n for r in rows if r.film == "twice"}[1.0] == 1037
    assert sorted(r.n for r in rows if r.film == "ok") == [0, 0, 0, 456, 456, 456, 456, 1037, 1037, 1037]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(records.slug_title(F.lit("the-invite-2026"))) == "the invite" and one(records.slug_year(F.lit("the-invite-2026"))) == 2026
    assert one(records.slug_title(F.lit("cure"))) == "cure" and one(records.slug_year(F.lit("cure"))) is None
    assert one(records.record_key(F.lit("Cidade de Deus!"), F.lit(2002))) == "cidade_de_deus_2002"
    assert [one(records.level_path(F.lit(x))) for x in (3.0, 3.5)] == ["3", "3.5"]
    assert [one(records.is_latin(F.lit(x))) for x in ("José-Ñ", "黒沢清", "12", "aб")] == [True, False, False, False]
    crew = F.array(F.struct(F.lit("Writer").alias("job"), F.lit("w").alias("name")), F.struct(F.lit("Director").alias("job"), F.lit("d").alias("name")))
    assert one(records.director(crew)) == "d"
    assert one(compare.grouped_digits(F.lit(12345678))) == "12.345.678" and one(compare.star_band(F.lit(0.5), F.lit(3.0))) == "0,5–3"
    assert one(compare.version_at_least(F.lit("m-2.5-x"), 2, 5)) and not one(compare.version_at_least(F.lit("m-2.4"), 2, 5)) and not one(compare.version_at_least(F.lit("m"), 2, 5))


def test_calls_retry_and_give_up(spark):
    def model(system, user):
        return "```json\n{\"a\": 1}\n```" if user == "fenced" else "no json"

    found = {r.message: (r.answer, r.n_calls) for r in calls.ask(spark.createDataFrame([("fenced",), ("bad",)], "message string"), model).collect()}
    assert found == {"fenced": ('{"a": 1}', 1), "bad": (None, 2)}


def test_stream_agrees_with_table(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id * 3) AS ts, id % 2 AS film, (id % 10 + 1) / 2D AS level FROM range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = votes.windowed_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("votes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, votes.windowed_histogram(rows).collect()))


def test_search_hits_and_records(spark):
    page = '<ul><li data-film-slug="a-1999" data-film-name="A" data-film-release-year="1999"></li><li data-film-slug="b">B (2001)</li><li data-film-slug="c">C</li></ul>'
    found = html.read_search(spark.createDataFrame([("q", page)], "query string, html string")).orderBy("rank").collect()
    assert [(r.slug, r.name, r.year) for r in found] == [("a-1999", "A", 1999), ("b", "B (2001)", 2001), ("c", "C", None)]
    details = [("f", "", "Cure", "", "Synopsis", [("drama",)], [("Director", "黒沢清")], [("Director", "Kiyoshi Kurosawa")], "1997-12-27"), ("g", "G", "", "Sinopse", None, [], [], [], None)]
    schema = "film string, title string, original_title string, overview string, overview_en string, genres array<struct<name:string>>, crew array<struct<job:string,name:string>>, crew_en array<struct<job:string,name:string>>, release_date string"
    rows = {r.film: r for r in records.film_records(spark.createDataFrame(details, schema)).collect()}
    assert tuple(rows["f"]) == ("f", "Cure", ["drama"], "Kiyoshi Kurosawa", True, "Synopsis", True, 1997)
    assert tuple(rows["g"]) == ("g", "G", [], None, False, "Sinopse", False, None)


def test_unusable_replies_leave_the_answer_before_them(spark):
    """Faulty, then unreadable: the faulty answer stays, and the calls end."""
    check = lambda rows: rows.withColumn("found", F.when(F.col("reply") == "bad", F.array(F.lit("fault"))).when(F.col("reply") == "?", F.array(F.lit(rounds.UNUSABLE))).otherwise(F.array().cast("array<string>")))
    script = lambda system, user: ({"a": "bad", "b": "?", "c": "good", "d": ""}[user] if "!" not in system else {"a": "?"}[user])
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "message string")
    found = {r.message: (r.answer, r.faults, r.n_calls, r.history) for r in rounds.in_rounds(rows, script, check, "s", {"fault": "!"}, retries=1, repairs=0).collect()}
    assert found == {
        "a": ("bad", ["fault"], 2, ["fault", "sem_resposta"]), "b": (None, ["sem_resposta"], 1, ["sem_resposta"]), "c": ("good", [], 1, []), "d": (None, ["sem_resposta"], 1, ["sem_resposta"]),
    }
    assert rounds.in_rounds(rows.limit(0), script, check).count() == 0


BUCKETS = "film string, bucket string, mode string, n_valid int, message string"


def test_synthesis_calls_and_flags(spark):
    good = '{"temas": [{"tema": "ritmo", "mencoes_aproximadas": "3"}], "observacao_geral": "O filme é lento para esse grupo."}'
    english = '{"temas": [], "observacao_geral": "It is the view of the group and it was for this."}'
    script = {"good": [good], "english": [english, good], "stubborn": [english, english], "broken": ["{", good], "never": ["{", "{"], "worse": [english, "{"], "scope": [good.replace("O filme", "O consenso é que o filme"), good]}
    seen = spark.sparkContext.accumulator(0)

    def model(system, user):
        seen.add(1)
        return script[user][min(system.count("!"), 1)] if user != "broken" else good

    rows = spark.createDataFrame([("f", k, "completo", 9, k) for k in script] + [("f", "skipped", "sem_analise", 2, "boom")], BUCKETS)
    found = {r.bucket: r for r in calls.synthesized(rows, model, "s", "!").collect()}
    assert {k: (r.n_calls, r.language_invalid, r.scope_suspect, len(r.themes)) for k, r in found.items()} == {
        "good": (1, False, False, 1), "english": (2, False, False, 1), "stubborn": (2, True, False, 0), "broken": (1, False, False, 1), "never": (2, False, False, 0), "worse": (3, True, False, 0), "scope": (2, False, False, 1),
        "skipped": (0, False, False, 0),
    }
    # calls are made once, whatever is read afterwards
    assert seen.value == sum(r.n_calls for r in found.values())
    assert calls.calls_where_none_is_due(spark.createDataFrame([("sem_analise", 0), ("completo", 1), ("sem_analise", 1)], "mode string, n_calls int")).count() == 1


def test_narratives_are_asked_again_with_what_failed(spark):
    known = spark.createDataFrame([("f", "negativas", "ritmo", 40, 2)], "film string, bucket string, theme string, pct int, force int")
    prose = "A grande maioria das notas (~80%) gosta. Uma minoria das notas (~15%) hesita, quem ficou no meio. Uma pequena minoria das notas (~5%) recusa. Para eles, \"é\" lento."
    good = {"narrativa": prose, "quantificadores_usados": [{"quantificador": "muitos", "tema": "ritmo"}, 3], "consensos_usados": [{"propriedade": "p", "grupos_de_origem": ["negativas"], "temas_de_origem": ["ritmo"]}]}
    script = {
        "good": [good], "inflated": [good | {"quantificadores_usados": [{"quantificador": "quase todos", "tema": "ritmo"}]}, good], "invented": [good | {"consensos_usados": [{"grupos_de_origem": ["negativas"], "temas_de_origem": ["x"]}]}] * 2,
        "strong": [good | {"narrativa": prose + " Quase todos concordam."}, good], "unmarked": [good | {"narrativa": prose.replace("Para eles, ", "")}, good], "public": [good | {"narrativa": prose + " Uma minoria do público ri."}] * 2,
    }
    model = lambda system, user: json.dumps(script[user][min(system.count("!"), len(script[user]) - 1)])
    shares = {"negativas": "neg", "medianas": "med", "positivas": "pos"}
    rows = spark.createDataFrame([("f" if k != "lone" else "g", k, 5, 15, 80) for k in script], "film string, message string, neg int, med int, pos int").withColumn("film", F.concat("film", "message"))
    every = known.crossJoin(rows.select(F.col("film").alias("own"))).withColumn("film", F.col("own")).drop("own")
    words = {f: "!" for f in ("quantificador", "consenso", "perspectiva_nao_marcada", "vocabulario_peso")}
    found = {r.message: r for r in calls.narrated(rows, model, every, shares, "s", words).collect()}
    assert {k: (r.n_calls, r.faults) for k, r in found.items()} == {
        "good": (1, []), "inflated": (2, []), "invented": (2, ["consenso"]), "strong": (2, []), "unmarked": (2, []), "public": (2, ["vocabulario_peso"]),
    }
    assert '"' not in found["good"].text and [q.tema for q in found["good"].quantificadores_usados] == ["ritmo"]


def test_edits_that_never_pass_leave_the_raw_text(spark):
    raw = "Uma minoria das notas (~15%) hesita, e o ritmo do filme é lento."
    said = []

    def model(system, user):
        said.append(system)
        return raw.replace("15", "16") if "números" not in system else "{ texto }"

    rows = spark.createDataFrame([(raw,), ("",), (None,)], "raw string").withColumn("protected", F.array().cast("array<string>"))
    found = {r.raw: r for r in calls.edited(rows, model, None, "s", {"numeros_alterados": " números", "formato_invalido": " formato"}, retries=2).collect()}
    assert (found[raw].text, found[raw].discarded, found[raw].n_calls, found[raw].history) == (raw, True, 3, ["numeros_alterados", "formato_invalido", "formato_invalido"])
    assert all(found[x].discarded and found[x].n_calls == 0 for x in ("", None))


def test_answers_name_places_of_their_batch(spark):
    told = spark.createDataFrame([("f", "b", 0, 3, '{"1": ["x", "y", "x"], "4": ["x"], "z": [], "2": []}'), ("f", "b", 1, 1, None)], "film string, bucket string, batch int, n_rows int, answer string")
    found = {(r.batch, r.place): (r.theme_ids, r.n_invalid) for r in themes.valid_answers(told, ["x"]).collect()}
    assert found == {(0, 1): (["x", "x"], 1), (0, 2): ([], 0), (0, 3): ([], 0), (1, 1): (None, 0)}


def test_documents_are_read_back_as_written(spark, tmp_path):
    documents = spark.createDataFrame([("a", 3, [("negativas", 7)]), ("b", 4, []), ("c", None, None)], "film string, total bigint, buckets array<struct<bucket:string,share_real:int>>")
    compare.write_documents(documents, str(tmp_path / "d"))
    back = spark.read.schema("total bigint, buckets array<struct<bucket:string,share_real:int>>, film string").json(str(tmp_path / "d"))
    key = lambda r: r.film
    assert sorted(back.select(*documents.columns).collect(), key=key) == sorted(documents.collect(), key=key)
    without = records.apply_distribution(documents, None)
    assert [b.share_real for r in without.collect() for b in r.buckets or []] == [None]


def test_text_of_a_page(spark):
    pages = [("<html><head><title>T</title><style>p {}</style></head><body><p>One  <b>two</b>&amp;three</p><script>x()</script><br>four</body>", "T One two &three four"), ("", ""), (None, ""), ("no tags", "no tags"), ("<p>open <i>tag", "open tag")]
    found = spark.createDataFrame([(h,) for h, _ in pages], "html string").select("html", html.page_text("html").alias("t")).collect()
    assert [r.t for r in found] == [t for _, t in pages]


def test_text_with_cut_references(spark):
    """References count with their semicolon alone; what is cut off, unknown or no reference stays as written."""
    pages = [
        ("<title>a&amp;&amp b&amp</title><p>c &lt;d&gt &copy;&copy x&am", "a&&amp b&amp c <d&gt ©&copy x&am"), ("<a href='?x=1&amp=2'>&#65;&#65 &#x42;&#x42</a>", "A&#65 B&#x42"),
        ("<script>a && b</script>&notit; &unknown; & &&amp;lt;", "&notit; &unknown; & &&lt;"), ("\ufdd0&amp&amp;\ufdd0\ufdd2\ufdd1", "\ufdd0&amp&\ufdd0\ufdd2\ufdd1"), (None, ""), ("", ""),
    ]
    found = spark.createDataFrame([(h,) for h, _ in pages], "html string").select(html.page_closed_text("html").alias("t")).collect()
    assert [r.t for r in found] == [t for _, t in pages]


def test_html_text_of_a_cut_title(spark, tmp_path):
    """The query and its SQL on a page whose title and heading end within an entity."""
    page = '<!DOCTYPE html><html lang="en"><head><title>A&amp;&amp;&amp; and&amp</title><style>p{}</style></head><body><h1>A&amp;&amp;&amp; and&amp</h1><p>t &copy; &quot;x&quot;</p>'
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in catalogue.html_text(spark, str(tmp_path)).collect()] == con.execute(catalogue.ORACLES["html_text"]).fetchall() == [(1, 'A&&& and&amp A&&& and&amp t © "x"')]


def test_calls_are_spread_over_the_cores(spark):
    """Rows of one file partition are asked in many tasks, in every round."""

    def model(system, user):
        return f"{system}{TaskContext.get().partitionId()}"

    def check(rows):
        return rows.withColumn("found", F.when(F.contains("system", F.lit("!")), F.array().cast("array<string>")).otherwise(F.array(F.lit("fault"))))

    rows = spark.range(400).select(F.col("id").cast("string").alias("message")).coalesce(1)
    found = rounds.in_rounds(rows, model, check, "", {"fault": "!"}).collect()
    assert sorted(int(r.message) for r in found) == list(range(400)) and {r.n_calls for r in found} == {2}
    assert len({r.answer for r in found}) >= 4 == spark.sparkContext.defaultParallelism


def test_pages_are_parsed_a_slice_at_a_time(spark):
    """A worker holds the rows of a slice of pages, not of its whole batch: 1,000 pages whose rows have 200 KB each."""

    def parse(page):
        return [{"mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "page": page, "left_out": page[:1] * 200_000}]

    pages = spark.range(1000, numPartitions=1).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("html"))
    found = html._rows(pages, parse, "mb long, page string").collect()
    assert sorted((r.id, r.page) for r in found) == [(k, f"p{k}") for k in range(1000)]
    assert max(r.mb for r in found) - min(r.mb for r in found) < 100
    texts = spark.range(200, numPartitions=1).select("id", html.page_text(F.concat(F.lit("<p>"), F.col("id").cast("string"))).alias("t")).collect()
    assert [r.t for r in texts] == [str(r.id) for r in texts] and len(texts) == 200
