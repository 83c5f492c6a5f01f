import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tierloom.functions import labels, matching, spans, text
from tierloom.operators import edits


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


QUANTIFIERS = {"poucos": (0, 5, 9), "alguns": (10, 24, 25), "muitos": (26, 49, 50), "cerca de metade": (51, 59, 60), "a maioria": (61, 79, 80), "quase todos": (81, 100)}
WEIGHTS = {"uma fração mínima": (0, 4), "uma pequena minoria": (5, 9), "uma minoria": (10, 24, 25), "uma parcela expressiva": (26, 44, 45), "a maioria": (46, 69, 70), "a grande maioria": (71, 100)}


@pytest.mark.parametrize(("table", "label"), [(QUANTIFIERS, labels.quantifier_label), (WEIGHTS, labels.weight_label)])
def test_bands(spark, table, label):
    rows = spark.createDataFrame([(p, name) for name, ps in table.items() for p in ps], "p int, name string")
    assert rows.filter(label(F.col("p")) != F.col("name")).count() == 0
    assert value(spark, label(F.lit(None).cast("int"))) is None


def test_force_phrase_and_weaker_labels(spark):
    assert value(spark, labels.quantifier_force(F.lit(67))) == 4
    assert value(spark, labels.weight_phrase(F.lit(79))) == "a grande maioria das notas (~79%)"
    assert value(spark, labels.labels_up_to(F.lit(12))) == ["uma fração mínima", "uma pequena minoria", "uma minoria"]


@pytest.mark.parametrize(("pct", "dominant", "marking"), [(79, 79, "nenhuma"), (30, 90, "simples"), (31, 90, "nenhuma"), (50, 90, "nenhuma"), (9, 90, "antecipada"), (10, 90, "simples"), (5, 0, "nenhuma"), (5, None, "nenhuma"), (3, 79, "antecipada"), (17, 79, "simples")])
def test_marking(spark, pct, dominant, marking):
    assert value(spark, labels.perspective_marking(F.lit(pct), F.lit(dominant).cast("int"))) == marking


@pytest.mark.parametrize(("phrase", "force"), [("Quase todos os elogios", 5), ("mais da metade", 4), ("metade", 3), ("aproximadamente metade", 3), ("uma parte", 1), ("Poucas", 0), ("uns", None), ("", None)])
def test_declared_force(spark, phrase, force):
    assert value(spark, labels.declared_force(F.lit(phrase))) == force


@pytest.mark.parametrize(("part", "whole", "pct"), [(15, 30, 50), (1, 3, 33), (2, 3, 67), (0, 0, 0), (1, 8, 12), (3, 8, 38), (5, -1, 0)])
def test_percent_rounds_halves_to_even(spark, part, whole, pct):
    assert value(spark, labels.percent(F.lit(part), F.lit(whole))) == pct


@pytest.mark.parametrize(("n", "target", "mode"), [(2, 20, "sem_analise"), (3, 20, "reduzido"), (19, 20, "reduzido"), (20, 20, "completo"), (30, 30, "completo")])
def test_mode(spark, n, target, mode):
    assert value(spark, labels.bucket_mode(F.lit(n), F.lit(target))) == mode


@pytest.mark.parametrize(("level", "bucket"), [(0.5, "negativas"), (2.5, "negativas"), (3.0, "medianas"), (3.5, "medianas"), (4.0, "positivas"), (5.0, "positivas"), (0.0, None), (None, None)])
def test_bucket(spark, level, bucket):
    assert value(spark, labels.bucket_of(F.lit(level).cast("double"))) == bucket


def test_quotes(spark):
    for source, clean, had in (('a \\"b\\"  c', "a b c", True), ("no quotes  here", "no quotes  here", False), ("“x” ‘y’", "x y", True), ("back\\slash", "back\\slash", False)):
        c, h = text.strip_quotes(F.lit(source))
        assert (value(spark, c), value(spark, h)) == (clean, had)


def test_sentences_and_numbers(spark):
    assert value(spark, text.sentences(F.lit("Um. Dois!? Três\nquatro"))) == ["Um.", "Dois!?", "Três\nquatro"]
    assert value(spark, text.sentences(F.lit(""))) == []
    assert value(spark, text.number_tokens(F.lit("b 9 a 10% ~79 % 1.000,5 9"))) == sorted(["9 ", "10%", "79 %", "1.000,5 ", "9"])


def test_language(spark):
    words = text.bare_words(F.lit(' "The end," (of) de! '))
    assert value(spark, words) == ["the", "end", "of", "de"]
    assert value(spark, text.count_among(words, text.STOPWORDS_EN)) == 2
    assert value(spark, text.bare_words(F.lit("A  «Não» ... 'É' (um)\tDIA!? ΟΔΟΣ."))) == ["a", "«não»", "", "é", "um", "dia", "οδος"]
    assert value(spark, text.bare_words(F.lit(""))) == [""]


def test_report_verbs_begin_words(spark):
    told = "Elogiam e DESTACAM; não reelogiam. Apontou-se, á_relata 2relata «relata» Éexpress express"
    assert value(spark, text.report_verbs(F.lit(told))) == len(re.findall(r"(?i)\b(?:" + "|".join(text.REPORT_STEMS) + r")\w*", told)) == 5
    assert value(spark, text.report_verbs(F.lit(""))) == 0
    for pt, en, label in ((0, 0, "indeterminado"), (2, 1, "pt-BR"), (1, 2, "en"), (1, 1, "misto/ambíguo")):
        assert value(spark, text.language_label(F.lit(pt), F.lit(en))) == label
    assert value(spark, text.language_ok(F.lit(0), F.lit(0))) and not value(spark, text.language_ok(F.lit(0), F.lit(1)))


def test_word_runs_guard_short_texts(spark):
    assert value(spark, text.word_runs(text.masked_words(F.lit("one two three")))) == []
    assert value(spark, text.word_runs(text.masked_words(F.lit("a b c d e f g h A b 12%")))) == ["a b c d e f g h", "b c d e f g h a", "c d e f g h a b"]


def test_wrapped_format(spark):
    bad = ['{ text: "x" }', "[1]", "a ``` b", 'ok\n"text": value', "narrativa: prosa", "a { b"]
    good = ["", "A prosa {assim} segue.", "um\ndois\ntrês\ncampo: depois"]
    assert all(value(spark, text.wrapped_format(F.lit(x))) for x in bad)
    assert not any(value(spark, text.wrapped_format(F.lit(x))) for x in good)


def test_percent_inside_another_is_no_anchor(spark):
    assert value(spark, text.guarded_percent_at(F.lit("são 91% das notas"), F.lit(1))) == 0
    assert value(spark, text.guarded_percent_at(F.lit("são ~1% das notas"), F.lit(1))) > 0
    assert value(spark, spans.anchor(F.lit("são 91% e depois 1%"), F.lit(1))) == 18
    assert value(spark, spans.anchor(F.lit("Uma Minoria, ~12%"), F.lit(12))) == 1
    assert value(spark, spans.anchor(F.lit("nada"), F.lit(12))) is None


def test_marks(spark):
    found = value(spark, spans.marks(F.lit("ab12%c~3 % 1234%"), spans.PERCENT))
    assert [(m.place, m.token) for m in found] == [(3, "12%"), (7, "~3 %"), (13, "234%")]
    assert value(spark, spans.marks(F.lit(""), "x")) == []


@pytest.fixture(scope="module")
def verdict(spark):
    def of(prose, shares=(3, 17, 79)):
        rows = spark.createDataFrame([(prose, *shares)], "text string, negativas int, medianas int, positivas int")
        return spans.with_marker_verdict(rows, "text", {b: b for b in ("negativas", "medianas", "positivas")}, "v").first().v

    return of


GOOD = "A grande maioria das notas (~79%) gostou. No meio, uma minoria das notas (~17%): quem ficou no meio hesita. Uma fração mínima das notas (~3%) discorda. Para eles, é lento."


@pytest.mark.parametrize(
    ("prose", "said"),
    [
        (GOOD, "ok"), (GOOD.replace("Para eles, é", "É"), "unmarked:negativas"), (GOOD.replace("Para eles, é lento", "É lento. Muito mesmo. Para eles"), "late:negativas"),
        (GOOD.replace("Para eles, é lento", "É lento.Para eles, muito"), "ok"), ("Nada.", "unanchored:negativas"), (None, "unanchored:negativas"),
        ("Fim." + GOOD[GOOD.index("Uma fração") :].replace(" Para eles, é", " É. Para eles,") + " Uma minoria das notas (~17%): quem ficou no meio hesita.", "late:negativas"),
    ],
)
def test_marker_verdicts(verdict, prose, said):
    assert verdict(prose) == said


def test_groups_without_a_share_need_no_mark(verdict):
    assert verdict("Nada.", (None, None, None)) == "ok"
    assert verdict("Nada.", (50, 60, 70)) == "ok"


def test_weight_vocabulary_and_case(spark):
    ok = lambda x: value(spark, spans.vocabulary_ok(F.lit(x)))
    assert not ok("A grande maioria das reviews elogia") and not ok("do público, ~79% gostou")
    assert ok("a grande maioria das notas, diz o público") and ok("a maioria das reviews analisadas") and ok("") and ok(None)
    # the noun has to lie in the window as a whole
    assert not ok("uma minoria" + "x" * 33 + "reviews") and ok("uma minoria" + "x" * 34 + "reviews")
    assert not ok("reviews" + "x" * 53 + "9%") and ok("reviews" + "x" * 54 + "9%")
    lowered = value(spark, spans.labels_lowered(F.lit("Já Uma pequena minoria. A grande maioria! Para A maioria")))
    assert lowered == "Já uma pequena minoria. A grande maioria! Para a maioria"


def spread(n, seed, letters="abcdefgh XYZ.,"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def edited(a, seed):
    rng, b = random.Random(seed), list(a)
    for _ in range(rng.randint(0, 10)):
        k = rng.randint(0, len(b))
        b[k : k + rng.randint(0, 6)] = spread(rng.randint(0, 4), k)
    return "".join(b)


def test_ratio_is_the_library_s():
    """Short texts, and long ones whose frequent characters begin no block."""
    for seed in range(400):
        a = spread(seed * 3 % 600, seed, "ab" if seed % 3 == 0 else "abcdefgh XYZ.,")
        b = spread(seed % 500, -seed) if seed % 7 == 0 else edited(a, seed)
        assert matching.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    assert matching.ratio("", "") == 1.0 and matching.ratio("", "a") == 0.0
    long = " ".join(f"w{k * k % 7919}" for k in range(18000))
    changed = long[:50000] + "!" + long[50003:90000] + " new words " + long[90000:]
    assert len(long) > 90000 and matching.ratio(long, changed) == difflib.SequenceMatcher(None, long, changed).ratio()


def test_similarity_and_its_bound(spark):
    rows = [("a  b", "a b"), ("abcd", "bcde"), ("", ""), (None, "x"), ("uma frase longa que muda", "a frase longa mudou, sim"), ("\u2003a\x1fb\xa0\x85", " a b"), ("same", "same")]
    rows += [(x := spread(300, k), edited(x, k)) for k in range(40)] + [("ab" * 90, "ba" * 90)]
    plain = lambda x: " ".join((x or "").split())
    told = spark.createDataFrame(rows, "a string, b string")
    ratios = lambda r: difflib.SequenceMatcher(None, plain(r.a), plain(r.b)).ratio()
    for r in edits.with_similarity(told, "a", "b").collect():
        assert r.similarity == ratios(r) and r.bound >= r.similarity - 1e-12
    few = edits.with_similarity(told, "a", "b", F.col("a") != "same", 0.97).collect()
    for r in few:
        assert (r.similarity is None) == (r.bound < 0.97 or r.a in (None, "same")) and (r.similarity is not None or ratios(r) < 0.97 or r.a == "same")
        assert r.similarity in (None, ratios(r))
    assert any(r.similarity is None for r in few) and any(r.similarity for r in few)
