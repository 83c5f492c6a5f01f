"""The flows that call a model: any function (system, user) to text. There is no network here.

:func:`keyword_model` is the offline default; prompts and reinforcements are parameters.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import spans, text
from tierloom.operators import edits, themes
from tierloom.operators.rounds import UNUSABLE, Model, in_rounds


def keyword_model(keywords: dict[str, tuple[str, ...]]) -> Model:
    """Answers a numbered message with the themes of each line."""

    def call(system: str, user: str) -> str:
        found = {}
        for line in user.split("\n"):
            if numbered := re.match(r"\[(\d+)\] (.*)", line):
                found[numbered[1]] = [t for t, words in keywords.items() if any(w in numbered[2].lower() for w in words)]
        return json.dumps(found)

    return call


def _faults(**bad: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in bad.items()))).cast("array<string>")


def _json_faults(otherwise: Column) -> Column:
    return F.when(F.try_parse_json("reply").isNull(), F.array(F.lit(UNUSABLE))).otherwise(otherwise)


def ask(messages: DataFrame, model: Model, system: str = "", calls: int = 2) -> DataFrame:
    """Adds answer (valid JSON text, or null when no call gave any) and n_calls to rows with ``message``."""
    check = lambda rows: rows.withColumn("found", _json_faults(F.array().cast("array<string>")))
    return in_rounds(messages, model, check, system, retries=0, repairs=calls - 1).drop("faults", "history")


#: Of an answer, what is read; anything else in it is ignored.
SYNTHESIS = "temas array<struct<tema:string,mencoes_aproximadas:string,exemplo_parafraseado:string>>, observacao_geral string"


def synthesized(buckets: DataFrame, model: Model, system: str = "", reinforcement: str = " ") -> DataFrame:
    """Buckets (film, bucket, mode, n_valid, message) get themes, observation, language_invalid, scope_suspect and n_calls.

    A bucket in mode sem_analise is never sent to the model. Others are asked once, once more if the answer is no JSON,
    and once more, reinforced, if language or scope are wrong; what is wrong then is only flagged, and an
    unreadable second answer leaves the first in place.
    """
    empty = buckets.filter(F.col("mode") == "sem_analise")

    def check(rows: DataFrame) -> DataFrame:
        told = rows.withColumn("__told", F.from_json("reply", SYNTHESIS))
        whole = F.concat_ws(" ", F.concat_ws(" ", F.transform("__told.temas", lambda t: t["tema"])), F.concat_ws(" ", F.transform("__told.temas", lambda t: t["exemplo_parafraseado"])), "__told.observacao_geral")
        language = text.language_fits(text.bare_words(whole))
        scope = text.has_any(F.coalesce("__told.observacao_geral", F.lit("")), text.SCOPE_MARKERS)
        return told.withColumn("found", _json_faults(_faults(idioma=~language, escopo=scope))).drop("__told")

    asked = in_rounds(buckets.filter(F.col("mode") != "sem_analise"), model, check, system, {"idioma": reinforcement, "escopo": reinforcement})
    told = F.from_json("answer", SYNTHESIS)
    answered = asked.select(
        *buckets.columns, F.coalesce(told["temas"], F.array()).alias("themes"), F.when(F.col("answer").isNull(), "sem JSON válido").otherwise(F.coalesce(told["observacao_geral"], F.lit(""))).alias("observation"),
        F.array_contains("faults", "idioma").alias("language_invalid"), F.array_contains("faults", "escopo").alias("scope_suspect"), "n_calls",
    )
    none = F.array().cast("array<struct<tema:string,mencoes_aproximadas:string,exemplo_parafraseado:string>>")
    note = F.concat(F.lit("sem análise temática: "), F.col("n_valid").cast("string"), F.lit(f" válidas (piso {config.FLOOR_PER_BUCKET})"))
    return answered.unionByName(empty.select(*buckets.columns, none.alias("themes"), note.alias("observation"), F.lit(False).alias("language_invalid"), F.lit(False).alias("scope_suspect"), F.lit(0).alias("n_calls")))


def calls_where_none_is_due(buckets: DataFrame) -> DataFrame:
    """Buckets in mode sem_analise for which the model was called all the same; there should be none."""
    return buckets.filter((F.col("mode") == "sem_analise") & (F.col("n_calls") > 0))


#: The declarations of a narrative and their fields.
DECLARED = {"consensos_usados": "propriedade string, grupos_de_origem array<string>, temas_de_origem array<string>", "quantificadores_usados": "quantificador string, tema string", "marcadores_perspectiva": "grupo string, trecho string"}


def declared(answer: Column, name: str) -> Column:
    """A list that an answer declares: entries that are no objects are dropped, fields are text, missing ones empty."""
    fields = [f.split(" ", 1) for f in DECLARED[name].split(", ")]
    entries = F.from_json(F.get_json_object(answer, f"$.{name}"), "array<string>")
    objects = F.filter(F.coalesce(entries, F.array().cast("array<string>")), lambda x: x.startswith("{"))

    def typed(x: Column) -> Column:
        told = lambda f: F.get_json_object(x, f"$.{f}")
        none = F.array().cast("array<string>")
        return F.struct(*(F.coalesce(told(f), F.lit("")).alias(f) if kind == "string" else F.coalesce(F.from_json(told(f), "array<string>"), none).alias(f) for f, kind in fields))

    return F.transform(objects, typed)


def declaration_faults(rows: DataFrame, known: DataFrame) -> DataFrame:
    """film, __declared: faults of what the replies of films declare about themes (``known``: film, bucket, theme, pct, force)."""
    told = rows.select("film", F.posexplode_outer(declared(F.col("reply"), "quantificadores_usados")).alias("claim", "q")).filter("q IS NOT NULL")
    claims = told.select("film", "claim", F.col("q.quantificador").alias("quantifier"), F.col("q.tema").alias("theme"))
    inflated = themes.check_quantifiers(claims, known).groupBy("film").agg(F.bool_or(F.col("verdict") != "ok").alias("inflated"))
    items = rows.select("film", F.posexplode_outer(declared(F.col("reply"), "consensos_usados")).alias("item", "c")).filter("c IS NOT NULL")
    consensus = items.select("film", "item", F.col("c.grupos_de_origem").alias("groups"), F.col("c.temas_de_origem").alias("themes"))
    invented = themes.check_consensus(consensus, known).groupBy("film").agg(F.bool_or(~F.col("valid")).alias("invented"))
    prose = rows.select("film", F.coalesce(F.get_json_object("reply", "$.narrativa"), F.lit("")).alias("text"))
    strong = themes.strong_phrase_without_support(prose, known).select("film", (~F.col("ok")).alias("strong"))
    both = strong.join(inflated, "film", "left").join(invented, "film", "left")
    return both.select("film", _faults(quantificador=F.col("strong") | F.coalesce("inflated", F.lit(False)), consenso=F.coalesce("invented", F.lit(False))).alias("__declared"))


def narrated(films: DataFrame, model: Model, known: DataFrame, shares: dict[str, str] | None = None, system: str = "", reinforcements: dict[str, str] | None = None) -> DataFrame:
    """Films (film, message, columns of ``shares``) get text (without quotation marks), faults, the lists of ``DECLARED`` and n_calls.

    One call for a film, one more if the answer is no JSON, and one more, with the reinforcements of all that failed, if any
    check does: those of :func:`edits.with_honesty`, strong phrases, quantifiers and consensus. What fails then is kept as faults.
    """

    def check(rows: DataFrame) -> DataFrame:
        prose = text.strip_quotes(F.coalesce(F.get_json_object("reply", "$.narrativa"), F.lit("")))[0]
        honest = edits.with_honesty(rows.withColumn("__prose", prose), "__prose", shares or {}, "__honesty")
        both = honest.join(declaration_faults(rows, known), "film", "left")
        return both.withColumn("found", _json_faults(F.concat("__honesty", F.coalesce("__declared", F.array().cast("array<string>"))))).drop("__prose", "__honesty", "__declared")

    asked = in_rounds(films, model, check, system, reinforcements)
    clean = text.strip_quotes(F.coalesce(F.get_json_object("answer", "$.narrativa"), F.lit("")))[0]
    return asked.select(*films.columns, clean.alias("text"), "faults", *(declared(F.col("answer"), n).alias(n) for n in DECLARED), "n_calls")


def editor_message(prose: Column, protected: Column) -> Column:
    """All that an editor is told: the text and the spans that must stay."""
    listed = F.when(F.size(protected) > 0, F.array_join(F.transform(protected, lambda p: F.concat(F.lit("- "), p)), "\n")).otherwise("(nenhum)")
    return F.concat_ws("\n", F.lit("TEXTO A EDITAR:"), prose, F.lit(""), F.lit("TRECHOS PROTEGIDOS (reproduza cada um EXATAMENTE):"), listed)


def edited(narratives: DataFrame, model: Model, shares: dict[str, str] | None = None, system: str = "", reinforcements: dict[str, str] | None = None, retries: int = config.EDIT_RETRIES) -> DataFrame:
    """Narratives (raw, protected, columns of ``shares``) get text, discarded, history and n_calls.

    An edit is asked for up to ``1 + retries`` times, each time with the reinforcements of all that failed so far. The first that
    passes :func:`edits.edit_verdicts` is taken, its capitals put right; if none does, the raw text stays.
    Empty texts are not sent.
    """
    blank = F.coalesce(text.stripped(F.col("raw")), F.lit("")) == ""

    def check(rows: DataFrame) -> DataFrame:
        judged = edits.edit_verdicts(rows.withColumn("edited", F.coalesce("reply", F.lit(""))), shares)
        return judged.withColumn("found", F.when(F.col("verdict") == "aceita", F.array().cast("array<string>")).otherwise(F.array("verdict")))

    # what is wrong with the raw text is found once, not in every round
    told = edits.with_raw_faults(narratives.filter(~blank), shares).withColumn("message", editor_message(F.col("raw"), F.col("protected")))
    asked = in_rounds(told, model, check, system, reinforcements, retries=retries, repairs=retries, most_calls=1 + retries)
    taken = F.size("faults") == 0
    own = F.when(taken, spans.labels_lowered(text.strip_quotes(F.col("answer"))[0])).otherwise(F.col("raw"))
    done = asked.select(*narratives.columns, own.alias("text"), (~taken).alias("discarded"), "history", "n_calls")
    return done.unionByName(narratives.filter(blank).select("*", F.lit("").alias("text"), F.lit(True).alias("discarded"), F.array(F.lit("vazia")).alias("history"), F.lit(0).alias("n_calls")))
