"""The whole report of a film document, line by line, as columns of its one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions import labels
from tierloom.operators.compare import grouped_digits
from tierloom.operators.records import TONES, disclaimer, reviews_url

#: What a document has to have; any part of it may be null.
DOCUMENT = (
    "film string, version string, card struct<title:string,year:int,director:string,genres:array<string>,minutes:int,synopsis_in_english:boolean>, n_ratings long, "
    "buckets array<struct<bucket:string,target:int,mode:string,n_raw:bigint,n_valid:bigint,share_real:int,levels:array<struct<level:double,n_valid:bigint,threshold:int>>,"
    "language_doubtful:boolean,scope_doubtful:boolean,observation:string,"
    "themes:array<struct<theme:string,mentions:int,n_reviews:bigint,example:string,reported:bigint,quotes_removed:boolean>>>>, "
    "narrative string, faults array<string>, consensus array<struct<property:string,groups:array<string>,themes:array<string>>>, quantifiers array<struct<phrase:string,theme:string>>, "
    "markers array<struct<bucket:string,passage:string>>, edit struct<verdict:string,n_protected:int,lost:array<string>,attempts:array<string>,case_mended:boolean,similarity:double>, fluency array<struct<name:string,value:string>>"
)
#: A warning for each fault of a narrative (fixed values).
FAULT_LINES = {
    "falhou": "nenhum texto válido do modelo", "idioma": "idioma não confirmado como pt-BR", "escopo": "generaliza o recorte para o filme inteiro", "prevalencia": "compara o tamanho dos grupos",
    "quantificador": "quantificador forte sem tema que o sustente", "ancoragem_peso": "um grupo sem o seu peso", "consenso": "consenso com grupo ou tema inexistente", "vocabulario_peso": "peso atribuído a pessoas, não a notas",
    "perspectiva_nao_marcada": "perspectiva exigida sem marcador", "aspas": "aspas removidas",
}
NO_LINES = "array<string>"


def _lines(*texts: Column | str) -> Column:
    """Those of the lines that are not null."""
    return F.array_compact(F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts)).cast(NO_LINES))


def _where(condition: Column, lines: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), lines).otherwise(F.array().cast(NO_LINES))


def _text(*parts: Column | str) -> Column:
    """The parts put together; null if one is missing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _shown(part: Column) -> Column:
    """A part, or a question mark where it is missing."""
    return F.coalesce(part.cast("string"), F.lit("?"))


def _each(items: Column, lines: Callable) -> Column:
    """The lines of every item, in order; none without items."""
    return F.flatten(F.coalesce(F.transform(items, lines), F.array().cast(f"array<{NO_LINES}>")))


def _section(title: str, items: Column, lines: Callable) -> Column:
    return _where(F.size(items) > 0, F.concat(_lines(title), _each(items, lines)))


def _header() -> Column:
    card = F.col("card")
    told = _text("filme: ", _shown(card["title"]), " (", _shown(card["year"]), ") · direção: ", _shown(card["director"]), " · ", F.array_join(F.coalesce(card["genres"], F.array().cast(NO_LINES)), ", "), " · ", _shown(card["minutes"]), " min")
    known = F.exists("buckets", lambda b: b["share_real"].isNotNull())
    return F.concat(
        _lines(_text("relatório de ", F.col("film"), F.coalesce(_text(" · versão ", F.col("version")), F.lit("")))),
        _where(card.isNotNull(), F.concat(_lines(told), _where(card["synopsis_in_english"], _lines("aviso: sinopse em inglês")))),
        _lines(_text("notas reais: ", grouped_digits(F.col("n_ratings"))), disclaimer(known)),
    )


def _theme(t: Column) -> Column:
    return F.concat(
        _lines(_text("  ", _shown(t["theme"]), ": ~", _shown(t["mentions"]), " de ", _shown(t["n_reviews"])), _text("    ex.: ", t["example"])),
        _where(t["reported"].isNotNull(), _lines(_text("    aviso: o modelo disse ", t["reported"], ", fora de 0 a ", _shown(t["n_reviews"])))),
        _where(t["quotes_removed"], _lines("    aviso: aspas removidas do exemplo")),
    )


def _bucket(structured: bool) -> Callable:
    def lines(b: Column) -> Column:
        levels = F.coalesce(b["levels"], F.array().cast("array<struct<level:double,n_valid:bigint,threshold:int>>"))
        by_level = F.array_join(F.transform(levels, lambda n: _text(n["level"], "★ ", n["n_valid"])), " · ")
        share = F.coalesce(_text(" · ~", b["share_real"], "% das notas"), F.lit(""))
        title = _text(F.upper(b["bucket"]), " ", _shown(b["n_valid"]), "/", _shown(b["target"]), " [", by_level, "] modo=", _shown(b["mode"]), share)
        filters = _text("  filtro (caracteres): ", F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(levels, lambda n: n["threshold"]))), lambda x: x.cast("string")), ", "))
        observed = F.when(b["observation"] != "", b["observation"])
        none = F.concat(_lines(_text("  aviso: ", observed)), _lines(_text("  ", _shown(b["n_valid"]), " disponíveis em ", reviews_url(F.col("film")))))
        warned = F.concat(
            _where(b["mode"] == "reduzido", _lines(_text("  aviso: modo reduzido, ", _shown(b["n_valid"]), " de ", _shown(b["target"])))),
            _where(b["language_doubtful"], _lines("  aviso: idioma não confirmado como pt-BR")),
            _where(b["scope_doubtful"], _lines("  aviso: a observação generaliza o recorte")),
        )
        body = F.concat(warned, _each(b["themes"], _theme), _lines(_text("  » ", observed))) if structured else warned
        return F.concat(_lines(title, filters), F.when(b["mode"] == "sem_analise", none).otherwise(body))

    return lines


def _quantifier(q: Column) -> Column:
    """A declared quantifier with the fraction that its theme really has."""
    every = F.flatten(F.transform("buckets", lambda b: F.coalesce(b["themes"], F.array().cast("array<struct<theme:string,mentions:int,n_reviews:bigint,example:string,reported:bigint,quotes_removed:boolean>>"))))
    first = F.get(F.filter(every, lambda t: t["theme"] == q["theme"]), F.lit(0))
    pct = F.bround(F.try_divide(first["mentions"] * F.lit(100.0), first["n_reviews"]), 0).cast("int")
    told = F.when(first.isNull(), "tema inexistente").otherwise(_text("fração real ", _shown(pct), "%, ", _shown(labels.quantifier_label(pct))))
    return _lines(_text("  ", _shown(q["phrase"]), " · tema: ", _shown(q["theme"]), " (", told, ")"))


def _edit() -> Column:
    e = F.col("edit")
    n = F.greatest(F.size(F.coalesce(e["attempts"], F.array().cast(NO_LINES))), F.lit(1))
    taken = F.concat(_lines(_text("edição aplicada · ", _shown(e["n_protected"]), " trechos protegidos · ", n, " tentativa(s)")), _where(e["case_mended"], _lines("  maiúsculas de rótulos ajustadas")))
    attempts = F.transform(F.coalesce(e["attempts"], F.array().cast(NO_LINES)), lambda x, i: _text("  tentativa ", i + 1, ": ", x))
    dropped = F.concat(_lines(_text("aviso: edição descartada (", _shown(e["verdict"]), ") · ", n, " tentativa(s)")), _each(e["lost"], lambda x: _lines(_text("  trecho perdido: ", x))), attempts)
    return _where(e.isNotNull(), F.concat(F.when(e["verdict"] == "aceita", taken).otherwise(dropped), _lines(_text("  semelhança: ", F.format_number(e["similarity"], 3)))))


def _narrative() -> Column:
    faults = F.coalesce("faults", F.array().cast(NO_LINES))
    told = F.coalesce(F.nullif("narrative", F.lit("")), F.lit("(narrativa não gerada)"))
    warned = [F.when(F.array_contains(faults, name), _text("aviso: narrativa: ", line)) for name, line in FAULT_LINES.items()]
    listed = lambda items: F.array_join(F.coalesce(items, F.array().cast(NO_LINES)), ", ")
    return F.concat(
        _lines("narrativa", told, *warned),
        _section("consensos", F.col("consensus"), lambda c: _lines(_text("  ", _shown(c["property"]), " · grupos: ", listed(c["groups"]), " · temas: ", listed(c["themes"])))),
        _section("quantificadores", F.col("quantifiers"), _quantifier),
        _section("marcadores", F.col("markers"), lambda m: _lines(_text("  ", _shown(m["bucket"]), ": ", _shown(m["passage"])))),
        _edit(),
        _where(F.size("fluency") > 0, _lines(_text("fluência: ", F.array_join(F.transform("fluency", lambda m: _text(_shown(m["name"]), "=", _shown(m["value"]))), " · ")))),
    )


def full_report(documents: DataFrame, tone: str = "estruturado") -> DataFrame:
    """film, ord, line: a report of each document (columns of ``DOCUMENT``) in one of three tones.

    Header, headings of buckets and their warnings are in every tone; themes and observations in "estruturado" and "ambos", the
    narrative with its faults, declared lists, edit and fluency in "narrativo" and "ambos". A document's lines come from its own
    row, so nothing is shuffled; what is missing from it is left out or shown as a question mark.
    """
    if tone not in TONES:
        raise ValueError(f"tone is one of {TONES}")
    parts = [_header(), _each(F.col("buckets"), _bucket(tone != "narrativo")), *([_narrative()] if tone != "estruturado" else [])]
    total = F.aggregate(F.transform("buckets", lambda b: F.coalesce(b["n_raw"], F.lit(0))), F.lit(0).cast("long"), lambda s, n: s + n)
    ends = _lines(_text("total de reviews: ", F.coalesce(total, F.lit(0))))
    return documents.select("film", F.posexplode(F.concat(*parts, ends)).alias("ord", "line"))
