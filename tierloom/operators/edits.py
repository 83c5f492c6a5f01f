"""Checks of edited prose against the text it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom import config
from tierloom.functions import labels, matching, spans, text


def protected_spans(source: Column, shares: list[Column]) -> Column:
    """Spans that an edit must keep, longest first: weight phrases and number tokens, as the source writes them."""
    low = F.lower(source)
    wanted = F.array().cast("array<string>")
    for share in shares:
        tail = F.concat(F.lit(" das notas (~"), share.cast("string"), F.lit("%)"))
        wanted = F.concat(wanted, F.array(labels.weight_phrase(share)), F.coalesce(F.transform(labels.labels_up_to(share), lambda x: F.concat(x, tail)), F.array().cast("array<string>")))  # noqa: B023
    found = F.filter(F.concat(wanted, F.transform(F.regexp_extract_all(source, F.lit(rf"~?{text.NUMBER}"), F.lit(0)), text.stripped)), lambda x: x != "")
    own = F.transform(found, lambda x: F.when(F.contains(source, x), x).when(F.instr(low, F.lower(x)) > 0, F.substring(source, F.instr(low, F.lower(x)), F.length(x))))
    kept = F.array_distinct(F.filter(own, lambda x: F.contains(source, x) & (x != "")))
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("span"))))
    return F.transform(ordered, lambda s: s["span"])


def lost_spans(edited: Column, protected: Column) -> Column:
    """Protected spans that the edit has neither as they are nor with the other case of their first letter."""
    return F.filter(protected, lambda p: ~(F.contains(edited, p) | F.contains(edited, text.first_letter_variant(p))))


def with_honesty(rows: DataFrame, prose: str, shares: dict[str, str], name: str) -> DataFrame:
    """Adds ``name``: the checks that a text fails, in a fixed order.

    idioma, escopo, prevalencia (only without shares), vocabulario_peso, ancoragem_peso and perspectiva_nao_marcada
    (only with shares). ``shares`` names the column of each bucket's share.
    """
    faults = [
        ("idioma", ~text.language_fits(text.bare_words(F.col(prose)))),
        ("escopo", text.has_any(F.col(prose), text.SCOPE_MARKERS)),
    ]
    marked = rows
    if shares:
        marked = spans.with_marker_verdict(rows, prose, shares, "__marks")
        faults += [
            ("vocabulario_peso", ~spans.vocabulary_ok(F.col(prose))), ("ancoragem_peso", ~weights_anchored(F.col(prose), [F.col(s) for s in shares.values()])), ("perspectiva_nao_marcada", F.col("__marks") != "ok"),
        ]
    else:
        faults.append(("prevalencia", text.has_any(F.col(prose), text.PREVALENCE_MARKERS)))
    return marked.withColumn(name, F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in faults)))).drop("__marks")


#: Checks that the raw text fails; where rows have the column, it is not computed again.
RAW_FAULTS = "__raw_faults"


def with_raw_faults(edits: DataFrame, shares: dict[str, str] | None = None) -> DataFrame:
    clean = edits.withColumn("__raw", text.strip_quotes(F.coalesce("raw", F.lit("")))[0])
    return with_honesty(clean, "__raw", shares or {}, RAW_FAULTS).drop("__raw")


def edit_checks(edits: DataFrame, shares: dict[str, str] | None = None) -> DataFrame:
    """Adds published (the edit without quotation marks), wrapped, n_lost, numbers_kept and regressions.

    ``edits``: raw, edited, protected and the columns of ``shares``. A regression is a check that the raw text
    passes and the edit fails; an edit need not mend what was wrong before.
    """
    shares = shares or {}
    known = edits if RAW_FAULTS in edits.columns else with_raw_faults(edits, shares)
    clean = known.withColumn("published", text.strip_quotes(F.coalesce("edited", F.lit("")))[0])
    clean = with_honesty(clean, "published", shares, "__after")
    kept = text.number_tokens(F.col("raw")) == text.number_tokens(F.col("published"))
    return (
        clean.withColumn("wrapped", text.wrapped_format(F.col("edited"))).withColumn("n_lost", F.size(lost_spans(F.col("published"), F.col("protected")))).withColumn("numbers_kept", kept)
        .withColumn("regressions", F.array_except("__after", RAW_FAULTS)).drop("__after", *({RAW_FAULTS} - {*edits.columns}))
    )


def with_similarity(rows: DataFrame, raw: str, edited: str, wanted: Column | None = None, least: float | None = None) -> DataFrame:
    """Adds bound and similarity of two texts whose white space is made even.

    No ratio passes its bound, which is columns only. Where ``least`` is given, rows whose bound lies below it have
    no similarity, nor have rows that are not ``wanted``; their texts do not travel to Python.
    """
    even = rows.withColumn("__a", matching.even_spaces(F.col(raw))).withColumn("__b", matching.even_spaces(F.col(edited)))
    bounded = even.withColumn("bound", matching.ratio_bound(F.col("__a"), F.col("__b")))
    opens = F.lit(True) if wanted is None else wanted
    if least is not None:
        opens = opens & (F.col("bound") >= least)
    asked = bounded.withColumn("__open", F.coalesce(opens, F.lit(False))).withColumn("__a", F.when(F.col("__open"), F.col("__a"))).withColumn("__b", F.when(F.col("__open"), F.col("__b")))
    return asked.withColumn("similarity", matching.exact_ratio("__a", "__b")).drop("__a", "__b", "__open")


def edit_verdicts(edits: DataFrame, shares: dict[str, str] | None = None) -> DataFrame:
    """``edit_checks`` with verdict, and with bound and similarity, which is null where the verdict does not need it.

    The first fault counts: wrapped format, lost spans, changed numbers, a regression of honesty, and last an edit
    that changes nothing.
    """
    fault = (
        F.when(F.col("wrapped"), "formato_invalido").when(F.col("n_lost") > 0, "protegidos_perdidos").when(~F.col("numbers_kept"), "numeros_alterados")
        .when(F.size("regressions") > 0, "regressao")
    )
    known = edit_checks(edits, shares).withColumn("__fault", fault)
    measured = with_similarity(known, "raw", "edited", F.col("__fault").isNull(), config.NULL_EDIT_SIMILARITY)
    null_edit = F.coalesce(F.col("similarity") >= config.NULL_EDIT_SIMILARITY, F.lit(False))
    return measured.withColumn("verdict", F.coalesce("__fault", F.when(null_edit, "edicao_nula").otherwise("aceita"))).drop("__fault")


def weights_anchored(prose: Column, shares: list[Column]) -> Column:
    """Every share is named by its label, a weaker one, or its percentage without a digit before it."""
    low, ok = F.lower(prose), F.lit(True)
    for s in shares:
        named = F.exists(labels.labels_up_to(s), lambda x: F.contains(low, x)) | (text.guarded_percent_at(prose, s) > 0)
        ok = ok & F.coalesce(named, F.lit(True))
    return ok
