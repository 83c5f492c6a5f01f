"""Checks that need character positions in prose, as columns.

Everything follows from lists of marks, (place, token) with 1-based places, that regular expressions
leave in a text. A group's anchor is one event; sorted, the events cut a text into movements, one for
each group, from its anchor to the next one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions import labels
from tierloom.functions.text import ATTRIBUTIONS, PLAIN_WEIGHTS, SENTENCE, WRONG_NOUNS, guarded_percent_at, held, stripped

# fixed values: characters that are looked at after a plain weight label, and before a percentage
AFTER_LABEL, BEFORE_PERCENT = 40, 60
PERCENT = r"~?\d{1,3}\s?%"
_ATTRIBUTION = "|".join(sorted(map(re.escape, ATTRIBUTIONS), key=len, reverse=True)).replace("\\ ", " ")
#: The rest of a sentence, and with it the next one. What stands right at a sentence's end without a space counts as still in it.
REST = rf"^[^.!?]*(?:[.!?]+(?:{_ATTRIBUTION})?)?"
REST_AND_NEXT = rf"^[^.!?]*(?:[.!?]+[^.!?]*(?:[.!?]+(?:{_ATTRIBUTION})?)?)?"


def marks(text: Column, pattern: str) -> Column:
    """All matches in order: array of (place, token)."""
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))

    def found(cut: Column) -> Column:
        parts, tokens = cut["parts"], cut["tokens"]
        place = lambda k: 1 + size(F.slice(parts, F.lit(1), k)) + size(F.slice(tokens, F.lit(1), k - 1))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda k: F.struct(place(k).alias("place"), F.get(tokens, k - 1).alias("token")))

    cut = F.struct(F.split(text, pattern).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tokens"))
    return F.filter(held(cut, found), lambda m: m["token"].isNotNull())


def anchor(text: Column, share: Column) -> Column:
    """Where a group is first named: by its weight label, a weaker one, or its percentage; null if nowhere."""
    low = F.lower(text)
    named = F.transform(labels.labels_up_to(share), lambda x: F.instr(low, x))
    return F.array_min(F.filter(F.concat(named, F.array(guarded_percent_at(text, share))), lambda p: p > 0))


def with_marker_verdict(rows: DataFrame, text: str, shares: dict[str, str], name: str) -> DataFrame:
    """Adds ``name``: ok, or the first fault in bucket order: unanchored:bucket, unmarked:bucket or late:bucket.

    ``shares`` names the column of each bucket's share; a null share needs no mark, and a null text has no anchor.
    A group whose share asks for a mark needs an attribution in its movement; where the mark has to come early, in
    the sentence of its anchor or the one after.
    """
    told = rows.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    events = F.array(*(F.struct(anchor(F.col("__low"), F.col(s)).alias("at"), F.lit(b).alias("bucket")) for b, s in shares.items()))
    told = told.withColumn("__events", F.filter(events, lambda e: e["at"].isNotNull()))
    end = lambda e: F.coalesce(F.array_min(F.filter(F.transform("__events", lambda o: o["at"]), lambda p: p > e["at"])), F.length("__low") + 1)
    before = lambda e: F.substring(F.col("__low"), F.greatest(e["at"] - 1, F.lit(1)), F.when(e["at"] > 1, 1).otherwise(0))
    movement = lambda e: F.struct(e["bucket"].alias("bucket"), before(e).alias("before"), F.substring(F.col("__low"), e["at"], end(e) - e["at"]).alias("text"))
    told = told.withColumn("__movements", F.transform("__events", movement))
    dominant, faults = F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(s), F.lit(0)) for s in shares.values())), []
    for bucket, share in shares.items():
        own = F.try_element_at(F.filter("__movements", lambda m: m["bucket"] == bucket), F.lit(1))  # noqa: B023
        marking = F.coalesce(labels.perspective_marking(F.col(share), dominant), F.lit("nenhuma"))
        early = F.when(own["before"].isin(".", "!", "?"), F.regexp_extract(own["text"], REST, 0)).otherwise(F.regexp_extract(own["text"], REST_AND_NEXT, 0))
        faults.append(
            F.when(F.col(share).isNull() | (marking == "nenhuma"), F.lit(None).cast("string")).when(own.isNull(), f"unanchored:{bucket}")
            .when(~own["text"].rlike(_ATTRIBUTION), f"unmarked:{bucket}").when((marking == "antecipada") & ~early.rlike(_ATTRIBUTION), f"late:{bucket}")
        )
    return told.withColumn(name, F.coalesce(*faults, F.lit("ok"))).drop("__low", "__events", "__movements")


def sentence_of(text: Column, place: Column) -> Column:
    """Number, from 0, of the sentence that a place is in; a place right behind one is still in it; null between sentences and for null."""
    bounds = F.transform(marks(text, SENTENCE), lambda m: F.struct((m["place"] + F.length(m["token"]) - F.length(F.ltrim(_spaces(m["token"])))).alias("a"), stripped(m["token"]).alias("t")))
    whole = F.filter(bounds, lambda m: m["t"] != "")
    around = F.transform(whole, lambda m, i: F.when((m["a"] <= place) & (place <= m["a"] + F.length(m["t"])), i))
    return F.array_min(F.array_compact(around))


def _spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", " ")


def diagnosed_markers(rows: DataFrame, text: str, shares: dict[str, str], markers: str) -> DataFrame:
    """A row for each declared marker (``markers``: array of grupo and trecho) with where it stands.

    Adds grupo, trecho, marking, anchor_sentence, marker_sentence and placed: whether an early mark stands in the sentence of
    its group's anchor or the next one. Marks that need not be early are always placed.
    """
    dominant = F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(s), F.lit(0)) for s in shares.values()))
    told = rows.select("*", F.explode(markers).alias("__m")).withColumns({"grupo": F.col("__m.grupo"), "trecho": F.col("__m.trecho")})
    share = F.coalesce(*(F.when(F.col("grupo") == b, F.col(s)) for b, s in shares.items()))
    told = told.withColumn("__share", share).withColumn("marking", F.coalesce(labels.perspective_marking(F.col("__share"), dominant), F.lit("nenhuma")))
    early = F.col("marking") == "antecipada"
    told = told.withColumn("anchor_sentence", F.when(early, sentence_of(F.col(text), anchor(F.col(text), F.col("__share")))))
    told = told.withColumn("marker_sentence", sentence_of(F.col(text), F.nullif(F.instr(F.col(text), F.col("trecho")), F.lit(0))))
    near = F.coalesce((F.col("marker_sentence") - F.col("anchor_sentence")).isin(0, 1), F.lit(False))
    return told.withColumn("placed", ~early | near).drop("__m", "__share")


def vocabulary_ok(text: Column) -> Column:
    """No weight is tied to readers: in no window after a plain label or before a percentage does a wrong noun come before "notas"."""
    low = F.lower(F.coalesce(text, F.lit("")))
    after = F.transform(marks(low, "|".join(PLAIN_WEIGHTS)), lambda m: F.substring(low, m["place"] + F.length(m["token"]), F.lit(AFTER_LABEL)))
    before = F.transform(marks(low, PERCENT), lambda m: F.substring(low, F.greatest(m["place"] - BEFORE_PERCENT, F.lit(1)), F.least(m["place"] - 1, F.lit(BEFORE_PERCENT))))

    def wrong(window: Column) -> Column:
        noun = F.array_min(F.filter(F.array(*(F.instr(window, n) for n in WRONG_NOUNS)), lambda p: p > 0))
        right = F.instr(window, "notas")
        return noun.isNotNull() & ((right == 0) | (noun < right))

    return ~F.exists(F.concat(after, before), wrong)


def labels_lowered(text: Column) -> Column:
    """Weight labels that stand capitalised inside a sentence, with a small first letter."""
    for label, _, _ in labels.WEIGHT_BANDS:
        text = F.regexp_replace(text, rf"(?U)(?<=[^.!?\s]\s{{0,99}})\b{label[0].upper()}{label[1:]}\b", label)
    return text
