"""Deterministic wording: bands from weak to strong, first fit wins, so a shared boundary goes to the weaker label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierloom import config

# fixed values: (label, upper bound, whether the bound itself belongs to the band)
QUANTIFIER_BANDS = (("poucos", 10, False), ("alguns", 25, True), ("muitos", 50, True), ("cerca de metade", 60, True), ("a maioria", 80, True), ("quase todos", 100, True))
WEIGHT_BANDS = (("uma fração mínima", 5, False), ("uma pequena minoria", 10, False), ("uma minoria", 25, True), ("uma parcela expressiva", 45, True), ("a maioria", 70, True), ("a grande maioria", 100, True))
# fixed values: declared phrase and its force on the scale of QUANTIFIER_BANDS
PHRASE_FORCES = {
    "poucos": 0, "poucas": 0,
    "alguns": 1, "algumas": 1, "uma parte": 1, "parte dos": 1, "parte das": 1,
    "muitos": 2, "muitas": 2, "boa parte": 2,
    "cerca de metade": 3, "aproximadamente metade": 3, "metade": 3,
    "a maioria": 4, "maioria": 4, "mais da metade": 4,
    "quase todos": 5, "quase todas": 5, "praticamente todos": 5, "praticamente todas": 5,
}


def band(pct: Column, bands) -> Column:
    """The label of a share from 0 to 100; null for null."""
    found = F.when(pct.isNull(), F.lit(None).cast("string"))
    for label, bound, inside in bands[:-1]:
        found = found.when(pct <= bound if inside else pct < bound, label)
    return found.otherwise(bands[-1][0])


def quantifier_label(pct: Column) -> Column:
    return band(pct, QUANTIFIER_BANDS)


def quantifier_force(pct: Column) -> Column:
    return F.array_position(F.array(*(F.lit(b[0]) for b in QUANTIFIER_BANDS)), quantifier_label(pct)).cast("int") - 1


def weight_label(pct: Column) -> Column:
    return band(pct, WEIGHT_BANDS)


def weight_phrase(pct: Column) -> Column:
    return F.concat(weight_label(pct), F.lit(" das notas (~"), pct.cast("string"), F.lit("%)"))


def labels_up_to(pct: Column) -> Column:
    """The weight label of a share and all weaker ones."""
    names = F.array(*(F.lit(b[0]) for b in WEIGHT_BANDS))
    return F.slice(names, F.lit(1), F.array_position(names, weight_label(pct)).cast("int"))


def perspective_marking(pct: Column, dominant: Column) -> Column:
    return F.when(F.coalesce(dominant, F.lit(0)) == 0, "nenhuma").when(pct <= dominant / 10, "antecipada").when(pct <= dominant / 3, "simples").otherwise("nenhuma")


def declared_force(phrase: Column) -> Column:
    """Force of a declared quantifier by the longest known phrase in it; null when there is none."""
    found = F.when(F.lit(False), F.lit(None).cast("int"))
    for known in sorted(PHRASE_FORCES, key=len, reverse=True):
        found = found.when(F.contains(F.lower(phrase), F.lit(known)), PHRASE_FORCES[known])
    return found


def bucket_of(level: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, levels in config.BUCKETS.items():
        found = found.when(level.between(min(levels), max(levels)), name)
    return found


def bucket_target(bucket: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, target in config.TARGETS.items():
        found = found.when(bucket == name, target)
    return found


def bucket_mode(n: Column, target: Column) -> Column:
    return F.when(n < config.FLOOR_PER_BUCKET, "sem_analise").when(n >= target, "completo").otherwise("reduzido")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even; 0 where there is no whole."""
    return F.coalesce(F.bround(F.try_divide(part * 100, F.when(whole > 0, whole)), 0), F.lit(0)).cast("int")
