"""License scans: phrase places, and an exact set-similarity join of runs of words with license notices.

A text is read once: its words are counted, the places of the phrases found, and the places kept of words that
templates or their telling phrases have. All else works on those places. A block is a run of consecutive words across
line breaks, from any of those places on, as long as the template and a few words more; it meets a template when it holds at
least ``CONTAINMENT`` of the template's distinct words and one telling phrase of each of its groups, so that notices of
neighbouring licences do not pass.

Template words are ordered by how often the whole corpus has them, rarest first. In that order a template's prefix
is its first ``size - needed + 1`` words; a run without any of them cannot reach ``needed``, so runs meet templates
through prefix words only (or through the rarest words of a group's phrases, which a run needs as well, where the corpus has
fewer of those). Runs with fewer than ``needed`` such words are dropped by length, and a meeting at positions i and j
can only give ``min(i, j) + 1 + min(words after i, words after j)`` common words, which drops more. What is
left is counted on the full sets.

Everything here is DataFrame functions. Templates are the constants of this module, or a table's (:func:`template_table`) of
bounded size, so what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import lasting, scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
MOST_TEMPLATES = 1000
#: Label and notice.
TEMPLATES = (
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: What a run must hold besides its share of words: one phrase of each group. Templates without an entry need none.
TELLING = {
    "gpl-3.0-notice": (("gnu general public license",), ("3", "v3")),
    "gpl-3.0-grant": (("gnu general public license",), ("free software foundation",)),
    "apache-2.0-notice": (("apache license",), ("2", "v2")),
    "mit-notice": (("mit license",),),
    "mit-grant": (("deal in the software",),),
    "cc-by-nc-4.0-notice": (("cc by nc 4", "cc by nc v4", "cc by nc version 4"),),
    "bsd-grant": (("redistribution and use in source and binary forms",), ("conditions are met",)),
    "mpl-2.0-notice": (("mozilla public license",), ("2", "v2")),
}


def word_set(text: str) -> list[str]:
    """The distinct words of a notice, in order."""
    return [w for w in dict.fromkeys(re.split(NOT_WORD, text.lower())) if w]


def needed(size: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(containment * size - 1e-9)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(text: Column) -> Column:
    """Every word between two spaces of its own: " a  b  c "; empty without words."""
    bare = F.trim(F.regexp_replace(lowered(text), NOT_WORD, "  "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def words_in(spaced_text: Column) -> Column:
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _phrase_columns(text: Column, n_words: Column) -> tuple[Column, Column, Column, Column]:
    """Number of places, first and last starting word, labels of the phrases of one spaced text."""
    count, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES:
        own = "".join(f" {w} " for w in phrase.split())
        at, size = F.instr(text, own), len(phrase.split())
        count = count + F.when(at > 0, ((F.length(text) - F.length(F.replace(text, F.lit(own), F.lit("")))) / len(own)).cast("long")).otherwise(F.lit(0))
        firsts.append(F.when(at > 0, words_in(F.substring(text, F.lit(1), at - 1))))
        lasts.append(F.when(at > 0, n_words - words_in(F.substring_index(text, own, -1)) - size))
        labels.append(F.when(at > 0, F.lit(label)))
    return count, F.least(*firsts), F.greatest(*lasts), F.array_compact(F.array(*labels))


def template_words(templates=None, telling=None) -> list[str]:
    """The words that are looked for: a fixed, small set."""
    templates, telling = TEMPLATES if templates is None else templates, TELLING if telling is None else telling
    phrases = [p for groups in telling.values() for group in groups for p in group]
    return sorted({w for x in (*(notice for _, notice in templates), *phrases) for w in word_set(x)})


def base_scan(docs: DataFrame, universe: list[str]) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, found (labels) and hits (places of the universe's words) of every row."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("w"))
    sized = text.withColumn("n_words", words_in(F.col("w"))).withColumn("all", F.split(F.trim("w"), "  "))
    n, first, last, labels = _phrase_columns(F.col("w"), F.col("n_words"))
    # the text of no words is split into one empty one, which is no template word
    held = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).isin(universe))
    hits = F.transform(held, lambda i: F.struct(i.alias("at"), F.get("all", i).alias("word")))
    return sized.select("row", "doc_id", "n_words", n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("found"), hits.alias("hits"))


def run_length(notice: str) -> int:
    """Words in a run: those of the notice, and room for a few between them."""
    n = len([w for w in re.split(NOT_WORD, notice) if w])
    return n + max(3, n // 4)


def template_table(rows: DataFrame) -> tuple[tuple[tuple[str, str], ...], dict[str, tuple[tuple[str, ...], ...]]]:
    """Templates and telling phrases of a table: label, notice, telling (lists of phrases, one of each list is needed; may be null).

    Templates are broadcast with every row's places, so a table of more than ``MOST_TEMPLATES`` rows is refused. Rows without
    a label or without words in their notice are left out; of rows with one label and notice one counts.
    """
    held = rows.select("label", "notice", "telling").filter("label IS NOT NULL").limit(MOST_TEMPLATES + 1).collect()
    if len(held) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    held = sorted({(r["label"], r["notice"], tuple(tuple(g) for g in r["telling"] or ())) for r in held if word_set(r["notice"] or "")})
    if len({label for label, *_ in held}) < len(held):
        raise ValueError("a label has several notices")
    bare = lambda phrase: " ".join(w for w in re.split(NOT_WORD, phrase.lower()) if w)
    told = {label: tuple(tuple(bare(p) for p in group) for group in groups) for label, _, groups in held if groups}
    return tuple((label, notice) for label, notice, _ in held), told


def _index(counts: dict[str, int], templates, containment: float, telling) -> list[tuple]:
    """A row for each word and template by which they meet: word, i (its place in the template's order), label, and the template."""
    rows = []
    for label, notice in templates:
        order = lambda w: (counts[w], w)
        words, groups = sorted(word_set(notice), key=order), telling.get(label, ())
        need = needed(len(words), containment)
        prefix = {w: i for i, w in enumerate(words[: len(words) - need + 1])}
        # a run that passes holds one word at least of every such list
        lists = [list(prefix), *(sorted({min(p.split(), key=order) for p in group}) for group in groups)]
        anchors = min(lists, key=lambda ws: sum(counts[w] for w in ws))
        rows += [(w, words.index(w) if w in words else None, label, words, len(words), need, run_length(notice), anchors, [list(group) for group in groups]) for w in anchors]
    return rows


def matching_runs(scanned: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, telling=None) -> DataFrame:
    """Runs that meet a template: row, block (its first word), label, common, size, containment; ``scanned``: row and hits.

    Runs start at words that are looked for: a run that starts elsewhere holds no more than the one from its first
    such word on. Each is judged once, at the first word in it by which it meets the template, and every step looks at no more
    places than a run has words, so the work grows with the places and not with a text's length times them.
    """
    spark, telling = scanned.sparkSession, TELLING if telling is None else telling
    universe = template_words(templates, telling)
    found = scanned.select(F.explode("hits.word").alias("word")).groupBy("word").count().collect()  # no more rows than the universe has words
    counts = dict.fromkeys(universe, 0) | {r["word"]: r["count"] for r in found}
    rows = _index(counts, templates, containment, telling)
    index = spark.createDataFrame(rows, "word string, i int, label string, words array<string>, size int, need int, length int, anchors array<string>, told array<array<string>>")
    reach = max((r[6] for r in rows), default=1)

    places = scanned.select("row", "hits", F.posexplode("hits").alias("k", "h")).filter(F.col("h.word").isin(sorted({r[0] for r in rows})))
    # hits stand in order and apart, so what lies within a run's reach are as many neighbours at most
    around = F.slice("hits", F.greatest(F.col("k") - reach + 2, F.lit(1)), F.lit(2 * reach))
    met = places.select("row", F.col("h.at").alias("at"), F.col("h.word").alias("word"), around.alias("around")).join(F.broadcast(index), "word")
    earlier = F.array_max(F.transform(F.filter("around", lambda h: (h["at"] < F.col("at")) & F.array_contains("anchors", h["word"])), lambda h: h["at"]))
    least = F.greatest(F.col("at") - F.col("length"), F.coalesce(earlier, F.lit(-1)))
    firsts = F.transform(F.filter("around", lambda h: (h["at"] <= F.col("at")) & (h["at"] > F.col("least"))), lambda h: h["at"])
    starts = met.withColumn("least", least).select("*", F.explode(firsts).alias("block"))
    runs = starts.withColumn("run", F.filter("around", lambda h: (h["at"] >= F.col("block")) & (h["at"] < F.col("block") + F.col("length")))).drop("around", "least", "anchors")
    # the template's words that the run has, in the template's order
    has = F.array_intersect("words", F.transform("run", lambda h: h["word"]))
    j = F.array_position("has", F.col("word")) - 1
    upper = F.when(F.col("i").isNull(), F.size("has")).otherwise(F.least("i", j) + 1 + F.least(F.col("size") - F.col("i") - 1, F.size("has") - j - 1))
    passed = runs.filter(F.size("run") >= F.col("need")).withColumn("has", has).filter((F.size("has") >= F.col("need")) & (upper >= F.col("need")))
    # the run's words, with a bar where other words stand between them
    apart = lambda h, n: F.when((n > 0) & (F.get("run", n - 1)["at"] + 1 < h["at"]), F.concat(F.lit("| "), h["word"])).otherwise(h["word"])
    said = passed.withColumn("said", F.concat(F.lit(" "), F.array_join(F.transform("run", apart), " "), F.lit(" ")))
    says = lambda x: F.forall("told", lambda group: F.exists(group, lambda p: F.contains(x, F.concat(F.lit(" "), p, F.lit(" ")))))
    # as an array's one element the words are put together once, not once for each phrase
    told = said.filter(F.exists(F.array("said"), says))
    return told.select("row", "block", "label", F.size("has").alias("common"), "size", (F.size("has") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, telling=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is the best containment of any template in any run, 0 without a match. Null texts count as empty: no
    words, no places, empty labels, score 0. Repeated rows are each reported; rows without an id are scanned too; whole
    texts are read, however long; other columns are not looked at. An empty table gives no rows.
    """
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    with scratch(docs.sparkSession):
        scanned = written(base_scan(docs, template_words(templates, telling)), "license-words")
        matched = matching_runs(scanned, templates, containment, telling).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("score"))
        both = scanned.drop("hits").join(matched, "row", "left")
        return lasting(
            both.select(
                "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("found")).alias("base_labels"),
                joined(F.concat("found", F.coalesce("met", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
            ),
            "licenses",
        )


def _oracle() -> str:
    split = lambda text: f"list_filter(string_split_regex({text}, '{NOT_WORD}'), lambda x: x <> '')"
    place = lambda phrase: "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + ")"
    labels = ", ".join(f"CASE WHEN len({place(p)}) > 0 THEN '{label}' END" for p, label in PHRASES)
    tells = lambda label, said: " AND ".join("(" + " OR ".join(f"contains({said}, ' {p} ')" for p in group) + ")" for group in TELLING.get(label, ())) or "true"
    met = []
    for label, notice in TEMPLATES:
        words = "[" + ", ".join(f"'{w}'" for w in word_set(notice)) + "]"
        run = f"w[b + 1:b + {run_length(notice)}]"
        met.append(f"""SELECT doc_id, '{label}' AS label, len(list_filter({words}, lambda x: list_contains(run, x))) / {len(word_set(notice))} AS share
  FROM (SELECT doc_id, {run} AS run FROM (SELECT doc_id, w, unnest(range(len(w))) AS b FROM worded WHERE {tells(label, "said")}))
  WHERE {tells(label, "' ' || array_to_string(run, ' ') || ' '")} AND len(list_filter({words}, lambda x: list_contains(run, x))) >= {needed(len(word_set(notice)))}""")
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
split AS (SELECT doc_id, {split("t")} AS w FROM low),
worded AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS said FROM split),
placed AS (
  SELECT doc_id, len(w) AS n_words, list_concat({", ".join(place(p) for p, _ in PHRASES)}) AS places,
    list_filter([{labels}], lambda x: x IS NOT NULL) AS found
  FROM worded),
runs AS ({" UNION ALL ".join(met)}),
met AS (SELECT doc_id, list(DISTINCT label) AS met, max(share) AS score FROM runs GROUP BY doc_id)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(found)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(met, []::VARCHAR[])))), ',') AS labels,
  coalesce(score, 0.0) AS score
FROM placed LEFT JOIN met USING (doc_id)
"""


ORACLE_SQL = _oracle()
