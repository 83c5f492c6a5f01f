"""Text measures as column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
QUOTES = "\"'“”‘’«»‹›"
STOPWORDS_PT = ("de", "da", "do", "das", "dos", "que", "para", "com", "uma", "um", "e", "os", "as", "não", "mais", "como", "por", "sobre", "são", "foi", "ao", "à", "às", "seu", "sua", "entre", "também", "muito", "há", "este", "esta", "esse", "essa", "mas", "ou", "já", "só", "sem", "pelo", "pela")
STOPWORDS_EN = ("the", "and", "of", "to", "in", "is", "for", "with", "on", "are", "as", "this", "that", "by", "from", "or", "an", "its", "be", "was", "were", "but", "not", "at", "it", "his", "her", "their", "than", "into")
SCOPE_MARKERS = ("a maioria dos críticos", "o consenso", "os críticos consideram", "amplamente aclamado", "amplamente rejeitado")
PREVALENCE_MARKERS = ("maioria dos espectadores", "maioria do público", "minoria", "grupo maior", "grupo menor", "igualmente expressivo", "polarizada", "dividida", "consenso")
REPORT_STEMS = ("elogi", "destac", "apont", "relat", "consider", "classific", "mencion", "ressalt", "reconhec", "express", "descrev")
INTENSIFIERS = ("intensamente", "profundamente", "extremamente", "excessivamente", "totalmente", "completamente", "absolutamente", "imensamente", "tremendamente", "surpreendentemente", "extraordinariamente", "impressionantemente", "brutalmente", "fortemente")
STRONG_PHRASES = ("quase todos", "praticamente todos")
MANDATORY_PHRASES = ("uma pequena minoria", "a grande maioria", "uma parcela expressiva", "uma minoria", "a maioria", "das notas", "quem gostou", "quem não gostou", "quem ficou no meio", "no meio-termo", "para esse grupo", "para eles", "nessa leitura", "quem está nessa faixa")
SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"
NUMBER = r"\d[\d.,]*\s?%?"
ENDS = """.,;:!?()"'"""

#: The shorter lists of the four-way label (fixed values).
LABEL_WORDS_PT = ("de", "da", "do", "das", "dos", "que", "para", "com", "uma", "um", "e", "os", "as", "não", "mais", "como", "por", "sobre", "são", "foi", "ao", "à", "às", "seu", "sua", "entre", "também", "muito", "há")
LABEL_WORDS_EN = ("the", "and", "of", "to", "in", "is", "for", "with", "on", "are", "as", "this", "that", "by", "from", "or", "an", "its", "be", "was", "were")
# fixed values: expressions that attribute a view to a group
ATTRIBUTIONS = (
    "quem está nessa faixa", "quem está nesta faixa", "para esse grupo", "para este grupo", "neste grupo", "nesse grupo", "para esse público", "para este público",
    "esse público", "este público", "nessa leitura", "nesta leitura", "para esses", "para estes", "para eles", "para elas", "quem gostou", "quem não gostou",
    "quem amou", "quem ficou no meio", "para quem gostou", "para quem não gostou",
)
# fixed values, for tierloom.functions.spans: nouns that a weight label must not be tied to, and labels that can only be weights
WRONG_NOUNS = ("reviews", "público", "publico", "espectadores")
PLAIN_WEIGHTS = ("uma fração mínima", "uma pequena minoria", "uma minoria", "uma parcela expressiva", "a grande maioria")


def held(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside functions of arrays an expression is computed wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bare_words(text: Column) -> Column:
    """Words between white space, lower-cased, without punctuation at either end."""
    return F.transform(F.split(stripped(F.lower(text)), r"\s+"), lambda w: F.btrim(w, F.lit(ENDS)))


def count_among(words: Column, known) -> Column:
    """How many words are in a short list; repeats count."""
    return F.size(F.filter(words, lambda w: w.isin(list(known))))


def language_fits(words: Column) -> Column:
    """:func:`language_ok` of words by the two lists."""
    return held(words, lambda w: language_ok(count_among(w, STOPWORDS_PT), count_among(w, STOPWORDS_EN)))


def language_ok(n_pt: Column, n_en: Column) -> Column:
    """No evidence is no violation."""
    return (n_pt >= n_en) | ((n_pt == 0) & (n_en == 0))


def language_label(n_pt: Column, n_en: Column) -> Column:
    return F.when((n_pt == 0) & (n_en == 0), "indeterminado").when(n_pt > n_en, "pt-BR").when(n_en > n_pt, "en").otherwise("misto/ambíguo")


def has_any(text: Column, markers) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m))
    return found


def strip_quotes(text: Column) -> tuple[Column, Column]:
    """(text without quotation marks and their backslashes, whether there were any)."""
    had = F.regexp_count(text, F.lit(f"[{QUOTES}]")) > 0
    bare = F.regexp_replace(F.regexp_replace(text, rf"\\?[{QUOTES}]", ""), r"[ \t]{2,}", " ")
    return F.when(had, stripped(bare)).otherwise(text), had


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), stripped), lambda s: s != "")


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def report_verbs(text: Column) -> Column:
    """How many words begin with a stem of ``REPORT_STEMS``; only places of a first letter of theirs are looked at."""
    initials = "".join(sorted({s[0] + s[0].upper() for s in REPORT_STEMS}))
    return F.regexp_count(text, F.lit(rf"(?U)(?=[{initials}])\b(?i:{'|'.join(REPORT_STEMS)})"))


def number_tokens(text: Column) -> Column:
    """The sorted number tokens, repeats included."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def masked_words(text: Column) -> Column:
    """Lower-cased words once set phrases and numbers are masked, the longest phrases first."""
    t = F.lower(text)
    for phrase in sorted(MANDATORY_PHRASES, key=len, reverse=True):
        t = F.replace(t, F.lit(phrase), F.lit(" § "))
    return letters(F.regexp_replace(t, rf"~?{NUMBER}", " § "))


def _runs(words: Column, n: int, of, kind: str) -> Column:
    """``of`` the place of each run of ``n`` words; none where there are fewer."""
    found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), of)
    return F.when(F.size(words) >= n, F.array_distinct(found)).otherwise(F.array().cast(f"array<{kind}>"))


def word_runs(words: Column, n: int = 8) -> Column:
    """The distinct runs of ``n`` words."""
    return _runs(words, n, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "), "string")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def run_hash(hashes: Column, place, n: int = 8) -> Column:
    """The 64-bit hash of the ``n`` words from a place on, from the words' hashes."""
    return F.xxhash64(*(F.get(hashes, place + j) for j in range(n)))


def word_run_hashes(hashes: Column, n: int = 8) -> Column:
    """The distinct hashes of runs of ``n`` words; every word is hashed once and no run is put together as text."""
    return _runs(hashes, n, lambda i: run_hash(hashes, i, n), "bigint")


def first_letter_variant(text: Column) -> Column:
    head, tail = F.substring(text, 1, 1), F.substring(text, F.lit(2), F.length(text))
    return F.when(F.regexp_count(head, F.lit(r"\p{L}")) == 0, text).when(head == F.upper(head), F.concat(F.lower(head), tail)).otherwise(F.concat(F.upper(head), tail))


def wrapped_format(text: Column) -> Column:
    """Signs that a text is wrapped in markup: braces, fences, field names, unbalanced braces."""
    t = stripped(text)
    lines = F.slice(F.filter(F.split(t, r"\r?\n"), lambda x: stripped(x) != ""), 1, 3)
    field = F.exists(lines, lambda x: F.regexp_count(x, F.lit(r'^\s*"?[A-Za-z_]\w*"?\s*:\s*\S')) > 0)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (t != "") & (F.substring(t, 1, 1).isin("{", "[") | F.contains(t, F.lit("```")) | field | (count("{") != count("}")))


def guarded_percent_at(text: Column, pct: Column) -> Column:
    """1-based place of "N%" that no digit precedes; 0 without one."""
    return F.regexp_instr(F.lower(text), F.concat(F.lit(r"(?<!\d)"), pct.cast("string"), F.lit("%")))


def without_fences(answer: Column) -> Column:
    """A model's answer without the Markdown fence around it."""
    return F.regexp_replace(stripped(answer), r"^```(?:json)?\s*|\s*```$", "")


def url_quoted(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and "-._~"."""
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(F.url_encode(text) if form == "+" else text, F.lit(form), F.lit(plain))
    return text


def html_escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches; null when none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))
