"""Fill-in-middle transformation by counted quantifiers.

A text is cut into units (code points). Their number comes from ``regexp_count``: runs of ``RUN`` units are
counted first and then the units of what they leave, so that a long text never stands as one array of its
characters. Two hashes of the id give the cuts a <= b, and a pattern of the row's own,
``\\A(unit{a}+)(unit{b-a}+)(unit*+)\\z`` with possessive groups, captures prefix, middle and suffix in one match,
whose replacement puts them in order between the markers. The text comes back from output and form by a match on
the markers, which no transformed text holds itself.

All of it is column functions on one row: no shuffle, nothing kept from one row to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "(?s:.)"
#: Units of a run that is counted as one.
RUN = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred: texts that are transformed, and of those the ones that begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"


def units(text: Column) -> Column:
    """How many units a text has."""
    run = f"{UNIT}{{{RUN}}}+"
    rest = F.regexp_replace(text, run, "")
    return F.regexp_count(text, F.lit(run)).cast("long") * RUN + F.regexp_count(rest, F.lit(UNIT))


def hashes(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from an id: the first groups of eight digits of SHA-256; a missing id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part, rest = "((?s:.)*?)", "((?s:.)*+)"
    psm = F.regexp_replace(output, rf"\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}{rest}\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}{rest}\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars and output of every row.

    A text stays plain, with null prefix_chars and middle_chars, where it is empty, holds a marker, or is not among the
    transformed; null texts count as empty. Rows that share an id are cut each for itself by the same hashes, rows
    without one by the hash of no digits. Whole texts are cut, however long; other columns are not looked at. An empty table
    gives no rows.
    """
    h1, h2, h3, h4 = hashes(F.col("doc_id").cast("long"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    counted = rows.select("*", units(F.col("text")).alias("n"), form.alias("form"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = counted.select("*", F.least(one, two).alias("a"), F.abs(one - two).alias("m"))
    group = lambda size: F.concat(F.lit(f"({UNIT}{{"), size.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), group(F.col("a")), group(F.col("m")), F.lit(rf"({UNIT}*+)\z"))
    order = F.when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    kept = lambda size: F.when(F.col("form") != "plain", F.col(size))
    return cut.select("doc_id", "n", "form", kept("a").alias("prefix_chars"), kept("m").alias("middle_chars"), output.alias("output"))


def digests(transformed: DataFrame) -> DataFrame:
    """Outputs and the texts restored from them, as SHA-256."""
    own = F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *own)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, {", ".join(f"CAST(CAST('0x' || substr(d, {8 * k + 1}, 8) AS UBIGINT) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
f AS (
  SELECT *, CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain'
    WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""
