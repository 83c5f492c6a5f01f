"""From raw documents to packed sequences: each stage's output is written and read again as the next one's input.

Stages but the last return the columns of ``documents``. The quality stage drops documents that its
classifier rejects, exact dedup keeps one row of each group of equal texts, near-dedup one document
of each group of linked ones, and packing returns a row for each piece of what is left.

In every stage a null text counts as empty, rows without an id are handled by their text, whole texts are
read, extra columns pass through (packing leaves them out), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierloom.llm import exact_dedup, minhash, packing, quality
from tierloom.llm.durable import drop_table, scratch, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores 0.3 or more; it learns from ``labels.quality`` of the rows at hand."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id; a group without ids keeps one row."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id; wordless texts all stay."""
    return minhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 1024; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier and the tokenizer are not expressible there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, in order, over the documents of ``sf_dir``.

    Each stage's tables go once its output is written, and that output once the next stage's is; the last stage's
    result goes when the driver ends.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            found, found_path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path is not None:
            drop_table(spark, path)
        docs, path = found, found_path
    return docs
