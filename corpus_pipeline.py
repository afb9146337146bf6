"""The corpus pipeline: language ID, near-dedup, PII, mixing and packing, each stage written and read again.

Every stage takes a table with doc_id, text, lang and source, in any order and with any other columns, whatever their
names, and all but the last return the columns they got. An empty table goes through every stage as one. Rows that
repeat an id, or have none, are rows of their own in every stage. Texts are processed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import langid, mixing, packing, pii, simhash
from tastegrid.llm.common import materialize, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; rejects those without letters or with no language ahead.

    A null or empty text has no letter and goes; so does everything if no row has a label to learn from. Null labels,
    ids and sources are no reason to go. Repeated rows are judged alike.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the smallest id; rows without an id come after all others.

    Of rows that repeat an id and are near duplicates one stays. Null and empty texts are copies of each other.
    """
    return simhash.deduplicated(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and keeps every row; n_chars, where it is a column, counts the new text.

    A null text stays null and has 0 characters; other nulls stay as they are.
    """
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents in as many copies as the mix asks for, in training order.

    Documents without words (null or empty texts) are not taken. A null source is a source of its own, the last.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; returns a row a piece, not the documents' columns.

    A null or empty text is its end id alone; null ids stay null; repeated rows are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii_redaction),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The kernels, fingerprints, classifier, mix and tokenizer can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages; a stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialize(out, f"stage-{name}")
            release(docs)
        docs = out
    return docs
