"""The curation pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Every stage keeps the columns of documents but the last, which adds to them. All stages read whole
texts of any length and give an empty table for an empty one; columns of other names pass through.
The files of a stage go once the next one is written, those of the last when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import decontamination, language_id, line_dedup, mixing, simhash_dedup
from sievewright.session import discard, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null and empty texts have none and go. Rows without an id or a label are judged by their text,
    repeated rows alike.
    """
    return language_id.drop_rejected(docs, language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with only the first occurrence of each line; those that lose every line go.

    First is the least id, a null id before all. Rows repeated as a whole are one document and stay
    together. Null and blank texts stay as they are.
    """
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Rows without an id and texts without a word stay; rows that repeat the id that is kept stay.
    """
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged by their text, those without an id and repeated ones too; null and empty texts
    stay. An empty benchmark leaves all.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw by raked weights of source, language and topic, with topic, n_tokens and probability.

    A null source or language is a value of its own; rows without an id are drawn by their text,
    repeated rows together; null and empty texts like others of their cell.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The vector search, the fingerprints and the fitted model of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one drew, with topic, n_tokens and probability."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
