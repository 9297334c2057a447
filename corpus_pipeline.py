"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. A stage's result is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``docs``.

1. language_id: documents without letters, or in no learned language, go.
2. quality: documents that score under the threshold go.
3. near_dedup: one document of each class of copies and near copies stays.
4. decontaminate: documents that hold a benchmark item go.
5. byte_bpe: ids of every text that is left, and their decoding.

Stages accept null texts and ids, empty and very long texts, repeated rows, empty
tables and extra columns; each operator's docstring states its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import byte_bpe, decontaminate, language_id, near_dedup, quality
from lakeloom.llm.common import stored, table
from lakeloom.llm.queries import BYTE_BPE_FILE, PATTERN


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.fit(language_id.training_rows(docs)))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    return quality.keep(docs, quality.fit(quality.statistics(docs), labels))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, BYTE_BPE_FILE, PATTERN)


STAGES = [
    ("language_id", stage_language_id),
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("byte_bpe", stage_byte_bpe),
]

#: Language ID, quality and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder
    and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
