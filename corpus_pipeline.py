"""The corpus pipeline: one of the training-data operators in each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteweave.llm import decontamination, language_id, line_dedup, near_copies, packing
from siteweave.llm.common import fresh_path, table


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to which language identification gives a language for sure enough; null, empty and letterless texts go, repeated rows stay or go together."""
    return language_id.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines; null and empty texts stay as they are."""
    return line_dedup.drop_repeated_lines(docs, counts=False)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by five-word shingles of similarity 0.8 or more; texts without words are copies of each other, the smallest doc_id stays."""
    return near_copies.keep_one_row(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window of words with the benchmark; null and empty texts have none and stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", of_known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Stages that draw on trained or hashed state can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs, at = table(spark, sf_dir, "documents"), fresh_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
