"""The corpus pipeline: five stages from raw documents to a training mix, each an operator of timeloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import decontam, lines, mixing, neardup, toxicity
from timeloom.llm.common import free_name, own_path, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labels of the documents at hand.

    Null texts are judged as empty ones; without labels, or for an empty table, all have one score, the share of toxic labels.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_name(docs, "score")
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text."""
    return lines.clean(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the sets of the query op5: two-word shingles, 0.8 or more.

    Documents without words and rows without an id have no near duplicates and stay; rows of one id stay or go together.
    """
    return neardup.deduplicated(docs, words=2, percent=80)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, for its source's target weight."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixture),
]

#: A classifier and a hashed search are no SQL; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = own_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
