"""The training-data pipeline: stages over the documents table, each one of the operators of wayfold.llm.

Documents of low quality go; of each class of near duplicates one stays;
documents that hold benchmark passages go; personal data is replaced by its
kind; and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.decontamination import clean
from wayfold.llm.ngram_join import one_of_each
from wayfold.llm.pii import without_personal_data
from wayfold.llm.quality_classifier import accepted
from wayfold.llm.queries import piece_model
from wayfold.llm.sentencepiece_codec import encode_and_decode
from wayfold.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; the classifier learns from four fifths of the labels."""
    return accepted(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose members' five-word shingles link at a similarity of 0.8 or more."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars as it is then."""
    return without_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded text."""
    return encode_and_decode(docs, piece_model()).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]

#: The stages learn models and compare sets of shingles, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; what each stage before it keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
