"""A corpus pipeline of five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are written
as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import mixing, pii, quality, sentencepiece_codec, simhash
from chronoweft.llm.common import holding, release, staged


def quality_classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_first(docs)


def pii_redaction(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks, and the length to match."""
    clean = pii.redact(docs)
    return holding(clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), clean)


def mixing_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens meet the source, language and topic targets."""
    return mixing.keep_mixed(docs)


def sentencepiece_encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, verified against the reference library, without the text."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii_redaction),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The classifier, fingerprints and models are beyond SQL; the tests hold the
#: pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables go once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        kept = staged(made, "stage")
        release(made, docs)
        docs = kept
    return holding(STAGES[-1][1](spark, docs, sf_dir), docs)
