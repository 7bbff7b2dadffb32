"""A training corpus from raw documents: five stages, each by one of the operators.

A stage takes (spark, docs, folder) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm import decontamination, near_copies, pii, quality_classifier, sentencepieces
from tempograin.llm.common import stored
from tempograin.sources.tables import Tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep_good(docs, Tables(spark, sf_dir).labels)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more, among op10's components and, as four bits are too narrow alone, bands of minima."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    return decontamination.drop_contaminated(docs, Tables(spark, sf_dir).benchmark)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and ``n_chars`` as the text now is."""
    whole = docs.select(F.struct("*").alias("doc"), "text")
    swapped = pii.pseudonymise(whole, pii.session_key(spark))
    done = swapped.select(F.col("doc").withField("text", F.col("text")).alias("doc")).select("doc.*")
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether decoding them gives the text again."""
    return sentencepieces.encode_documents(docs, check=True)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece encoding and decoding", encoded),
]

# The stages fit a model, follow links and permute by key: SQL has no equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
