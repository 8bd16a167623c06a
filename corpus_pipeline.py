"""A training corpus in five stages, each over all rows that the one before has kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``docs``. ``run`` applies them to the documents table, each written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import dart_minhash, decontamination, language_id, mixture, token_store
from trailmark.llm.shared import materialise, read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected; learned from the labels of ``docs`` itself."""
    return language_id.accepted(docs, language_id.fit(language_id.train_part(docs, 5)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dart_minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix, each as often as it is read."""
    return mixture.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus; one row per document as read back from them."""
    return token_store.token_file_digests(spark, docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixture", mixed),
    ("tokens", tokens),
]

# Hash signatures, a trained model, alignment and tokenization cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline_{name}")
    return docs
