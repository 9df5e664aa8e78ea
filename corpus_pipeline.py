"""From documents to a training mixture in five stages.

Each stage takes all that its predecessor kept, is written as Parquet to the shared folder, and is read again by the next:

1. language: documents whose main language isn't known, or has less than half of the text, go;
2. near_duplicates: of each group of SimHash near-duplicates the document of the least id stays;
3. benchmarks: documents in which a window of a benchmark item occurs go;
4. secrets: secrets are replaced by a mark in the text;
5. mixture: documents get rates that bring the domains to their target shares; those with no copy go.

All but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, secrets, simhash
from tidemark.llm.common import table
from tidemark.sources.tables import materialize


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def by_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def by_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, so ``n_chars`` is counted anew where it is given."""
    cleared = secrets.redact(docs)
    return cleared.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleared


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


STAGES = [("language", by_language), ("near_duplicates", by_near_duplicates), ("benchmarks", by_benchmarks), ("secrets", by_secrets), ("mixture", by_mixture)]

#: Fingerprints, language models and the mixture have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
