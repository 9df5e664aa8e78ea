"""One query per operator, with its SQL form where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import conversations, decontaminate, language, licenses, lines, mixing, pii, quality, secrets, simhash, sql_forms, substring, tokens, vector_codes
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return add


@query("op1_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, folder, "documents")))


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_licenses")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


@query("op5_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, folder, "documents")))


@query("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op7_quality", sql_forms.QUALITY)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(quality.quality(table(spark, folder, "documents")))


@query("op8_decontaminate", sql_forms.DECONTAMINATE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op9_substring", sql_forms.SUBSTRING)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return substring.without_repeats(table(spark, folder, "documents"))


@query("op10_tokens")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"))


@query("op11_lines", sql_forms.LINES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digest(lines.deduplicate_lines(table(spark, folder, "documents")))


@query("op12_vector_codes", sql_forms.VECTOR_CODES)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.digest(vector_codes.encode(table(spark, folder, "embeddings")))


@query("op13_conversations", sql_forms.CONVERSATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.digest(conversations.repair(conversations.damage(table(spark, folder, "conversations"))))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
