"""A training-data pipeline over `documents`: quality, near duplicates, leaks, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it reads what its predecessor wrote. All take empty tables,
null and repeated ids, null and empty texts, and further columns of any name, which they hand on; what becomes of such
rows stands below and in the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, jaccard_join, quality, secret_scan, sentencepiece
from netloom.llm.common import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects; null and empty texts are judged as texts without words, and without
    positive labels nothing is rejected."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the one with the smallest doc_id. Texts
    without words and rows with a null doc_id stay."""
    return jaccard_join.keep_first(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item of the benchmark, whatever its case; rows with a null doc_id stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced in their texts; no row goes."""
    return secret_scan.redact(docs, secret_scan.fit_on(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of each text; a null text has null ids."""
    return sentencepiece.encode(docs, sentencepiece.model_bytes(), ["doc_id", "lang", "source"])


STAGES = [("quality", good_quality), ("jaccard_join", one_of_each), ("decontamination", no_leaks), ("secret_scan", no_secrets), ("sentencepiece", token_ids)]
#: The fitted classifier, the models of the secret scan and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage before is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
