"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Defined results. Every stage takes null ids and null texts and keeps them unless its own rule rejects them (quality rules reject texts
without words); a null id is an id of its own row, told from others by the text. Rows that repeat an id are judged by their own texts;
near-duplicate texts leave one row, ties go to the smallest id, then the smallest hash of the text. Texts are taken whole whatever
their length. Empty tables give empty results. Columns that no stage knows pass through, whatever their names; in the last stage one
that is named like a result (n_tokens, ids_sha256, round_trip) gets a line at its end. ORACLE_SQL is None: SQL cannot express
the SentencePiece stage; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausework.llm._store import materialise, table
from clausework.llm.decontaminate import decontaminated
from clausework.llm.ngram_join import one_of_each_group
from clausework.llm.pii import redact
from clausework.llm.quality_rules import rules_applied
from clausework.llm.sentencepiece_codec import digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    return rules_applied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): of the smallest id. Documents without words stay."""
    return one_of_each_group(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of the documents but the text, and the digest of their SentencePiece ids."""
    keep = [c for c in docs.columns if c != "text"]
    return digest(docs, keep=keep)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("SentencePiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
