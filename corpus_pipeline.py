"""Corpus pipeline: toxicity, near-duplicates, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run`` writes every
stage's rows to the shared folder and reads them again. Columns of ``documents`` pass through unchanged but for
redacted texts and their ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import bpe, mixing, secrets, simhash, toxicity
from gridlark.llm.common import materialise, read_table, small_batches


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows of ``docs``, rejects go; null and empty texts score like any other."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest id stays; null and empty texts are one component."""
    small_batches(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; what the scan finds in their texts is replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it, up to three times; rows without words are not taken (words can't come near a target through them)."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests for each row of the mix; copies have rows of their own."""
    small_batches(spark)
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the classifier, the fingerprints' closure or the encoder; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
