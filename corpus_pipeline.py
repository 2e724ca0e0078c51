"""A corpus pipeline: each stage reads what the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns
of ``docs``; where a stage changes a text, ``n_chars`` follows.

1. ``quality_rules``: documents that fail the rules go, and lines that are too
   frequent in a host leave the documents that stay.
2. ``near_dedup``: of each group of near-duplicates the smallest id stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``secret_scan``: secrets are replaced in the text; no document goes.
5. ``byte_bpe``: each document's number of tokens, and digests of its token ids
   and of the bytes decoded from them.

An empty table passes through all stages and gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.llm import byte_bpe, decontaminate, minhash, quality_lines, secret_scan
from rallygrid.llm.common import load, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality_lines.filtered(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.redacted(docs))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("byte_bpe", encode_bytes)]

#: A trained forest takes part, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
