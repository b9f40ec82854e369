"""The corpus pipeline: documents that pass the quality rules, one of each near-duplicate group, none with benchmark
passages, personal data replaced, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, near_copies, packing, pii, quality_rules, tokens
from docloom.llm.common import documents, staged, table
from docloom.llm.registry import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 at a similarity: wide SimHash fingerprints in BK-trees, nearest links compared exactly."""
    return near_copies.drop_near_copies(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tokens.token_pieces(docs, vocabulary(), max_tokens=4096, end_id=1), capacity=4096)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("pii", redact), ("best_fit_packing", pack)]

#: Tokenisation and the genetic search have no SQL form; tests/llm/test_pipeline.py compares the whole with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents, each reading what the one before has written.

    Null and empty texts fail the quality rules; null ids stay and never link documents; repeated rows are one document;
    ties go to the smallest id; texts are read whole; an empty table gives no pieces; other columns, whatever their names,
    are carried along to the last stage, which returns pieces.
    """
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
