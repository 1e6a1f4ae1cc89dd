"""The corpus pipeline: its stages one after the other, each result written and read again.

Documents that are judged toxic go, one document of each class of near-duplicates
stays, documents that overlap a benchmark go, sources are mixed to their targets
(documents are left out or doubled), and the rest is laid out in shards. All but
the last stage return the columns of `documents`; the last returns the manifest of
the shards: what identifies a row, its size and checksum, its shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowtrace.llm.common import table, written
from rowtrace.llm.decontamination import decontaminate
from rowtrace.llm.mixing import apply_mix
from rowtrace.llm.neardup import drop_near_duplicates
from rowtrace.llm.sharding import shard_documents
from rowtrace.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, ("doc_id", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned lexicons and signatures are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` to the manifest."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        docs = result if k == len(STAGES) - 1 else written(result, name)
    return docs
