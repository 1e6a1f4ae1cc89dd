"""Contiguous shards of equal byte size, from global prefix sums.

Rows are put in the order of their id. Each range of that order has a byte
total; the running sum of the totals gives every row its place in the whole
byte stream, and shard k takes the rows whose middle is in the k-th of n equal
pieces of it. Only ids, sizes and checksums are moved, never texts.

Defined cases: a null text has size 1 and checksum 0; null ids come first;
repeated rows each get a slot; an empty table gives an empty result; other
columns are left alone. A shard may be empty if single rows exceed a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import prefix_sums, table, utf8_bytes

SHARDS = 16


def shard_by_bytes(rows: DataFrame, order: list[str], size: str, shards: int = SHARDS) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to rows of positive integer sizes."""
    placed = prefix_sums(rows, order, [size])
    total = rows.agg(F.sum(size)).first()[0] or 1
    middle = F.col(f"before_{size}") * 2 + F.col(size)
    cut_at = placed.withColumn(
        "shard", F.least(F.floor(middle * shards / F.lit(total * 2)), F.lit(shards - 1)).cast("int")
    )
    # first row of each shard: one row per shard
    firsts = cut_at.groupBy("shard").agg(F.min("before_rows").alias("first_row"))
    joined = cut_at.join(F.broadcast(firsts), "shard")
    return joined.select(*rows.columns, "shard", (F.col("before_rows") - F.col("first_row")).alias("slot"))


def sized_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Id and further named columns with the size and checksum of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *keep, (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def shard_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shards: int = SHARDS) -> DataFrame:
    return shard_by_bytes(sized_rows(docs, list(keep)), ["doc_id", "text_crc32"], "size", shards)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents."""
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
