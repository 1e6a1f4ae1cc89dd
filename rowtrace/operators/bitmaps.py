"""Id sets as bitmaps: dense integer ids, in buckets of a fixed number of bits.

A set is rows (bucket, word, bits): one long for each run of 64 ids that it touches. A set
of few ids that lie far apart has no more rows than ids, a hot group one for 64 ids, and
every operation is an aggregate of longs with partial results before the shuffle.
`pieces` has the same set as values of 4 KB for each run of 32,768 ids, made where they
are used: many small sets would move that much for a single id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrace.operators.attach import ordinal

BITS = 32_768  # fixed value: ids of a bucket
WORD = 64  # fixed value: ids of a word


def dense(df: DataFrame, order: Sequence[str], name: str = "id", bound: int | None = None) -> DataFrame:
    """Rows with a number from 1 on (as buckets count) in the given order, without a task that sees all rows.

    `bound`: row count of `df`, if it is known; otherwise it is measured.
    """
    numbered = ordinal(df, [F.col(c) for c in order], name, bound=bound)
    return numbered.withColumn(name, F.col(name) + 1)


def group_bitmaps(df: DataFrame, keys: Sequence[str], ident: str = "id") -> DataFrame:
    """(keys, bucket, word, bits): the ids of each group."""
    at = df.select(*keys, F.bitmap_bucket_number(ident).alias("bucket"), F.bitmap_bit_position(ident).alias("_at"))
    word, bit = F.floor(F.col("_at") / WORD).cast("int"), (F.col("_at") % WORD).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return at.select(*keys, "bucket", word.alias("word"), one.alias("bits")).groupBy(*keys, "bucket", "word").agg(F.bit_or("bits").alias("bits"))


def union(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One set for each value of `keys` from the sets of finer groups."""
    return bitmaps.groupBy(*keys, "bucket", "word").agg(F.bit_or("bits").alias("bits"))


def intersection(bitmaps: DataFrame, keys: Sequence[str], sets: int) -> DataFrame:
    """What `sets` sets of each value of `keys` have in common; a word that one of them lacks has nothing."""
    common = bitmaps.groupBy(*keys, "bucket", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return common.filter(F.col("_n") == sets).drop("_n")


def sizes(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cnt): ids of each set."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("cnt"))


def _positions(bitmaps: DataFrame) -> DataFrame:
    """One row for each bit set, with its position `_at` in the bucket: bytes that are not zero are unpacked, then their bits."""
    others = [c for c in bitmaps.columns if c not in ("word", "bits")]
    eight = F.explode(F.sequence(F.lit(0), F.lit(7)))
    value = F.call_function("shiftrightunsigned", F.col("bits"), F.col("byte") * 8).bitwiseAND(F.lit(255))
    set_bytes = bitmaps.select("*", eight.alias("byte")).select(*others, "word", "byte", value.alias("value")).filter("value <> 0")
    bits = set_bytes.select("*", eight.alias("bit")).filter("(value >> bit) & 1 = 1")
    return bits.select(*others, (F.col("word") * WORD + F.col("byte") * 8 + F.col("bit")).cast("long").alias("_at"))


def members(bitmaps: DataFrame, ident: str = "id") -> DataFrame:
    """The ids of each set, one row each."""
    others = [c for c in bitmaps.columns if c not in ("bucket", "word", "bits")]
    return _positions(bitmaps).select(*others, ((F.col("bucket") - 1) * BITS + F.col("_at") + 1).cast("long").alias(ident))


def pieces(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bucket, bits): the sets as binary bitmaps of a bucket each.

    Words are dealt by bucket first, so that only they are moved and sorted: a task makes one bitmap after the other.
    """
    dealt = _positions(bitmaps.repartition(*keys, "bucket"))
    return dealt.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))
