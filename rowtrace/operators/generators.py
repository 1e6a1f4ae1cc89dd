"""Test data with known shape, made from the ids of a given relation.

Every function maps rows to rows with column expressions: no driver loop, no
random state, so a lost partition is rebuilt with the same values. `ids` is a
relation with an integer column `idx`; the exact-count generators need
idx = 0 .. n-1 without gaps.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtrace.functions.portable import uniform
from rowtrace.operators.attach import sized

# A prime step and an offset that permute 0 .. n-1.
STEP = 1000003
OFFSET = 7919
#: Groups whose running sums are worked out together.
BLOCK = 65_536


def step_for(n: int) -> int:
    """The first step from STEP on that has no common divisor with n, so that multiples of it permute 0 .. n-1."""
    step = STEP
    while gcd(step, n) != 1:
        step += 1
    return step


def shuffled(idx: Column, n: int) -> Column:
    """A permutation of 0 .. n-1: any k of its values are hit by exactly k rows."""
    return (F.pmod(idx, F.lit(n).cast("long")) * F.lit(step_for(n)).cast("long") + F.lit(OFFSET)) % F.lit(n).cast("long")


def uniform_groups(ids: DataFrame, groups: int, top: float = 100.0) -> DataFrame:
    """(idx, z, v): z uniform over 0 .. groups-1, v uniform in [0, top)."""
    idx = F.col("idx")
    z = F.floor(uniform(idx, 0) * groups).cast("long")
    return ids.select("idx", z.alias("z"), (uniform(idx, 2) * top).alias("v"))


def zipf_ranges(ids: DataFrame, groups: int, theta: float) -> DataFrame:
    """(z, low, high): the share of the unit interval that belongs to each group."""
    ranks = ids.sparkSession.range(groups).select(
        F.col("id").alias("z"),
        F.floor(F.col("id") / BLOCK).alias("block"),
        (F.lit(1.0) / F.pow(F.col("id") + 1, F.lit(theta))).alias("weight"),
    )
    # running sums within blocks of groups, and over the blocks' totals: one row for each block
    totals = ranks.groupBy("block").agg(F.sum("weight").alias("total"))
    blocks = Window.orderBy("block")
    starts = totals.select(
        F.col("block").alias("_block"),
        F.coalesce(F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start"),
        F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    in_block = Window.partitionBy("block").orderBy("z")
    upto = F.sum("weight").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) + F.col("start")
    high = F.when(F.col("z") == groups - 1, 1.0).otherwise(upto / F.col("all"))
    edges = ranks.join(starts, F.col("block") == F.col("_block")).select("z", "block", high.alias("high"))
    # a group begins exactly where the one before it ends, across blocks too
    ends = edges.groupBy((F.col("block") + 1).alias("_block")).agg(F.max("high").alias("end"))
    joined = edges.join(ends, F.col("block") == F.col("_block"), "left")
    low = F.coalesce(F.lag("high").over(in_block), F.col("end"), F.lit(0.0))
    return joined.select("z", low.alias("low"), "high")


def zipf_groups(ids: DataFrame, groups: int, theta: float, top: float = 100.0) -> DataFrame:
    """(idx, z, v): z follows a Zipf law with exponent theta over `groups` values.

    Inverse lookup without comparing all pairs: the unit interval is cut into
    cells, a group's range is listed under each cell it touches, and a row only
    looks at the ranges of its own cell.
    """
    if theta == 0:
        return uniform_groups(ids, groups, top)
    cells = 16 * groups
    ranges = zipf_ranges(ids, groups, theta)
    first = F.floor(F.col("low") * cells)
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    listed = ranges.select("z", "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    idx = F.col("idx")
    rows = ids.select("idx", uniform(idx, 0).alias("u"), (uniform(idx, 2) * top).alias("v"))
    rows = rows.select("*", F.floor(F.col("u") * cells).alias("cell"))
    found = rows.join(sized(listed), "cell").filter((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high")))
    return found.select("idx", "z", "v")


def selective(ids: DataFrame, n: int, share: float, top: float = 100.0) -> DataFrame:
    """(idx, z, v): exactly floor(n * share) rows have z = 0, the others z in 1 .. n."""
    place = shuffled(F.col("idx"), n)
    other = F.floor(uniform(F.col("idx"), 1) * n).cast("long") + 1
    z = F.when(place < int(n * share), F.lit(0).cast("long")).otherwise(other)
    return ids.select("idx", z.alias("z"), (uniform(F.col("idx"), 2) * top).alias("v"))


def copies(ids: DataFrame, n: int, times: int, top: float = 100.0) -> DataFrame:
    """(idx, z, v): the sequence 0 .. n-1, `times` times over."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))
    rows = ids.select(F.col("idx").alias("z"), copy.alias("copy"))
    rows = rows.select((F.col("copy") * n + F.col("z")).alias("idx"), "z")
    return rows.select("idx", "z", (uniform(F.col("idx"), 2) * top).alias("v"))


def below_pair(left: DataFrame, n1: int, right: DataFrame, n2: int, share: float) -> tuple[DataFrame, DataFrame]:
    """t1(v, id), t2(v, id) with exactly int(share*n1) * int(share*n2) pairs t1.v < t2.v.

    Matching rows hold 2*n1 and 3*n1; others lie above or below every partner.
    """
    idx = F.col("idx")
    high = F.lit(10.0 * n1) + uniform(idx, 1) * F.lit(10.0 * n1)
    v1 = F.when(shuffled(idx, n1) < int(share * n1), F.lit(2.0 * n1)).otherwise(high)
    v2 = F.when(shuffled(idx, n2) < int(share * n2), F.lit(3.0 * n1)).otherwise(uniform(idx, 2) * F.lit(float(n1)))
    return (
        left.select(v1.alias("v"), F.col("idx").alias("id")),
        right.select(v2.alias("v"), F.col("idx").alias("id")),
    )


def keyed(ids: DataFrame, top: float = 100.0) -> DataFrame:
    """(id, v): a primary-key side."""
    return ids.select(F.col("idx").alias("id"), (uniform(F.col("idx"), 3) * top).alias("v"))


def widened(df: DataFrame, columns: int) -> DataFrame:
    """Adds col0 .. col{columns-1}, integers in 0 .. 99, from `idx`."""
    extra = [
        F.floor(uniform(F.col("idx") * 31 + 1009 * (i + 1), i) * 100).cast("int").alias(f"col{i}")
        for i in range(columns)
    ]
    return df.select("*", *extra)


def profile(df: DataFrame) -> DataFrame:
    """Distinct values of z and how often each occurs."""
    return df.groupBy("z").agg(F.count(F.lit(1)).alias("n"))
