"""Joins whose physical form is chosen by measured size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrace.functions.exact import Aggregate, aggregate
from rowtrace.session import DEFAULT_LIMITS, Limits, cut


def row_bytes(schema: T.StructType) -> int:
    """Rough width of one row in memory, generous for text."""
    widths = {"string": 64, "binary": 64, "array": 512, "map": 512, "struct": 256}
    return sum(widths.get(f.dataType.typeName(), 16) for f in schema.fields) or 1


@dataclass(frozen=True)
class Measured:
    """A relation written to the shared folder, with its row count."""

    frame: DataFrame
    rows: int

    def small(self, limits: Limits) -> bool:
        return (
            self.rows <= limits.broadcast_rows
            and self.rows * row_bytes(self.frame.schema) <= limits.broadcast_bytes
        )


def measure(df: DataFrame) -> Measured:
    frame = cut(df)
    return Measured(frame, frame.count())


def sized(df: DataFrame, limits: Limits = DEFAULT_LIMITS, bound: int | None = None) -> DataFrame:
    """`df` for the side of a join that may be broadcast.

    `bound` is a row count known in advance (a LIMIT, or counted before); without
    one the relation is measured. Small: broadcast. Otherwise: left to a shuffle.
    """
    known = Measured(df, bound) if bound is not None else measure(df)
    return F.broadcast(known.frame) if known.small(limits) else known.frame


def few(df: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """`df` for the side of a join that is most likely small, and too large to be written down if it is not.

    No more rows are written than one above the bound. At or below it, all of them have been written: broadcast.
    """
    head = measure(df.limit(limits.broadcast_rows + 1))
    return F.broadcast(head.frame) if head.small(limits) else df


def matching(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two column lists (groups with a null key keep their rows)."""
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & a.eqNullSafe(b)
    return condition


def attach(
    rows: DataFrame,
    values: DataFrame,
    keys: list[str],
    limits: Limits = DEFAULT_LIMITS,
    bound: int | None = None,
) -> DataFrame:
    """Rows of `rows` that have a group in `values`, extended by that group's columns.

    No keys: `values` is a single row and is added as a scalar subquery. Small
    `values` (see `sized`) are broadcast, so `rows` is not shuffled. Otherwise
    both sides are shuffled on the keys and adaptive execution splits hot keys.
    """
    added = [c for c in values.columns if c not in keys]
    if not keys:
        packed = values.select(F.struct(*added).alias("v")).scalar()
        return rows.select("*", packed.alias("_v")).select(*rows.columns, *[f"_v.{c}" for c in added])
    return join_values(rows, sized(values, limits, bound), keys)


def join_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Plain null-safe join on equally named keys."""
    added = [c for c in values.columns if c not in keys]
    renamed = values.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *added)
    condition = matching([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys])
    return rows.join(renamed, condition).select(*rows.columns, *added)


def known_keys_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, rare: bool = False) -> DataFrame:
    """Semi or anti join on equal columns, with a hot key on either side.

    The right keys are made distinct, which reduces a hot key there before the
    shuffle. They are then free of nulls, so null-safe equality means the same as
    plain equality; it makes the join shuffle both sides anew instead of building on
    the exchange of the aggregate, and only so adaptive execution may split a hot
    key on the left. `rare` keys are broadcast if they are found to be few.
    """
    names = [f"_k{i}" for i in range(len(on))]
    keys = right.select(*[F.col(b).alias(n) for n, (_, b) in zip(names, on, strict=True)])
    keys = few(keys.dropna().distinct()) if rare else keys.dropna().distinct()
    return left.join(keys, matching([F.col(a) for a, _ in on], [F.col(n) for n in names]), how)


def left_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Left outer join on equal columns, as matched rows plus unmatched left rows.

    Adaptive execution may split a hot key on either side of an inner join, but
    only on the left of an outer one.
    """
    condition = F.lit(True)
    for a, b in on:
        condition = condition & (F.col(a) == F.col(b))
    unmatched = known_keys_join(left, right, on, "left_anti")
    return left.join(right, condition).unionByName(unmatched, allowMissingColumns=True)


def over_groups(
    rows: DataFrame, keys: list[str], aggregates: dict[str, Aggregate], limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Every row with the aggregates of its group, by whole-partition window functions.

    A window brings a group into one task, so the largest group is counted first;
    only if it exceeds what a task can sort, the pre-aggregated values are joined to
    the rows instead, with the same result.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"))
    if (counted.first()[0] or 0) <= limits.window_group_rows:
        window = Window.partitionBy(*keys)
        spread = [aggregate(part, lambda a: a.over(window)).alias(name) for name, part in aggregates.items()]
        return rows.select("*", *spread)
    named = [aggregate(part).alias(name) for name, part in aggregates.items()]
    return join_values(rows, rows.groupBy(*keys).agg(*named), keys)


def ordinal(
    df: DataFrame,
    order: list[Column],
    name: str = "out_index",
    limits: Limits = DEFAULT_LIMITS,
    bound: int | None = None,
) -> DataFrame:
    """Position (from 0) of each row in the total order `order`.

    Small inputs are numbered in one task. Others are range-partitioned into slices of
    about `slice_rows`, more of them for more rows: each partition numbers its own rows
    and adds the row count of those before it.
    """
    position = F.row_number().over(Window.orderBy(*order)).cast("long") - 1
    rows = Measured(df, bound) if bound is not None else measure(df)
    if rows.small(limits):
        return rows.frame.select(position.alias(name), "*")
    slices = max(2, -(-rows.rows // limits.slice_rows))
    sliced = rows.frame.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    # number of the partition above bit 33, number of the row in it below
    spread = cut(sliced.select(F.monotonically_increasing_id().alias("_place"), "*"))
    here = F.shiftright("_place", 33)
    # one row per partition from here on: bounded by the partition count
    counts = spread.groupBy(here.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = spread.join(F.broadcast(starts), here == F.col("_slice"))
    return joined.select((F.col("_start") + local).alias(name), *df.columns)


def inequality_join(
    left: DataFrame,
    right: DataFrame,
    low: str,
    high: str,
    or_equal: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    buckets: int = 64,
    cell_rows: int = 100_000,
) -> DataFrame:
    """Pairs with left.low < right.high (or <=), without comparing every pair.

    A small side is broadcast. Otherwise the right side is cut into value
    ranges, large ranges into several pieces, and each left row only visits the
    ranges that can hold a partner. Work follows the size of the result.
    """
    condition = F.col(low) <= F.col(high) if or_equal else F.col(low) < F.col(high)
    left = left.filter(F.col(low).isNotNull())
    right = right.filter(F.col(high).isNotNull())
    left_rows, right_rows = left.count(), right.count()
    if Measured(right, right_rows).small(limits):
        return left.join(F.broadcast(right), condition)
    if Measured(left, left_rows).small(limits):
        return F.broadcast(left).join(right, condition)
    steps = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(right.select(F.percentile_approx(F.col(high), steps)).first()[0]))
    edges = F.array(*[F.lit(c) for c in cuts])

    def bucket(column: str) -> Column:
        return F.size(F.filter(edges, lambda edge: edge <= F.col(column)))

    counted = right.groupBy(bucket(high).alias("b")).count().collect()  # at most `buckets` rows
    pieces = {row["b"]: -(-row["count"] // cell_rows) for row in counted}
    piece_counts = F.array(*[F.lit(pieces.get(b, 0)) for b in range(len(cuts) + 1)])
    stripes = max(1, -(-left_rows // cell_rows))

    def spread(frame: DataFrame, parts: Column) -> Column:
        return F.pmod(F.xxhash64(*frame.columns), parts).cast("int")

    partners = F.flatten(
        F.transform(
            F.sequence(bucket(low), F.lit(len(cuts))),
            lambda b: F.transform(
                F.when(piece_counts[b] > 0, F.sequence(F.lit(0), piece_counts[b] - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda p: F.struct(b.alias("b"), p.alias("p")),
            ),
        )
    )
    seeking = left.select("*", spread(left, F.lit(stripes)).alias("_s"), F.explode(partners).alias("_cell"))
    offered = right.select("*", bucket(high).alias("_b"))
    offered = offered.select("*", spread(right, piece_counts[F.col("_b")]).alias("_p"))
    offered = offered.select("*", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_rs"))
    same_cell = (
        (F.col("_s") == F.col("_rs")) & (F.col("_cell.b") == F.col("_b")) & (F.col("_cell.p") == F.col("_p"))
    )
    return seeking.join(offered, same_cell & condition).select(*left.columns, *right.columns)


@dataclass(frozen=True)
class Branch:
    """One branch of a disjunction: `equal` columns, or left.low < right.high (or <=)."""

    equal: tuple[tuple[str, str], ...] = ()
    low: str = ""
    high: str = ""
    or_equal: bool = False

    def holds(self) -> Column:
        """True or false, never null."""
        if self.equal:
            condition = F.lit(True)
            for a, b in self.equal:
                condition = condition & (F.col(a) == F.col(b))
        else:
            condition = F.col(self.low) <= F.col(self.high) if self.or_equal else F.col(self.low) < F.col(self.high)
        return F.coalesce(condition, F.lit(False))


def any_of(left: DataFrame, right: DataFrame, branches: Sequence[Branch], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Pairs for which any branch holds, each once.

    Every branch is a join of its own kind, without the pairs that an earlier branch has: no pair is compared but
    those that an equality or a range brings together.
    """
    parts = []
    for number, branch in enumerate(branches):
        if branch.equal:
            joined = left.join(right, reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in branch.equal]))
        else:
            joined = inequality_join(left, right, branch.low, branch.high, branch.or_equal, limits)
        for earlier in branches[:number]:
            joined = joined.filter(~earlier.holds())
        parts.append(joined)
    return reduce(DataFrame.unionByName, parts)
