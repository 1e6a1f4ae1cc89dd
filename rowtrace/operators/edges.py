"""Lineage of single operators as edge tables, and their composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrace.functions.portable import bucket_of
from rowtrace.operators.attach import attach, known_keys_join, left_join, ordinal, sized
from rowtrace.session import DEFAULT_LIMITS, Limits


def row_edges(df: DataFrame, rid: str) -> DataFrame:
    """Scan, projection, filter: an output row is one input row."""
    return df.select(F.col(rid).alias("out_id"), F.col(rid).alias("in_id"))


def order_edges(df: DataFrame, rid: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Order-by (with limit, top-k): position in the output <- input row."""
    rows = df if limit is None else df.orderBy(*order).limit(limit)
    return ordinal(rows, order, "out_id", bound=limit).select("out_id", F.col(rid).alias("in_id"))


def group_edges(df: DataFrame, keys: Sequence[str], rid: str) -> DataFrame:
    """Group-by: group <- each of its rows. The key itself names the group."""
    return df.select(*keys, F.col(rid).alias("in_id"))


def whole_edges(df: DataFrame, rid: str) -> DataFrame:
    """Aggregate without keys: output 0 <- every row."""
    return df.select(F.lit(0).cast("long").alias("out_id"), F.col(rid).alias("in_id"))


def join_edges(joined: DataFrame, left_rid: str, right_rid: str) -> DataFrame:
    """Join (equi, theta, outer): output <- its left row and its right row, if any."""
    left, right = F.col(left_rid).cast("string"), F.col(right_rid).cast("string")
    return joined.select(
        F.concat_ws("|", left, right).alias("out_id"), F.col(left_rid).alias("lhs_id"), F.col(right_rid).alias("rhs_id")
    )


def numbered(df: DataFrame, keys: Sequence[str], name: str = "address") -> DataFrame:
    """Distinct values of the keys that are not null, with a number from 0 on in their order."""
    return ordinal(df.select(*keys).dropna().distinct(), [F.col(k) for k in keys], name)


def address_edges(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_rid: str, right_rid: str
) -> DataFrame:
    """Hash join as two edge tables in one: (side, address, id).

    Every value of the right join columns has an address. `build` rows say which right
    rows lie there, `probe` rows which left rows look there: n + m rows, where the pairs
    of a hot key are n * m. The join is not run.
    """
    columns = [b for _, b in on]
    addresses = numbered(right, columns)

    def side(name: str, frame: DataFrame, own: Sequence[str], rid: str) -> DataFrame:
        keyed = frame.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(own)], F.col(rid).alias("id"))
        known = addresses.select("address", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)])
        same = F.lit(True)
        for i in range(len(columns)):
            same = same & (F.col(f"_o{i}") == F.col(f"_k{i}"))
        return keyed.join(known, same).select(F.lit(name).alias("side"), "address", F.col("id").cast("string").alias("id"))

    return side("build", right, columns, right_rid).unionByName(side("probe", left, [a for a, _ in on], left_rid))


def pairs_of(addressed: DataFrame) -> DataFrame:
    """The pairs (out_id, lhs_id, rhs_id) of a join from its address edges."""
    probe = addressed.filter(F.col("side") == "probe").select("address", F.col("id").alias("lhs_id"))
    build = addressed.filter(F.col("side") == "build").select(F.col("address").alias("_a"), F.col("id").alias("rhs_id"))
    joined = probe.join(build, F.col("address") == F.col("_a"))
    return joined.select(F.concat_ws("|", "lhs_id", "rhs_id").alias("out_id"), "lhs_id", "rhs_id")


def pair_counts(addressed: DataFrame) -> DataFrame:
    """(address, n_probe, n_build, n_pairs): the size of the joined form, without building it."""
    count = addressed.groupBy("address").agg(
        F.count_if(F.col("side") == "probe").alias("n_probe"), F.count_if(F.col("side") == "build").alias("n_build")
    )
    return count.select("*", (F.col("n_probe") * F.col("n_build")).alias("n_pairs"))


def phase_edges(df: DataFrame, keys: Sequence[str], rid: str, order: list[Column]) -> DataFrame:
    """Group-by in two phases: (phase, out_id, in_id).

    Phase 0 leads from a group's address to its rows, phase 1 from the position of an
    output to the address of its group; `order` orders the groups, over the keys and
    their row count `cnt`.
    """
    groups = numbered(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).select(*keys), keys)
    counted = attach(groups, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")), list(keys))
    outputs = ordinal(counted, order, "out_id")
    rows = attach(df.select(*keys, rid), groups, list(keys))
    first = rows.select(F.lit(0).cast("long").alias("phase"), F.col("address").alias("out_id"), F.col(rid).cast("string").alias("in_id"))
    second = outputs.select(F.lit(1).cast("long").alias("phase"), "out_id", F.col("address").cast("string").alias("in_id"))
    return first.unionByName(second)


def through_phases(phased: DataFrame) -> DataFrame:
    """(out_id, in_id) of a group-by from its two phases."""
    upper = phased.filter("phase = 1").select("out_id", F.col("in_id").cast("long").alias("in_id"))
    return compose(upper, phased.filter("phase = 0").select("out_id", "in_id"))


def full_compose(upper: DataFrame, lower: DataFrame, via: str = "in_id", to: str = "out_id") -> DataFrame:
    """Follows `upper` one operator down and keeps what is unmatched on either side, with nulls for the other.

    Matched rows by an inner join, and the unmatched ones of either side by anti joins: each of the three can be
    split where a key is hot, which a full outer join cannot.
    """
    below = lower.withColumnsRenamed({c: f"_b_{c}" for c in lower.columns})
    kept = [F.col(c) for c in upper.columns if c != via]
    added = [F.col(f"_b_{c}").alias(c) for c in lower.columns if c != to]
    matched = left_join(upper, below, [(via, f"_b_{to}")]).select(*kept, *added)
    alone = known_keys_join(lower, upper, [(to, via)], "left_anti").select(*[c for c in lower.columns if c != to])
    return matched.unionByName(alone, allowMissingColumns=True)


def compose(
    upper: DataFrame, lower: DataFrame, via: str = "in_id", to: str = "out_id", how: str = "inner"
) -> DataFrame:
    """Follows `upper` one operator further down: upper.via = lower.to.

    how="left" keeps upper edges without a lower one (outer joins).
    """
    below = lower.withColumnsRenamed({c: f"_b_{c}" for c in lower.columns})
    on = (via, f"_b_{to}")
    joined = left_join(upper, below, [on]) if how == "left" else upper.join(below, F.col(on[0]) == F.col(on[1]), how)
    kept = [F.col(c) for c in upper.columns if c != via]
    added = [F.col(f"_b_{c}").alias(c) for c in lower.columns if c != to]
    return joined.select(*kept, *added)


def segments(
    df: DataFrame,
    keys: Sequence[str],
    rid: str,
    limits: Limits = DEFAULT_LIMITS,
    as_text: bool = False,
) -> DataFrame:
    """Per group: row count and the sorted ids, in segments of about `list_rows` ids.

    A group up to that size is one row. A larger one is spread over several
    rows by a hash of the id, so that no array and no task holds a whole hot
    group. Columns: keys, cnt, segment, rids.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    rows = attach(df.select(*keys, F.col(rid).cast("string").alias(rid)), sizes, list(keys), limits)
    pieces = F.ceil(F.col("cnt") / F.lit(limits.list_rows)).cast("long")
    segment = F.when(pieces > 1, bucket_of(F.col(rid), pieces)).otherwise(F.lit(0).cast("long"))
    grouped = rows.select(*keys, "cnt", segment.alias("segment"), rid).groupBy(*keys, "cnt", "segment")
    packed = F.array_sort(F.collect_list(rid))
    return grouped.agg((F.concat_ws(",", packed) if as_text else packed).alias("rids"))


def lookup(edges: DataFrame, ids: DataFrame, column: str = "out_id", bound: int | None = None) -> DataFrame:
    """Edges of the wanted output ids; `bound` is their number, if known."""
    return edges.join(sized(ids, bound=bound), column)
