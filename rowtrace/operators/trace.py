"""Questions put to a captured lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrace.operators.attach import matching, sized
from rowtrace.operators.lineage import Lineage


def by_key(lineage: DataFrame, wanted: DataFrame, keys: Sequence[str], bound: int | None = None) -> DataFrame:
    """Lineage rows of the outputs whose keys are in `wanted` (null matches null).

    `bound`: row count of `wanted`, if it is known; otherwise it is measured.
    """
    picked = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys]).distinct()
    condition = matching([F.col(k) for k in keys], [F.col(f"_w_{k}") for k in keys])
    return lineage.join(sized(picked, bound=bound), condition, "left_semi")


def sizes(lineage: Lineage, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Smallest, largest and mean lineage size over the first `rows` outputs (None: all); 0 without outputs."""
    counted = lineage.backward(keys, rows)
    return counted.agg(
        F.count(F.lit(1)).alias("outputs"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_n"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_n"),
        F.coalesce(F.sum("n").cast("double") / F.count(F.lit(1)), F.lit(0.0)).alias("avg_n"),
    )


def originals(lineage: DataFrame, bases: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Lineage rows with columns of the base rows they point to.

    bases: (id column of the lineage, base table whose first column is its id, columns wanted).
    """
    rows = lineage
    for rid, base, columns in bases:
        renamed = base.select(F.col(base.columns[0]).alias("_id"), *columns)
        rows = rows.join(renamed, F.col(rid) == F.col("_id"), "left").drop("_id")
    return rows


def agreement(rows: DataFrame, holds: Column) -> DataFrame:
    """How many lineage rows there are, and for how many the join condition holds."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(holds, F.lit(False))).alias("n_agree")
    )


def row_counts(lineage: DataFrame) -> DataFrame:
    """Ids of each relation of a lineage table: (relation, rows). Only counts leave a task."""
    rids = [c for c in lineage.columns if c.endswith("_rid")]
    counted = lineage.agg(*[F.count(F.col(r)).alias(r) for r in rids])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).alias("rows")) for r in rids])))


def id_counts(lineage: DataFrame) -> DataFrame:
    """Rows, text bytes and distinct ids per relation of a lineage table: (relation, rows, bytes, distinct_ids).

    Whole numbers are told apart as such: they become text where they are counted.
    """
    rids = [c for c in lineage.columns if c.endswith("_rid")]
    whole = {r for r, kind in lineage.dtypes if kind in ("int", "bigint")}
    number = {r: F.col(r).cast("long") if r in whole else F.lit(None).cast("long") for r in rids}
    text = {r: F.lit(None).cast("string") if r in whole else F.col(r).cast("string") for r in rids}
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), number[r].alias("number"), text[r].alias("id")) for i, r in enumerate(rids)])
    long = lineage.select(F.explode(pairs).alias("p")).select("p.*").filter("number is not null or id is not null")
    per_id = long.groupBy("at", "number", "id").agg(F.count(F.lit(1)).alias("n"))
    per_relation = per_id.groupBy("at").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.length(F.coalesce(F.col("id"), F.col("number").cast("string")))).alias("bytes"),
        F.count(F.lit(1)).alias("distinct_ids"),
    )
    return per_relation.select(F.array(*[F.lit(r) for r in rids])[F.col("at")].alias("relation"), "rows", "bytes", "distinct_ids")
