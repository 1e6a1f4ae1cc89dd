"""Ways to store edges so that later lookups read little."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rowtrace.operators.edges import segments
from rowtrace.session import DEFAULT_LIMITS, Limits, fresh_path


def store_plain(edges: DataFrame, path: str | None = None) -> DataFrame:
    """As they come: a lookup reads everything."""
    path = path or fresh_path(edges.sparkSession, "edges")
    edges.write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)


def store_zoned(edges: DataFrame, order: Sequence[str] = ("out_id", "in_id"), path: str | None = None) -> DataFrame:
    """Range-partitioned and sorted, so that row-group statistics rule out most of the file.

    The input id is part of the range key: the edges of a hot output spread over
    several files.
    """
    path = path or fresh_path(edges.sparkSession, "zoned")
    spread = edges.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)


def store_grouped(
    edges: DataFrame, path: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """One row per output and segment, with the input ids in an array."""
    path = path or fresh_path(edges.sparkSession, "grouped")
    packed = segments(edges, ["out_id"], "in_id", limits)
    packed.repartitionByRange("out_id", "segment").sortWithinPartitions("out_id").write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)
