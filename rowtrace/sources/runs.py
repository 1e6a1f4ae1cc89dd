"""Readers for CSV tables: generated micro tables and benchmark run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the run-table families.
FAMILIES = {
    "micro_old": "query string, runtime double, cardinality long, groups string, output long, stats string, "
    "lineage_type string, notes string",
    "micro": "r long, query string, runtime double, n1 long, n2 long, sel string, skew double, ncol long, groups string, "
    "index_scan string, output long, stats string, lineage_type string, notes string, plan_timings string",
    "capture_v1": "query string, runtime double, sf double, repeat long, lineage_type string, n_threads long, "
    "size long, notes string",
    "capture_v2": "query string, runtime double, sf double, repeat long, lineage_type string, n_threads long, "
    "output long, stats string, notes string",
    "capture_v3": "query string, runtime double, sf double, repeat long, lineage_type string, n_threads long, "
    "output long, stats string, notes string, plan_timings string",
    "backward": "query string, runtime double, min double, max double, sf double, repeat long, lineage_type string, "
    "n_threads long, lineage_size long, base_size long",
    "per_query": "queryId string, sf double, mode string, avg_duration double, rowCount long",
    "per_operator": "op string, avg_duration double, row_count double, zipf_a double, num_records long, groups long, "
    "oids long, avg_parse_time double",
    "filter_scaling": "op string, avg_duration double, row_count double, zipf_a double, num_records long, "
    "groups long, oids long",
    "postprocess": "query_id string, sf double, ablation long, time_in_sec1 double, time_in_sec2 double, "
    "time_in_sec3 double, time_in_sec4 double, time_in_sec5 double",
}
MICRO = "idx long, z long, v double"


def read_micro(spark: SparkSession, path: str, columns: int = 0, text_key: bool = False) -> DataFrame:
    """Generated table with `columns` extra integer columns."""
    schema = MICRO.replace("z long", "z string") if text_key else MICRO
    schema += "".join(f", col{i} int" for i in range(columns))
    return spark.read.schema(schema).option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str, family: str, separator: str = ",") -> DataFrame:
    """One family of run tables; header lines repeated by appends are dropped."""
    columns = [c.strip().split(" ") for c in FAMILIES[family].split(",")]
    text = ", ".join(f"{name} string" for name, _ in columns)
    rows = spark.read.schema(text).option("header", True).option("sep", separator).csv(path)
    first = columns[0][0]
    rows = rows.filter(F.col(first).isNull() | (F.col(first) != first))
    return rows.select(*[F.expr(f"try_cast({name} as {kind})").alias(name) for name, kind in columns])


def union_families(frames: list[DataFrame]) -> DataFrame:
    """Rows of all families; columns a family lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
