"""Stored edges: written once in buckets of the output id, and looked up by it.

A store is a folder of Parquet files, bucketed and sorted by `out_id`, with a small
table beside it that says how. It can be opened again by its path. A lookup of a few
ids reads the files of their buckets only, and in these the row groups that may hold
them. A lookup of many joins them to the store: the ids are shuffled into the store's
buckets, the store itself stays where it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.operators.attach import measure
from rowtrace.session import fresh_path

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 4_096
FEW_IDS = 1_000  # ids that are put into the filter of the scan


@dataclass(frozen=True)
class EdgeStore:
    """Edges at `path`, in `buckets` buckets; `table` is the session's name for them."""

    spark: SparkSession
    path: str
    buckets: int
    table: str

    @staticmethod
    def write(edges: DataFrame, path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> EdgeStore:
        """One file for each bucket; a bucket with a hot id is dealt into several by the other columns."""
        spark = edges.sparkSession
        path = path or fresh_path(spark, "store")
        known = measure(edges)
        buckets = max(1, min(MOST_BUCKETS, -(-known.rows // bucket_rows)))
        bucket = F.pmod(F.hash("out_id"), F.lit(buckets)).alias("_bucket")
        sizes = known.frame.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_pieces"))  # `buckets` rows
        dealt = known.frame.select("*", bucket).join(F.broadcast(sizes), "_bucket")
        parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = dealt.repartition(parts, "_bucket", F.pmod(F.xxhash64(*edges.columns), F.col("_pieces"))).select(*edges.columns)
        table = f"edges_{uuid.uuid4().hex[:12]}"
        writer = dealt.write.format("parquet").bucketBy(buckets, "out_id").sortBy("out_id").option("path", f"{path}/edges")
        writer.saveAsTable(table)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields)
        spark.createDataFrame([(columns, buckets)], "columns string, buckets int").write.parquet(f"{path}/layout")
        return EdgeStore(spark, path, buckets, table)

    @staticmethod
    def open(spark: SparkSession, path: str) -> EdgeStore:
        columns, buckets = spark.read.parquet(f"{path}/layout").first()
        table = f"edges_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"create table {table} ({columns}) using parquet clustered by (out_id) sorted by (out_id) "
            f"into {buckets} buckets location '{path}/edges'"
        )
        return EdgeStore(spark, path, buckets, table)

    def edges(self) -> DataFrame:
        return self.spark.table(self.table)

    def lookup(self, ids: DataFrame, bound: int | None = None) -> DataFrame:
        """Edges of the output ids in the column `out_id` of `ids`, with the further columns of `ids`."""
        if bound is not None and bound <= FEW_IDS:
            wanted = [row[0] for row in ids.select("out_id").distinct().collect()]  # at most `bound`
            chosen = self.edges().filter(F.col("out_id").isin(wanted))
            return chosen.join(F.broadcast(ids), "out_id")
        return self.edges().join(ids, "out_id")


def rows_read(df: DataFrame) -> int:
    """Rows that the file scans of a query give out when it is run as a whole."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    read = 0
    pending = [execution.executedPlan()]
    while pending:
        node = pending.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            pending.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            pending.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            read += node.metrics().apply("numOutputRows").value()
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return read
