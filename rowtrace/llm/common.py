"""What the operators share: reading tables, cutting lineage in the shared folder, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

_own_folder: list[str] = []
_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one in a plain local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="rowtrace-llm-"))
    return _own_folder[0]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: a lost executor costs no recomputation of what is above."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """As `cut`, as a Parquet table: columns are pruned and compressed when it is read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application; Spark serves the file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="rowtrace-code-")) / "rowtrace_code.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, job: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """`mapInArrow` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(job, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int, row_cost: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes each; a longer text is a slice of its own. `row_cost` is
    added for each row."""
    yield from slices_by(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + row_cost, limit)


def slices_by(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rows have about `limit` together; a larger row is a slice of its own."""
    group = np.cumsum(sizes) // limit
    edges = (np.flatnonzero(np.diff(group)) + 1).tolist()
    for start, stop in zip([0, *edges], [*edges, len(sizes)], strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """Whole rows as one column `row` beside further columns, so that names cannot clash; `row.*` unpacks them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def prefix_sums(df: DataFrame, order: list[str], values: list[str], within: list[str] | None = None) -> DataFrame:
    """Exact running sums over a global order, without a task that sees all rows.

    Rows are dealt by range of (within, order); each range sums its own rows and
    adds the totals of the ranges before it, of which there is one row per range
    and group. Adds `before_<value>` (exclusive) for each value and `before_rows`.
    Identical rows are told apart by their place in the input, so that many of
    them spread over several ranges.
    """
    within = within or []
    keyed = df.withColumn("_place", F.monotonically_increasing_id())
    columns = [*within, *order, "_place"]
    dealt = cut(
        keyed.repartitionByRange(shuffle_parts(df.sparkSession), *columns).withColumn("_range", F.spark_partition_id())
    )
    sums = [*values, "_one"]
    dealt = dealt.withColumn("_one", F.lit(1).cast("long"))
    totals = dealt.groupBy("_range", *within).agg(*[F.sum(v).alias(f"_total_{v}") for v in sums])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        "_range", *within, *[F.coalesce(F.sum(f"_total_{v}").over(earlier), zero).alias(f"_offset_{v}") for v in sums]
    )
    here = Window.partitionBy("_range", *within).orderBy(*order, "_place").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(v).over(here), zero).alias(f"_local_{v}") for v in sums])
    condition = local["_range"] == offsets["_range"]
    for name in within:
        condition = condition & local[name].eqNullSafe(offsets[name])
    joined = local.join(offsets, condition)
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.col(f"_local_{v}") + F.col(f"_offset_{v}")).alias(f"before_{v}") for v in values],
        (F.col("_local__one") + F.col("_offset__one")).alias("before_rows"),
    )
