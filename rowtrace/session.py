"""Session settings, size limits and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    """Bounds behind every choice of a physical form.

    A result is only broadcast, sorted in one task or gathered into one array
    when it was measured (or is known) to stay under these bounds; beyond them
    the shuffled form of the same operator is used.
    """

    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 * 1024 * 1024
    window_group_rows: int = 1_000_000
    list_rows: int = 10_000
    slice_rows: int = 250_000


DEFAULT_LIMITS = Limits()


def build_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "rowtrace") -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the session names it.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="rowtrace-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, one per call."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there (short lineage)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a relation that two branches of one job read; freed by `release_caches`."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release_caches(down_to: int = 0) -> None:
    """Free what `keep` holds, but for the first `down_to`; later reads recompute it."""
    while len(_kept) > down_to:
        _kept.pop().unpersist()


#: Spark's own Bloom filters for joins of which one side is filtered: the other side's rows are asked before they are
#: shuffled. By default this is for scans of 10 GB and more. A filter has 2 MB; too many keys only make it pass more rows.
PRUNED = {
    "enabled": "true", "applicationSideScanSizeThreshold": "8m", "creationSideThreshold": "1t",
    "numBits": str(1 << 24), "maxNumBits": str(1 << 24), "expectedNumItems": "6000000", "maxNumItems": "6000000",
}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Plans made inside follow `settings`; the session's own are as before afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pruned(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins inside use Bloom filters as `PRUNED` says."""
    return configured(spark, {f"spark.sql.optimizer.runtime.bloomFilter.{name}": value for name, value in PRUNED.items()})


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A step that is over when it is left, with a result of its own: what it kept and shuffled is freed then.

    Inside, what a question shuffled goes as soon as it is answered. Files behind kept relations, and those of
    checkpoints, are deleted by Spark once the driver's garbage collector has found that nothing refers to them; a
    driver with free memory would not look for hours.
    """
    kept = len(_kept)
    try:
        with configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            yield
    finally:
        release_caches(kept)
        for _ in range(2):
            spark.sql("select 1").collect()  # Spark's listeners refer to the last question until the next one ends
            gc.collect()
            spark.sparkContext._jvm.System.gc()
