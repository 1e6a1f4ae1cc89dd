"""Writers for lineage tables and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowtrace.session import fresh_path


def store_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Materialises a lineage query and reads it back."""
    path = path or fresh_path(df.sparkSession, "lineage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", append: bool = False) -> None:
    """CSV with a header line per file; `append` adds to what is there."""
    writer = df.write.mode("append" if append else "overwrite")
    writer.option("header", True).option("sep", separator).csv(path)
