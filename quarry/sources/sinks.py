"""Writers. Each replaces what was at its path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def text(df: DataFrame, path: str) -> None:
    """A line for each value; null is an empty line."""
    (name,) = df.columns
    df.select(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def parquet(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").option("compression", "none")
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(path)
