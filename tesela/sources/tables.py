"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one Parquet table; ``columns`` prunes the scan and must exist."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
