"""File sources: CSV, JSON documents, GeoJSON layers, spreadsheets, settings, and an inventory of artifacts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """CSV with a declared schema; unreadable cells are null."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents, one per file or one per line of an array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


GEOJSON = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON layers as ``propiedades, tipo, coordenadas`` (coordinates as JSON text)."""
    return read_json(spark, path, GEOJSON).select(F.explode("features").alias("f")).select(F.col("f.properties").alias("propiedades"), F.col("f.geometry.type").alias("tipo"), F.col("f.geometry.coordinates").alias("coordenadas"))


def read_excel(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """First sheet of a workbook; needs openpyxl or xlrd on the driver and raises ``ImportError`` without them."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path), schema)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A frame without rows."""
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table, or no rows while it doesn't exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return empty(spark, schema)


def require_input(paths: dict[str, str], name: str) -> str:
    """Path of a named input; ``KeyError`` for an unknown name, ``FileNotFoundError`` for a missing file."""
    if name not in paths:
        raise KeyError(f"unknown input {name}; known: {', '.join(sorted(paths))}")
    if not Path(paths[name]).exists():
        raise FileNotFoundError(paths[name])
    return paths[name]


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``nombre, ruta, existe, mb`` of named artifacts, sorted by name."""
    size = lambda p: sum(f.stat().st_size for f in ([p] if p.is_file() else p.rglob("*")) if f.is_file())
    rows = [(n, p, Path(p).exists(), round(size(Path(p)) / 1e6, 2) if Path(p).exists() else None) for n, p in sorted(paths.items())]
    return spark.createDataFrame(rows, "nombre string, ruta string, existe boolean, mb double")


def read_report(path: str) -> str:
    """Text of a report, empty if there is none."""
    return Path(path).read_text(encoding="utf-8") if Path(path).exists() else ""


def read_settings(path: str) -> dict[str, str]:
    """``KEY=value`` lines of a settings file; blank lines, comments and lines without = are skipped."""
    lines = [x.strip() for x in read_report(path).splitlines()]
    return {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition("=") for x in lines if x and not x.startswith("#") and "=" in x)}
