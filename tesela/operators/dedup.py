"""One row per key, by an order that is always total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; nulls of a key are a key.

    As an aggregate of structs where the order is plain columns would lose mixed directions, this is a window; partial
    top-1 filtering before the shuffle (window group limit) keeps hot keys small.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def overridden(base: DataFrame, manual: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of both, those of ``manual`` taking the place of rows of ``base`` with the same key; ``prioridad`` tells which (1 manual)."""
    both = base.withColumn("prioridad", F.lit(0)).unionByName(manual.withColumn("prioridad", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, F.col("prioridad").desc(), *order)
