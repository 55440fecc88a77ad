"""Categories as indicator columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.panel import present_values


def one_hot(df: DataFrame, column: str, levels: list[str] | None = None, prefix: str | None = None, drop: str | None = None) -> DataFrame:
    """Add ``<prefix>_<level>`` with 1 or 0 for each of ``levels`` but ``drop``, by default the distinct values in order but the first.

    A null value has 0 everywhere. The levels of a column are counted and limited as in ``present_values``.
    """
    levels = present_values(df, column) if levels is None else levels
    drop = levels[0] if drop is None and levels else drop
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels if v != drop})


def yes_no(df: DataFrame, column: str, yes: tuple[str, ...] = ("yes", "si", "sí")) -> DataFrame:
    """``column`` as 1 for one of ``yes``, ignoring case and outer blanks, else 0; null stays null."""
    return df.withColumn(column, F.lower(F.trim(F.col(column))).isin(*yes).cast("int"))
