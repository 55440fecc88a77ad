"""Joins with checked cardinality, keyed updates and lookups with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.runtime import cut, small


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Raise ``ValueError`` if a non-null key of ``df`` occurs twice; else return ``df``."""
    twice = df.dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {tuple(twice[0][k] for k in keys)} occurs {twice[0]['count']} times")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str | None = None) -> DataFrame:
    """Equi-join on non-null keys; ``validate`` is ``m:1`` or ``1:1`` and is checked by a count before, or None. What is checked is written once, so nothing is computed twice."""
    if validate:
        if validate not in ("m:1", "1:1"):
            raise ValueError(f"unknown cardinality {validate}")
        right = assert_unique(cut(right), on, "right side")
        if validate == "1:1":
            left = assert_unique(cut(left), on, "left side")
    return left.join(right, on, how)


def single_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it has exactly one row, else ``ValueError``."""
    if len(df.take(2)) != 1:
        raise ValueError(f"{name} must have exactly one row")
    return df


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame, computed once, to every row."""
    return df.join(F.broadcast(single_row(cut(one), "reference")), how="cross")


def looked_up(df: DataFrame, reference: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """Add ``value`` of the reference row with the same ``key``, or ``default``. The reference is broadcast only when counted small."""
    joined = df.join(small(reference.select(key, value)), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), default))


def updated(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keyed update: non-null ``values`` of ``new``, unique by key, replace those of ``old``; rows of ``new`` without a partner are ignored."""
    fresh = new.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values])
    joined = old.join(fresh, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like`` in its order: missing ones null, others dropped."""
    kinds = dict(like.dtypes)
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in like.columns])
