"""Samples and splits by a hash of a key: the same rows on every run, at every size and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_share(*keys: str) -> Column:
    """A number from 0 to below 2**32 by the MD5 of the keys, joined by ``|``; a null key counts as an empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hundredth(*keys: str) -> Column:
    """A number from 0 to 99 by the hash of the keys."""
    return hash_share(*keys) % 100


def sampled(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """About ``share`` of the rows, in steps of a hundredth; rows with equal keys stay together."""
    return df.where(hundredth(*keys) < round(share * 100))
