"""Lineage cuts, skew-safe lookups and other plumbing shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast or collected by an operator that says so.
SMALL_TABLE_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's own, else ``spark.checkpoint.dir``, else, in local mode
    as in tests, a temporary folder. On a cluster without one it is an error."""
    context = spark.sparkContext
    there = context.getCheckpointDir()
    if there is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            there = tempfile.mkdtemp(prefix="tesela-checkpoint-")
        context.setCheckpointDir(there)
    return there


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers that start from now on find this package where the driver found it.

    Enough in local mode and wherever executors see the driver's folders; elsewhere ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left", salts: int = 16, spread: Column | None = None) -> DataFrame:
    """Join ``rows`` with ``per_key`` (at most one row per key) so that a hot key is spread over ``salts`` tasks.

    The lookup side is repeated once per salt; it is never hinted for broadcast, so adaptive execution
    broadcasts it only when its measured size is under the session's threshold. Rows with a null key
    find no partner.
    """
    spread = F.xxhash64(*[c for c in rows.columns]) if spread is None else spread
    left = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left", spread: Column | None = None) -> DataFrame:
    """``salted_lookup`` without its shuffle of ``rows`` where ``per_key``, which should be cut, is counted to be a small table."""
    return rows.join(F.broadcast(per_key), keys, how) if has_at_most(per_key, SMALL_TABLE_ROWS) else salted_lookup(rows, per_key, keys, how, spread=spread)


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns``, each computed exactly once per row.

    They pass through a one-row generator, which the optimizer neither merges with later projections nor
    pushes filters through; without it, long expressions are repeated wherever their result is used.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def small(df: DataFrame, rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` if it is counted to have at most ``rows`` rows; else leave the join to the planner."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def require_columns(df: DataFrame, names: list[str], contract: str) -> DataFrame:
    """Raise ``ValueError`` naming the columns of ``names`` that ``df`` lacks; else return ``df``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{contract}: missing columns {', '.join(missing)}")
    return df
