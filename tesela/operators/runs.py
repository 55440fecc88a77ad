"""Runs of equal values along an order, for sources of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.runtime import cut, salted_lookup


def equal_runs(df: DataFrame, row: str, key: str, order: str, value: str, chunks: int = 64, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """``row, key, order, value, run_length``: how many consecutive rows of ``key``, ordered by numeric ``order`` and then ``row``, share this row's ``value``.

    Rows with a null ``key`` or ``order`` are left out; a null ``value`` breaks a run and has length 0. Each key is
    cut at approximate quantiles of ``order`` into ``chunks`` parts, or as many more as keep a part of the largest key near ``rows_per_chunk``;
    runs are found inside a part, and only the first and last run of every part, at most two rows each, are joined along the key.
    """
    rows = df.select(row, key, order, value).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    most = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    chunks = max(chunks, -(-most // rows_per_chunk))
    cuts = cut(rows.groupBy(key).agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], max(1000, 4 * chunks)).alias("_cuts")))
    parts = salted_lookup(rows, cuts, [key], "inner", spread=F.xxhash64(row)).withColumn("_part", F.expr(f"size(filter(_cuts, c -> c < `{order}`))")).drop("_cuts")
    along = Window.partitionBy(key, "_part").orderBy(order, row)
    same = F.coalesce(F.lag(value).over(along) == F.col(value), F.lit(False))
    parts = parts.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(key, "_part", "_run")))
    ends = parts.groupBy(key, "_part").agg(F.min(F.struct("_run", "_size", F.col(value).alias("_value"))).alias("_a"), F.max(F.struct("_run", "_size", F.col(value).alias("_value"))).alias("_b"))
    segments = ends.select(key, "_part", F.explode(F.when(F.col("_a._run") == F.col("_b._run"), F.array("_a")).otherwise(F.array("_a", "_b"))).alias("_s")).select(key, "_part", "_s.*")
    chain = Window.partitionBy(key).orderBy("_part", "_run")
    joined = F.coalesce((F.lag("_value").over(chain) == F.col("_value")) & (F.lag("_part").over(chain) != F.col("_part")), F.lit(False))
    segments = segments.withColumn("_chain", F.sum(F.when(joined, 0).otherwise(1)).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    segments = segments.withColumn("_total", F.sum("_size").over(Window.partitionBy(key, "_chain"))).select(key, "_part", "_run", "_total")
    length = F.when(F.col(value).isNull(), 0).otherwise(F.coalesce("_total", "_size"))
    return parts.join(segments, [key, "_part", "_run"], "left").withColumn("run_length", length.cast("bigint")).drop("_part", "_run", "_size", "_total")


def day_runs(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """``key, value, day, run_length`` for each distinct day a key shows a value: the number of consecutive calendar days it does.

    Repeated rows of a day count once. A key's days are bounded by the calendar.
    """
    days = df.where(F.col(key).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull()).select(key, value, day).distinct()
    island = F.date_sub(day, F.row_number().over(Window.partitionBy(key, value).orderBy(day)))
    return days.withColumn("_island", island).withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(key, value, "_island"))).drop("_island")
