"""Global row numbers, running sums, ranks and shares without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.runtime import cut, salted_lookup


def ordered(df: DataFrame, order: list[Column], number: str = "puesto", sums: dict[str, str] | None = None) -> DataFrame:
    """Add ``number``, counted from 1 along ``order``, and running totals ``sums`` (new name: column).

    ``order`` must be total for a defined result. Rows are range-partitioned and written once; each partition numbers its own
    rows, and the partitions' counts and totals, one row each, give the offsets.
    """
    sums = sums or {}
    parts = cut(df.repartitionByRange(*order).withColumn("_o_part", F.spark_partition_id()))
    totals = parts.groupBy("_o_part").agg(F.count(F.lit(1)).alias("_o_n"), *[F.sum(c).alias(f"_o_{n}_") for n, c in sums.items()])
    before = Window.orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_o_part", start("_o_n").alias("_o_n"), *[start(f"_o_{n}_").alias(f"_o_{n}_") for n in sums])
    own = Window.partitionBy("_o_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_o_part")  # a row per partition
    return out.withColumns({number: (F.row_number().over(own) + F.col("_o_n")).cast("bigint"), **{n: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_o_{n}_") for n, c in sums.items()}}).drop("_o_part", "_o_n", *[f"_o_{n}_" for n in sums])


def with_totals(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add whole-frame aggregates as columns; one row is broadcast."""
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in columns.items()])), how="cross")


def with_share(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add each row's share of the total of ``value``."""
    return with_totals(df, {"_total": F.sum(value)}).withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def dense_ranks(df: DataFrame, values: list[str]) -> DataFrame:
    """Add ``rank_<value>``, the descending dense rank, for each of ``values``, and their sum ``puntaje``. Nulls have no rank."""
    for v in values:
        distinct = ordered(df.select(v).where(F.col(v).isNotNull()).distinct(), [F.desc(v)], f"rank_{v}")
        df = salted_lookup(df, distinct, [v])
    return df.withColumn("puntaje", sum((F.col(f"rank_{v}") for v in values), F.lit(0)))


def mid_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the ascending rank of ``value``, equal values sharing the mean of theirs."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    ends = ordered(counts, [F.asc(value)], "_r", {"_end": "_k"}).select(value, (F.col("_end") - (F.col("_k") - 1) / 2.0).alias(out))
    return salted_lookup(df, ends, [value])


def rank_groups(df: DataFrame, value: str, tie: str, out: str = "cuartil", parts: int = 4) -> DataFrame:
    """Add the quantile group by rank of first appearance: edges at ``1 + (n-1)k/parts``, ties settled by ``tie``."""
    rows = with_totals(ordered(df, [F.asc(value), F.asc(tie)], "_r"), {"_n": F.count(F.lit(1))})
    group = F.lit(parts)
    for k in range(parts - 1, 0, -1):
        group = F.when(F.col("_r") <= 1 + (F.col("_n") - 1) * k / F.lit(float(parts)), k).otherwise(group)
    return rows.withColumn(out, group).drop("_r", "_n")
