"""Sequence operators: online medians and forward fill."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.runtime import cut, ready_workers


def online_median(df: DataFrame, keys: list[str], order: list[str], value: str, least: int, out: str) -> DataFrame:
    """Median of the earlier non-null values of the key, null with fewer than ``least`` of them; for keys of calendar length.

    For short histories; ``online_median_sorted`` is the linear-time form for long ones.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def trailing_median(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, least: int, out: str) -> DataFrame:
    """Median of the last ``n`` rows before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def online_median_sorted(df: DataFrame, key: str, day: str, value: str, least: int, out: str) -> DataFrame:
    """``key, day, out``: as ``online_median`` for one row per key and day, with a sorted list per key; a key's days are bounded by the calendar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        seen, medians = [], []
        for v in pdf[value].tolist():
            n = len(seen)
            medians.append((seen[(n - 1) // 2] + seen[n // 2]) / 2 if n >= max(1, least) else None)
            if v is not None and v == v:
                insort(seen, v)
        return pd.DataFrame({key: pdf[key].to_numpy(), day: pdf[day].to_numpy(), out: np.array(medians, float)})

    ready_workers(df.sparkSession)
    kind = dict(df.dtypes)
    return df.select(key, day, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {day} {kind[day]}, {out} double").withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def past_median(df: DataFrame, day: str, value: str, least: int, out: str, series: str | None = None, rows_per_bucket: int = 1_000_000, buckets: int = 64) -> DataFrame:
    """``day, out`` (and ``series``, if given): for each day the median of the values of all earlier days, over all entities; null with fewer than ``least``.

    Exact and distributed: values are counted per day, then cut at approximate quantiles into buckets (``buckets``, more if
    one would hold over ``rows_per_bucket`` counts); totals per day and bucket tell in which bucket each day's
    middle ranks lie and how deep, and each bucket then answers those ranks alone, in day order.
    A value that a third of all rows share is one row per day. ``series`` names a few series, each with medians of its own.
    """
    name = F.col(series).cast("string") if series else F.lit("")
    rows = df.select(F.coalesce(name, F.lit("")).alias("_k"), F.col(day).alias("_d"), F.col(value).cast("double").alias("_v"))
    counted = cut(rows.where("_v is not null").groupBy("_k", "_d", "_v").agg(F.count(F.lit(1)).alias("_n")))
    buckets = max(buckets, -(-counted.count() // rows_per_bucket))
    found = counted.groupBy("_k").agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10_000)).collect()
    cuts = {k: sorted(set(q)) for k, q in found}
    bounds = F.create_map(*[x for k, q in cuts.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in q]))]) if cuts else None
    valued = counted.withColumn("_b", F.size(F.filter(F.try_element_at(bounds, "_k"), lambda c: c < F.col("_v"))) if cuts else F.lit(0))
    daily = valued.groupBy("_k", "_d", "_b").agg(F.sum("_n").alias("_n"))
    most = max([len(q) for q in cuts.values()], default=0)
    grid = rows.select("_k", "_d").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(most)))).join(daily, ["_k", "_d", "_b"], "left")
    before = Window.partitionBy("_k", "_b").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    lower = Window.partitionBy("_k", "_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_below", F.coalesce(F.sum("_c").over(lower), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy("_k", "_d")))
    grid = cut(grid.select("_k", "_d", "_b", "_c", "_below", "_all"))
    ranks = grid.where("_all > 0").select("_k", "_d", "_b", "_c", "_below", F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))).alias("_r")).where("_r >= _below and _r < _below + _c")
    asked = ranks.select("_k", "_b", "_d", F.lit(None).cast("double").alias("_v"), F.lit(None).cast("bigint").alias("_n"), (F.col("_r") - F.col("_below")).alias("_i"))
    work = valued.select("_k", "_b", "_d", "_v", "_n", F.lit(None).cast("bigint").alias("_i")).unionByName(asked)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a day's questions come before its values
        pdf = pdf.assign(_q=pdf["_i"].isna()).sort_values(["_d", "_q"], kind="stable")
        known = np.unique(pdf.loc[pdf["_q"], "_v"].to_numpy(float))
        places = np.searchsorted(known, pdf["_v"].fillna(0).to_numpy(float)).tolist()
        tree, top = CountTree(len(known)), []
        for d, place, n, i, is_value in zip(pdf["_d"].tolist(), places, pdf["_n"].tolist(), pdf["_i"].tolist(), pdf["_q"].tolist()):
            if is_value:
                tree.add(place, int(n))
            else:
                top.append((pdf["_k"].iat[0], d, known[tree.holder(int(i))]))
        return pd.DataFrame(top, columns=["_k", "_d", "_v"])

    ready_workers(df.sparkSession)
    kind = dict(df.dtypes)[day]
    answers = work.groupBy("_k", "_b").applyInPandas(run, f"_k string, _d {kind}, _v double").groupBy("_k", "_d").agg(F.avg("_v").alias("_m"))
    totals = grid.groupBy("_k", "_d").agg(F.max("_all").alias("_all"))
    found = totals.join(answers, ["_k", "_d"], "left")
    return found.select(*([F.col("_k").alias(series)] if series else []), F.col("_d").alias(day), F.when(F.col("_all") >= least, F.col("_m")).alias(out))


class CountTree:
    """Counts of ``n`` ordered places with prefix search in logarithmic time."""

    def __init__(self, n: int):
        self.tree, self.top = [0] * (n + 1), 1 << max(0, n.bit_length() - 1)

    def add(self, place: int, count: int) -> None:
        place += 1
        while place < len(self.tree):
            self.tree[place] += count
            place += place & -place

    def holder(self, rank: int) -> int:
        """The place that holds the item of rank ``rank``, from 0."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= rank:
                at += step
                rank -= self.tree[at]
            step >>= 1
        return at


def forward_filled(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Nulls replaced by the key's last value before them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
