"""Exact quantiles per key without gathering a key's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.runtime import cut, lookup, salted_lookup

#: Most rows of a bracket that are ranked in one task; a wider bracket is narrowed again.
BRACKET_ROWS = 2_000_000
_GRID = 1_000


def exact_quantile(df: DataFrame, key: str, value: str, p: float, out: str, accuracy: int = 10_000) -> DataFrame:
    """``key, out``: the linearly interpolated quantile ``p`` of ``value`` per ``key``; null values and null keys are left out."""
    return exact_quantiles(df, key, value, {out: p}, accuracy)


def exact_quantiles(df: DataFrame, key: str, value: str, ps: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """``key`` and a column for each of ``ps``: linearly interpolated quantiles of ``value`` per ``key``; null values and null keys are left out.

    A mergeable sketch brackets each wanted rank to within 4/accuracy of a key's rows, or, for a key of fewer rows
    than ``accuracy``, by its extremes; while a bracket holds more than BRACKET_ROWS, a sketch of its own rows narrows it.
    One more pass counts what lies below the brackets and keeps, pre-aggregated, only the distinct values inside them.
    """
    rows = df.select(key, F.col(value).alias("_v")).where(F.col("_v").isNotNull() & F.col(key).isNotNull())
    e = 4.0 / accuracy
    parts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", [x for p in ps.values() for x in (max(p - e, 0.0), min(p + e, 1.0))], accuracy).alias("_q"))
    few = F.col("_n") < accuracy
    ends = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(few | F.lit(p <= e), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"), F.when(few | F.lit(p + e >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi")) for i, p in enumerate(ps.values())]
    brackets = cut(parts.select(key, "_n", F.array(*ends).alias("_b")))
    most = brackets.agg(F.max("_n")).first()[0] or 0
    share = 2.5 * e
    while most * share > BRACKET_ROWS and share > 1e-9:
        brackets, share = cut(_narrowed(rows, brackets, key, accuracy)), share * 4 / _GRID
    inside = lookup(rows, brackets, [key], "inner", spread=F.xxhash64("_v")).select(key, "_n", "_v", F.explode("_b").alias("_b")).where("_v <= _b.hi")
    counted = inside.groupBy(key, "_n", F.col("_b.i").alias("_i"), F.col("_b.p").alias("_p"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(key, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_rank", F.col("_p") * (F.col("_n") - 1))
    holds = lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))
    low, high = F.floor("_rank"), F.ceil("_rank")
    at = lambda i, c: F.when(F.col("_i") == i, c)
    picked = ranked.where("_v is not null").groupBy(key).agg(*[f for i in range(len(ps)) for f in (F.max(at(i, F.when(holds(low), F.col("_v")))).alias(f"_a{i}"), F.max(at(i, F.when(holds(high), F.col("_v")))).alias(f"_b{i}"), F.max(at(i, F.col("_rank") - low)).alias(f"_f{i}"))])
    return picked.select(key, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(out) for i, out in enumerate(ps)])


def _narrowed(rows: DataFrame, brackets: DataFrame, key: str, accuracy: int) -> DataFrame:
    """The brackets, each cut down to about 4/1000 of its rows by a grid of quantiles of the rows inside it."""
    each = salted_lookup(rows, brackets, [key], "inner", spread=F.xxhash64("_v")).select(key, "_n", "_v", F.explode("_b").alias("_b"))
    within = (F.col("_v") >= F.col("_b.lo")) & (F.col("_v") <= F.col("_b.hi"))
    grid = [g / _GRID for g in range(_GRID + 1)]
    found = each.groupBy(key, "_n", "_b").agg(F.count_if(F.col("_v") < F.col("_b.lo")).alias("_below"), F.count_if(within).alias("_k"), F.percentile_approx(F.when(within, F.col("_v")), grid, accuracy).alias("_q"))
    # the places of the ranks before and behind the two that are interpolated, with room for the sketch's error
    rank, step = F.col("_b.p") * (F.col("_n") - 1) - F.col("_below"), 1 + 4 * _GRID / accuracy
    place = lambda r: r / F.col("_k") * _GRID
    low, high = F.floor(place(F.floor(rank) - 1) - step).cast("int"), F.ceil(place(F.ceil(rank) + 2) + step).cast("int")
    lo = F.when(low <= 0, F.col("_b.lo")).otherwise(F.get("_q", low))
    hi = F.when(high >= _GRID, F.col("_b.hi")).otherwise(F.get("_q", high))
    return found.groupBy(key, "_n").agg(F.collect_list(F.struct(F.col("_b.i").alias("i"), F.col("_b.p").alias("p"), lo.alias("lo"), hi.alias("hi"))).alias("_b"))


def table_quantiles(df: DataFrame, columns: list[str], ps: dict[str, float]) -> DataFrame:
    """``columna`` and a column for each of ``ps``: quantiles of whole columns, as doubles; a column without values has no row."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "columna", "_value")
    return exact_quantiles(long, "columna", "_value", ps)
