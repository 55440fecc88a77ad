"""Profiles of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.operators.quantiles import table_quantiles
from tesela.operators.ranking import mid_ranks
from tesela.runtime import cut


def _unpivoted(row: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One row per column from a one-row frame with columns ``<column>__<part>``."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), *[F.col(f"`{c}__{p}`").alias(p) for p in parts]) for c in columns])).alias("r")).select("r.*")


def value_text(df: DataFrame, column: str) -> Column:
    """A column as text that doesn't depend on the engine: doubles and floats at six decimals."""
    c = F.col(f"`{column}`")
    return (c.try_cast("decimal(24,6)") if dict(df.dtypes)[column] in ("double", "float") else c).cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columna, valor, filas`` for every value of each column, null included; counted before the shuffle."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), value_text(df, c).alias("valor")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("columna", "valor").agg(F.count(F.lit(1)).alias("filas"))


def quality_profile(df: DataFrame, n: int = 5) -> DataFrame:
    """Per column: type, nulls, null ratio at four decimals, distinct values, and its ``n`` most frequent values with their counts, null written ``<NA>``.

    Everything comes from one count of values; ties of frequent values go by text. Doubles are told apart at six decimals. Columns of an empty table have no ratio and no values.
    """
    counts = value_counts(df, df.columns)
    first = first_of(counts, ["columna"], n, F.desc("filas"), F.coalesce("valor", F.lit("<NA>")))
    shown = F.concat(F.coalesce("valor", F.lit("<NA>")), F.lit(" ("), F.col("filas").cast("string"), F.lit(")"))
    tops = first.groupBy("columna").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("puesto", shown.alias("t")))), lambda x: x["t"])).alias("ejemplos"))
    known = F.col("valor").isNotNull()
    out = counts.groupBy("columna").agg(F.coalesce(F.sum(F.when(~known, F.col("filas"))), F.lit(0)).alias("nulos"), F.sum("filas").alias("_n"), F.count("valor").alias("distintos"))
    columns = df.sparkSession.createDataFrame(df.dtypes, "columna string, tipo string")
    whole = columns.join(out.join(tops, "columna"), "columna", "left").na.fill(0, ["nulos", "distintos"])
    return whole.select("columna", "tipo", "nulos", F.round(F.col("nulos") / F.col("_n"), 4).alias("nulos_ratio"), "distintos", "ejemplos")


def first_of(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered in ``puesto``; partial limits before the shuffle keep large keys small."""
    return df.withColumn("puesto", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("puesto") <= n)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, standard deviation, minimum, exact quantiles and maximum."""
    v = lambda c: F.col(f"`{c}`").cast("double")
    aggs = [f.alias(f"{c}__{n}") for c in columns for n, f in (("n", F.count(v(c))), ("media", F.avg(v(c))), ("desvio", F.stddev_samp(v(c))), ("minimo", F.min(v(c))), ("maximo", F.max(v(c))))]
    moments = _unpivoted(df.agg(*aggs), columns, ["n", "media", "desvio", "minimo", "maximo"])
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return moments.join(table_quantiles(df, columns, names), "columna", "left").select("columna", "n", "media", "desvio", "minimo", *names, "maximo")


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of each column, null written ``<NA>``; ties by value."""
    counts = value_counts(df, columns).withColumn("valor", F.coalesce("valor", F.lit("<NA>")))
    return first_of(counts, ["columna"], n, F.desc("filas"), F.asc("valor"))


def table_overview(df: DataFrame, name: str, day: str) -> DataFrame:
    """Rows, columns, first and last day, repeated rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(F.col(day).cast("date").alias("_d"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("_h"))
    return hashed.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"), F.lit(len(df.columns)).alias("columnas"), F.min("_d").alias("desde"), F.max("_d").alias("hasta"), (F.count(F.lit(1)) - F.count_distinct("_h")).alias("repetidas"))


def feature_inventory(base: DataFrame, derived: DataFrame) -> DataFrame:
    """Per column of ``derived``: family, whether ``base`` lacks it, nulls and coverage at four decimals."""
    from tesela.functions.scalars import feature_family

    families = F.create_map(*[F.lit(x) for c in derived.columns for x in (c, feature_family(c))])
    aggs = [f for c in derived.columns for f in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulos"), F.count(F.lit(1)).alias(f"{c}__filas"))]
    out = _unpivoted(derived.agg(*aggs), derived.columns, ["nulos", "filas"])
    return out.select("columna", F.try_element_at(families, "columna").alias("familia"), (~F.col("columna").isin(base.columns)).alias("nueva"), "nulos", F.round(F.lit(1.0) - F.col("nulos") / F.nullif("filas", F.lit(0)), 4).alias("cobertura"))


def family_summary(inventory: DataFrame) -> DataFrame:
    """Columns, new columns, nulls and mean coverage of each family of ``feature_inventory``."""
    return inventory.groupBy("familia").agg(F.count(F.lit(1)).alias("columnas"), F.count_if("nueva").alias("nuevas"), F.sum("nulos").alias("nulos"), F.round(F.avg("cobertura"), 4).alias("cobertura_media"))


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``variable_a, variable_b, spearman`` at three decimals for every pair of columns, over the rows that have all of them; ties share their mean rank."""
    rows = cut(df.select(*columns).dropna())
    for c in columns:
        rows = mid_ranks(rows, c, f"_r_{c}")
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.round(F.corr(f"_r_{a}", f"_r_{b}"), 3).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col(f"`{i}`").alias("spearman")) for i, (a, b) in enumerate(pairs)])))
