"""The zone-by-day panel: aggregation, calendar completion, lags, trailing means and next-day targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.functions.scalars import season
from tesela.operators.ranking import ordered
from tesela.runtime import cut

#: Sums of the panel: output name, claim column, decimals kept in the exact sum.
SUMS = {"distance_km_total": "distance_km", "traslado_min_total": "traslado_min", "resolucion_base_min_total": "resolucion_base_min", "costo_operativo_total_ars": "costo_operativo_ars", "costo_total_compuesto_ars": "costo_total_compuesto_ars"}
METRICS = ["reclamos_count", "tiempo_total_operativo_min", "costo_total_compuesto_ars", "traslado_min_total", "lluvia_mm"]
TARGETS = {"reclamos": "reclamos_count", "tiempo": "tiempo_total_operativo_min", "costo": "costo_total_compuesto_ars"}
#: A pivot has a column per value, so at most so many values.
MOST_PIVOTED = 2_000


def exact_sum(c: str, scale: int = 4) -> Column:
    """Sum as a decimal, so that the order of rows doesn't matter, returned as a double; 0 for no values."""
    return F.coalesce(F.sum(F.col(c).try_cast(f"decimal(18,{scale})")), F.lit(0)).cast("double")


def zone_days(claims: DataFrame) -> DataFrame:
    """Claims per zone and day with distinct counts, sums and the mean travel time; claims without a zone are left out."""
    distinct = {"reclamos_unicos": "reclamo_id", "sedes_unicas": "sede_id", "destinos_unicos": "destino_key", "servicios_unicos": "servicio_normalizado", "localidades_unicas": "localidad"}
    out = (
        claims.where("zona_id is not null")
        .groupBy("zona_id", "fecha")
        .agg(F.count(F.lit(1)).alias("reclamos_count"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()], *[exact_sum(c).alias(n) for n, c in SUMS.items()], F.count("traslado_min").alias("_n"))
    )
    return out.withColumns({"tiempo_total_operativo_min": F.col("traslado_min_total") + F.col("resolucion_base_min_total"), "traslado_min_promedio": F.try_divide("traslado_min_total", "_n")}).drop("_n")


def with_rain(panel: DataFrame, rain: DataFrame) -> DataFrame:
    """Add the day's rain ``fecha, lluvia_mm``, one row per day, to every zone: 0 and status ``missing`` where there is none."""
    known = F.col("lluvia_mm").isNotNull()
    out = panel.join(rain, "fecha", "left").withColumn("lluvia_status", F.when(known, "observed").otherwise("missing"))
    return out.withColumn("lluvia_mm", F.coalesce("lluvia_mm", F.lit(0.0))).withColumn("llovio", F.col("lluvia_mm") > 0)


def pivoted_counts(claims: DataFrame, values: list[str], by: str = "sede_id", prefix: str = "reclamos_") -> DataFrame:
    """Claims per zone and day for each of ``values``, 0 where there are none."""
    counts = [F.count_if(F.col(by) == v).alias(f"{prefix}{v.lower()}") for v in values]
    return claims.where("zona_id is not null").groupBy("zona_id", "fecha").agg(*counts)


def present_values(df: DataFrame, column: str, most: int = MOST_PIVOTED) -> list[str]:
    """The distinct values of ``column`` in order, without null; more than ``most`` are an error, as a table can't have a column for each."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column}: more than {most} values to pivot")
    return sorted(found)


def calendar(df: DataFrame, entity: str, day: str) -> DataFrame:
    """Every calendar day of each entity from its first to its last."""
    return df.groupBy(entity).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).where("_a is not null").select(entity, F.explode(F.sequence("_a", "_b")).alias(day))


def fixed_calendar(spark, since: str, until: str) -> DataFrame:
    """The days from ``since`` to ``until``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("fecha"))


def filled_by_name(df: DataFrame, endings: tuple[str, ...] = ("_count", "_total", "_ars", "_unicos", "_promedio", "_operativo_min"), starts: tuple[str, ...] = ("reclamos_",)) -> DataFrame:
    """Nulls to 0 in the numeric columns whose name has one of the endings or starts; others stay null."""
    return df.na.fill(0, [c for c in df.columns if c.endswith(endings) or c.startswith(starts)])


def completed(df: DataFrame, entity: str = "zona_id", day: str = "fecha") -> DataFrame:
    """``df``, unique by entity and day, with all days of each entity; counts and totals 0 on added days, ``has_claims`` tells which."""
    out = calendar(df, entity, day).join(df, [entity, day], "left")
    return filled_by_name(out).withColumn("has_claims", F.col("reclamos_count") > 0)


def calendar_features(df: DataFrame, day: str = "fecha") -> DataFrame:
    """Add day of week (Monday 0), month, quarter, season and weekend flag."""
    d = F.col(day)
    return df.withColumns({"day_of_week": F.weekday(d), "month": F.month(d), "quarter": F.quarter(d), "season": season(d), "is_weekend": F.weekday(d).isin(5, 6)})


def trailing_mean(c: str, n: int, least: int, over) -> Column:
    """Mean of the ``n`` rows before this one, null with fewer than ``least`` values."""
    w = over.rowsBetween(-n, -1)
    return F.when(F.count(c).over(w) >= least, F.sum(F.col(c).try_cast("decimal(18,4)")).over(w).cast("double") / F.count(c).over(w))


def supervised(df: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Lags 1 and 7, trailing means of 7 (from 3 values) and 28 (from 7) that end the day before, and next-day targets, per zone."""
    w = Window.partitionBy("zona_id").orderBy("fecha")
    cols = {}
    for m in metrics:
        cols |= {f"{m}_lag_1": F.lag(m, 1).over(w), f"{m}_lag_7": F.lag(m, 7).over(w), f"{m}_roll_7_mean": trailing_mean(m, 7, 3, w), f"{m}_roll_28_mean": trailing_mean(m, 28, 7, w), f"y_{m}_t1": F.lead(m, 1).over(w)}
    return df.withColumns(cols).withColumn("target_available_t1", F.lead("fecha", 1).over(w).isNotNull())


def literal_rolling(df: DataFrame, metric: str = "reclamos_count", n: int = 7, least: int = 3) -> DataFrame:
    """The trailing mean of a whole-number ``metric`` that runs across zone borders, kept for comparison: only the shift is per zone.

    The frame is one sequence in the order of zone and day; running totals of value and count over it, found per range partition, give each row's
    mean as the difference to the row ``n`` before, so no task holds the whole sequence. ``supervised`` is the form that stays inside zones.
    """
    lag = F.lag(metric, 1).over(Window.partitionBy("zona_id").orderBy("fecha"))
    rows = df.select("zona_id", "fecha", lag.cast("bigint").alias("_lag")).select("*", F.coalesce("_lag", F.lit(0)).alias("_v"), F.col("_lag").isNotNull().cast("bigint").alias("_k"))
    rows = cut(ordered(rows, [F.asc("zona_id"), F.asc("fecha")], "_r", {"_sum": "_v", "_count": "_k"}))
    earlier = rows.select((F.col("_r") + n).alias("_r"), F.col("_sum").alias("_s0"), F.col("_count").alias("_c0"))
    both = rows.join(earlier, "_r", "left")
    total, count = F.col("_sum") - F.coalesce("_s0", F.lit(0)), F.col("_count") - F.coalesce("_c0", F.lit(0))
    return both.select("zona_id", "fecha", F.when(count >= least, total / count).alias("media_literal"))
