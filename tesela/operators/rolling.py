"""Trailing totals and averages per entity and calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures as whole units: column, factor.
ZONE_MEASURES = {"reclamos_count": 1, "costo_total_compuesto_ars": 100, "lluvia_mm": 10}


def latest_version(df: DataFrame, entity: str, day: str, version: str, values: list[str]) -> DataFrame:
    """One row per entity and day: the values with the latest ``version``; of equal versions the greatest values. Null entities and days are left out."""
    rows = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return rows.groupBy(entity, day).agg(F.max(F.struct(F.col(version), *values)).alias("_latest")).select(entity, day, *[f"_latest.{v}" for v in values])


def trailing_totals(daily: DataFrame, entity: str, day: str, values: list[str], windows: tuple[int, ...] = (7, 30), block_days: int = 64) -> DataFrame:
    """Totals of integer ``values`` over the days ending at each calendar day of an entity, from its first to its last day.

    Adds ``<value>_<w>`` for each window. Active days and the entity's calendar go, each once per block of ``block_days`` that it reaches
    into, to the task of that entity and block. There each active day is put on every date of the block that it influences, and the
    contributions are summed per entity and date together with the calendar's rows, which give the zeros; so the
    exploded rows are never shuffled. Absent days and nulls count as 0. ``daily`` has one row per entity and day.
    """
    longest = max(windows)
    block = lambda d: F.floor(F.unix_date(d) / block_days)
    active = daily.where(" or ".join(f"coalesce(`{v}`, 0) != 0" for v in values))
    totals = active.select(F.col(entity).alias("_e"), F.col(day).alias("_from"), F.date_add(day, longest - 1).alias("_to"), F.lit(None).cast("date").alias("_first"), *[F.col(v).cast("bigint").alias(f"_v{i}") for i, v in enumerate(values)])
    span = daily.groupBy(F.col(entity).alias("_e")).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    calendar = span.select("_e", "_from", "_to", F.col("_from").alias("_first"), *[F.lit(None).cast("bigint").alias(f"_v{i}") for i in range(len(values))])
    placed = totals.unionByName(calendar).withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to"))))).repartition("_e", "_block")
    since, until = F.greatest("_from", F.date_from_unix_date((F.col("_block") * block_days).cast("int"))), F.least("_to", F.date_from_unix_date((F.col("_block") * block_days + block_days - 1).cast("int")))
    spread = placed.withColumn("_on", F.explode(F.sequence(since, until))).withColumn("_lag", F.when(F.col("_first").isNull(), F.datediff("_on", "_from")))
    sums = [F.sum(F.when(F.col("_lag") < w, F.coalesce(F.col(f"_v{i}"), F.lit(0))).otherwise(0)).alias(f"{v}_{w}") for i, v in enumerate(values) for w in windows]
    out = spread.groupBy("_e", "_block", "_on").agg(F.max("_first").alias("_first"), *sums).where("_first is not null")  # only days of the calendar
    return out.select(F.col("_e").alias(entity), F.col("_on").alias(day), F.datediff("_on", "_first").alias("dia_nro"), *[f"{v}_{w}" for v in values for w in windows])


def zone_daily(zona_diario: DataFrame) -> DataFrame:
    """The zone-days that count, measures in whole claims, cents and tenths of mm; unusable numbers are 0."""
    rows = latest_version(zona_diario, "zona_id", "fecha", "cargado_en", list(ZONE_MEASURES))
    whole = lambda v, k: F.when(F.isnan(F.col(v).cast("double")), 0).otherwise(F.round(F.col(v).cast("double") * k)).try_cast("bigint").alias(v)
    return rows.select("zona_id", "fecha", *[whole(v, k) for v, k in ZONE_MEASURES.items()])


def zone_trailing(zona_diario: DataFrame) -> DataFrame:
    """Totals and averages of the zone measures over 7 and 30 days in their own units, for every zone and calendar day."""
    totals = trailing_totals(zone_daily(zona_diario), "zona_id", "fecha", list(ZONE_MEASURES))
    out = [(F.col(f"{v}_{w}") / k / d).alias(f"{v}_{n}_{w}") for v, k in ZONE_MEASURES.items() for w in (7, 30) for n, d in (("total", 1), ("media", w))]
    return totals.select("zona_id", "fecha", *out)


def zone_surges(zona_diario: DataFrame) -> DataFrame:
    """``zona_id, fecha, campo`` where twice the total of 7 days exceeds that of 30, from a zone's 30th day on."""
    totals = trailing_totals(zone_daily(zona_diario), "zona_id", "fecha", list(ZONE_MEASURES)).where("dia_nro >= 29")
    fields = F.array(*[F.when(2 * F.col(f"{v}_7") > F.col(f"{v}_30"), F.lit(v)) for v in ZONE_MEASURES])
    return totals.select("zona_id", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), F.explode(F.array_compact(fields)).alias("campo"))
