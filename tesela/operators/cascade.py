"""Exclusion cascades: the first rule that a row breaks is its reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.functions.scalars import composite_key


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], out: str = "motivo_exclusion") -> DataFrame:
    """Add the name of the first rule that holds, null for kept rows; a rule that is null does not hold."""
    first, *rest = [(n, F.coalesce(c, F.lit(False))) for n, c in rules]
    return df.withColumn(out, reduce(lambda acc, r: acc.when(r[1], r[0]), rest, F.when(first[1], first[0])))


def claims_with_reason(tramites: DataFrame, since: str = "2021-01-01 00:00:00", until: str = "2026-03-31 23:59:59", box: tuple[float, float, float, float] = (-30.0, -25.0, -57.0, -53.0)) -> DataFrame:
    """Raw claims with id, time, repaired coordinates and ``motivo_exclusion`` (null = kept).

    Reasons in order: fecha_invalida, fuera_de_rango, geo_faltante, geo_cero, geo_fuera, duplicado. A claim is a duplicate if an
    earlier ``row_idx`` has its id, even one that is itself excluded. Only the plain ISO spelling counts as a time here, as in
    the rules this follows; ``instants.claim_instants`` is the reader of every spelling.
    """
    south, north, west, east = box
    iso = F.col("dt_inicio").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    g1, g2 = F.trim("geo1").try_cast("double"), F.trim("geo2").try_cast("double")
    rows = tramites.select(
        "row_idx",
        composite_key(F.col("numerotramite"), F.col("numeroorden")).alias("reclamo_id"),
        F.when(iso, F.try_to_timestamp("dt_inicio", F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz").alias("fecha_reclamo"),
        g1.alias("g1"),
        g2.alias("g2"),
    )
    direct = F.coalesce(F.col("g1").between(south, north) & F.col("g2").between(west, east), F.lit(False))
    swapped = F.coalesce(F.col("g2").between(south, north) & F.col("g1").between(west, east), F.lit(False))
    rows = rows.withColumn("estado_geo", F.when(swapped, "swapped").when(direct, "direct").otherwise("invalid"))
    rows = rows.withColumn("lat", F.when(swapped, F.col("g2")).when(direct, F.col("g1"))).withColumn("lon", F.when(swapped, F.col("g1")).when(direct, F.col("g2")))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("reclamo_id").orderBy("row_idx")))
    t = F.col("fecha_reclamo")
    return with_reason(
        rows,
        [
            ("fecha_invalida", t.isNull()),
            ("fuera_de_rango", ~t.between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))),
            ("geo_faltante", F.col("g1").isNull() | F.col("g2").isNull()),
            ("geo_cero", (F.col("g1") == 0) | (F.col("g2") == 0)),
            ("geo_fuera", F.col("estado_geo") == "invalid"),
            ("duplicado", F.col("_copy") > 1),
        ],
    ).drop("_copy", "g1", "g2")


def swapped_world(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Exchange coordinates whose latitude is beyond 90 degrees and longitude is not; keep rows that are then on the globe."""
    turn = (F.abs(F.col(lat)) > 90) & (F.abs(F.col(lon)) <= 90)
    a, b = F.when(turn, F.col(lon)).otherwise(F.col(lat)), F.when(turn, F.col(lat)).otherwise(F.col(lon))
    return df.withColumns({lat: a, lon: b}).where((F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) <= 180))
