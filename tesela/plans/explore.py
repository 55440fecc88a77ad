"""Parameterised exploration: pure functions from frames and parameters to frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions.scalars import service_label


def filtered(df: DataFrame, since: str | None = None, until: str | None = None, zones: list[str] | None = None, rainy: bool | None = None, day: str = "fecha") -> DataFrame:
    """Rows in a closed range of days, of some zones, with or without rain; a parameter that is None filters nothing and a null flag is no rain."""
    if since:
        df = df.where(F.col(day) >= F.lit(since).cast("date"))
    if until:
        df = df.where(F.col(day) <= F.lit(until).cast("date"))
    if zones is not None:
        df = df.where(F.col("zona_id").isin(zones))
    if rainy is not None:
        df = df.where(F.coalesce("llovio", F.lit(False)) == rainy)
    return df


def allowed_services(df: DataFrame, columns: list[str], allowed: list[str]) -> DataFrame:
    """Rows with one of ``allowed`` in any of the columns present, compared without case and outer blanks; unchanged if there is no column."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    wanted = [a.strip().upper() for a in allowed]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(service_label(F.col(c)).isin(wanted), F.lit(False)) for c in present]))


# Names of service and date columns, in order of preference.
SERVICE_COLUMNS = ["servicio", "servicio_normalizado", "service_label"]
DATE_COLUMNS = ["fecha", "fecha_reclamo", "fecha_hora"]


def detect_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of ``candidates`` that ``df`` has."""
    return next((c for c in candidates if c in df.columns), None)


def service_dimension(df: DataFrame, claims: DataFrame | None = None, least: int = 3) -> tuple[str, str | None, DataFrame]:
    """How the services of a table can be filtered: ``mode``, the column, and a frame with ``servicio``.

    ``claims_proxy`` if the table is by zone and day and its claims are given: their services stand for its own. ``direct`` if it has a service column
    with at least ``least`` different values that are not blank. Else ``none``, with no rows.
    """
    if claims is not None and {"fecha", "zona_id"} <= set(df.columns):
        return "claims_proxy", "servicio", service_frame(claims)
    column = detect_column(df, SERVICE_COLUMNS)
    if column is not None:
        services = df.select(F.col(column).alias("servicio"))
        known = services.select(F.nullif(F.trim("servicio"), F.lit("")).alias("s")).where("s is not null").distinct()
        if known.limit(least).count() >= least:
            return "direct", column, services
    return "none", None, df.sparkSession.createDataFrame([], "servicio string")


def service_frame(claims: DataFrame) -> DataFrame:
    """Distinct claims per day, zone and service."""
    return claims.where("zona_id is not null").groupBy("fecha", "zona_id", F.col("servicio_normalizado").alias("servicio")).agg(F.count_distinct("reclamo_id").alias("reclamos"))


def by_services(days: DataFrame, services: DataFrame, selected: list[str]) -> DataFrame:
    """Zone-days that had a claim of one of the ``selected`` services; an empty selection filters nothing."""
    if not selected:
        return days
    return days.join(allowed_services(services, ["servicio"], selected), ["zona_id", "fecha"], "left_semi")


def kpis(df: DataFrame) -> DataFrame:
    """Rows, zones and claims."""
    return df.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("zona_id").alias("zonas"), F.sum("reclamos_count").alias("reclamos"))


def by_date(df: DataFrame, metric: str, day: str = "fecha") -> DataFrame:
    """A metric's total per day."""
    return df.groupBy(day).agg(F.sum(metric).alias("valor"))
