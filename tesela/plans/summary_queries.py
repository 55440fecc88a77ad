"""Summary, profile, spatial, exploration and score queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import scalars as S
from tesela.operators import clusters, joins, metrics, panel, profiles, proximity, ranking
from tesela.operators.quantiles import exact_quantile, exact_quantiles, table_quantiles
from tesela.plans import explore, panel_queries
from tesela.plans.registry import Registry
from tesela.runtime import cut
from tesela.sources.tables import table

query = Registry()


def _sum(c: str) -> str:
    return f"coalesce(cast(sum(cast({c} as decimal(18,4))) as double), 0)"


@query("with k as (select distinct round_even(lat, 5) as a, round_even(lon, 5) as o, reclamo_id from reclamos_clean where estado_geo != 'invalid' and lat is not null and lon is not null) select printf('%.5f_%.5f', a, o) as destino_key, count(distinct reclamo_id) as reclamos_count from k group by 1")
def destinations_unique(spark, d):
    """Claims per destination, a destination being a place at five decimals."""
    rows = table(spark, d, "reclamos_clean", ["reclamo_id", "lat", "lon", "estado_geo"]).where("estado_geo != 'invalid' and lat is not null and lon is not null")
    return rows.groupBy(S.place_key(F.col("lat"), F.col("lon")).alias("destino_key")).agg(F.count_distinct("reclamo_id").alias("reclamos_count"))


@query(
    "with s as (select sede_id, destino_key, count(distinct reclamo_id) as reclamos_count, array_to_string(list_sort(list_distinct(list(trim(servicio_normalizado)))), ' | ') as servicios from reclamos_zonificados where destino_key is not null group by 1, 2) "
    "select *, row_number() over (order by reclamos_count desc, sede_id, destino_key) as priority_rank from s"
)
def routing_scope(spark, d):
    """Depot and destination pairs by priority, with their services."""
    rows = table(spark, d, "reclamos_zonificados").where("destino_key is not null")
    pairs = rows.groupBy("sede_id", "destino_key").agg(F.count_distinct("reclamo_id").alias("reclamos_count"), F.concat_ws(" | ", F.array_sort(F.collect_set(F.trim("servicio_normalizado")))).alias("servicios"))
    return ranking.ordered(pairs, [F.desc("reclamos_count"), F.asc("sede_id"), F.asc("destino_key")], "priority_rank")


@query(
    "with c as (select sede_id, destino_key, distance_m, duration_s, routing_status, row_number() over (partition by sede_id, destino_key order by requested_at desc nulls last, cache_row_id desc) as n from distancias_cache), "
    "r as (select z.reclamo_id, z.sede_id, z.destino_key, coalesce(c.routing_status, 'pending') as routing_status, case when c.routing_status = 'ok' then c.distance_m end as m, case when c.routing_status = 'ok' then c.duration_s end as s from (select distinct reclamo_id, sede_id, destino_key from reclamos_zonificados) z left join c on z.sede_id = c.sede_id and z.destino_key = c.destino_key and c.n = 1) "
    "select *, routing_status = 'ok' as routing_available, m / 1000 * 2 as km_ida_vuelta, s / 3600 * 2 as horas_ida_vuelta, s / 60 as traslado_min, case when routing_status != 'ok' then 'routing_' || routing_status end as motivo from r"
)
def claims_routed(spark, d):
    """Claims with their route: one way, both ways, and why there is none."""
    claims = table(spark, d, "reclamos_zonificados").select("reclamo_id", "sede_id", "destino_key").distinct()
    routes = panel_queries.latest_routes(spark, d).select("sede_id", "destino_key", F.col("routing_status").alias("st"), "distance_m", "duration_s")
    ok = F.col("st") == "ok"
    rows = joins.checked_join(claims, routes, ["sede_id", "destino_key"], validate="m:1").select("reclamo_id", "sede_id", "destino_key", F.coalesce("st", F.lit("pending")).alias("routing_status"), F.when(ok, F.col("distance_m")).alias("m"), F.when(ok, F.col("duration_s")).alias("s"))
    status = F.col("routing_status")
    return rows.select("*", (status == "ok").alias("routing_available"), (F.col("m") / 1000 * 2).alias("km_ida_vuelta"), (F.col("s") / 3600 * 2).alias("horas_ida_vuelta"), (F.col("s") / 60).alias("traslado_min"), F.when(status != "ok", F.concat(F.lit("routing_"), status)).alias("motivo"))


@query(
    f"with z as (select fecha, count(*) as reclamos, count(distinct zona_id) as zonas, count(*) filter (where distance_km is not null) as con_ruta, {_sum('distance_km')} as km, {_sum('traslado_min')} as traslado_min from reclamos_zonificados group by fecha), "
    "l as (select fecha, max(lluvia_mm) as lluvia_mm from lluvia_diaria_clean where lluvia_mm between 0 and 500 and not isnan(lluvia_mm) group by fecha) "
    "select z.*, con_ruta * 100.0 / reclamos as cobertura_pct, case when con_ruta > 0 then km / con_ruta end as km_medio, l.lluvia_mm, case when l.fecha is null then 'out_of_range' else 'observed' end as lluvia_status from z left join l on z.fecha = l.fecha"
)
def daily_summary(spark, d):
    """Claims, routed share, distances and rain per day."""
    rain = table(spark, d, "lluvia_diaria_clean").where("lluvia_mm between 0 and 500 and not isnan(lluvia_mm)").groupBy("fecha").agg(F.max("lluvia_mm").alias("lluvia_mm"), F.lit("observed").alias("st"))
    days = table(spark, d, "reclamos_zonificados").groupBy("fecha").agg(F.count(F.lit(1)).alias("reclamos"), F.count_distinct("zona_id").alias("zonas"), F.count("distance_km").alias("con_ruta"), panel.exact_sum("distance_km").alias("km"), panel.exact_sum("traslado_min").alias("traslado_min"))
    days = days.withColumn("cobertura_pct", F.col("con_ruta") * 100.0 / F.col("reclamos")).withColumn("km_medio", S.safe_ratio(F.col("km"), F.col("con_ruta")))
    return days.join(rain, "fecha", "left").withColumn("lluvia_status", F.coalesce("st", F.lit("out_of_range"))).drop("st")


_MODE = "coalesce((select min(v) from (select v from unnest(l) as t(v) where v is not null and v != '' group by v having count(*) = (select max(c) from (select count(*) as c from unnest(l) as u(w) where w is not null and w != '' group by w)))), '')"


@query(
    f"with g as (select sede_id, destino_key, count(*) as reclamos, count(distinct zona_id) as zonas, {_sum('distance_km')} as km, list(trim(servicio_normalizado)) as l, min(fecha) as desde, max(fecha) as hasta from reclamos_zonificados group by 1, 2) "
    f"select sede_id, destino_key, reclamos, zonas, km, {_MODE} as servicio_modal, desde, hasta from g"
)
def hotspots(spark, d):
    """Claims per depot and destination with the most frequent service."""
    rows = table(spark, d, "reclamos_zonificados")
    mode = F.coalesce(F.mode(F.nullif(F.trim("servicio_normalizado"), F.lit("")), True), F.lit(""))
    return rows.groupBy("sede_id", "destino_key").agg(F.count(F.lit(1)).alias("reclamos"), F.count_distinct("zona_id").alias("zonas"), panel.exact_sum("distance_km").alias("km"), mode.alias("servicio_modal"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))


_DOMINANT = {"sede_principal": "sede_id", "servicio_principal": "servicio_normalizado", "localidad_principal": "localidad"}


@query(
    "with "
    + ", ".join(f"{n} as (select zona_id, coalesce({c}, 'desconocido') as {n} from (select zona_id, {c}, row_number() over (partition by zona_id order by count(*) desc, {c} nulls last) as k from reclamos_zonificados where zona_id is not null group by zona_id, {c}) where k = 1)" for n, c in _DOMINANT.items())
    + ", z as (select zona_id, count(distinct destino_key) as destinos, count(distinct sede_id) as sedes, count(distinct servicio_normalizado) as servicios from reclamos_zonificados where zona_id is not null group by zona_id) "
    + "select z.*, "
    + ", ".join(_DOMINANT)
    + " from z "
    + " ".join(f"join {n} on z.zona_id = {n}.zona_id" for n in _DOMINANT)
)
def zone_profile(spark, d):
    """Dominant depot, service and locality and distinct counts per zone; nulls count as a value of their own."""
    rows = table(spark, d, "reclamos_zonificados").where("zona_id is not null")
    each = F.array(*[F.struct(F.lit(n).alias("que"), F.col(c).alias("valor")) for n, c in _DOMINANT.items()])
    counted = rows.select("zona_id", F.inline(each)).groupBy("zona_id", "que", "valor").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(-F.col("n"), F.col("valor").isNull(), "valor")
    tops = counted.groupBy("zona_id").agg(*[F.coalesce(F.min_by(F.when(F.col("que") == n, F.struct("valor")), F.when(F.col("que") == n, order)).valor, F.lit("desconocido")).alias(n) for n in _DOMINANT])
    return rows.groupBy("zona_id").agg(F.count_distinct("destino_key").alias("destinos"), F.count_distinct("sede_id").alias("sedes"), F.count_distinct("servicio_normalizado").alias("servicios")).join(tops, "zona_id")


@query("select case when grouping(localidad) = 1 then 'GLOBAL_FALLBACK' else coalesce(localidad, 'desconocida') end as localidad, quantile_cont(resolucion_base_min, 0.5) as mediana, count(*) as filas from reclamos_zonificados where resolucion_base_min > 0 and resolucion_base_min <= 1440 group by grouping sets ((localidad), ())")
def resolution_median(spark, d):
    """Median resolution time per locality and over all."""
    rows = table(spark, d, "reclamos_zonificados").where("resolucion_base_min > 0 and resolucion_base_min <= 1440").select(F.coalesce("localidad", F.lit("desconocida")).alias("localidad"), "resolucion_base_min")
    both = rows.select(F.explode(F.array("localidad", F.lit("GLOBAL_FALLBACK"))).alias("localidad"), "resolucion_base_min")
    counts = both.groupBy("localidad").agg(F.count(F.lit(1)).alias("filas"))
    return exact_quantile(both, "localidad", "resolucion_base_min", 0.5, "mediana").join(counts, "localidad")


@query("select sede_id, servicio_normalizado, count(*) as reclamos, count(distance_km) as con_ruta, count(distance_km) * 100.0 / count(*) as cobertura_pct, grouping(servicio_normalizado) as nivel from reclamos_zonificados group by grouping sets ((sede_id), (sede_id, servicio_normalizado))")
def coverage_depot_service(spark, d):
    """Routed share per depot, and per depot and service."""
    rows = table(spark, d, "reclamos_zonificados")
    out = rows.groupingSets([[F.col("sede_id")], [F.col("sede_id"), F.col("servicio_normalizado")]], "sede_id", "servicio_normalizado").agg(F.count(F.lit(1)).alias("reclamos"), F.count("distance_km").alias("con_ruta"), F.grouping("servicio_normalizado").cast("int").alias("nivel"))
    return out.withColumn("cobertura_pct", F.col("con_ruta") * 100.0 / F.col("reclamos"))


_STATUSES = ["ok", "pending", "zero_results", "api_error", "request_error"]


@query("select sede_id, " + ", ".join(f"count(*) filter (where routing_status = '{s}') as {s}" for s in _STATUSES) + ", count(*) as total from distancias_cache group by sede_id")
def status_pivot(spark, d):
    """Answers per depot and status: the known statuses in their order, then a column for any other that the table has."""
    cache = table(spark, d, "distancias_cache", ["sede_id", "routing_status"])
    extra = [v for v in panel.present_values(cache, "routing_status") if v not in _STATUSES]
    return cache.groupBy("sede_id").agg(*[F.count_if(F.col("routing_status") == s).alias(s) for s in [*_STATUSES, *extra]], F.count(F.lit(1)).alias("total"))


_Q = {"reclamo_id": "string", "fecha_reclamo": "timestamp_ntz", "destino_key": "string", "sede_id": "string", "servicio_normalizado": "string", "localidad": "string", "zona_id": "string", "fecha": "date", "distance_km": "double", "traslado_min": "double", "resolucion_base_min": "double", "costo_operativo_ars": "double", "costo_total_compuesto_ars": "double"}


@query(
    "with v as ("
    + " union all ".join(f"select '{c}' as columna, '{t}' as tipo, cast({f'cast({c} as decimal(24,6))' if t == 'double' else c} as varchar) as valor from reclamos_zonificados" for c, t in _Q.items())
    + "), n as (select columna, tipo, valor, count(*) as filas from v group by all), k as (select *, row_number() over (partition by columna order by filas desc, coalesce(valor, '<NA>')) as k from n) "
    "select columna, tipo, cast(coalesce(sum(filas) filter (where valor is null), 0) as bigint) as nulos, round(cast(coalesce(sum(filas) filter (where valor is null), 0) as double) / sum(filas), 4) as nulos_ratio, count(valor) as distintos, string_agg(coalesce(valor, '<NA>') || ' (' || filas || ')', ', ' order by k) filter (where k <= 5) as ejemplos from k group by columna, tipo"
)
def quality_profile(spark, d):
    """Type, nulls, distinct and most frequent values of every column of the table."""
    return profiles.quality_profile(table(spark, d, "reclamos_zonificados"))


_N = ["distance_km", "traslado_min", "resolucion_base_min"]


@query(
    " union all ".join(
        f"select '{c}' as columna, count({c}) as n, round(avg({c}), 6) as media, round(stddev_samp({c}), 6) as desvio, min({c}) as minimo, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.9), 6) as p90, round(quantile_cont({c}, 0.95), 6) as p95, round(quantile_cont({c}, 0.99), 6) as p99, max({c}) as maximo from reclamos_zonificados" for c in _N
    )
)
def numeric_profile(spark, d):
    """Moments and exact quantiles per column."""
    out = profiles.numeric_profile(table(spark, d, "reclamos_zonificados", _N), _N)
    return out.withColumns({c: F.round(c, 6) for c in ("media", "desvio", "p50", "p90", "p95", "p99")})


@query(
    "with l as (select 'motivo' as columna, coalesce(motivo, '<NA>') as valor from reclamos_clean union all select 'codigomotivo', coalesce(codigomotivo, '<NA>') from reclamos_clean), n as (select columna, valor, count(*) as filas from l group by 1, 2) "
    "select * from (select *, row_number() over (partition by columna order by filas desc, valor) as puesto from n) where puesto <= 10"
)
def topn_categories(spark, d):
    """The most frequent values per column."""
    return profiles.top_values(table(spark, d, "reclamos_clean", ["motivo", "codigomotivo"]), ["motivo", "codigomotivo"], 10)


@query("select 'reclamos_zonificados' as tabla, count(*) as filas, 13 as columnas, min(fecha) as desde, max(fecha) as hasta, count(*) - (select count(*) from (select distinct * from reclamos_zonificados)) as repetidas from reclamos_zonificados")
def table_overview(spark, d):
    """Rows, columns, days and repeated rows of a table."""
    return profiles.table_overview(table(spark, d, "reclamos_zonificados"), "reclamos_zonificados", "fecha")


@query(
    " union all ".join(
        f"select '{c}' as objetivo, count({c}) as n, round(avg({c}), 6) as media, round(quantile_cont({c}, 0.5), 6) as mediana, round(stddev_samp({c}), 6) as desvio, min({c}) as minimo, max({c}) as maximo, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.75), 6) as q75 from (select cast(reclamos_count as double) as reclamos_count, distance_km_total, lluvia_mm from zona_diario_base)"
        for c in ("reclamos_count", "distance_km_total", "lluvia_mm")
    )
)
def target_stats(spark, d):
    """Statistics of the targets in long form."""
    rows = table(spark, d, "zona_diario_base").select(F.col("reclamos_count").cast("double").alias("reclamos_count"), "distance_km_total", "lluvia_mm")
    long = rows.unpivot([], rows.columns, "objetivo", "v")
    r = lambda c: F.round(c, 6)
    moments = long.groupBy("objetivo").agg(F.count("v").alias("n"), r(F.avg("v")).alias("media"), r(F.stddev_samp("v")).alias("desvio"), F.min("v").alias("minimo"), F.max("v").alias("maximo"))
    parts = exact_quantiles(long, "objetivo", "v", {"mediana": 0.5, "q25": 0.25, "q75": 0.75})
    return moments.join(parts.select("objetivo", *[r(c).alias(c) for c in ("mediana", "q25", "q75")]), "objetivo", "left")


@query("select cast(date_trunc('month', fecha_reclamo) as date) as mes, count(*) as reclamos from reclamos_clean group by 1")
def monthly_counts(spark, d):
    """Claims per month."""
    return table(spark, d, "reclamos_clean").groupBy(F.to_date(F.date_trunc("month", "fecha_reclamo")).alias("mes")).agg(F.count(F.lit(1)).alias("reclamos"))


_ZS = f"with z as (select zona_id, count(*) as reclamos, {_sum('traslado_min')} as traslado, {_sum('distance_km')} as km, count(distinct destino_key) as destinos from reclamos_zonificados where zona_id is not null group by zona_id)"


def zone_summary(spark, d):
    """Totals per zone."""
    rows = table(spark, d, "reclamos_zonificados").where("zona_id is not null")
    return rows.groupBy("zona_id").agg(F.count(F.lit(1)).alias("reclamos"), panel.exact_sum("traslado_min").alias("traslado"), panel.exact_sum("distance_km").alias("km"), F.count_distinct("destino_key").alias("destinos"))


@query(_ZS + ", r as (select *, dense_rank() over (order by reclamos desc) as rank_reclamos, dense_rank() over (order by traslado desc) as rank_traslado, dense_rank() over (order by km desc) as rank_km from z) select *, rank_reclamos + rank_traslado + rank_km as puntaje, cast(reclamos as double) / sum(reclamos) over () as parte from r")
def zone_summary_rank(spark, d):
    """Zones with three ranks, their sum, and their share."""
    return ranking.with_share(ranking.dense_ranks(cut(zone_summary(spark, d)), ["reclamos", "traslado", "km"]), "reclamos", "parte")


@query(_ZS + " select zona_id, reclamos, row_number() over o as puesto, cast(sum(reclamos) over (order by reclamos desc, zona_id rows unbounded preceding) as double) / sum(reclamos) over () as acumulado from z window o as (order by reclamos desc, zona_id)")
def pareto_shares(spark, d):
    """Running share of claims by zone."""
    rows = ranking.ordered(zone_summary(spark, d).select("zona_id", "reclamos"), [F.desc("reclamos"), F.asc("zona_id")], "puesto", {"_upto": "reclamos"})
    return ranking.with_totals(rows, {"_all": F.sum("reclamos")}).select("zona_id", "reclamos", "puesto", (F.col("_upto") / F.col("_all")).alias("acumulado"))


@query(
    _ZS
    + ", q as (select *, row_number() over (order by reclamos, zona_id) as r, count(*) over () as n from z), c as (select *, case when r <= 1 + (n - 1) / 4.0 then 1 when r <= 1 + (n - 1) * 2 / 4.0 then 2 when r <= 1 + (n - 1) * 3 / 4.0 then 3 else 4 end as cuartil from q) "
    "select cuartil, count(*) as zonas, cast(sum(reclamos) as bigint) as reclamos, cast(sum(reclamos) as double) / sum(sum(reclamos)) over () as parte from c group by cuartil"
)
def quartile_compare(spark, d):
    """Zones by quartile of claims."""
    rows = ranking.rank_groups(zone_summary(spark, d), "reclamos", "zona_id")
    return ranking.with_share(rows.groupBy("cuartil").agg(F.count(F.lit(1)).alias("zonas"), F.sum("reclamos").alias("reclamos")), "reclamos", "parte")


@query("with m as (select quantile_cont(distance_km, 0.5) as q from reclamos_zonificados), t as (select case when distance_km <= q then 'cerca' else 'lejos' end as grupo, traslado_min from reclamos_zonificados, m where distance_km is not null) select grupo, count(*) as reclamos, cast(sum(cast(traslado_min as decimal(18,4))) as double) / count(traslado_min) as traslado_medio, cast(count(*) as double) / sum(count(*)) over () as parte from t group by grupo")
def near_far(spark, d):
    """Claims nearer and farther than the median distance."""
    rows = table(spark, d, "reclamos_zonificados").where("distance_km is not null")
    rows = joins.with_scalars(rows, table_quantiles(rows, ["distance_km"], {"q": 0.5}).select("q"))
    out = rows.groupBy(F.when(F.col("distance_km") <= F.col("q"), "cerca").otherwise("lejos").alias("grupo")).agg(F.count(F.lit(1)).alias("reclamos"), (F.sum(F.col("traslado_min").cast("decimal(18,4)")).cast("double") / F.count("traslado_min")).alias("traslado_medio"))
    return ranking.with_share(out, "reclamos", "parte")


_RAINY = "with dia as (select fecha, cast(sum(reclamos_count) as bigint) as reclamos, max(lluvia_mm) as mm from zona_diario_base group by fecha)"


def _days(spark, d):
    return table(spark, d, "zona_diario_base").groupBy("fecha").agg(F.sum("reclamos_count").alias("reclamos"), F.max("lluvia_mm").alias("mm"))


@query(_RAINY + " select coalesce(mm, 0) > 0 as llovio, count(*) as dias, cast(sum(reclamos) as bigint) as reclamos, cast(sum(reclamos) as double) / count(reclamos) as media from dia group by 1")
def rain_vs_dry(spark, d):
    """Claims on days with and without rain."""
    return _days(spark, d).groupBy((F.coalesce("mm", F.lit(0.0)) > 0).alias("llovio")).agg(F.count(F.lit(1)).alias("dias"), F.sum("reclamos").alias("reclamos"), (F.sum("reclamos") / F.count("reclamos")).alias("media"))


@query(
    _RAINY
    + ", b(tramo) as (values ('0'), ('0-5'), ('5-20'), ('>20'), ('sin_dato')), t as (select case when mm is null then 'sin_dato' when mm <= 0 then '0' when mm <= 5 then '0-5' when mm <= 20 then '5-20' else '>20' end as tramo, reclamos from dia) select b.tramo, count(t.tramo) as dias, cast(coalesce(sum(reclamos), 0) as bigint) as reclamos from b left join t on b.tramo = t.tramo group by b.tramo"
)
def rain_buckets(spark, d):
    """Days and claims per rain class, empty classes kept."""
    labels = spark.createDataFrame([(b,) for b in ("0", "0-5", "5-20", ">20", "sin_dato")], "tramo string")
    own = _days(spark, d).select(S.rain_bucket(F.col("mm")).alias("tramo"), "reclamos").groupBy("tramo").agg(F.count(F.lit(1)).alias("dias"), F.sum("reclamos").alias("reclamos"))
    return labels.join(own, "tramo", "left").na.fill(0, ["dias", "reclamos"])


_VARS = ["reclamos", "mm", "km", "traslado"]
_DAYS = "with dia as (select fecha, cast(sum(reclamos_count) as bigint) as reclamos, max(lluvia_mm) as mm, cast(sum(cast(distance_km_total as decimal(18,4))) as double) as km, cast(sum(cast(traslado_min_total as decimal(18,4))) as double) as traslado from zona_diario_base group by fecha)"


@query(
    _DAYS
    + ", r as (select "
    + ", ".join(f"rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0 as {v}" for v in _VARS)
    + " from dia where "
    + " and ".join(f"{v} is not null" for v in _VARS)
    + ") "
    + " union all ".join(f"select '{a}' as variable_a, '{b}' as variable_b, round(corr({a}, {b}), 3) as spearman from r" for a in _VARS for b in _VARS)
)
def spearman_matrix(spark, d):
    """Rank correlations of claims, rain, distance and travel time per day."""
    total = lambda c: F.sum(F.col(c).try_cast("decimal(18,4)")).cast("double")
    days = table(spark, d, "zona_diario_base").groupBy("fecha").agg(F.sum("reclamos_count").alias("reclamos"), F.max("lluvia_mm").alias("mm"), total("distance_km_total").alias("km"), total("traslado_min_total").alias("traslado"))
    return profiles.rank_correlations(days, _VARS)


@query(_ZS + ", s as (select zona_id, cast(reclamos as double) / sum(reclamos) over () as parte_reclamos, cast(destinos as double) / sum(destinos) over () as parte_destinos from z) select zona_id, 'parte_reclamos' as medida, parte_reclamos as valor from s union all select zona_id, 'parte_destinos', parte_destinos from s")
def melt_shares(spark, d):
    """Shares of claims and destinations in long form."""
    s = ranking.with_share(ranking.with_share(cut(zone_summary(spark, d)), "reclamos", "parte_reclamos"), "destinos", "parte_destinos")
    return s.unpivot(["zona_id"], ["parte_reclamos", "parte_destinos"], "medida", "valor")


@query(f"select destino_key, count(*) as reclamos, {_sum('traslado_min')} as traslado, mode(servicio_normalizado order by servicio_normalizado) as servicio from reclamos_zonificados where destino_key is not null group by destino_key")
def points_ranking_all(spark, d):
    """Claims, travel time and most frequent service per destination."""
    rows = table(spark, d, "reclamos_zonificados").where("destino_key is not null")
    return rows.groupBy("destino_key").agg(F.count(F.lit(1)).alias("reclamos"), panel.exact_sum("traslado_min").alias("traslado"), F.mode("servicio_normalizado", True).alias("servicio"))


@query(f"select destino_key, count(*) as reclamos, {_sum('traslado_min')} as traslado from reclamos_zonificados where destino_key is not null group by destino_key order by reclamos desc, destino_key limit 20")
def points_ranking(spark, d):
    """The twenty destinations with most claims."""
    return points_ranking_all(spark, d).drop("servicio").orderBy(F.desc("reclamos"), "destino_key").limit(20)


@query(f"with z as (select zona_id, round(avg(lat), 9) as lat, round(avg(lon), 9) as lon, count(distinct destino_id) as destinos from zonas_clusterizadas group by zona_id), r as (select zona_id, count(distinct fecha) as dias, {_sum('distance_km')} as km from reclamos_zonificados group by zona_id) select z.*, coalesce(dias, 0) as dias, coalesce(km, 0) as km from z left join r on z.zona_id = r.zona_id")
def zone_map(spark, d):
    """Position, destinations, days and distance per zone."""
    zones = table(spark, d, "zonas_clusterizadas").groupBy("zona_id").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"), F.count_distinct("destino_id").alias("destinos"))
    days = table(spark, d, "reclamos_zonificados").groupBy("zona_id").agg(F.count_distinct("fecha").alias("dias"), panel.exact_sum("distance_km").alias("km"))
    return zones.join(days, "zona_id", "left").na.fill(0, ["dias", "km"])


@query("with c as (select reclamo_id, fecha_reclamo, lat, lon, lat between -30 and -25 and lon between -57 and -53 as d, lon between -30 and -25 and lat between -57 and -53 as s from reclamos_clean) select reclamo_id, fecha_reclamo, case when d then lat else lon end as lat, case when d then lon else lat end as lon from c where d or s order by fecha_reclamo desc, md5(reclamo_id), 3, 4 limit 5000")
def claim_map(spark, d):
    """Newest claims with usable coordinates; the cap is the map's own feature."""
    claims = proximity.usable_coordinates(table(spark, d, "reclamos_clean", ["reclamo_id", "fecha_reclamo", "lat", "lon"]))
    return claims.orderBy(F.desc("fecha_reclamo"), F.md5("reclamo_id"), "lat", "lon").limit(5000)


@query("select fecha, zona_id, servicio_normalizado as servicio, count(distinct reclamo_id) as reclamos from reclamos_zonificados where zona_id is not null group by 1, 2, 3")
def service_frame(spark, d):
    """Distinct claims per day, zone and service."""
    return explore.service_frame(table(spark, d, "reclamos_zonificados"))


@query("select distinct zona_id, fecha from zona_diario_base b where exists (select 1 from reclamos_zonificados r where r.zona_id = b.zona_id and r.fecha = b.fecha and upper(trim(r.servicio_normalizado)) in ('AGUA', 'INTERNET'))")
def service_semi_filter(spark, d):
    """Zone-days with a claim of the chosen services."""
    days = table(spark, d, "zona_diario_base", ["zona_id", "fecha"]).distinct()
    return explore.by_services(days, service_frame(spark, d), ["agua ", "INTERNET"])


@query("select zona_id, fecha, reclamos_count, lluvia_mm, cargado_en from zona_diario_base where fecha between date '2022-01-01' and date '2024-12-31' and coalesce(llovio, false)")
def explore_filtered(spark, d):
    """Zone-days with rain in a range of days."""
    return explore.filtered(table(spark, d, "zona_diario_base"), since="2022-01-01", until="2024-12-31", rainy=True).select("zona_id", "fecha", "reclamos_count", "lluvia_mm", "cargado_en")


@query("select count(*) as filas, count(distinct zona_id) as zonas, cast(sum(reclamos_count) as bigint) as reclamos from zona_diario_base")
def explore_kpis(spark, d):
    """Rows, zones and claims of the whole table, every load of a day counted."""
    return explore.kpis(explore.filtered(table(spark, d, "zona_diario_base", ["zona_id", "reclamos_count"])))


@query("select fecha, cast(sum(reclamos_count) as bigint) as valor from zona_diario_base group by fecha")
def metric_by_date(spark, d):
    """Claims per day over the whole table, every load of a day counted."""
    return explore.by_date(explore.filtered(table(spark, d, "zona_diario_base", ["fecha", "reclamos_count"])), "reclamos_count")


@query("with g as (select zona_id, min(destino_key) as nombre from zonas_clusterizadas where zona_id is not null group by zona_id) select distinct b.zona_id, case when b.zona_id = 'Z00-0001' then 'Centro' else coalesce(g.nombre, b.zona_id) end as nombre from zona_diario_base b left join g on b.zona_id = g.zona_id")
def zone_names(spark, d):
    """A name per zone: override, else destination, else the id."""
    named = table(spark, d, "zonas_clusterizadas").where("zona_id is not null").groupBy("zona_id").agg(F.min("destino_key").alias("nombre"))
    override = spark.createDataFrame([("Z00-0001", "Centro")], "zona_id string, nombre string")
    zones = joins.looked_up(table(spark, d, "zona_diario_base", ["zona_id"]).distinct(), named, "zona_id", "nombre", F.col("zona_id"))
    return joins.updated(zones, override, ["zona_id"], ["nombre"])


_HAV = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_H = _HAV.format(a="a.lat", b="a.lon", c="b.lat", d="b.lon")


@query(f"with p as (select distinct destino_id, lat, lon from zonas_clusterizadas where lat is not null and lon is not null) select distinct a.destino_id as id_a, b.destino_id as id_b from p a join p b on a.destino_id < b.destino_id where {_H} <= 500")
def haversine_pairs(spark, d):
    """Pairs of destinations at most 500 m apart."""
    return proximity.close_pairs(table(spark, d, "zonas_clusterizadas").withColumn("todo", F.lit(1)), "destino_id", "todo", "lat", "lon", 500.0)


@query(
    f"with p as (select zona_id, destino_id, min(lat) as lat, min(lon) as lon from zonas_clusterizadas where zona_id is not null and lat is not null and lon is not null group by 1, 2), q as (select a.zona_id, round(max({_H}) / 1000, 6) as dm from p a join p b on a.zona_id = b.zona_id group by 1) select p.zona_id, count(*) as puntos, any_value(q.dm) as diametro_km from p join q on p.zona_id = q.zona_id group by 1"
)
def zone_diameter(spark, d):
    """Greatest distance within each zone."""
    p = table(spark, d, "zonas_clusterizadas").dropna(subset=["zona_id", "lat", "lon"]).groupBy("zona_id", "destino_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return clusters.zone_diameters(p, "zona_id").withColumn("diametro_km", F.round("diametro_km", 6))


_HC = _HAV.format(a="c.a", b="c.o", c="p.lat", d="p.lon")


@query(f"with p as (select zona_id, lat, lon, cast(cluster_reclamos_count as double) as w from zonas_clusterizadas where zona_id is not null), c as (select zona_id, sum(lat * w) / sum(w) as a, sum(lon * w) / sum(w) as o from p group by 1) select c.zona_id, round(any_value(a), 6) as centro_lat, round(any_value(o), 6) as centro_lon, round(max({_HC}) / 1000, 4) as radio_km from c join p on c.zona_id = p.zona_id group by 1")
def zone_summary_geo(spark, d):
    """Weighted centre and radius of each zone."""
    out = clusters.zone_geometry(table(spark, d, "zonas_clusterizadas").where("zona_id is not null"), "zona_id", "cluster_reclamos_count")
    return out.select("zona_id", F.round("centro_lat", 6).alias("centro_lat"), F.round("centro_lon", 6).alias("centro_lon"), F.round("radio_km", 4).alias("radio_km"))


@query("select cast(floor(lat * 110.574 / 5.0) as bigint) as cy, cast(floor(lon * (111.320 * cos(radians(-29.5))) / 5.0) as bigint) as cx, count(*) as destinos from zonas_clusterizadas where lat is not null and lon is not null group by 1, 2")
def grid_cells(spark, d):
    """Destinations per cell of 5 km."""
    y, x = S.plane_km(F.col("lat"), F.col("lon"), -29.5)
    return table(spark, d, "zonas_clusterizadas").where("lat is not null and lon is not null").groupBy(F.floor(y / 5.0).alias("cy"), F.floor(x / 5.0).alias("cx")).agg(F.count(F.lit(1)).alias("destinos"))


@query()
def zone_cluster(spark, d):
    """Zones of at most 5 km, grown greedily."""
    points = table(spark, d, "zonas_clusterizadas").groupBy("destino_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.max("cluster_reclamos_count").alias("peso"))
    return clusters.bounded_zones(points)


@query("select 'destinos' as control, count(distinct destino_id) filter (where lat is not null and lon is not null) as valor from zonas_clusterizadas union all select 'sin_zona', 0 union all select 'en_varias', 0 union all select 'demasiado_anchas', 0")
def zone_cluster_check(spark, d):
    """What must hold of the grown zones, counted."""
    points = table(spark, d, "zonas_clusterizadas").where("destino_id is not null").groupBy("destino_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.max("cluster_reclamos_count").alias("peso")).dropna(subset=["lat", "lon"])
    zones = cut(clusters.bounded_zones(points))
    wide = clusters.zone_diameters(zones.join(points, "destino_id"), "zona").where("diametro_km > 5")
    several = zones.groupBy("destino_id").count().where("count > 1")
    parts = {"destinos": zones, "sin_zona": points.join(zones, "destino_id", "left_anti"), "en_varias": several, "demasiado_anchas": wide}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("control"), F.count(F.lit(1)).alias("valor"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select event_type, count(*) as eventos, count(json_extract_string(props, '$.k')) as con_k, count(json_extract_string(props, '$.page')) as con_pagina, sum(length(props)) as largo from events group by event_type")
def json_components(spark, d):
    """Fields present in JSON text."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("eventos"), F.count(F.get_json_object("props", "$.k")).alias("con_k"), F.count(F.get_json_object("props", "$.page")).alias("con_pagina"), F.sum(F.length("props")).alias("largo"))


_D = "list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(cast(x[1] as double) - cast(x[2] as double)))"


@query(f"with g as (select a.vec_id, {_D} as z from embeddings a, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) b) select vec_id, round(sqrt(list_sum(list_transform(z, lambda v: v * v))), 6) as euclidea, round(list_sum(z), 6) as manhattan, round(list_max(z), 6) as chebyshev, round(pow(list_sum(list_transform(z, lambda v: pow(v, 3))), 1.0 / 3), 6) as minkowski from g")
def distance_metrics(spark, d):
    """Four distances of each vector to the first."""
    e = table(spark, d, "embeddings")
    rows = joins.with_scalars(e, e.agg(F.min_by("embedding", "vec_id").alias("ref")))
    kinds = {"euclidea": "euclidean", "manhattan": "manhattan", "chebyshev": "chebyshev", "minkowski": "minkowski"}
    return rows.select("vec_id", *[F.round(S.distance(k, F.col("embedding"), F.col("ref")), 6).alias(n) for n, k in kinds.items()])


@query(
    f"with g as (select a.vec_id as consulta, b.vec_id as vecino, sqrt(list_sum(list_transform({_D}, lambda v: v * v))) as dist, b.label from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id != b.vec_id), r as (select *, row_number() over (partition by consulta order by dist, vecino) as puesto from g) "
    "select consulta, vecino, puesto, round(dist, 6) as dist from r where puesto <= 5"
)
def knn_topk(spark, d):
    """The five nearest vectors of every twentieth."""
    from tesela.operators.neighbours import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("consulta", "vecino", "puesto", F.round("dist", 6).alias("dist"))


_PRED = "with p as (select o_orderkey as id, cast(o_orderstatus = 'F' as integer) as y, (o_orderkey * 7919 % 1000) / 1000.0 as s from orders)"


def _scored(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("s"))


@query(
    _PRED
    + ", n as (select count(*) filter (where y = 1 and s >= 0.5) as vp, count(*) filter (where y = 0 and s >= 0.5) as fp, count(*) filter (where y = 0 and s < 0.5) as vn, count(*) filter (where y = 1 and s < 0.5) as fn from p) "
    "select *, vp / (vp + fn) as sensibilidad, vn / (vn + fp) as especificidad, vp / (vp + fp) as precision, (vp + vn) / (vp + vn + fp + fn) as exactitud, 2 * vp / (2 * vp + fp + fn) as f1, (vp / (vp + fn) + vn / (vn + fp)) / 2 as exactitud_balanceada from n"
)
def confusion_metrics(spark, d):
    """Confusion counts and rates."""
    return metrics.confusion(_scored(spark, d).withColumn("p", (F.col("s") >= 0.5).cast("int")), "y", "p")


@query("with p as (select cast(l_extendedprice as double) as a, l_quantity * 1000 as q from lineitem), x as (select a, a - q as e from p) select count(e) as filas, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(sum(abs(e)) / sum(abs(a)), 6) as wmape, round(avg(abs(e) / nullif(abs(a), 0)), 6) as mape, round(1 - sum(e * e) / (var_pop(a) * count(e)), 6) as r2 from x")
def regression_metrics(spark, d):
    """Errors of a simple price estimate."""
    rows = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("q"))
    out = rows.agg(*metrics.regression_scores("l_extendedprice", "q"))
    return out.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "wmape": F.round("wmape", 6), "mape": F.round("mape", 6), "r2": F.round("r2", 6)})


@query(_PRED + " select cast(least(floor(s * 10), 9) as integer) as tramo, count(*) as filas, round(avg(s), 9) as prob_media, avg(cast(y as double)) as observado from p group by 1")
def reliability_bins(spark, d):
    """Mean probability and observed share per bin."""
    return metrics.reliability(_scored(spark, d), "y", "s").withColumn("prob_media", F.round("prob_media", 9))


@query(_PRED + ", q as (select y, s, least(greatest(s, 1e-15), 1 - 1e-15) as z from p) select round(avg((s - y) * (s - y)), 9) as brier, round(avg(-(y * ln(z) + (1 - y) * ln(1 - z))), 9) as log_loss, round(avg(case when (s >= 0.5) = (y = 1) then 1.0 else 0.0 end), 9) as exactitud from q")
def brier_logloss(spark, d):
    """Brier score, log loss and accuracy."""
    out = _scored(spark, d).agg(*metrics.probability_scores("y", "s"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_THR = _PRED + ", c as (select s as umbral, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n from p group by s), t as (select umbral, sum(p) over w / sum(p) over () as tpr, sum(n) over w / sum(n) over () as fpr from c window w as (order by umbral desc rows unbounded preceding))"


@query(_THR + " select umbral, tpr, fpr, tpr - fpr as j from t order by j desc, umbral desc limit 1")
def youden_threshold(spark, d):
    """The threshold with the greatest TPR - FPR."""
    return metrics.youden(_scored(spark, d), "y", "s")


@query(_THR + ", a as (select (fpr - coalesce(lag(fpr) over w, 0)) * (tpr + coalesce(lag(tpr) over w, 0)) / 2 as x from t window w as (order by umbral desc)) select round(sum(x), 9) as auc from a")
def roc_auc(spark, d):
    """Area under the ROC curve."""
    return metrics.roc_auc(_scored(spark, d), "y", "s").select(F.round("auc", 9).alias("auc"))


@query("with n as (select label as t, vec_id % 3 as c, count(*) as n from embeddings group by 1, 2), e as (select t, sum(n * (n - 1)) as j, sum(n) as s from n group by t having sum(n) > 1) select min(j / (s * (s - 1))) as fuerza from e")
def prediction_strength(spark, d):
    """Least co-membership of a cluster under another clustering."""
    return metrics.prediction_strength(table(spark, d, "embeddings").withColumn("c", F.col("vec_id") % 3), "label", "c")


@query(
    "with a as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings), m as (select label as c, k, avg(x) as mu, avg(x * x) as q from a group by 1, 2), n as (select label as c, count(*) as n from embeddings group by 1), "
    "g as (select a.vec_id, a.label, m.c, sum(a.x * a.x - 2 * a.x * m.mu + m.q) as g, any_value(n.n) as n from a join m on a.k = m.k join n on n.c = m.c group by 1, 2, 3), "
    "s as (select vec_id, max(case when c = label then g * n / nullif(n - 1, 0) end) as i, min(case when c != label then g end) as o, max(case when c = label then n end) as n from g group by 1) select vec_id, round(case when n = 1 then 0.0 else (o - i) / greatest(i, o) end, 6) as silueta from s"
)
def silhouette(spark, d):
    """Silhouette of each vector with squared distances."""
    return metrics.silhouette_squared(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.round("silueta", 6).alias("silueta"))


_BASE = ["zona_id", "fecha", "reclamos_count", "reclamos_unicos", "sedes_unicas", "destinos_unicos", "servicios_unicos", "localidades_unicas", *panel.SUMS, "tiempo_total_operativo_min", "traslado_min_promedio", "has_claims", "lluvia_mm", "lluvia_status", "llovio"]
_DERIVED = [*_BASE, *[f"{m}_{x}" for m in panel.METRICS for x in ("lag_1", "lag_7", "roll_7_mean", "roll_28_mean")], *[f"y_{m}_t1" for m in panel.METRICS], "target_available_t1"]
_FAMILY = (
    "case when starts_with(columna, 'y_') then 'target' when contains(columna, '_lag_') then 'lag' when contains(columna, '_roll_') then 'rolling' when starts_with(columna, 'lluvia') or columna = 'llovio' then 'weather' "
    "when columna in ('fecha', 'zona_id') then 'calendar_or_key' when starts_with(columna, 'zona_') or starts_with(columna, 'reclamos_') then 'zone_or_claims' else 'base_feature' end"
)
_INVENTORY = (
    panel_queries._SUPERVISED
    + ", n as (select count(*) as filas from s), v as ("
    + " union all ".join(f"select '{c}' as columna, {str(c not in _BASE).lower()} as nueva, count(*) - count(\"{c}\") as nulos from s" for c in _DERIVED)
    + f"), i as (select columna, {_FAMILY} as familia, nueva, nulos, round(1 - cast(nulos as double) / filas, 4) as cobertura from v, n)"
)


@query(_INVENTORY + " select * from i")
def feature_inventory(spark, d):
    """Family, origin, nulls and coverage of each panel column."""
    base = panel_queries.zone_panel(spark, d)
    return profiles.feature_inventory(base, panel.supervised(base))


@query(_INVENTORY + " select familia, count(*) as columnas, count(*) filter (where nueva) as nuevas, cast(sum(nulos) as bigint) as nulos, round(avg(cobertura), 4) as cobertura_media from i group by familia")
def feature_families(spark, d):
    """Columns, new columns, nulls and coverage per family."""
    return profiles.family_summary(feature_inventory(spark, d))


@query("with s as (select servicio_normalizado, translate(upper(trim(regexp_replace(servicio_normalizado, '\\s+', ' ', 'g'))), 'ÁÉÍÓÚÑ', 'AEIOUN') as servicio from reclamos_zonificados) select servicio, case when servicio in ('AGUA', 'ENERGIA') then 'redes' else 'otros' end as grupo, count(*) as filas from s group by 1, 2")
def service_map(spark, d):
    """Claims per normalised service and its group."""
    groups = spark.createDataFrame([("AGUA", "redes"), ("ENERGIA", "redes")], "servicio string, grupo string")
    rows = table(spark, d, "reclamos_zonificados").select(S.service_name(F.col("servicio_normalizado")).alias("servicio"))
    return joins.looked_up(rows, groups, "servicio", "grupo", F.lit("otros")).groupBy("servicio", "grupo").agg(F.count(F.lit(1)).alias("filas"))


@query(
    "with e as (select vec_id, label, cast(embedding as double[]) as x from embeddings), n as (select label, count(*) as n from e group by 1), s as (select a.vec_id, a.label as own, b.label as c, sum(list_distance(a.x, b.x)) as d from e a cross join e b group by 1, 2, 3), "
    "m as (select vec_id, max(n) filter (where c = own) as k, max(d / nullif(n - 1, 0)) filter (where c = own) as i, min(d / n) filter (where c != own) as o from s join n on n.label = s.c group by 1) "
    "select vec_id, round(case when o is not null then case when k = 1 then 0.0 else coalesce((o - i) / nullif(greatest(i, o), 0), 0) end end, 6) as silueta from m"
)
def silhouette_exact(spark, d):
    """Silhouette per vector with euclidean distance."""
    return metrics.silhouette_euclidean(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.round("silueta", 6).alias("silueta"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
