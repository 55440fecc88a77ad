"""Cleaning, panel, window and forecast queries with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.functions import scalars as S
from tesela.operators import cascade, dedup, joins, metrics, orphans, panel, ranking, windows
from tesela.operators.quantiles import exact_quantile
from tesela.plans.registry import Registry
from tesela.runtime import checkpoint_dir, cut
from tesela.sources import files, sinks
from tesela.sources.tables import table

query = Registry()

_CLAIMS = r"""
with r as (
  select row_idx, coalesce(cast(try_cast(numerotramite as bigint) as varchar), '<NA>') || '-' || coalesce(cast(try_cast(numeroorden as bigint) as varchar), '<NA>') as reclamo_id,
    case when regexp_full_match(dt_inicio, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') then try_strptime(dt_inicio, '%Y-%m-%d %H:%M:%S') end as fecha_reclamo,
    try_cast(trim(geo1) as double) as g1, try_cast(trim(geo2) as double) as g2
  from tramites
), s as (
  select *, coalesce(g1 between -30 and -25 and g2 between -57 and -53, false) as directo, coalesce(g2 between -30 and -25 and g1 between -57 and -53, false) as cambiado, row_number() over (partition by reclamo_id order by row_idx) as copia from r
), c as (
  select row_idx, reclamo_id, fecha_reclamo, case when cambiado then 'swapped' when directo then 'direct' else 'invalid' end as estado_geo, case when cambiado then g2 when directo then g1 end as lat, case when cambiado then g1 when directo then g2 end as lon,
    case when fecha_reclamo is null then 'fecha_invalida' when fecha_reclamo not between timestamp '2021-01-01' and timestamp '2026-03-31 23:59:59' then 'fuera_de_rango' when g1 is null or g2 is null then 'geo_faltante'
      when g1 = 0 or g2 = 0 then 'geo_cero' when not cambiado and not directo then 'geo_fuera' when copia > 1 then 'duplicado' end as motivo_exclusion
  from s
)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return cascade.claims_with_reason(table(spark, d, "tramites"))


@query(_CLAIMS + " select row_idx, reclamo_id, fecha_reclamo, estado_geo, lat, lon from c where motivo_exclusion is null")
def clean_cascade(spark, d):
    """Claims kept by the exclusion cascade, with repaired coordinates."""
    return _claims(spark, d).where("motivo_exclusion is null").drop("motivo_exclusion")


@query(_CLAIMS + " select row_idx, reclamo_id, motivo_exclusion from c where motivo_exclusion is not null")
def clean_rejected(spark, d):
    """Claims excluded by the cascade and the first reason each breaks."""
    return _claims(spark, d).where("motivo_exclusion is not null").select("row_idx", "reclamo_id", "motivo_exclusion")


@query(_CLAIMS + " select motivo_exclusion, count(*) as filas, count(*) * 100.0 / sum(count(*)) over () as porcentaje from c where motivo_exclusion is not null group by motivo_exclusion")
def exclusion_share(spark, d):
    """Excluded claims per reason and their share in percent."""
    n = _claims(spark, d).where("motivo_exclusion is not null").groupBy("motivo_exclusion").agg(F.count(F.lit(1)).alias("filas"))
    return ranking.with_totals(n, {"_all": F.sum("filas")}).select("motivo_exclusion", "filas", (F.col("filas") * 100.0 / F.col("_all")).alias("porcentaje"))


_PAIR_SQL = r"^\s*0*(\d+)(?:\.0*)?\s*[-/_\x{2010}-\x{2015}\x{2212}]\s*0*(\d+)(?:\.0*)?\s*$"


@query(
    f"with t as (select tarea_row_id, case when regexp_matches(reclamo_id, '{_PAIR_SQL}') then regexp_replace(reclamo_id, '{_PAIR_SQL}', '\\1-\\2') end as k, try_strptime(fecha, '%Y-%m-%d') as f from tramites_tareas) "
    "select tarea_row_id, case when f is null then 'fecha_invalida' else 'huerfana' end as motivo_exclusion from t where f is null or k is null or k not in (select reclamo_id from reclamos_clean)"
)
def tasks_orphans(spark, d):
    """Tasks with a bad date, else without a claim; references are compared by their two numbers, and one that names none has no claim."""
    day = F.when(F.col("fecha").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp("fecha", F.lit("yyyy-M-d")))
    tasks = table(spark, d, "tramites_tareas").select("tarea_row_id", orphans.pair_key(F.col("reclamo_id")).alias("k"), day.alias("f"))
    claims = table(spark, d, "reclamos_clean", ["reclamo_id"]).select(orphans.pair_key(F.col("reclamo_id")).alias("k"))
    orphan = tasks.where("f is not null").join(claims, "k", "left_anti")
    rows = tasks.where("f is null").withColumn("motivo_exclusion", F.lit("fecha_invalida")).unionByName(orphan.withColumn("motivo_exclusion", F.lit("huerfana")))
    return rows.select("tarea_row_id", "motivo_exclusion")


@query(
    "with t as (select row_idx, regexp_replace(horainicio, '[^0-9]', '', 'g') as g, fechainicio from tramites), u as (select row_idx, g, right('0000' || g, 4) as h, fechainicio from t), "
    "v as (select row_idx, case when length(g) > 0 and h[1:2] <= '23' and h[3:4] <= '59' then h[1:2] || ':' || h[3:4] end as hhmm, fechainicio from u) "
    "select row_idx, hhmm, case when regexp_full_match(fechainicio, '\\d{4}-\\d{2}-\\d{2}') then try_strptime(fechainicio || ' ' || coalesce(hhmm, '00:00'), '%Y-%m-%d %H:%M') end as momento from v"
)
def hhmm_normalise(spark, d):
    """Times of day read from the last four digits, and the timestamp they make with the date."""
    rows = table(spark, d, "tramites").select("row_idx", S.hhmm(F.col("horainicio")).alias("hhmm"), "fechainicio")
    iso = F.when(F.col("fechainicio").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("fechainicio"))
    return rows.select("row_idx", "hhmm", S.at_hhmm(iso, F.col("hhmm")).alias("momento"))


@query(
    "with t as (select row_idx, try_cast(trim(replace(geo1, ',', '.')) as double) as a, try_cast(trim(replace(geo2, ',', '.')) as double) as b from tramites), "
    "u as (select row_idx, case when abs(a) > 90 and abs(b) <= 90 then b else a end as lat, case when abs(a) > 90 and abs(b) <= 90 then a else b end as lon from t) "
    "select * from u where abs(lat) <= 90 and abs(lon) <= 180"
)
def geo_swap_world(spark, d):
    """Coordinates exchanged where the latitude is beyond the poles, kept where they are on the globe."""
    rows = table(spark, d, "tramites").select("row_idx", S.coordinate(F.col("geo1")).alias("lat"), S.coordinate(F.col("geo2")).alias("lon"))
    return cascade.swapped_world(rows, "lat", "lon")


@query(_CLAIMS + " select estado_geo, count(*) as filas, min(lat) as lat_min, max(lat) as lat_max from c group by estado_geo")
def geo_swap_bounds(spark, d):
    """Claims per state of their coordinates after the box repair."""
    return _claims(spark, d).groupBy("estado_geo").agg(F.count(F.lit(1)).alias("filas"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


_RAIN = """
with m(mes, n) as (values ('enero',1),('febrero',2),('marzo',3),('abril',4),('mayo',5),('junio',6),('julio',7),('agosto',8),('septiembre',9),('setiembre',9),('octubre',10),('noviembre',11),('diciembre',12)),
t as (
  select row_idx, pluviometro, archivo, observacion_codigo, m.n, try_cast("año_extraido" || '-' || m.n || '-' || trim(dia) as date) as fecha, try_cast(trim(lluvia_mm) as double) as mm
  from rainfall_manual_recovered_months r left join m on lower(trim(r.mes_extraido)) = m.mes
), c as (
  select *, case when n is null then 'mes_invalido' when fecha is null then 'fecha_invalida' when mm is null then 'no_numerico' when mm < 0 then 'negativo' when fecha not between date '2021-01-01' and date '2026-03-31' then 'fuera_de_rango' end as motivo from t
), g as (
  select pluviometro, fecha, max(mm) as lluvia_mm, array_to_string(list_sort(list_distinct(list(trim(observacion_codigo)) filter (where trim(observacion_codigo) != ''))), ' | ') as codigos, count(*) as filas, count(distinct archivo) as archivos from c where motivo is null group by pluviometro, fecha
)"""


def _rain(spark, d):
    raw = table(spark, d, "rainfall_manual_recovered_months")
    rows = raw.select("row_idx", "pluviometro", "archivo", "observacion_codigo", S.month_number(F.col("mes_extraido")).alias("n"), F.col("`año_extraido`").try_cast("int").alias("y"), F.trim("dia").try_cast("int").alias("dd"), S.number_or_null(F.col("lluvia_mm")).alias("mm"))
    rows = rows.withColumn("fecha", S.date_of(F.col("y"), F.col("n"), F.col("dd")))
    rules = [("mes_invalido", F.col("n").isNull()), ("fecha_invalida", F.col("fecha").isNull()), ("no_numerico", F.col("mm").isNull()), ("negativo", F.col("mm") < 0), ("fuera_de_rango", ~F.col("fecha").between(F.lit("2021-01-01").cast("date"), F.lit("2026-03-31").cast("date")))]
    return cascade.with_reason(rows, rules, "motivo")


def _rain_daily(spark, d):
    code = F.nullif(F.trim("observacion_codigo"), F.lit(""))
    return _rain(spark, d).where("motivo is null").groupBy("pluviometro", "fecha").agg(F.max("mm").alias("lluvia_mm"), F.concat_ws(" | ", F.array_sort(F.collect_set(code))).alias("codigos"), F.count(F.lit(1)).alias("filas"), F.count_distinct("archivo").alias("archivos"))


@query(_RAIN + " select pluviometro, fecha, lluvia_mm, coalesce(codigos, '') as codigos, filas, archivos, case when filas > 1 then 'duplicate_collapsed' else 'observed' end as lluvia_status from g")
def rain_daily_clean(spark, d):
    """Readable rain per gauge and day: greatest value, codes, rows and sheets."""
    return _rain_daily(spark, d).withColumn("lluvia_status", F.when(F.col("filas") > 1, "duplicate_collapsed").otherwise("observed"))


@query(_RAIN + " select row_idx, motivo from c where motivo is not null")
def rain_rejected(spark, d):
    """Rain rows excluded and the first reason each breaks."""
    return _rain(spark, d).where("motivo is not null").select("row_idx", "motivo")


@query(
    _RAIN
    + ", k as (select cast(unnest(generate_series(date '2021-01-01', date '2026-03-31', interval 1 day)) as date) as fecha), x as (select fecha, max(lluvia_mm) as mm, count(*) as pluviometros from g group by fecha) "
    "select k.fecha, x.mm as lluvia_mm, coalesce(x.pluviometros, 0) as pluviometros, case when x.fecha is null then 'missing_source' else 'observed' end as lluvia_status from k left join x on k.fecha = x.fecha"
)
def rain_calendar(spark, d):
    """Rain of every calendar day of the window, missing days marked."""
    days = _rain_daily(spark, d).groupBy("fecha").agg(F.max("lluvia_mm").alias("lluvia_mm"), F.count(F.lit(1)).alias("pluviometros"))
    out = panel.fixed_calendar(spark, "2021-01-01", "2026-03-31").join(days, "fecha", "left")
    return out.select("fecha", "lluvia_mm", F.coalesce("pluviometros", F.lit(0)).alias("pluviometros"), F.when(F.col("pluviometros").isNull(), "missing_source").otherwise("observed").alias("lluvia_status"))


_CODE = "case when c = '' then 'missing' when c = 'A' then 'plain_a' when contains(c, 'R') then 'evento_intenso' when regexp_matches(c, '[=°/]') then 'marca_horaria' else 'otro_codigo' end"


@query(
    "with t as (select upper(regexp_replace(coalesce(observacion_codigo, ''), '\\s', '', 'g')) as c, case when lluvia_mm between 0 and 500 and not isnan(lluvia_mm) then cast(lluvia_mm as decimal(18,4)) end as mm from lluvia_diaria_clean) "
    f"select {_CODE} as categoria, count(*) as filas, count(*) filter (where mm > 0) as con_lluvia, cast(sum(mm) as double) / count(mm) as media, quantile_cont(cast(mm as double), 0.5) as mediana from t group by 1"
)
def rain_classes(spark, d):
    """Rain by kind of observation code."""
    mm = F.when(F.col("lluvia_mm").between(0, 500), F.col("lluvia_mm"))
    rows = table(spark, d, "lluvia_diaria_clean").select(S.rain_code(F.col("observacion_codigo")).alias("categoria"), mm.alias("mm"))
    out = rows.groupBy("categoria").agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("mm") > 0).alias("con_lluvia"), (F.sum(F.col("mm").cast("decimal(18,4)")).cast("double") / F.count("mm")).alias("media"))
    return out.join(exact_quantile(rows, "categoria", "mm", 0.5, "mediana"), "categoria", "left")


_SUM_SQL = ", ".join(f"coalesce(cast(sum(cast({c} as decimal(18,4))) as double), 0) as {n}" for n, c in panel.SUMS.items())
_PANEL = f"""
with q as (
  select zona_id, fecha, count(*) as reclamos_count, count(distinct reclamo_id) as reclamos_unicos, count(distinct sede_id) as sedes_unicas, count(distinct destino_key) as destinos_unicos, count(distinct servicio_normalizado) as servicios_unicos, count(distinct localidad) as localidades_unicas,
    {_SUM_SQL}, count(traslado_min) as n_traslado
  from reclamos_zonificados where zona_id is not null group by zona_id, fecha
), p as (select * exclude (n_traslado), traslado_min_total + resolucion_base_min_total as tiempo_total_operativo_min, traslado_min_total / nullif(n_traslado, 0) as traslado_min_promedio from q),
k as (select zona_id, cast(unnest(generate_series(min(fecha), max(fecha), interval 1 day)) as date) as fecha from p group by zona_id),
l as (select fecha, max(lluvia_mm) as mm from lluvia_diaria_clean where lluvia_mm between 0 and 500 and not isnan(lluvia_mm) group by fecha),
f as (
  select k.zona_id, k.fecha, {", ".join(f"coalesce(p.{c}, 0) as {c}" for c in ("reclamos_count", "reclamos_unicos", "destinos_unicos", "servicios_unicos", *panel.SUMS, "tiempo_total_operativo_min", "traslado_min_promedio"))}, sedes_unicas, localidades_unicas,
    coalesce(reclamos_count, 0) > 0 as has_claims, coalesce(mm, 0) as lluvia_mm, coalesce(mm, 0) > 0 as llovio, case when mm is null then 'missing' else 'observed' end as lluvia_status
  from k left join p on k.zona_id = p.zona_id and k.fecha = p.fecha left join l on k.fecha = l.fecha
)"""


def daily_rain(spark, d):
    """The greatest possible rain of each day over all gauges."""
    return table(spark, d, "lluvia_diaria_clean", ["fecha", "lluvia_mm"]).where("lluvia_mm between 0 and 500 and not isnan(lluvia_mm) and fecha is not null").groupBy("fecha").agg(F.max("lluvia_mm").alias("lluvia_mm"))


def zone_panel(spark, d):
    """The complete zone-by-day panel with the day's rain."""
    return panel.with_rain(panel.completed(panel.zone_days(table(spark, d, "reclamos_zonificados"))), daily_rain(spark, d))


@query(_PANEL + " select * from p")
def panel_base(spark, d):
    """Claims per zone and day."""
    return panel.zone_days(table(spark, d, "reclamos_zonificados"))


@query(_PANEL + " select * from f")
def panel_fill_pattern(spark, d):
    """The panel on its complete calendar, counts and totals filled by name."""
    return zone_panel(spark, d)


def _roll(m: str, n: int, least: int) -> str:
    w = f"(partition by zona_id order by fecha rows between {n} preceding and 1 preceding)"
    return f"case when count({m}) over {w} >= {least} then cast(sum(cast({m} as decimal(18,4))) over {w} as double) / count({m}) over {w} end as {m}_roll_{n}_mean"


_SUP = ", ".join(f"lag({m}, 1) over z as {m}_lag_1, lag({m}, 7) over z as {m}_lag_7, {_roll(m, 7, 3)}, {_roll(m, 28, 7)}, lead({m}, 1) over z as y_{m}_t1" for m in panel.METRICS)
_SUPERVISED = _PANEL + f", s as (select f.*, {_SUP}, lead(fecha, 1) over z is not null as target_available_t1 from f window z as (partition by zona_id order by fecha))"


@query(_SUPERVISED + " select * from s")
def panel_supervised(spark, d):
    """The complete panel with lags, trailing means and next-day targets."""
    return panel.supervised(zone_panel(spark, d))


@query(
    _PANEL
    + ", g as (select zona_id, fecha, lag(reclamos_count, 1) over (partition by zona_id order by fecha) as l from f) select zona_id, fecha, case when count(l) over w >= 3 then cast(sum(l) over w as double) / count(l) over w end as media_literal from g window w as (order by zona_id, fecha rows 6 preceding)"
)
def roll_literal(spark, d):
    """The trailing mean that runs across zone borders, for comparison."""
    return panel.literal_rolling(zone_panel(spark, d))


@query("select distinct fecha, cast(isodow(fecha) - 1 as integer) as day_of_week, cast(month(fecha) as integer) as month, cast(quarter(fecha) as integer) as quarter, cast(floor((month(fecha) - 1) / 3) + 1 as integer) as season, isodow(fecha) >= 6 as is_weekend from zona_diario_base")
def calendar_features(spark, d):
    """Calendar features of every day of the panel."""
    return panel.calendar_features(table(spark, d, "zona_diario_base", ["fecha"]).distinct())


@query("select * from (pivot (select zona_id, fecha, 'reclamos_' || lower(sede_id) as c from reclamos_zonificados where zona_id is not null and sede_id is not null) on c using count(*) group by zona_id, fecha)")
def depot_pivot(spark, d):
    """Claims per zone, day and depot: a column for every depot of the table."""
    claims = table(spark, d, "reclamos_zonificados").where("zona_id is not null and sede_id is not null")
    return panel.pivoted_counts(claims, panel.present_values(claims, "sede_id"))


_ZV = "with v as (select zona_id, fecha, max(cast(reclamos_count as double)) as y, max(lluvia_mm) as mm from zona_diario_base group by 1, 2)"


def _daily_max(spark, d):
    return table(spark, d, "zona_diario_base").groupBy("zona_id", "fecha").agg(F.max(F.col("reclamos_count").cast("double")).alias("y"), F.max("lluvia_mm").alias("mm"))


@query(_ZV + " select zona_id, fecha, case when count(y) over w >= 5 then quantile_cont(y, 0.5) over w end as mediana from v window w as (partition by zona_id, month(fecha) order by fecha rows between unbounded preceding and 1 preceding)")
def online_median_zone_month(spark, d):
    """Median of the earlier values of the zone in the same month."""
    return windows.online_median(_daily_max(spark, d).withColumn("mes", F.month("fecha")), ["zona_id", "mes"], ["fecha"], "y", 5, "mediana").select("zona_id", "fecha", "mediana")


@query(_ZV + " select zona_id, fecha, case when count(y) over w >= 7 then quantile_cont(y, 0.5) over w end as mediana from v window w as (partition by zona_id order by fecha rows between unbounded preceding and 1 preceding)")
def online_median_zone(spark, d):
    """Median of all earlier values of the zone."""
    return windows.online_median_sorted(_daily_max(spark, d), "zona_id", "fecha", "y", 7, "mediana")


@query(_ZV + ", k as (select distinct fecha from v) select k.fecha, case when count(v.y) >= 30 then quantile_cont(v.y, 0.5) end as mediana from k left join v on v.fecha < k.fecha group by k.fecha")
def online_median_global(spark, d):
    """Median of all values of all earlier days."""
    return windows.past_median(_daily_max(spark, d), "fecha", "y", 30, "mediana")


@query(_ZV + " select zona_id, fecha, case when count(y) over w >= 7 then quantile_cont(y, 0.5) over w end as mediana from v window w as (partition by zona_id order by fecha rows between 28 preceding and 1 preceding)")
def trailing_median_28(spark, d):
    """Median of the last 28 rows of the zone."""
    return windows.trailing_median(_daily_max(spark, d), ["zona_id"], ["fecha"], "y", 28, 7, "mediana").select("zona_id", "fecha", "mediana")


# the target of the day six days back is the same weekday as tomorrow
_FORECAST = (
    _PANEL
    + """, y as (
  select zona_id, fecha, month(fecha) as mes, (month(fecha) - 1) // 3 as estacion, lead(fecha) over z is not null as hay, cast(lag(reclamos_count, 6) over z as double) as previa,
    cast(lead(reclamos_count) over z as double) as y_reclamos, lead(tiempo_total_operativo_min) over z as y_tiempo, lead(costo_total_compuesto_ars) over z as y_costo
  from f window z as (partition by zona_id order by fecha)
), u as (
  select zona_id, fecha, mes, estacion, 'reclamos' as objetivo, y_reclamos as y from y union all select zona_id, fecha, mes, estacion, 'tiempo', y_tiempo from y
  union all select zona_id, fecha, mes, estacion, 'unitario', y_costo / nullif(y_reclamos, 0) from y
), h as (
  select *, case when count(y) over t >= 7 then quantile_cont(y, 0.5) over t end as trail, case when count(y) over e >= 7 then quantile_cont(y, 0.5) over e end as hist,
    case when count(y) over m >= 5 then quantile_cont(y, 0.5) over m end as mensual, case when count(y) over s >= 5 then quantile_cont(y, 0.5) over s end as estacional
  from u window t as (partition by objetivo, zona_id order by fecha rows between 28 preceding and 1 preceding), e as (partition by objetivo, zona_id order by fecha rows between unbounded preceding and 1 preceding),
    m as (partition by objetivo, zona_id, mes order by fecha rows between unbounded preceding and 1 preceding), s as (partition by objetivo, zona_id, estacion order by fecha rows between unbounded preceding and 1 preceding)
), gd as (select k.objetivo, k.fecha, case when count(u.y) >= 30 then quantile_cont(u.y, 0.5) end as glo from (select distinct objetivo, fecha from u) k left join u on u.objetivo = k.objetivo and u.fecha < k.fecha group by k.objetivo, k.fecha),
c as (select objetivo, quantile_cont(y, 0.5) as konst from u group by objetivo),
j as (select h.*, glo, konst from h join gd on h.objetivo = gd.objetivo and h.fecha = gd.fecha join c on h.objetivo = c.objetivo),
b as (
  select y.zona_id, y.fecha, y_reclamos, y_tiempo, y_costo, greatest(coalesce(previa, r.trail, r.hist, r.glo, r.konst), 0) as base_reclamos, coalesce(t.mensual, t.estacional, t.trail, t.hist, t.glo, t.konst) as base_tiempo,
    greatest(greatest(coalesce(previa, r.trail, r.hist, r.glo, r.konst), 0) * coalesce(n.mensual, n.trail, n.hist, n.glo, n.konst), 0) as base_costo,
    case when previa is not null then 'semana_anterior' when r.trail is not null then 'trailing_28' when r.hist is not null then 'historia_zona' when r.glo is not null then 'historia_global' else 'global_fallback' end as regla_reclamos,
    case when t.mensual is not null then 'zona_mes' when t.estacional is not null then 'zona_estacion' when t.trail is not null then 'trailing_28' when t.hist is not null then 'historia_zona' when t.glo is not null then 'historia_global' else 'global_fallback' end as regla_tiempo,
    case when n.mensual is not null then 'zona_mes' when n.trail is not null then 'trailing_28' when n.hist is not null then 'historia_zona' when n.glo is not null then 'historia_global' else 'global_fallback' end as regla_costo
  from y join j r on r.objetivo = 'reclamos' and y.zona_id = r.zona_id and y.fecha = r.fecha join j t on t.objetivo = 'tiempo' and y.zona_id = t.zona_id and y.fecha = t.fecha join j n on n.objetivo = 'unitario' and y.zona_id = n.zona_id and y.fecha = n.fecha
  where hay
)"""
)


def forecast(spark, d):
    """Past-only heuristic forecast of next-day claims, time and cost, with the rule that gave each; cost is claims times the median cost of a claim."""
    w = Window.partitionBy("zona_id").orderBy("fecha")
    targets = {f"y_{n}": F.lead(c).over(w).cast("double") for n, c in panel.TARGETS.items()}
    y = zone_panel(spark, d).select("zona_id", "fecha", F.month("fecha").alias("mes"), F.floor((F.month("fecha") - 1) / 3).alias("estacion"), F.lead("fecha").over(w).isNotNull().alias("hay"), F.lag("reclamos_count", 6).over(w).cast("double").alias("previa"), *[c.alias(n) for n, c in targets.items()])
    y = cut(y)  # many branches read it
    each = F.array(*[F.struct(F.lit(n).alias("objetivo"), v.alias("y")) for n, v in (("reclamos", F.col("y_reclamos")), ("tiempo", F.col("y_tiempo")), ("unitario", F.try_divide("y_costo", "y_reclamos")))])
    u = y.select("zona_id", "fecha", "mes", "estacion", F.inline(each)).withColumn("serie", F.concat_ws("|", "objetivo", "zona_id"))
    h = windows.trailing_median(u, ["serie"], ["fecha"], "y", 28, 7, "trail")
    h = windows.online_median(h, ["serie", "mes"], ["fecha"], "y", 5, "mensual")
    h = cut(windows.online_median(h, ["serie", "estacion"], ["fecha"], "y", 5, "estacional"))
    h = h.join(windows.online_median_sorted(h, "serie", "fecha", "y", 7, "hist"), ["serie", "fecha"], "left")
    h = h.join(windows.past_median(u, "fecha", "y", 30, "glo", "objetivo"), ["objetivo", "fecha"], "left").join(F.broadcast(exact_quantile(u, "objetivo", "y", 0.5, "konst")), "objetivo", "left")  # three rows
    value = lambda n, c: F.max(F.when(F.col("objetivo") == n, F.col(c))).alias(f"{n}_{c}")
    wide = h.groupBy("zona_id", "fecha").agg(*[value(n, c) for n in ("reclamos", "tiempo", "unitario") for c in ("mensual", "estacional", "trail", "hist", "glo", "konst")])
    y = y.where("hay").join(wide, ["zona_id", "fecha"])
    names = {"mensual": "zona_mes", "estacional": "zona_estacion", "trail": "trailing_28", "hist": "historia_zona", "glo": "historia_global"}
    chains = {"reclamos": ["trail", "hist", "glo"], "tiempo": ["mensual", "estacional", "trail", "hist", "glo"], "unitario": ["mensual", "trail", "hist", "glo"]}
    steps = {n: [(names[c], F.col(f"{n}_{c}")) for c in chain] for n, chain in chains.items()}
    steps["reclamos"].insert(0, ("semana_anterior", F.col("previa")))
    best = {n: F.coalesce(*[c for _, c in s], F.col(f"{n}_konst")) for n, s in steps.items()}
    claims = F.greatest(best["reclamos"], F.lit(0.0))
    out = {"base_reclamos": claims, "base_tiempo": best["tiempo"], "base_costo": F.greatest(claims * best["unitario"], F.lit(0.0))}
    rules = {f"regla_{n}": S.source_label(*steps[k]) for n, k in (("reclamos", "reclamos"), ("tiempo", "tiempo"), ("costo", "unitario"))}
    return y.select("zona_id", "fecha", "y_reclamos", "y_tiempo", "y_costo", *[c.alias(n) for n, c in (out | rules).items()])


_ROUNDED = ["y_tiempo", "y_costo", "base_tiempo", "base_costo"]


@query(_FORECAST + f" select * replace ({', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)}), {', '.join(f'round(abs(y_{n} - base_{n}), 6) as error_{n}' for n in panel.TARGETS)} from b")
def baseline_forecast(spark, d):
    """The three forecasts with their rules and absolute errors."""
    out = forecast(spark, d).withColumns({f"error_{n}": F.round(F.abs(F.col(f"y_{n}") - F.col(f"base_{n}")), 6) for n in panel.TARGETS})
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


_SCORES = "count(e) as filas, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(coalesce(sum(abs(e)) / nullif(sum(abs(a)), 0), 0), 6) as wmape, round(avg(abs(e) / nullif(abs(a), 0)), 6) as mape, round(1 - sum(e * e) / nullif(var_pop(a) * count(e), 0), 6) as r2, round(sum(a), 4) as total_real, round(sum(p), 4) as total_previsto"


@query(
    _FORECAST
    + ", x as ("
    + " union all ".join(f"select '{n}' as objetivo, y_{n} as a, base_{n} as p, y_{n} - base_{n} as e, fecha >= (select max(fecha) from b) - 179 as r from b" for n in panel.TARGETS)
    + f") select objetivo, 'full' as ventana, {_SCORES} from x group by objetivo union all select objetivo, 'recent_180', {_SCORES} from x where r group by objetivo"
)
def baseline_metrics(spark, d):
    """Errors and totals of each forecast over all days and over the last 180."""
    b = cut(forecast(spark, d))
    b = joins.with_scalars(b, b.agg(F.date_sub(F.max("fecha"), 179).alias("corte")))
    each = F.array(*[F.struct(F.lit(n).alias("objetivo"), F.col(f"y_{n}").alias("a"), F.col(f"base_{n}").alias("p")) for n in panel.TARGETS])
    spans = F.array_compact(F.array(F.lit("full"), F.when(F.col("fecha") >= F.col("corte"), F.lit("recent_180"))))
    long = b.select(F.explode(spans).alias("ventana"), each.alias("x")).select("ventana", F.inline("x"))
    out = long.groupBy("objetivo", "ventana").agg(*metrics.regression_scores("a", "p"), F.round(F.sum("a"), 4).alias("total_real"), F.round(F.sum("p"), 4).alias("total_previsto"))
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "wmape", "mape", "r2")})


@query(_FORECAST + " " + " union all ".join(f"select '{n}' as objetivo, regla_{n} as regla, count(*) as filas from b group by regla_{n}" for n in panel.TARGETS))
def rule_coverage(spark, d):
    """Forecasts per target and rule."""
    each = F.array(*[F.struct(F.lit(n).alias("objetivo"), F.col(f"regla_{n}").alias("regla")) for n in panel.TARGETS])
    return forecast(spark, d).select(F.inline(each)).groupBy("objetivo", "regla").agg(F.count(F.lit(1)).alias("filas"))


@query(_ZV + " select zona_id, fecha, coalesce(mm, last_value(mm ignore nulls) over (partition by zona_id order by fecha rows unbounded preceding)) as mm, y from v")
def ffill_features(spark, d):
    """Rain filled forward per zone."""
    return windows.forward_filled(_daily_max(spark, d), "zona_id", "fecha", ["mm"])


@query(_ZV + " select case when fecha < date '2025-04-01' then 'train' else 'test' end as parte, count(*) as filas, count(distinct zona_id) as zonas, min(fecha) as desde, max(fecha) as hasta from v group by 1")
def oot_split(spark, d):
    """Rows, zones and days before and from a cut date."""
    part = F.when(F.col("fecha") < F.lit("2025-04-01").cast("date"), "train").otherwise("test")
    return _daily_max(spark, d).groupBy(part.alias("parte")).agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("zona_id").alias("zonas"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))


@query(
    "with c as (select sede_id, destino_key, distance_m, duration_s, routing_status, requested_at, cache_row_id, row_number() over (partition by sede_id, destino_key order by requested_at desc nulls last, cache_row_id desc) as n from distancias_cache) "
    "select sede_id, destino_key, distance_m, duration_s, routing_status, requested_at, cache_row_id from c where n = 1"
)
def cache_latest(spark, d):
    """The latest answer per depot and destination."""
    return latest_routes(spark, d)


def latest_routes(spark, d):
    """The latest answer of each depot and destination; unknown request times are the oldest."""
    cache = table(spark, d, "distancias_cache", ["sede_id", "destino_key", "distance_m", "duration_s", "routing_status", "requested_at", "cache_row_id"])
    return dedup.first_by(cache, ["sede_id", "destino_key"], F.col("requested_at").desc_nulls_last(), F.col("cache_row_id").desc())


@query(
    _RAIN
    + ", b as (select pluviometro, fecha, max(lluvia_mm) as mm from lluvia_diaria_clean where lluvia_mm between 0 and 500 and not isnan(lluvia_mm) group by 1, 2), h as (select replace(pluviometro, 'PL', 'PE') as pluviometro, fecha, lluvia_mm as mm from g) "
    "select coalesce(h.pluviometro, b.pluviometro) as pluviometro, coalesce(h.fecha, b.fecha) as fecha, case when h.fecha is not null then h.mm else b.mm end as mm, cast(h.fecha is not null as integer) as prioridad from b full join h on b.pluviometro = h.pluviometro and b.fecha = h.fecha"
)
def override_merge(spark, d):
    """Hand-copied rain over the daily table, by gauge and day."""
    base = table(spark, d, "lluvia_diaria_clean").where("lluvia_mm between 0 and 500 and not isnan(lluvia_mm)").groupBy("pluviometro", "fecha").agg(F.max("lluvia_mm").alias("mm"))
    manual = _rain_daily(spark, d).select(F.replace("pluviometro", F.lit("PL"), F.lit("PE")).alias("pluviometro"), "fecha", F.col("lluvia_mm").alias("mm"), "codigos")
    return dedup.overridden(base, joins.aligned(manual, base), ["pluviometro", "fecha"], F.col("mm"))


_PAIRS = [(m, p) for m in ("reclamos_count", "tiempo_total_operativo_min", "costo_total_compuesto_ars") for p in ("lag_1", "lag_7", "roll_7_mean", "roll_28_mean")]


@query(
    _SUPERVISED
    + ", w as ("
    + " union all ".join(f"select '{m}' as objetivo, '{p}' as modelo, round(sum(abs(y_{m}_t1 - {m}_{p})) / nullif(sum(case when {m}_{p} is not null then abs(y_{m}_t1) end), 0), 6) as wmape from s where y_{m}_t1 is not null" for m, p in _PAIRS)
    + ") select objetivo, modelo, wmape from (select *, row_number() over (partition by objetivo order by wmape, modelo) as k from w) where k = 1"
)
def best_model(spark, d):
    """The simple predictor with the least error per target."""
    s = panel.supervised(zone_panel(spark, d))
    error = lambda m, p: F.round(F.sum(F.abs(F.col(f"y_{m}_t1") - F.col(f"{m}_{p}"))) / F.nullif(F.sum(F.when(F.col(f"{m}_{p}").isNotNull(), F.abs(f"y_{m}_t1"))), F.lit(0)), 6)
    one = s.agg(*[error(m, p).alias(f"{m}:{p}") for m, p in _PAIRS])
    scores = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("objetivo"), F.lit(p).alias("modelo"), F.col(f"`{m}:{p}`").alias("wmape")) for m, p in _PAIRS])).alias("x")).select("x.*")
    return dedup.first_by(scores, ["objetivo"], F.col("wmape").asc_nulls_last(), F.col("modelo"))


@query("select tabla, clave, count(*) - count(distinct k) as repetidas from (select 'reclamos_clean' as tabla, 'reclamo_id' as clave, reclamo_id as k from reclamos_clean union all select 'tramites', 'row_idx', cast(row_idx as varchar) from tramites union all select 'zona_diario_base', 'zona_id,fecha', zona_id || '|' || fecha from zona_diario_base) group by 1, 2")
def dup_checks(spark, d):
    """Repeated keys per table."""
    one = lambda t, c, k: table(spark, d, t).agg((F.count(F.lit(1)) - F.count_distinct(k)).alias("repetidas")).select(F.lit(t).alias("tabla"), F.lit(c).alias("clave"), "repetidas")
    return one("reclamos_clean", "reclamo_id", F.col("reclamo_id")).unionByName(one("tramites", "row_idx", F.col("row_idx"))).unionByName(one("zona_diario_base", "zona_id,fecha", F.struct("zona_id", "fecha")))


@query("with t as (select tarea_row_id, regexp_replace(trim(tarea_id), '^0*(\\d+)(?:\\.0*)?$', '\\1') as k from tramites_tareas where tarea_id is not null) select t.tarea_row_id, r.tarea, coalesce(r.tarea, 'sin_catalogo') as tarea_nombre from t left join (select cast(tarea_id as varchar) as k, tarea from tareas_ref) r on t.k = r.k")
def keyed_lookup(spark, d):
    """Task names by number, with a default."""
    names = table(spark, d, "tareas_ref").select(orphans.number_key(F.col("tarea_id").cast("string")).alias("k"), "tarea")
    tasks = table(spark, d, "tramites_tareas").where("tarea_id is not null").select("tarea_row_id", orphans.number_key(F.col("tarea_id")).alias("k"))
    return joins.looked_up(tasks, names, "k", "tarea").select("tarea_row_id", "tarea", F.coalesce("tarea", F.lit("sin_catalogo")).alias("tarea_nombre"))


@query("with c as (select zona_id, destino_key, count(*) as reclamos from reclamos_zonificados where zona_id is not null group by 1, 2), z as (select distinct zona_id, destino_key from zonas_clusterizadas where zona_id is not null) select z.zona_id, z.destino_key, coalesce(reclamos, 0) as reclamos from z left join c on z.zona_id = c.zona_id and z.destino_key = c.destino_key")
def zone_destinations(spark, d):
    """Claims of each zone's destinations: joined on the destination and on the zone it depends on."""
    zones = table(spark, d, "zonas_clusterizadas", ["zona_id", "destino_key"]).where("zona_id is not null").distinct()
    claims = table(spark, d, "reclamos_zonificados", ["zona_id", "destino_key"]).where("zona_id is not null").groupBy("zona_id", "destino_key").agg(F.count(F.lit(1)).alias("reclamos"))
    return joins.checked_join(zones, claims, ["zona_id", "destino_key"], validate="1:1").select("zona_id", "destino_key", F.coalesce("reclamos", F.lit(0)).alias("reclamos"))


@query("select c.cache_row_id, c.sede_id, c.destino_key, c.routing_status from distancias_cache c where exists (select 1 from reclamos_zonificados z where z.sede_id = c.sede_id and z.destino_key = c.destino_key)")
def cache_in_scope(spark, d):
    """Answers of the route cache for depots and destinations that claims ask for."""
    scope = table(spark, d, "reclamos_zonificados", ["sede_id", "destino_key"])
    return table(spark, d, "distancias_cache", ["cache_row_id", "sede_id", "destino_key", "routing_status"]).join(scope, ["sede_id", "destino_key"], "left_semi").select("cache_row_id", "sede_id", "destino_key", "routing_status")


@query("select reclamo_id, cargado_en, coalesce(nullif(trim(direccion), ''), nullif(trim(localidad), '')) as lugar from reclamos_clean")
def claim_places(spark, d):
    """The address of each claim, else its locality."""
    return table(spark, d, "reclamos_clean").select("reclamo_id", "cargado_en", S.first_present(F.col("direccion"), F.col("localidad")).alias("lugar"))


_STORED = ["csv", "historia", "json", "parquet"]


@query(" union all ".join(f"select '{via}' as via, n_nationkey, n_name from nation" for via in _STORED))
def stored_tables(spark, d):
    """A small table written to the shared checkpoint folder by each sink and read back by its source."""
    rows, folder = table(spark, d, "nation", ["n_nationkey", "n_name"]), f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    sinks.write_csv(rows, f"{folder}/csv")
    sinks.append_history(rows.where("n_nationkey < 10"), f"{folder}/historia")
    sinks.append_history(rows.where("n_nationkey >= 10"), f"{folder}/historia")
    rows.write.json(f"{folder}/json")
    sinks.write_table(rows, f"{folder}/parquet", rows.columns)
    schema = "n_nationkey int, n_name string"
    back = {"csv": files.read_csv(spark, f"{folder}/csv", schema), "historia": files.read_or_empty(spark, f"{folder}/historia", schema), "json": spark.read.schema(schema).json(f"{folder}/json"), "parquet": files.read_or_empty(spark, f"{folder}/parquet", schema)}
    out = files.empty(spark, f"via string, {schema}")
    for via in _STORED:
        out = out.unionByName(back[via].select(F.lit(via).alias("via"), "n_nationkey", "n_name"))
    return out


QUERIES, ORACLES = query.QUERIES, query.ORACLES
