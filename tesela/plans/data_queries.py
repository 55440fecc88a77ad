"""Queries of the data problems in the core, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import filling, instants, orphans, proximity, rolling, spikes
from tesela.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC second of every readable claim start."""
    return instants.claim_instants(table(spark, d, "tramites"), table(spark, d, "canales"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of the task table."""
    return orphans.task_orphans(table(spark, d, "tramites_tareas"), table(spark, d, "reclamos_clean"), table(spark, d, "tareas_ref"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per parent table, kind and month."""
    return orphans.orphan_counts(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every wrong reading of the rain sheets and the route cache, with its kind."""
    rain = spikes.rain_flags(spikes.rain_readings(table(spark, d, "rainfall_manual_recovered_months")))
    routes = spikes.route_flags(spikes.route_answers(table(spark, d, "distancias_cache")))
    named = lambda name, df: df.select(F.lit(name).alias("tabla"), "fila", "clase")
    return named("rainfall_manual_recovered_months", rain).unionByName(named("distancias_cache", routes))


def p4_tails(spark: SparkSession, d: str) -> DataFrame:
    """Every possible reading with its seasonal residual, the tail cutoffs of its gauge or depot at a risk of one in a thousand, and whether it lies beyond them."""
    rain = spikes.tail_readings(spikes.rain_readings(table(spark, d, "rainfall_manual_recovered_months")).where("valor <= 1825"), "mes", "valor", 0.9, False)
    routes = spikes.tail_readings(spikes.possible_answers(spikes.route_answers(table(spark, d, "distancias_cache"))), "hora", "ritmo", 0.5, True)
    both = rain.withColumn("tabla", F.lit("rainfall_manual_recovered_months")).unionByName(routes.withColumn("tabla", F.lit("distancias_cache")))
    return both.withColumns({c: F.round(c, 6) for c in ("residuo", "corte_bajo", "corte_alto")})


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """Readings, peaks and readings beyond the tail cutoffs per gauge and depot."""
    return spikes.tail_cutoffs(p4_tails(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Zone-days whose last week makes up more than half of the last 30 days."""
    return rolling.zone_surges(table(spark, d, "zona_diario_base"))


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages over 7 and 30 days for every zone and calendar day."""
    return rolling.zone_trailing(table(spark, d, "zona_diario_base"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of claims of one day at most 100 m apart, and the districts that contain claims."""
    return proximity.claims_nearby(table(spark, d, "reclamos_clean"), table(spark, d, "distritos"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every missing rain cell that was filled, and from where."""
    return filling.filled_cells(p7_filled(spark, d))


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """All rain rows with their present or filled values and marks."""
    return filling.fill_rain(table(spark, d, "lluvia_diaria_clean")).withColumn("mm_llena", F.round("mm_llena", 6))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_counts, p4_found, p4_tails, p4_sources, p5_found, p5_trailing, p6_found, p7_found, p7_filled)}

_MONTH_SQL = "case m[1:3] " + " ".join(f"when '{n[:3]}' then {k}" for k, v in instants.MONTHS.items() for n in dict.fromkeys(x[:3] for x in v)) + " end"
# the spellings one after the other, with DuckDB's own rules of time zones
_P1 = r"""
with t as (
  select row_idx, c.zona_horaria as zona, c.orden_fecha as orden, lower(trim(dt_inicio)) as a, trim(dt_inicio) as crudo, trim(fechainicio) as f, lower(trim(horainicio)) as h from tramites x left join canales c using (canal)
), p as (
  select *, unnest([{'de': 'a', 'd': a}, {'de': 'b', 'd': f}], recursive := true) from t
), q as (
  select *, regexp_extract(d, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', ['y', 'm', 'd']) as iso, regexp_extract(d, '^(\d{4})(\d{2})(\d{2})(?:t?\d{4,6}$| |$)', ['y', 'm', 'd']) as junta, regexp_extract(d, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?:\D|$)', ['x', 'z', 'y']) as num,
    regexp_extract(d, '^(\d{1,2})(?: de | |-)([a-z]{3,})(?: de | |-)(\d{4})', ['d', 'm', 'y']) as texto, regexp_extract(d, '^([a-z]{3,}) (\d{1,2}), (\d{4})', ['m', 'd', 'y']) as ingles
  from p
), r as (
  select *, case when iso.y != '' then iso.y when junta.y != '' then junta.y when num.y != '' then case when length(num.y) = 2 then '20' || num.y else num.y end when texto.y != '' then texto.y when ingles.y != '' then ingles.y end as yy,
    case when iso.y != '' then iso.m when junta.y != '' then junta.m when num.y != '' then case when orden = 'MDY' then num.x else num.z end else (select cast({mes} as varchar) from (select case when texto.y != '' then texto.m else ingles.m end as m)) end as mm,
    case when iso.y != '' then iso.d when junta.y != '' then junta.d when num.y != '' then case when orden = 'MDY' then num.z else num.x end when texto.y != '' then texto.d when ingles.y != '' then ingles.d end as dd
  from q
), s as (
  select *, try_cast(yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') as date) as dia,
    case when de = 'a' then regexp_extract(a, '(?:[ t])(\d{1,2}):(\d{2})(?::(\d{2}))?', ['h', 'i', 's']) else regexp_extract(h, '^(\d{1,2})[:.](\d{2})(?:[:](\d{2}))?(?:\D|$)', ['h', 'i', 's']) end as reloj,
    regexp_extract(a, '^\d{8}t?(\d{2})(\d{2})(\d{2})?$', ['h', 'i', 's']) as corrido, lpad(regexp_extract(h, '^(\d{1,4})(?:\.0)?$', 1), 4, '0') as cifras, regexp_extract(case when de = 'a' then a else coalesce(h, '') end, '\d ([ap])\.? ?m\.?$', 1) as mitad,
    regexp_extract(a, ':\d{2}(?:\.\d+)? ?([-+])(\d{2}):?(\d{2})', ['s', 'h', 'm']) as desvio, regexp_matches(a, '\d ?(z|utc|gmt)$') as cero, regexp_extract(crudo, '([A-Z][a-z]+(?:/[A-Za-z_]+)+)', 1) as nombre
  from r
), u as (
  select *, case when de = 'a' and corrido.h != '' then corrido.h when reloj.h != '' then reloj.h when de = 'b' and length(cifras) = 4 and cifras != '0000' then cifras[1:2] when de = 'b' then '0' end as hh,
    case when de = 'a' and corrido.h != '' then corrido.i when reloj.h != '' then reloj.i when de = 'b' and length(cifras) = 4 then cifras[3:4] else '0' end as ii, case when de = 'a' and corrido.h != '' then nullif(corrido.s, '') when reloj.h != '' then nullif(reloj.s, '') end as ss
  from s
), v as (
  select *, case when mitad = '' then cast(hh as integer) when cast(hh as integer) = 12 then case when mitad = 'a' then 0 else 12 end when mitad = 'p' and cast(hh as integer) < 12 then cast(hh as integer) + 12 else cast(hh as integer) end as ho, cast(ii as integer) as mi, coalesce(cast(ss as integer), 0) as se from u
), w as (
  select *, dia is not null and ho between 0 and 23 and mi between 0 and 59 and se between 0 and 59 as bien,
    case when de = 'b' and not coalesce(ho between 0 and 23 and mi between 0 and 59 and se between 0 and 59, false) then cast(dia as timestamp) else dia + to_hours(ho) + to_minutes(mi) + to_seconds(se) end as lugar, case when de = 'a' and nombre != '' then nombre else zona end as huso
  from v
), z as (
  select *, case when de = 'a' and regexp_full_match(a, '\d{10}') then a::bigint when de = 'a' and regexp_full_match(a, '\d{13}') then a::bigint // 1000
    when de = 'a' and not bien or dia is null then null when de = 'a' and desvio.s != '' then epoch(lugar)::bigint - case desvio.s when '-' then -1 else 1 end * (desvio.h::bigint * 3600 + desvio.m::bigint * 60) when de = 'a' and cero then epoch(lugar)::bigint end as fijo, epoch(timezone(huso, lugar))::bigint as tarde
  from w
), k as (
  -- of two instants of one local time the earlier
  select row_idx, de, case when fijo is not null then fijo when dia is not null and (de = 'b' or bien) then case when timezone(huso, to_timestamp(tarde - 3600)) = lugar then tarde - 3600 else tarde end end as utc_s from z
)
select row_idx, coalesce(max(utc_s) filter (where de = 'a'), max(utc_s) filter (where de = 'b')) as utc_s from k group by row_idx having coalesce(max(utc_s) filter (where de = 'a'), max(utc_s) filter (where de = 'b')) is not null""".replace("{mes}", _MONTH_SQL)

_P3 = r"""
with r as (
  select tarea_row_id, 'reclamo_id' as campo, case when regexp_full_match(reclamo_id, '\s*0*\d+(\.0*)?\s*[-/_\x{2010}-\x{2015}]\s*0*\d+(\.0*)?\s*')
    then regexp_replace(reclamo_id, '^\s*0*(\d+)(?:\.0*)?\s*[-/_\x{2010}-\x{2015}]\s*0*(\d+)(?:\.0*)?\s*$', '\1-\2') end as llave, cargado_en
  from tramites_tareas where reclamo_id is not null
  union all
  select tarea_row_id, 'tarea_id', case when regexp_full_match(tarea_id, '\s*0*\d+(\.0*)?\s*') then regexp_replace(tarea_id, '^\s*0*(\d+)(?:\.0*)?\s*$', '\1') end, cargado_en
  from tramites_tareas where tarea_id is not null
), o as (
  select 'reclamo_id' as campo, reclamo_id as llave, min(cargado_en) as primera, count(baja_en) as bajas from reclamos_clean group by reclamo_id
  union all select 'tarea_id', cast(tarea_id as varchar), min(alta_en), count(baja_en) from tareas_ref group by tarea_id
), c as (
  select r.tarea_row_id, r.campo, strftime(r.cargado_en, '%Y-%m') as periodo,
    case when o.llave is null then 'missing' when o.bajas > 0 then 'deleted' when o.primera > r.cargado_en then 'late' end as clase
  from r left join o on r.campo = o.campo and r.llave = o.llave
)"""

_P4 = r"""
with meses(mes, n) as (values ('enero',1),('febrero',2),('marzo',3),('abril',4),('mayo',5),('junio',6),('julio',7),('agosto',8),('septiembre',9),('setiembre',9),('octubre',10),('noviembre',11),('diciembre',12)),
t as (
  select row_idx, pluviometro, try_cast(replace(regexp_extract(lluvia_mm, '^\s*([-+]?\d+(?:[.,]\d*)?)\s*(?:mm)?\s*$', 1), ',', '.') as double) as v,
    try_cast("año_extraido" || '-' || m.n || '-' || trim(dia) as date) as f
  from rainfall_manual_recovered_months r join meses m on lower(trim(r.mes_extraido)) = m.mes
), ok as (select *, v < 0 or v > 1825 as mal from t where v is not null and f is not null),
p90 as (select pluviometro, quantile_cont(v, 0.9) as q from ok where not mal and v > 0 group by pluviometro),
dias as (select distinct pluviometro, v, f from ok where not mal and v > 0),
islas as (select *, f - cast(row_number() over (partition by pluviometro, v order by f) as integer) as isla from dias),
fijos as (select pluviometro, v, f from (select *, count(*) over (partition by pluviometro, v, isla) as n from islas) where n >= 5),
lluvia as (
  select 'rainfall_manual_recovered_months' as tabla, row_idx as fila, case when mal then 'impossible' when fijos.v is not null then 'stuck' when ok.v > 4 * q then 'spike' end as clase
  from ok left join fijos on ok.pluviometro = fijos.pluviometro and ok.v = fijos.v and ok.f = fijos.f left join p90 on ok.pluviometro = p90.pluviometro
), r as (
  select *, duration_s is null or isnan(duration_s) or duration_s <= 0 or duration_s > 86400 or distance_m / 1000 > 250 * duration_s / 3600 as mal from distancias_cache where routing_status = 'ok'
), med as (select sede_id, quantile_cont(duration_s / distance_m, 0.5) as q from r where not mal group by sede_id),
s as (select *, row_number() over (partition by sede_id order by requested_at, cache_row_id) - row_number() over (partition by sede_id, duration_s order by requested_at, cache_row_id) as isla from r where requested_at is not null),
fijas as (select cache_row_id from (select cache_row_id, count(*) over (partition by sede_id, duration_s, isla) as n from s) where n >= 5),
rutas as (
  select 'distancias_cache' as tabla, r.cache_row_id as fila, case when mal then 'impossible' when fijas.cache_row_id is not null then 'stuck' when duration_s / distance_m > 4 * q or duration_s / distance_m < q / 4 then 'spike' end as clase
  from r left join fijas on r.cache_row_id = fijas.cache_row_id left join med on r.sede_id = med.sede_id
)
select * from lluvia where clase is not null union all select * from rutas where clase is not null"""

_LN2 = "0.6931471805599453"


def _tails(name: str, rows: str, p: float, two_sided: bool) -> str:
    """CTEs ``<name>_t`` of the tail cutoffs of ``rows(fila, fuente, temporada, v)`` by the moment fit, in plain SQL."""

    def past(side: str) -> str:
        k, m, v, share = f"{side}k", f"{side}m", f"{side}v", f"(0.001 * n / {side}k)"
        shape, scale = f"((1 - {m} * {m} / {v}) / 2)", f"({m} * ({m} * {m} / {v} + 1) / 2)"
        return f"case when {k} = 0 then 0.0 when {k} < 2 or {v} <= 1e-12 or {share} >= 1 then {m} when abs({shape}) < 1e-6 then -{scale} * ln({share}) else {scale} / {shape} * (pow({share}, -{shape}) - 1) end"

    low = f"greatest(-{_LN2}, round(quantile_cont(res, 0.1), 9))" if two_sided else "cast(null as double)"
    sides = ", ".join(f"count(*) filter (where {x} > 0) as {s}k, avg({x}) filter (where {x} > 0) as {s}m, var_samp({x}) filter (where {x} > 0) as {s}v" for s, x in (("h", "(res - alto)"), ("l", "(bajo - res)")))
    return f"""{name}_n as (select fuente, quantile_cont(v, {p}) as nivel from {rows} group by fuente),
{name}_w as (select r.*, ln(v / nivel) as w from {rows} r join {name}_n n on r.fuente = n.fuente),
{name}_s as (select fuente, temporada, sum(w) as s, count(*) as k from {name}_w group by fuente, temporada),
{name}_m as (select fuente, sum(s) / sum(k) as media from {name}_s group by fuente),
{name}_r as (
  select w.fila, w.fuente, round(w.w - greatest(-{_LN2}, least({_LN2}, s.s / s.k - m.media)), 9) as res
  from {name}_w w join {name}_s s on w.fuente = s.fuente and w.temporada is not distinct from s.temporada join {name}_m m on w.fuente = m.fuente
), {name}_u as (select fuente, least({_LN2}, round(quantile_cont(res, 0.9), 9)) as alto, {low} as bajo from {name}_r group by fuente),
{name}_x as (select r.*, alto, bajo from {name}_r r join {name}_u u on r.fuente = u.fuente),
{name}_k as (select fuente, count(*) as n, max(alto) as alto, max(bajo) as bajo, {sides} from {name}_x group by fuente),
{name}_c as (select fuente, round(alto + ({past("h")}), 9) as corte_alto, round(bajo - ({past("l")}), 9) as corte_bajo from {name}_k),
{name}_t as (
  select fila, x.fuente, round(res, 6) as residuo, round(corte_bajo, 6) as corte_bajo, round(corte_alto, 6) as corte_alto, res > alto or coalesce(res < bajo, false) as pico, res > corte_alto or coalesce(res < corte_bajo, false) as fuera
  from {name}_x x join {name}_c c on x.fuente = c.fuente
)"""


_P4_TAILS = (
    _P4[: _P4.index("\nselect * from lluvia")]
    + ", a as (select row_idx as fila, pluviometro as fuente, month(f) as temporada, v from ok where not mal and v > 0 and pluviometro is not null)"
    + ", b as (select cache_row_id as fila, sede_id as fuente, hour(try_cast(requested_at as timestamptz) at time zone 'UTC') as temporada, duration_s / distance_m as v from r where not mal and duration_s / distance_m > 0 and sede_id is not null), "
    + _tails("a", "a", 0.9, False)
    + ", "
    + _tails("b", "b", 0.5, True)
)

_P5 = """
with v as (
  select zona_id, fecha, arg_max({'r': coalesce(reclamos_count, 0), 'c': cast(round(coalesce(costo_total_compuesto_ars, 0) * 100) as bigint), 'l': cast(round(coalesce(lluvia_mm, 0) * 10) as bigint)}, cargado_en) as x
  from zona_diario_base group by zona_id, fecha
), z as (select zona_id, min(fecha) as a, max(fecha) as b from v group by zona_id),
cal as (select zona_id, a, cast(unnest(generate_series(a, b, interval 1 day)) as date) as fecha from z),
d as (select cal.zona_id, cal.a, cal.fecha, coalesce(x.r, 0) as r, coalesce(x.c, 0) as c, coalesce(x.l, 0) as l from cal left join v on cal.zona_id = v.zona_id and cal.fecha = v.fecha),
t as (
  select zona_id, a, fecha, sum(r) over s as r7, sum(c) over s as c7, sum(l) over s as l7, sum(r) over m as r30, sum(c) over m as c30, sum(l) over m as l30
  from d window s as (partition by zona_id order by fecha rows 6 preceding), m as (partition by zona_id order by fecha rows 29 preceding)
)"""

_P6 = """
with c as (
  select distinct reclamo_id, cast(fecha_reclamo as date) as dia, case when d then lat else lon end as lat, case when d then lon else lat end as lon
  from (select *, lat between -30 and -25 and lon between -57 and -53 as d, lon between -30 and -25 and lat between -57 and -53 as s from reclamos_clean) where d or s
), p as (
  select distinct a.reclamo_id as id_a, b.reclamo_id as id_b from c a join c b on a.dia = b.dia and a.reclamo_id < b.reclamo_id
  where 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100
), v as (
  select distrito_id, generate_subscripts(vert_lat, 1) as i, unnest(vert_lat) as y, unnest(vert_lon) as x, list_max(vert_lat) as y1, list_min(vert_lat) as y0, list_max(vert_lon) as x1, list_min(vert_lon) as x0, len(vert_lat) as n from distritos
), e as (select a.*, b.x as bx, b.y as by_ from v a join v b on a.distrito_id = b.distrito_id and b.i = a.i % a.n + 1),
q as (select distinct lat, lon from c),
w as (
  select lat, lon, distrito_id from q join e on lat between y0 and y1 and lon between x0 and x1
  group by lat, lon, distrito_id having sum(case when (y > lat) != (by_ > lat) and lon < (bx - x) * (lat - y) / (by_ - y) + x then 1 else 0 end) % 2 = 1
)
select 'par' as tipo, id_a, id_b from p
union all select distinct 'distrito', c.reclamo_id, w.distrito_id from c join w on c.lat = w.lat and c.lon = w.lon"""

_P7 = """
with r as (
  select row_id, pluviometro, cuenca, fecha, coalesce(lluvia_mm >= 0 and lluvia_mm <= 500 and not isnan(lluvia_mm), false) as m, coalesce(lower(trim(lluvia_status)) in ('observed', 'duplicate_collapsed', 'missing_source'), false) as s from lluvia_diaria_clean
), cells as (select row_id, pluviometro, cuenca, fecha, 'lluvia_mm' as campo, m as hay from r union all select row_id, pluviometro, cuenca, fecha, 'lluvia_status', s from r),
have as (select distinct campo, pluviometro, cuenca, fecha from cells where hay),
g as (select distinct c.row_id, c.campo from cells c join have h on c.campo = h.campo and c.cuenca = h.cuenca and c.fecha = h.fecha and c.pluviometro != h.pluviometro where not c.hay),
t as (select distinct c.row_id, c.campo from cells c join have h on c.campo = h.campo and c.pluviometro = h.pluviometro and abs(date_diff('day', c.fecha, h.fecha)) <= 3 where not c.hay)
select row_id, campo, case when max(k) = 2 then 'grupo' else 'tiempo' end as via from (select row_id, campo, 2 as k from g union all select row_id, campo, 1 from t) group by row_id, campo"""

_BIN = "case when {v} is null then -1 " + " ".join(f"when {{v}} <= {e} then {i}" for i, e in enumerate(filling.BIN_ENDS)) + f" else {len(filling.BIN_ENDS)} end"
_ST = "case " + " ".join(f"when {{s}} = '{s}' then {i}" for i, s in enumerate(filling.STATUSES)) + " end"
_ST_NAME = "case {x} " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(filling.STATUSES)) + " end"
_NEAR = "case when b{c} is null or a{c} is null then coalesce(bv{c}, av{c}) when f - b{c} = a{c} - f then {tie} when f - b{c} < a{c} - f then bv{c} else av{c} end"
# evidence as in the operator; the tree's edges are those without a better way round; posteriors by summing the tree's joint over all 13,824 states
_P7_FILLED = f"""
with recursive r as (
  select row_id, pluviometro as p, cuenca as g, fecha as f, case when lluvia_mm between 0 and 500 and not isnan(lluvia_mm) then lluvia_mm end as mm, {_ST.format(s="lower(trim(lluvia_status))")} as st from lluvia_diaria_clean
), d as (select g, p, f, cast(sum(cast(mm as decimal(24,9))) as double) / count(mm) as mm, min(st) as st from r group by g, p, f),
k as (select g, f, sum(cast(mm as decimal(24,9))) as s, count(mm) as n, count(*) filter (where st = 0) as c0, count(*) filter (where st = 1) as c1, count(*) filter (where st = 2) as c2 from d where g is not null and p is not null and f is not null group by g, f),
o as (select p, f, cast(sum(cast(mm as decimal(24,9))) as double) / count(mm) as mm, min(st) as st from d where p is not null and f is not null group by p, f),
w as (
  select a.p, a.f, {", ".join(f"max(b.f) filter (where b.f < a.f and b.{c} is not null) as b{c}, arg_max(b.{c}, b.f) filter (where b.f < a.f and b.{c} is not null) as bv{c}, min(b.f) filter (where b.f > a.f and b.{c} is not null) as a{c}, arg_min(b.{c}, b.f) filter (where b.f > a.f and b.{c} is not null) as av{c}" for c in ("mm", "st"))}
  from o a join o b on a.p = b.p and b.f between a.f - 3 and a.f + 3 group by a.p, a.f
), c as (select p, f, {_NEAR.format(c="mm", tie="(bvmm + avmm) / 2")} as mm, {_NEAR.format(c="st", tie="least(bvst, avst)")} as st from w),
e as (
  select r.row_id, r.mm, r.st, case when k.n - cast(d.mm is not null as integer) > 0 then cast(k.s - coalesce(cast(d.mm as decimal(24,9)), 0) as double) / (k.n - cast(d.mm is not null as integer)) end as pmm,
    k.c0 - coalesce(cast(d.st = 0 as integer), 0) as p0, k.c1 - coalesce(cast(d.st = 1 as integer), 0) as p1, k.c2 - coalesce(cast(d.st = 2 as integer), 0) as p2,
    case when r.mm is null then coalesce(o.mm, c.mm) else c.mm end as nmm, case when r.st is null then coalesce(o.st, c.st) else c.st end as nst
  from r left join d on r.g is not distinct from d.g and r.p is not distinct from d.p and r.f is not distinct from d.f left join k on r.g = k.g and r.f = k.f left join o on r.p = o.p and r.f = o.f left join c on r.p = c.p and r.f = c.f
), v as (
  select row_id, mm, st, {_BIN.format(v="mm")} as v0, {_BIN.format(v="pmm")} as v1, {_BIN.format(v="nmm")} as v2, coalesce(st, -1) as v3, case when coalesce(p0 + p1 + p2, 0) <= 0 then -1 when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as v4, coalesce(nst, -1) as v5 from e
), n as (select *, row_number() over () as id from (select v0, v1, v2, v3, v4, v5, count(*) as n from v group by all)),
vars(a, k) as (values (0, 8), (1, 8), (2, 8), (3, 3), (4, 3), (5, 3)),
l as ({" union all ".join(f"select id, n, {i} as a, v{i} as x from n where v{i} >= 0" for i in range(6))}),
pc as (select i.a, j.a as b, i.x, j.x as y, sum(i.n) as n from l i join l j on i.id = j.id and i.a < j.a group by 1, 2, 3, 4),
jw as (select i.a, j.a as b, x, y from vars i join vars j on i.a < j.a, range(8) as rx(x), range(8) as ry(y) where x < i.k and y < j.k),
jn as (select jw.*, 0.1 + coalesce(pc.n, 0) as w from jw left join pc using (a, b, x, y)),
jp as (select a, b, x, y, cast(w as double) / sum(cast(w as double)) over (partition by a, b) as p from jn),
mi as (select a, b, round(sum(p * ln(p / (px * py))), 9) as m from (select *, sum(p) over (partition by a, b, x) as px, sum(p) over (partition by a, b, y) as py from jp) group by a, b),
rk as (select a, b, row_number() over (order by m desc, a, b) as k from mi),
re as (select k, a as at from rk union select re.k, case when rk.a = re.at then rk.b else rk.a end from re join rk on rk.k < re.k and (rk.a = re.at or rk.b = re.at)),
tr as (select a, b from rk where not exists (select 1 from re where re.k = rk.k and re.at = rk.b)),
t2 as (select a, b from tr union all select b, a from tr),
way as (select t as objetivo, t as nodo, -1 as padre from (values (0), (3)) as x(t) union all select objetivo, t2.b, nodo from way join t2 on t2.a = nodo and t2.b != padre),
j2 as (select a, b, x, y, p from jp union all select b, a, y, x, p from jp),
cd as (select a, b, x, y, p / sum(p) over (partition by a, b, x) as p from j2),
ow as (select a, x, (0.1 + coalesce(sum(n), 0)) as w, coalesce(sum(n), 0) as filas from (select a, x from vars, range(8) as rx(x) where x < k) left join l using (a, x) group by a, x),
op as (select a, x, filas, cast(w as double) / sum(cast(w as double)) over (partition by a) as p from ow),
es as (select [s0, s1, s2, s3, s4, s5] as s from range(8) as q0(s0), range(8) as q1(s1), range(8) as q2(s2), range(3) as q3(s3), range(3) as q4(s4), range(3) as q5(s5)),
lp as (select objetivo, s, exp(sum(ln(cd.p))) as p from es, way join cd on cd.a = way.padre and cd.b = way.nodo and cd.x = s[way.padre + 1] and cd.y = s[way.nodo + 1] where padre >= 0 group by objetivo, s),
qs as (select objetivo, list_value(v0, v1, v2, v3, v4, v5) as v from n, (values (0), (3)) as x(objetivo) where (objetivo = 0 and v0 < 0 and (v1 >= 0 or v2 >= 0)) or (objetivo = 3 and v3 < 0 and (v4 >= 0 or v5 >= 0))),
po as (
  select qs.objetivo, qs.v, lp.s[qs.objetivo + 1] as x, sum(lp.p) as p from qs join lp on qs.objetivo = lp.objetivo
  and (v[1] < 0 or v[1] = s[1]) and (v[2] < 0 or v[2] = s[2]) and (v[3] < 0 or v[3] = s[3]) and (v[4] < 0 or v[4] = s[4]) and (v[5] < 0 or v[5] = s[5]) and (v[6] < 0 or v[6] = s[6]) group by 1, 2, 3
), pq as (select po.objetivo, po.v, po.x, po.p * op.p as p, filas from po join op on op.a = po.objetivo and op.x = po.x),
pn as (select *, round(p / sum(p) over (partition by objetivo, v), 12) as q from pq),
best as (select objetivo, v, arg_max(x, (q, -x)) filter (where filas > 0) as x from pn group by objetivo, v),
md as (select v0 as x, quantile_cont(mm, 0.5) as mm from v where v0 >= 0 group by v0)
select row_id, round(case when v0 >= 0 then v.mm else md.mm end, 6) as mm_llena, case when v0 >= 0 or md.mm is null then null when v1 >= 0 then 'grupo' when v2 >= 0 then 'tiempo' end as mm_via,
  {_ST_NAME.format(x="case when v3 >= 0 then v3 else b3.x end")} as status_llena, case when v3 >= 0 or b3.x is null then null when v4 >= 0 then 'grupo' when v5 >= 0 then 'tiempo' end as status_via
from v left join best b0 on b0.objetivo = 0 and b0.v = list_value(v0, v1, v2, v3, v4, v5) left join md on md.x = b0.x left join best b3 on b3.objetivo = 3 and b3.v = list_value(v0, v1, v2, v3, v4, v5)"""

ORACLES = {
    "p1_found": _P1,
    "p3_found": _P3 + " select tarea_row_id, campo, clase, periodo from c where clase is not null",
    "p3_counts": _P3 + " select case when campo = 'reclamo_id' then 'reclamos_clean' else 'tareas_ref' end as tabla, clase, periodo, count(*) as referencias from c where clase is not null group by 1, 2, 3",
    "p4_found": _P4,
    "p4_tails": _P4_TAILS + " select *, 'rainfall_manual_recovered_months' as tabla from a_t union all select *, 'distancias_cache' from b_t",
    "p4_sources": _P4_TAILS + " select fuente, count(*) as lecturas, count(*) filter (where pico) as picos, count(*) filter (where fuera) as fuera from (select * from a_t union all select * from b_t) group by fuente",
    "p5_found": _P5
    + "".join(
        f" {'union all ' * bool(k)}select zona_id, strftime(fecha, '%Y-%m-%d') as fecha, '{name}' as campo from t where date_diff('day', a, fecha) >= 29 and 2 * {c}7 > {c}30"
        for k, (c, name) in enumerate((("r", "reclamos_count"), ("c", "costo_total_compuesto_ars"), ("l", "lluvia_mm")))
    ),
    "p5_trailing": _P5
    + " select zona_id, fecha, "
    + ", ".join(f"cast({c}{w} as double) / {k} / {n} as {name}_{kind}_{w}" for c, name, k in (("r", "reclamos_count", 1), ("c", "costo_total_compuesto_ars", 100), ("l", "lluvia_mm", 10)) for w in (7, 30) for kind, n in (("total", 1), ("media", w)))
    + " from t",
    "p6_found": _P6,
    "p7_found": _P7,
    "p7_filled": _P7_FILLED,
}
