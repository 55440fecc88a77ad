"""Sampling, encoding, payload and verification queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesela.functions import scalars as S
from tesela.operators import panel, ranking
from tesela.operators.dedup import first_by, overridden
from tesela.operators.encoding import one_hot as one_hot_encoded
from tesela.operators.neighbours import nearest, vote
from tesela.operators.sampling import hundredth, sampled
from tesela.plans import explore, panel_queries
from tesela.plans.registry import Registry
from tesela.runtime import cut
from tesela.sources.tables import table

query = Registry()


@query("select event_type, count(*) as eventos, sum(cast(json_extract_string(props, '$.k') as bigint)) as k_total, cast(count(distinct json_extract_string(props, '$.k')) as bigint) as k_distintos from events group by event_type")
def json_fields(spark, d):
    """Typed fields of JSON text."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").k.alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("eventos"), F.sum("k").alias("k_total"), F.count_distinct("k").alias("k_distintos"))


GEOCODE = "status string, results array<struct<formatted_address: string, address_components: array<struct<long_name: string, types: array<string>>>>>"


def place_name(payload):
    """Locality in any result, else sublocality, else neighborhood, else ``Unknown``."""
    parts = F.flatten(F.transform(F.from_json(payload, GEOCODE).results, lambda r: r.address_components))
    of = lambda kind: F.try_element_at(F.filter(parts, lambda c: F.array_contains(c.types, kind)), F.lit(1)).long_name
    return F.coalesce(of("locality"), of("sublocality"), of("neighborhood"), F.lit("Unknown"))


@query("select distinct localidad as consulta, case when localidad is null then 'Unknown' when length(localidad) % 2 = 0 then localidad else 'Barrio ' || localidad end as lugar from reclamos_clean")
def geocode_components(spark, d):
    """Place names out of geocoder payloads."""
    # a payload whose components depend on the name's length, to exercise the order of preference
    kind = F.when(F.length("localidad") % 2 == 0, "locality").otherwise("neighborhood")
    name = F.when(F.length("localidad") % 2 == 0, F.col("localidad")).otherwise(F.concat(F.lit("Barrio "), "localidad"))
    component = F.struct(name.alias("long_name"), F.array(kind).alias("types"))
    other = F.struct(F.lit("Provincia").alias("long_name"), F.array(F.lit("administrative_area_level_1")).alias("types"))
    results = F.array(F.struct(F.array(other).alias("address_components")), F.struct(F.when(F.col("localidad").isNotNull(), F.array(component)).otherwise(F.array(other)).alias("address_components")))
    rows = table(spark, d, "reclamos_clean", ["localidad"]).distinct()
    return rows.select(F.col("localidad").alias("consulta"), place_name(F.to_json(F.struct(F.lit("OK").alias("status"), results.alias("results")))).alias("lugar"))


@query(
    "with g as (select a.vec_id as consulta, b.vec_id as vecino, b.label, a.label as propia, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(cast(x[1] as double) - cast(x[2] as double), 2)))) as dist from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id != b.vec_id), "
    "r as (select *, row_number() over (partition by consulta order by dist, vecino) as k from g), v as (select consulta, propia, label, count(*) as n from r where k <= 5 group by 1, 2, 3), w as (select *, row_number() over (partition by consulta order by n desc, label) as k from v) select consulta, propia, label as voto, n as votos from w where k = 1"
)
def knn_vote(spark, d):
    """Class by the vote of the five nearest neighbours; ties go to the smaller class."""
    e = table(spark, d, "embeddings")
    near = nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    labels = e.select(F.col("vec_id").alias("vecino"), F.col("label").alias("voto"))
    own = e.select(F.col("vec_id").alias("consulta"), F.col("label").alias("propia"))
    return vote(near, labels).join(own, "consulta").select("consulta", "propia", "voto", "votos")


@query(
    "with g as (select a.vec_id as consulta, b.vec_id as vecino, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(cast(x[1] as double) - cast(x[2] as double), 2)))) as dist from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id != b.vec_id), "
    "r as (select *, row_number() over (partition by consulta order by dist, vecino) as k from g), v as (select consulta, label, round(sum(1 / greatest(dist, 1e-9)), 9) as n from r where k <= 5 group by 1, 2), w as (select *, row_number() over (partition by consulta order by n desc, label) as k from v) select consulta, label as voto, round(n, 6) as votos from w where k = 1"
)
def knn_vote_weighted(spark, d):
    """Class by the vote of the five nearest neighbours, each weighing the inverse of its distance."""
    e = table(spark, d, "embeddings")
    near = nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return vote(near, e.select(F.col("vec_id").alias("vecino"), F.col("label").alias("voto")), 1 / F.greatest("dist", F.lit(1e-9))).withColumn("votos", F.round("votos", 6))


@query(
    "select 'zona_diario_base' as tabla, 'claims_proxy' as modo, 'servicio' as columna, count(distinct servicio_normalizado) as servicios from reclamos_zonificados where zona_id is not null and trim(servicio_normalizado) != '' union all select 'reclamos_zonificados', 'direct', 'servicio_normalizado', count(distinct trim(servicio_normalizado)) from reclamos_zonificados where trim(servicio_normalizado) != '' "
    "union all select 'distancias_cache', 'none', null, 0"
)
def service_modes(spark, d):
    """How each table's services can be filtered, and how many there are."""
    claims = table(spark, d, "reclamos_zonificados")
    out = None
    for name, own in (("zona_diario_base", claims), ("reclamos_zonificados", None), ("distancias_cache", None)):
        mode, column, frame = explore.service_dimension(table(spark, d, name), own)
        one = frame.where("trim(servicio) != ''").agg(F.count_distinct(F.trim("servicio")).alias("servicios")).select(F.lit(name).alias("tabla"), F.lit(mode).alias("modo"), F.lit(column).cast("string").alias("columna"), "servicios")
        out = one if out is None else out.unionByName(one)
    return out


@query("with i as (select servicio_normalizado as servicio, sede_id as sede, row_number() over (partition by servicio_normalizado order by count(*) desc, sede_id) as k from reclamos_zonificados group by 1, 2), e(servicio, sede) as (values ('AGUA', 'SD00001'), ('TELEFONIA', 'SD00002')) select coalesce(e.servicio, i.servicio) as servicio, coalesce(e.sede, i.sede) as sede, cast(e.servicio is not null as integer) as prioridad from (select * from i where k = 1) i full join e on i.servicio = e.servicio")
def service_precedence(spark, d):
    """The depot of each service: a given one first, else the one with most of its claims."""
    counts = table(spark, d, "reclamos_zonificados").groupBy(F.col("servicio_normalizado").alias("servicio"), F.col("sede_id").alias("sede")).agg(F.count(F.lit(1)).alias("n"))
    inferred = first_by(counts, ["servicio"], F.desc("n"), F.asc("sede")).drop("n")
    given = spark.createDataFrame([("AGUA", "SD00001"), ("TELEFONIA", "SD00002")], "servicio string, sede string")
    return overridden(inferred, given, ["servicio"], F.col("sede"))


@query("select reclamo_id, cargado_en, cast(estado_geo = 'direct' as integer) as geo_direct, cast(estado_geo = 'swapped' as integer) as geo_swapped, cast(baja_en is not null as integer) as baja, case when numero_tramite > 0 then round(ln(numero_tramite), 9) end as log_tramite from reclamos_clean")
def one_hot(spark, d):
    """Indicator columns with the first level (invalid) left out, a flag, and a logarithm."""
    rows = one_hot_encoded(table(spark, d, "reclamos_clean"), "estado_geo", ["direct", "invalid", "swapped"], "geo", drop="invalid")
    return rows.select("reclamo_id", "cargado_en", "geo_direct", "geo_swapped", F.col("baja_en").isNotNull().cast("int").alias("baja"), F.when(F.col("numero_tramite") > 0, F.round(F.ln("numero_tramite"), 9)).alias("log_tramite"))


@query("with p as (select o_orderkey, 1 / (1 + exp(-(o_totalprice - 150000) / 50000)) as p from orders) select o_orderkey, round(p, 9) as logistica, round(p / max(p) over (), 9) as relativa from p")
def naive_probability(spark, d):
    """Logistic of a margin, and divided by the greatest of all rows."""
    p = table(spark, d, "orders").select("o_orderkey", S.logistic((F.col("o_totalprice") - 150000) / 50000).alias("p"))
    return ranking.with_totals(p, {"m": F.max("p")}).select("o_orderkey", F.round("p", 9).alias("logistica"), F.round(F.col("p") / F.col("m"), 9).alias("relativa"))


@query(
    "with z as (select zona_id, count(*) as n from reclamos_zonificados where zona_id is not null group by 1), m as (select cast(min(n) as double) as lo, cast(max(n) as double) as hi from z), s as (select zona_id, n, case when hi = lo then 0.5 else (n - lo) / (hi - lo) end as s from z, m) "
    "select zona_id, n, round(case when (select hi = lo from m) then 12.0 else 4 + s * 16 end, 9) as radio, cast(least(floor(s * 5), 4) as integer) as color, replace(format('{:,}', n), ',', '.') as texto from s"
)
def scaled_palette(spark, d):
    """Map radius, colour number and label of each zone."""
    z = table(spark, d, "reclamos_zonificados").where("zona_id is not null").groupBy("zona_id").agg(F.count(F.lit(1)).alias("n"))
    z = ranking.with_totals(z, {"lo": F.min("n").cast("double"), "hi": F.max("n").cast("double")})
    share = S.scaled(F.col("n").cast("double"), F.col("lo"), F.col("hi"), 0.0, 1.0)
    return z.select("zona_id", "n", F.round(S.scaled(F.col("n").cast("double"), F.col("lo"), F.col("hi"), 4.0, 20.0), 9).alias("radio"), S.palette_bin(share, 5).alias("color"), S.thousands(F.col("n")).alias("texto"))


@query("select zona_id, fecha, nullif(upper(trim(servicio_normalizado)), '') as servicio, count(distinct reclamo_id) as reclamos from reclamos_zonificados where zona_id is not null and upper(trim(servicio_normalizado)) in ('ENERGIA', 'AGUA') group by 1, 2, 3")
def service_dimension(spark, d):
    """Claims per zone, day and allowed service, the service taken from the first usable column."""
    rows = table(spark, d, "reclamos_zonificados").where("zona_id is not null")
    allowed = explore.allowed_services(rows, ["servicio", "servicio_normalizado"], ["energia", "AGUA"])
    return allowed.groupBy("zona_id", "fecha", S.service_label(F.col("servicio_normalizado")).alias("servicio")).agg(F.count_distinct("reclamo_id").alias("reclamos"))


@query("select reclamo_id, fecha_reclamo, lat, lon from reclamos_clean order by md5(reclamo_id), fecha_reclamo, lat, lon limit 1000")
def sample_hashed(spark, d):
    """A thousand rows of the claims, the same on every run; the cap is the sampler's feature."""
    return table(spark, d, "reclamos_clean", ["reclamo_id", "fecha_reclamo", "lat", "lon"]).orderBy(F.md5("reclamo_id"), "fecha_reclamo", "lat", "lon").limit(1000)


_HUNDREDTH = "('0x' || md5({k})[1:8])::bigint % 100"


@query(f"select reclamo_id, cargado_en from reclamos_clean where {_HUNDREDTH.format(k='reclamo_id')} < 5")
def sample_fraction(spark, d):
    """A twentieth of the claims by a hash of their id, the same on every run."""
    return sampled(table(spark, d, "reclamos_clean", ["reclamo_id", "cargado_en"]), ["reclamo_id"], 0.05)


@query(f"select estado_geo, case when {_HUNDREDTH.format(k='reclamo_id')} < 70 then 'train' else 'test' end as parte, count(*) as filas from reclamos_clean group by 1, 2")
def stratified_split(spark, d):
    """Rows per part and class of a hash split within each class."""
    rows = table(spark, d, "reclamos_clean").select("estado_geo", "reclamo_id")
    part = F.when(hundredth("reclamo_id") < 70, "train").otherwise("test")
    return rows.groupBy("estado_geo", part.alias("parte")).agg(F.count(F.lit(1)).alias("filas"))


@query(
    panel_queries._SUPERVISED
    + ", u as (select count(*) as n from reclamos_zonificados where destino_key is not null and destino_key not in (select destino_key from zonas_clusterizadas where destino_key is not null)) "
    "select 'claves_repetidas' as control, count(*) - count(distinct (zona_id, fecha)) as valor from s union all select 'dias_sin_reclamos', count(*) from s where not has_claims union all select 'objetivos_nulos', count(*) from s where y_reclamos_count_t1 is null union all select 'reclamos_sin_destino', n from u"
)
def verification_summary(spark, d):
    """Checks of the panel: repeated keys, days without claims, rows without a target, claims without a destination."""
    s = cut(panel.supervised(panel_queries.zone_panel(spark, d)))
    counts = s.agg((F.count(F.lit(1)) - F.count_distinct("zona_id", "fecha")).alias("claves_repetidas"), F.count_if(~F.col("has_claims")).alias("dias_sin_reclamos"), F.count_if(F.col("y_reclamos_count_t1").isNull()).alias("objetivos_nulos"))
    lost = table(spark, d, "reclamos_zonificados", ["destino_key"]).where("destino_key is not null").join(table(spark, d, "zonas_clusterizadas", ["destino_key"]), "destino_key", "left_anti")
    long = counts.unpivot([], counts.columns, "control", "valor")
    return long.unionByName(lost.agg(F.lit("reclamos_sin_destino").alias("control"), F.count(F.lit(1)).alias("valor")))


@query("select fecha_reclamo, fecha_reclamo_alt, reclamo_id, cargado_en, abs(date_diff('second', fecha_reclamo, fecha_reclamo_alt)) / 60.0 as minutos from reclamos_clean where fecha_reclamo_alt is not null and fecha_reclamo is not null and abs(date_diff('second', fecha_reclamo, fecha_reclamo_alt)) > 0")
def temporal_audit(spark, d):
    """Claims whose two times differ, and by how many minutes."""
    rows = table(spark, d, "reclamos_clean").where("fecha_reclamo_alt is not null and fecha_reclamo is not null")
    return rows.select("fecha_reclamo", "fecha_reclamo_alt", "reclamo_id", "cargado_en", S.minutes_between(F.col("fecha_reclamo"), F.col("fecha_reclamo_alt")).alias("minutos")).where("minutos > 0")


@query("select zona_id, fecha, case when max(lluvia_mm) is null then 'sin_dato' when max(lluvia_mm) <= 0 then 'seco' when max(lluvia_mm) <= 10 then 'leve' when max(lluvia_mm) <= 30 then 'moderada' else 'intensa' end as nivel from zona_diario_base group by 1, 2")
def rain_levels(spark, d):
    """Rain class of each zone and day."""
    return table(spark, d, "zona_diario_base").groupBy("zona_id", "fecha").agg(S.rain_level(F.max("lluvia_mm")).alias("nivel"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
