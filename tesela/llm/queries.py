"""Queries of the problems on texts and match graphs, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesela.llm import groups, leakage, packing, splitting
from tesela.runtime import cut
from tesela.sources.tables import table


def _limit(spark: SparkSession, d: str, use: str) -> tuple[int, int]:
    """Capacity and overlap of a use; a fixed table of a few rows."""
    row = table(spark, d, "limites_tokens").where(f"uso = '{use}'").first()
    if row is None:
        raise ValueError(f"limites_tokens lacks {use}")
    return int(row["capacidad"]), int(row["solape"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every destination and zone."""
    return groups.territorial_groups(table(spark, d, "zonas_clusterizadas"), table(spark, d, "destino_pares"), table(spark, d, "reclamos_zonificados"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document or piece of one."""
    return packing.pack_documents(table(spark, d, "documents"), _limit(spark, d, "contenedor")[0])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused space."""
    return packing.container_fill(p8_containers(spark, d), _limit(spark, d, "contenedor")[0])


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, counted."""
    return packing.container_checks(cut(p8_containers(spark, d)), table(spark, d, "documents"), _limit(spark, d, "contenedor")[0])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain 12 or more consecutive words of an item: the verified candidates without an edit."""
    return p9_near(spark, d).where("ediciones = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 11 to 13 consecutive words within one word edit of 12 of an item, and the least number of edits."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "items_eval"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized document."""
    return splitting.split_documents(table(spark, d, "documents"), *_limit(spark, d, "pieza"))


def p10_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces, counted."""
    return splitting.piece_checks(p10_pieces(spark, d), table(spark, d, "documents"), *_limit(spark, d, "pieza"))


QUERIES = {f.__name__: f for f in (p2_found, p8_containers, p8_fill, p8_check, p9_found, p9_near, p10_pieces, p10_check)}

_P2 = """
with recursive d as (select distinct destino_id as id from zonas_clusterizadas where destino_id is not null),
l as (
  select destino_id as a, cluster_root as b from zonas_clusterizadas union all select destino_a, destino_b from destino_pares where lower(trim(decision)) = 'match'
), k as (select a, b from l where a in (select id from d) and b in (select id from d)),
e as (select a, b from k union select b, a from k),
rd as (select id as a, id as b from d union select rd.a, e.b from rd join e on rd.b = e.a),
z as (select distinct zona_id as id from reclamos_zonificados where zona_id is not null),
s as (select distinct x.zona_id as a, y.zona_id as b from reclamos_zonificados x join reclamos_zonificados y on x.reclamo_id = y.reclamo_id and x.zona_id != y.zona_id),
rz as (select id as a, id as b from z union select rz.a, s.b from rz join s on rz.b = s.a)
select 'destino' as entidad, cast(a as varchar) as miembro, cast(min(b) as varchar) as grupo from rd group by a
union all select 'zona', a, min(b) from rz group by a"""

_P9 = r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as ws from documents where text is not null
  union all select 'i', item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') from items_eval where text is not null
), g as (select kind, id, array_to_string(ws[k:k + 11], ' ') as s from (select kind, id, ws, unnest(range(1, len(ws) - 10)) as k from w where len(ws) >= 12))
select distinct a.id as doc_id, b.id as item_id from g a join g b on a.kind = 'd' and b.kind = 'i' and a.s = b.s"""

# one edit apart: equal without the same word, or one is the other without a word
_P9_NEAR = r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as ws from documents where text is not null
  union all select 'i', item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') from items_eval where text is not null
), n as (select kind, id, n, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda k: ws[k:k + n - 1])) as g from w, (values (11), (12), (13)) as l(n) where kind = 'd' or n = 12),
g as (select distinct * from n),
x as (
  select kind, id, 0 as ediciones, 'todas ' || array_to_string(g, ' ') as s from g where n = 12
  union all select kind, id, 1, 'sin ' || k || ' ' || array_to_string(list_concat(g[:k - 1], g[k + 1:]), ' ') from g, range(1, 13) as r(k) where n = 12
  union all select kind, id, 1, 'corta ' || array_to_string(list_concat(g[:k - 1], g[k + 1:]), ' ') from g, range(1, 13) as r(k) where kind = 'i'
  union all select kind, id, 1, 'corta ' || array_to_string(g, ' ') from g where n = 11
  union all select kind, id, 1, 'larga ' || array_to_string(g, ' ') from g where kind = 'i'
  union all select kind, id, 1, 'larga ' || array_to_string(list_concat(g[:k - 1], g[k + 1:]), ' ') from g, range(1, 14) as r(k) where n = 13
)
select a.id as doc_id, b.id as item_id, min(b.ediciones) as ediciones from x a join x b on a.kind = 'd' and b.kind = 'i' and a.s = b.s group by 1, 2"""

_none = lambda *names: "".join(f" union all select '{n}', 0" for n in names)
_P8_CHECK = "select 'documentos' as control, count(distinct doc_id) as valor from documents" + _none("perdidos", "excedidos", "con_huecos", "cortados_sin_motivo")
_P10_CHECK = "select 'excedidas' as control, 0::bigint as valor" + _none("solapes_distintos", "sin_principio_o_fin", "ajenas")

ORACLES = {"p2_found": _P2, "p8_check": _P8_CHECK, "p9_found": _P9, "p9_near": _P9_NEAR, "p10_check": _P10_CHECK}
