"""Scalar functions, joins, windows, sources, sinks, fetchers, zones and streams on small frames."""

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tesela.functions import scalars as S
from tesela.operators import cascade, clusters, dedup, joins, metrics, panel, profiles, ranking, windows
from tesela.operators.encoding import one_hot, yes_no
from tesela.operators.neighbours import nearest, vote
from tesela.operators.sampling import sampled
from tesela.plans import explore
from tesela.runtime import has_at_most, require_columns, salted_lookup
from tesela.sources import fetched, files, sinks
from tesela.streaming import daily

D0 = dt.date(2021, 1, 1)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).collect()[0].r


@pytest.mark.parametrize("text,want", [("8:30", "08:30"), ("830", "08:30"), ("12:30:00", None), ("830.0", None), ("2460", None), ("", None), (None, None), ("0", "00:00")])
def test_hhmm(spark, text, want):
    assert one(spark, S.hhmm, text) == want


@pytest.mark.parametrize("text,want", [(" energía   eléctrica ", "ENERGIA ELECTRICA"), ("", "SIN_SERVICIO"), (None, "SIN_SERVICIO")])
def test_service_name(spark, text, want):
    assert one(spark, S.service_name, text) == want


@pytest.mark.parametrize("text,want", [("A", "plain_a"), (" A ", "plain_a"), ("R°", "evento_intenso"), ("=", "marca_horaria"), ("A/B°", "marca_horaria"), ("x", "otro_codigo"), ("", "missing"), (None, "missing")])
def test_rain_code(spark, text, want):
    assert one(spark, S.rain_code, text) == want


@pytest.mark.parametrize("mm,want", [(0.0, "0"), (5.0, "0-5"), (5.1, "5-20"), (20.0, "5-20"), (30.0, ">20"), (None, "sin_dato")])
def test_rain_bucket(spark, mm, want):
    assert one(spark, S.rain_bucket, mm, "double") == want


def test_small_functions(spark):
    assert one(spark, S.coordinate, " -26,5 ") == -26.5 and one(spark, S.coordinate, "x") is None
    assert one(spark, S.number_or_null, "nan") is None and one(spark, S.month_number, " Setiembre ") == 9
    assert one(spark, S.thousands, 1234567.0, "double") == "1.234.567" and one(spark, S.thousands, None, "double") == "—"
    assert one(spark, lambda c: S.date_of(c, F.lit(2), F.lit(30)), 2023, "int") is None
    assert one(spark, lambda c: S.composite_key(c, F.lit(1)), None) == "<NA>-1"
    assert one(spark, lambda c: S.safe_ratio(F.lit(1.0), c), 0.0, "double") is None
    assert one(spark, lambda c: S.scaled(c, F.lit(5.0), F.lit(5.0), 1.0, 3.0), 5.0, "double") == 2.0
    assert one(spark, lambda c: S.palette_bin(c, 4), 1.0, "double") == 3
    assert one(spark, lambda c: S.first_present(c, F.lit(" b ")), " ") == "b"
    assert one(spark, lambda c: S.source_label(("a", c), ("b", F.lit(1))), None, "int") == "b"
    assert one(spark, lambda c: S.minutes_between(c, F.lit("2021-01-01 00:30:00").cast("timestamp_ntz")), dt.datetime(2021, 1, 1), "timestamp_ntz") == 30.0
    assert S.feature_family("reclamos_lag_1") == "lag" and S.feature_family("km") == "base_feature" and S.feature_family("y_km_lag_1") == "target" and S.feature_family("llovio") == "weather" and S.feature_family("reclamos_count") == "zone_or_claims"


def test_joins(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, 10.0), (None, 99.0)], "k int, v double")
    assert rows(joins.checked_join(left, right, ["k"], validate="m:1"), "l", "v") == sorted([("a", 10.0), ("b", 10.0), ("c", None), ("d", None)])
    with pytest.raises(ValueError):
        joins.checked_join(right, left, ["k"], validate="m:1")
    with pytest.raises(ValueError):
        joins.single_row(left, "x")
    assert rows(joins.updated(right, spark.createDataFrame([(1, 11.0), (7, 1.0)], "k int, v double"), ["k"], ["v"])) == [(None, 99.0), (1, 11.0)]
    assert joins.aligned(left, right).columns == ["k", "v"]
    assert rows(salted_lookup(left, right, ["k"]), "l", "v") == sorted([("a", 10.0), ("b", 10.0), ("c", None), ("d", None)])
    assert has_at_most(left, 4) and not has_at_most(left, 3)
    with pytest.raises(ValueError, match="zz"):
        require_columns(left, ["k", "zz"], "t")


def test_dedup(spark, rows):
    cache = spark.createDataFrame([("a", "2021", 1), ("a", None, 2), ("a", "2022", 3), ("b", None, 4)], "k string, t string, v int")
    assert rows(dedup.first_by(cache, ["k"], F.col("t").desc_nulls_last(), F.col("v")), "k", "v") == [("a", 3), ("b", 4)]
    base, manual = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 7), ("z", 8)], "k string, v int")
    assert rows(dedup.overridden(base, manual, ["k"], F.col("v"))) == [("x", 1, 0), ("y", 7, 1), ("z", 8, 1)]


def test_cascade_names_the_first_reason_and_twins_of_excluded_rows(spark):
    columns = "row_idx bigint, numerotramite string, numeroorden string, dt_inicio string, geo1 string, geo2 string"
    good, far = ("2021-05-05 10:00:00", "-26.5", "-54.5"), ("2020-12-31 23:59:59", "-26.5", "-54.5")
    data = [(1, "1", "1", *good), (2, "1", "1", *good), (3, "2", "1", *far), (4, "2", "1", *good), (5, "3", "1", "x", None, None), (6, "4", "1", "2021-01-01 00:00:00", "-54.5", "-26.5"), (7, "5", "1", "2026-03-31 23:59:59", "0", "-54.5"), (8, None, None, "2021-05-05 10:00:00", "-10", "-54.5"), (9, "6", "1", "2021-05-05 10:00:00", "s/d", "-54.5")]
    got = {r.row_idx: (r.motivo_exclusion, r.reclamo_id, r.estado_geo) for r in cascade.claims_with_reason(spark.createDataFrame(data, columns)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: "duplicado", 3: "fuera_de_rango", 4: "duplicado", 5: "fecha_invalida", 6: None, 7: "geo_cero", 8: "geo_fuera", 9: "geo_faltante"}
    assert got[8][1] == "<NA>-<NA>" and got[6][2] == "swapped"


def test_panel(spark):
    days = [("a", D0 + dt.timedelta(i), i + 1) for i in (0, 1, 2, 5)] + [("b", D0, 100)]
    base = spark.createDataFrame(days, "zona_id string, fecha date, reclamos_count bigint")
    full = panel.completed(base)
    out = {(r.zona_id, r.fecha): r for r in panel.supervised(full, ["reclamos_count"]).collect()}
    assert len(out) == 7
    last = out["a", D0 + dt.timedelta(5)]
    assert last.reclamos_count_lag_1 == 0 and last.reclamos_count_roll_7_mean == 6 / 5 and last.y_reclamos_count_t1 is None and not last.target_available_t1
    assert out["b", D0].reclamos_count_roll_7_mean is None  # nothing of zone a
    literal = {(r.zona_id, r.fecha): r.media_literal for r in panel.literal_rolling(full).collect()}
    assert literal["b", D0] is not None  # the literal form runs on across zones
    assert full.where("not has_claims").count() == 2


def test_medians(spark):
    rng = random.Random(3)
    data = [(z, D0 + dt.timedelta(i), float(rng.randrange(30)) if rng.random() > 0.1 else None) for z in "abc" for i in range(80)]
    df = spark.createDataFrame(data, "z string, d date, v double")

    def brute(history, least):
        h = [v for v in history if v is not None]
        return statistics.median(h) if len(h) >= least else None

    own = {(z, d): brute([v for a, b, v in data if a == z and b < d], 7) for z, d, _ in data}
    assert {(r.z, r.d): r.m for r in windows.online_median(df, ["z"], ["d"], "v", 7, "m").collect()} == own
    assert {(r.z, r.d): r.m for r in windows.online_median_sorted(df, "z", "d", "v", 7, "m").collect()} == own
    assert {r.d: r.m for r in windows.past_median(df, "d", "v", 30, "m", buckets=7).collect()} == {d: brute([v for _, b, v in data if b < d], 30) for _, d, _ in data}
    assert windows.past_median(df.limit(0), "d", "v", 30, "m").count() == 0


@pytest.mark.parametrize("n", [4, 5, 43])
def test_quartile_edges(spark, n):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id int, v double")
    got = [r.cuartil for r in ranking.rank_groups(df, "v", "id").orderBy("id").collect()]
    assert got == [sum(i + 1 > 1 + (n - 1) * k / 4 for k in (1, 2, 3)) + 1 for i in range(n)]


def test_ordered(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(40)) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, v int")
    total, want = 0, {}
    for n, (v, i) in enumerate(sorted((v, i) for i, v in data), 1):
        total += v
        want[i] = (n, total)
    got = ranking.ordered(df.repartition(6), [F.asc("v"), F.asc("id")], "n", {"t": "v"}).collect()
    assert {r.id: (r.n, r.t) for r in got} == want
    assert ranking.ordered(df.limit(0), [F.asc("v")]).count() == 0
    ranks = {r.id: r.rank_v for r in ranking.dense_ranks(df, ["v"]).collect()}
    assert ranks == {i: 40 - v for i, v in data}


def test_zones(spark):
    rng = random.Random(8)
    data = [(i, -29.5 + rng.uniform(0, 0.3), -56.5 + rng.uniform(0, 0.3), rng.randrange(50)) for i in range(300)] + [(999, None, 1.0, 5)]
    points = spark.createDataFrame(data, "destino_id bigint, lat double, lon double, peso bigint")
    placed = clusters.bounded_zones(points, 5.0)
    assert placed.count() == placed.select("destino_id").distinct().count() == 300
    # many points in few cells: the sequential step sees the cells
    crowd = points.where("lat is not null").crossJoin(spark.range(20)).select(F.expr("destino_id * 100 + id").alias("destino_id"), F.expr("lat + id * 1e-5").alias("lat"), "lon", "peso", F.lit("x").alias("tile"))
    thick = clusters.bounded_zones(crowd, 5.0)
    assert thick.count() == 6000 and clusters.zone_diameters(thick.join(crowd, "destino_id"), "zona").agg(F.max("diametro_km")).first()[0] <= 5.0
    spread = clusters.zone_diameters(placed.join(points, "destino_id"), "zona")
    assert spread.agg(F.max("diametro_km")).first()[0] <= 5.0 + 1e-9 and spread.agg(F.sum("puntos")).first()[0] == 300
    exact, swept = clusters.zone_diameters(points.withColumn("z", F.lit(1)), "z", 500).first(), clusters.zone_diameters(points.withColumn("z", F.lit(1)), "z", 10).first()
    assert 0.5 * exact.diametro_km <= swept.diametro_km <= exact.diametro_km + 1e-9


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.2), (1, 0.2)], "y int, s double")
    best = metrics.youden(df, "y", "s").first()
    assert best.umbral == 0.8 and best.tpr == pytest.approx(2 / 3)
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx((2 + 2 + 0.5) / 6)
    only = df.where("y = 1").withColumn("p", F.lit(1))
    assert metrics.confusion(only, "y", "p").first().especificidad is None
    flat = spark.createDataFrame([(0.0, 1.0)], "a double, p double").agg(*metrics.regression_scores("a", "p")).first()
    assert flat.wmape == 0.0 and flat.mae == 1.0
    pairs = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "t int, c int")
    assert metrics.prediction_strength(pairs, "t", "c").first().fuerza == pytest.approx(1 / 3)


def test_nearest(spark):
    rng = random.Random(2)
    data = [(i, [rng.random() for _ in range(4)]) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    got = {}
    for r in nearest(df.where("id % 20 = 0"), df, "id", "v", 3).collect():
        got.setdefault(r.consulta, []).append((r.puesto, r.vecino))
    known = {i: v for i, v in data if v}
    want = {q: sorted((sum((a - b) ** 2 for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)[:3] for q in known if q % 20 == 0}
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_nearest_among_ties_and_repeats(spark):
    data = [(i, [1.0, 0.0]) for i in range(1, 400)] + [(500, [0.0, 0.0]), (501, [0.5, 0.0]), (502, [1.0, 0.0])]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(3)
    got = [(r.puesto, r.vecino, r.dist) for r in nearest(df.where("id = 500"), df, "id", "v", 4).orderBy("puesto").collect()]
    assert got == [(1, 501, 0.5), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]
    labels = df.select(F.col("id").alias("vecino"), F.when(F.col("id") == 501, 7).otherwise(3).alias("voto"))
    near = nearest(df.where("id = 500"), df, "id", "v", 2)
    assert vote(near, labels).first().voto == 3 and vote(near, labels, 1 / F.col("dist")).first().voto == 7


def test_samples_and_encodings(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("c"))
    part = sampled(df, ["id"], 0.05)
    assert 120 < part.count() < 280 and sorted(part.collect()) == sorted(sampled(df.repartition(7), ["id"], 0.05).collect()) and sampled(df, ["id"], 1.0).count() == 4000
    coded = one_hot(df, "c")
    assert coded.columns == ["id", "c", "c_b"] and coded.where("c_b = 1").count() == 1333 and coded.where("c is null and c_b != 0").count() == 0
    flags = spark.createDataFrame([(" Yes",), ("no",), (None,)], "f string")
    assert [r.f for r in yes_no(flags, "f").collect()] == [1, 0, None]


def test_service_dimension(spark):
    claims = spark.createDataFrame([("r1", D0, "z", "agua"), ("r2", D0, "z", "luz")], "reclamo_id string, fecha date, zona_id string, servicio_normalizado string")
    days = spark.createDataFrame([(D0, "z")], "fecha date, zona_id string")
    assert explore.service_dimension(days, claims)[:2] == ("claims_proxy", "servicio") and explore.service_dimension(days, claims)[2].count() == 2
    assert explore.service_dimension(claims, least=2)[:2] == ("direct", "servicio_normalizado") and explore.service_dimension(claims)[0] == "none"
    assert explore.detect_column(days, explore.DATE_COLUMNS) == "fecha" and explore.detect_column(days, ["x"]) is None


def test_texts_and_numbers(spark):
    assert one(spark, S.title_case, "  casa   CENTRAL ") == "Casa Central"
    assert one(spark, S.number_or_error, " 2.5 ") == 2.5 and one(spark, S.number_or_error, None) is None
    with pytest.raises(Exception, match="not a number: x"):
        one(spark, S.number_or_error, "x")
    assert S.run_id(dt.datetime(2025, 1, 31, 23, 59, 59, tzinfo=dt.timezone.utc)) == "20250131T235959Z"


def test_batches_of_fetched_answers(spark, tmp_path):
    scope = spark.createDataFrame([(f"k{i}",) for i in range(7)], "k string")
    answer = lambda key: {"status": {"k3": "zero_results", "k4": "api_error"}.get(key["k"], "ok"), "valor": key["k"]}
    path = str(tmp_path / "cache")
    first = fetched.run_batches(scope, path, ["k"], answer, ["k"], batch_size=2, most_batches=2).collect()
    assert [(r.pedidos, r.motivo) for r in first] == [(2, "sigue"), (2, "sigue"), (0, "lotes_agotados")]
    second = fetched.run_batches(scope, path, ["k"], answer, ["k"], batch_size=5, retry_failed=True).collect()
    assert [(r.pedidos, r.ok, r.errores, r.motivo) for r in second] == [(3, 2, 1, "sigue"), (0, 0, 0, "sin_pendientes")]
    third = fetched.run_batches(scope, path, ["k"], lambda key: {"status": "denied", "valor": ""}, ["k"], retry_failed=True).collect()
    assert [(r.pedidos, r.motivo) for r in third] == [(1, "estado_fatal")]
    late = iter([0.0, 9e9, 9e9])
    assert fetched.run_batches(scope, str(tmp_path / "other"), ["k"], answer, ["k"], clock=lambda: next(late)).collect()[0].motivo == "tiempo_agotado"


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", D0), (1, "a", D0), (None, None, D0)], "n int, s string, f date")
    q = {r.columna: r for r in profiles.quality_profile(df).collect()}
    assert q["n"].ejemplos == "1 (2), <NA> (1)" and q["n"].nulos == 1 and q["n"].nulos_ratio == 0.3333 and q["s"].distintos == 1
    o = profiles.table_overview(df, "t", "f").first()
    assert (o.filas, o.repetidas, o.desde) == (3, 1, D0)
    assert profiles.quality_profile(df.limit(0)).first().nulos_ratio is None
    assert {r.valor for r in profiles.top_values(df, ["s"], 1).collect()} == {"a"}


def test_explore(spark):
    df = spark.createDataFrame([("z1", D0, True), ("z1", D0 + dt.timedelta(9), None), ("z2", D0, False)], "zona_id string, fecha date, llovio boolean")
    assert explore.filtered(df, rainy=False).count() == 2 and explore.filtered(df, since="2021-01-02").count() == 1
    assert explore.allowed_services(df, ["nada"], ["x"]).count() == 3 and explore.by_services(df, df, []).count() == 3


def test_sources_and_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), ["k", "nope"])
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t"), ["k"])
        sinks.append_history(df, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "h")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "k string, v int")) == [("a", 1), ("b", 2)]
    sinks.write_json_map(df, "k", "v", str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1, "b": 2}
    assert "| a | 1 |" in sinks.markdown_table(df.orderBy("k"), "T") and "first 1 rows" in sinks.markdown_table(df, "T", 1)
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"color": "red"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}))
    g = files.read_geojson(spark, str(tmp_path / "g.json")).first()
    assert g.propiedades == {"color": "red"} and json.loads(g.coordenadas) == [[1, 2], [3, 4]]
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / ".env").write_text("# c\nA=1\n\nbad\nB = 'x y'\n")
    assert files.read_settings(str(tmp_path / ".env")) == {"A": "1", "B": "x y"}
    inv = files.inventory(spark, {"t": str(tmp_path / "t"), "none": str(tmp_path / "zz")}).collect()
    assert [(r.nombre, r.existe) for r in inv] == [("none", False), ("t", True)]
    with pytest.raises(KeyError):
        files.require_input({}, "x")
    with pytest.raises(FileNotFoundError):
        files.require_input({"x": str(tmp_path / "zz")}, "x")


def test_fetching(spark, rows):
    scope = spark.createDataFrame([("s", str(i), i) for i in range(5)], "a string, b string, orden int")
    cache = spark.createDataFrame([("s", "0", "ok", "7", "2021"), ("s", "1", "api_error", None, "2021"), ("s", "2", "pending", None, None)], "a string, b string, status string, valor string, requested_at string")
    todo = fetched.pending(scope, cache, ["a", "b"])
    assert rows(todo, "b") == [("2",), ("3",), ("4",)] and fetched.pending(scope, cache, ["a", "b"], True).count() == 4

    def fake(key):
        if key["b"] == "3":
            raise RuntimeError("down")
        return {"status": "ok", "valor": int(key["b"]) * 2}

    got = fetched.fetch(todo, ["a", "b"], fake, ["orden"], 2, "2022")
    assert rows(got, "b", "status", "valor") == [("2", "ok", "4"), ("3", "request_error", "down")]
    assert fetched.refreshed(cache, got, ["a", "b"]).where("status = 'ok'").count() == 2


def test_streams_equal_batch(spark, tmp_path, rows):
    rng = random.Random(1)
    data = [(i, dt.datetime(2021, 1, 1) + dt.timedelta(hours=i), "xy"[i % 2], rng.random()) for i in range(200)]
    schema = "id bigint, ts timestamp_ntz, k string, v double"
    df = spark.createDataFrame(data, schema)
    df.repartitionByRange(3, "id").write.parquet(str(tmp_path / "e"))
    streamed = daily.replayed(spark, str(tmp_path / "e"), df.schema, "tesela_daily", lambda s: daily.daily_counts(s, "ts", "k", "v"))
    assert rows(streamed) == rows(daily.daily_counts(df, "ts", "k", "v"))
    medians = daily.replayed(spark, str(tmp_path / "e"), df.schema, "tesela_median", lambda s: daily.running_median(s.select("k", "v"), "k", "v"), mode="update")
    final = {r.k: r.mediana for r in medians.orderBy("n").collect()}
    assert final == {k: pytest.approx(statistics.median(v for _, _, a, v in data if a == k)) for k in "xy"}
