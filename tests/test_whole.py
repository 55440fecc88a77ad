"""Queries over values, spellings and sizes that the smallest test data lacks."""

import datetime as dt
import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tesela.operators import clusters, metrics, panel
from tesela.operators.spikes import peaks_over_threshold

D0 = dt.date(2021, 1, 1)
DATA = os.environ.get("TESELA_TEST_DATA", "/root/testdata/sf0.001")


def stored(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_depot_pivot_counts_every_depot(spark, tmp_path):
    data = [("Z1", D0, f"SD{k:05d}") for k in range(1, 8) for _ in range(k)] + [(None, D0, "SD00009")]
    stored(spark, tmp_path, "reclamos_zonificados", data, "zona_id string, fecha date, sede_id string")
    got = entry.queries()["depot_pivot"](spark, str(tmp_path)).collect()
    assert [r.asDict() for r in got] == [{"zona_id": "Z1", "fecha": D0} | {f"reclamos_sd{k:05d}": k for k in range(1, 8)}]
    with pytest.raises(ValueError):
        panel.present_values(spark.createDataFrame(data, "z string, d date, s string"), "s", 7)


def test_tasks_orphans_reads_all_spellings(spark, tmp_path):
    names = ["1000649-1", "0001000649-01", " 1000649 - 1 ", "1000649/1", "1000649.0-1.0", "1000649–1", "<NA>-<NA>", "S/N", "", None, "1000649", "1000649-2", "1000649-1"]
    days = ["2021-02-09"] * 12 + ["09/02/2021"]
    stored(spark, tmp_path, "tramites_tareas", [(i, n, f) for i, (n, f) in enumerate(zip(names, days))], "tarea_row_id bigint, reclamo_id string, fecha string")
    stored(spark, tmp_path, "reclamos_clean", [("1000649-1",), ("1000649-1",), ("<NA>-<NA>",)], "reclamo_id string")
    got = entry.queries()["tasks_orphans"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, "huerfana") for i in range(6, 12)] + [(12, "fecha_invalida")]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_tasks_orphans_against_numbers_in_sql(spark):
    """The numbers are compared with those of the claims, not with the texts of their ids."""
    tasks, claims = f"'{DATA}/tramites_tareas.parquet'", f"'{DATA}/reclamos_clean.parquet'"
    want = duckdb.sql(
        f"with t as (select tarea_row_id, try_strptime(fecha, '%Y-%m-%d') as f, string_split(regexp_replace(reclamo_id, '[/_\u2010-\u2015\u2212]', '-', 'g'), '-') as p from {tasks}), "
        "n as (select tarea_row_id, f, case when len(p) = 2 then try_cast(trim(p[1]) as decimal(18,1)) end as a, case when len(p) = 2 then try_cast(trim(p[2]) as decimal(18,1)) end as b from t) "
        f"select tarea_row_id, case when f is null then 'fecha_invalida' else 'huerfana' end from n where f is null or not exists (select 1 from {claims} c where c.numero_tramite = n.a and c.numero_orden = n.b)"
    ).fetchall()
    assert sorted(map(tuple, entry.queries()["tasks_orphans"](spark, DATA).collect())) == sorted(want)


def test_exploration_totals_take_every_zone_and_day(spark, tmp_path):
    data = [(f"Z{z:02d}-0001", D0 + dt.timedelta(400 * k), z + k, k % 2 == 0) for z in range(5) for k in range(4)] + [("Z09-0001", D0, None, None)]
    stored(spark, tmp_path, "zona_diario_base", data, "zona_id string, fecha date, reclamos_count bigint, llovio boolean")
    q = entry.queries()
    assert tuple(q["explore_kpis"](spark, str(tmp_path)).first()) == (21, 6, 70)
    got = q["metric_by_date"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(D0 + dt.timedelta(400 * k), 10 + 5 * k) for k in range(4)]


def test_zone_diameters_are_exact_at_every_size(spark):
    rng = random.Random(3)
    shapes = {
        "triangle": [(-29 + 0.02 * k, -56.0) for k in (0, 1)] + [(-28.99, -55.98)] + [(-28.99 + rng.uniform(-1e-3, 1e-3), -55.995 + rng.uniform(-1e-3, 1e-3)) for _ in range(400)],
        "square": [(-29 + rng.uniform(0, 0.05), -56 + rng.uniform(0, 0.05)) for _ in range(600)],
        "date line": [(10 + rng.uniform(-3, 3), (179 + rng.uniform(0, 4) + 180) % 360 - 180) for _ in range(400)],
        "globe": [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(300)],
        "one place": [(-29.0, -56.0)] * 300,
        "line": [(0.0, 0.001 * k) for k in range(300)],
        "few": [(-29.0, -56.0), (-29.01, -56.0)],
    }
    data = [(z, i, la, lo) for z, at in shapes.items() for i, (la, lo) in enumerate(at)]
    points = spark.createDataFrame(data, "zona string, destino_id bigint, lat double, lon double").repartition(5)
    got = {r.zona: (r.puntos, r.diametro_km) for r in clusters.zone_diameters(points, "zona").collect()}
    for z, at in shapes.items():
        la, lo = np.array(at).T
        want = max(float(clusters._km(la, lo, a, o).max()) for a, o in at)
        assert got[z] == (len(at), pytest.approx(want, rel=1e-9, abs=1e-9)), z


def test_peak_thresholds_are_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    value = rng.lognormal(0, 0.3, 30_000)
    df = spark.createDataFrame([(i, "x", 1, float(v)) for i, v in enumerate(value)], "id int, s string, m int, v double")
    row = peaks_over_threshold(df, "id", "s", "m", "v", 0.5, True).select("lower", "upper").first()
    residual = np.log(value / np.median(value))
    assert [row.lower, row.upper] == pytest.approx(np.quantile(residual, [0.1, 0.9]).tolist(), abs=2e-9)  # residuals are kept at nine decimals


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_quality_profile_takes_every_column(spark):
    columns = spark.read.parquet(f"{DATA}/reclamos_zonificados.parquet").columns
    assert sorted(r.columna for r in entry.queries()["quality_profile"](spark, DATA).collect()) == sorted(columns)


def test_silhouette_euclidean(spark):
    rng = np.random.default_rng(4)
    x, own = rng.normal(size=(60, 3)), [i % 3 for i in range(59)] + [7]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i, c in enumerate(own):
        mean = {k: d[i, [j for j in range(60) if own[j] == k and j != i]].mean() for k in set(own) if k != c or own.count(c) > 1}
        b = min(v for k, v in mean.items() if k != c)
        want[i] = (b - mean[c]) / max(mean[c], b) if c in mean else 0.0
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, own))], "id bigint, v array<double>, c int")
    got = {r.id: r.silueta for r in metrics.silhouette_euclidean(df, "id", "v", "c", 16).collect()}
    assert got == pytest.approx(want)
