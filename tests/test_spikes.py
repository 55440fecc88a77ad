"""Exact quantiles, runs and implausible readings against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesela import runtime
from tesela.operators import quantiles, spikes
from tesela.operators.quantiles import exact_quantile
from tesela.operators.runs import day_runs, equal_runs
from tesela.operators.spikes import peaks_over_threshold, rain_flags, rain_readings, route_answers, route_flags, tail_cutoffs, tail_readings


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(30_000) < 0.5, 0, rng.integers(0, 40, 30_000)), "v": np.round(rng.lognormal(size=30_000), 3), "_n": 1})
    got = exact_quantile(spark.createDataFrame(pdf), "k", "v", p, "q", accuracy=500).toPandas().set_index("k").q
    want = pdf.groupby("k").v.quantile(p)
    assert np.allclose(got.sort_index(), want.sort_index(), rtol=1e-12)


def test_exact_quantile_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0), (2, 5.0), (2, 5.0)], "k int, v double")
    assert [tuple(r) for r in exact_quantile(df, "k", "v", 0.5, "q").collect()] == [(2, 5.0)]
    assert exact_quantile(df.limit(0), "k", "v", 0.5, "q").count() == 0


def test_equal_runs(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("aab"), i * 10 if rng.random() > 0.02 else None, None if rng.random() < 0.02 else float(rng.randrange(2)), 1) for i in range(4000)]
    data += [(5000 + i, "c", i, 1.0, 1) for i in range(700)]
    df = spark.createDataFrame(data, "id int, k string, t bigint, v double, _part int")
    got = {r.id: r.run_length for r in equal_runs(df, "id", "k", "t", "v", chunks=8).collect()}
    want = {}
    for key in "abc":
        line = sorted((t, i, v) for i, k, t, v, _ in data if k == key and t is not None)
        start = 0
        while start < len(line):
            end = start + 1
            while end < len(line) and line[end][2] == line[start][2] and line[start][2] is not None:
                end += 1
            for _, i, v in line[start:end]:
                want[i] = 0 if v is None else end - start
            start = end
    assert got == want


def test_day_runs(spark):
    d = dt.date(2021, 2, 26)
    data = [("g", d + dt.timedelta(i), 2.5) for i in (0, 1, 1, 2, 3, 4, 6)] + [("g", None, 2.5), (None, d, 2.5), ("h", d, None)]
    got = {(r.k, r.d): r.run_length for r in day_runs(spark.createDataFrame(data, "k string, d date, v double"), "k", "d", "v").collect()}
    assert got == {("g", d + dt.timedelta(i)): 5 for i in range(5)} | {("g", d + dt.timedelta(6)): 1}


SHEETS = "row_idx bigint, pluviometro string, archivo string, `año_extraido` string, mes_extraido string, dia string, lluvia_mm string, observacion_codigo string, level double"


def test_rain(spark, rows):
    month = [(i, "P", "f", "2023", "Setiembre ", str(i), mm, None, 0.0) for i, mm in enumerate(["5,0", "4.0 mm", " 6", "5.5", "4.5", "5.1", "4.9"] * 3, 1)]
    odd = [(110, "P", "f", "2023", "octubre", "1", "31", None, 0.0), (111, "P", "f", "2023", "octubre", "2", "-0.4", None, 0.0), (112, "P", "f", "2023", "octubre", "3", "9999", None, 0.0), (113, "P", "f", "2023", "febrero", "30", "9999", None, 0.0), (114, "P", "f", "2023", "nada", "3", "9999", None, 0.0), (115, "P", "f", "2023", "octubre", "4", "ilegible", None, 0.0), (116, None, None, None, None, None, None, None, None), (117, None, "f", "2023", "octubre", "4", "-1", None, 0.0)]
    stuck = [(120 + i, "Q", "f", "2023", "Marzo", str(i + 1), "7.7", None, 0.0) for i in range(5)] + [(130, "Q", "f", "2023", "marzo", "3", "7,7", None, 0.0)] + [(140 + i, "R", "f", "2023", "Marzo", str(i + 1), "0.0", None, 0.0) for i in range(6)]
    sheets = spark.createDataFrame(month + odd + stuck, SHEETS)
    want = [(110, "spike"), (111, "impossible"), (112, "impossible"), (117, "impossible")] + [(120 + i, "stuck") for i in range(5)] + [(130, "stuck")]
    assert rows(rain_flags(rain_readings(sheets))) == sorted(want, key=lambda t: (str(t[0]), t[1]))
    assert rain_flags(rain_readings(sheets.limit(0))).count() == 0


ROUTES = "cache_row_id bigint, sede_id string, destino_key string, distance_m double, duration_s double, routing_status string, requested_at string"


def test_routes(spark, rows):
    t = lambda i: f"2025-01-15T{i // 60:02d}:{i % 60:02d}:00+00:00"
    good = [(i, "S", "d", 1000.0 * i, 100.0 * i + i % 3, "ok", t(i)) for i in range(1, 20)]
    odd = [(30, "S", "d", 1000.0, 401.0, "ok", t(31)), (31, "S", "d", 8000.0, 199.0, "ok", t(32)), (32, "S", "d", 1000.0, -1.0, "ok", t(33)), (33, "S", "d", 1000.0, float("nan"), "ok", t(34)), (34, "S", "d", 1000.0, 90000.0, "ok", t(35)), (35, "S", "d", 100000.0, 100.0, "ok", None), (36, "S", "d", 1000.0, 500.0, "pending", t(36)), (37, "S", "d", None, None, "ok", "?")]
    stuck = [(50 + i, "T", "d", 1000.0 + i, 120.0, "ok", t(i)) for i in range(5)] + [(60, "T", "d", 1000.0, 120.0, "ok", None)]
    df = spark.createDataFrame(good + odd + stuck, ROUTES)
    want = [(30, "spike"), (31, "spike"), (32, "impossible"), (33, "impossible"), (34, "impossible"), (35, "impossible"), (37, "impossible")] + [(50 + i, "stuck") for i in range(5)]
    assert rows(route_flags(route_answers(df))) == sorted(want, key=lambda t: (str(t[0]), t[1]))
    assert route_flags(route_answers(df.limit(0))).count() == 0


def test_peaks_hold_every_spike_whatever_the_season(spark):
    rng = np.random.default_rng(6)
    n = 4000
    season = rng.integers(1, 13, n)
    value = rng.lognormal(0, 1.2, n) * np.where(season < 4, 30.0, 1.0)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "s": "x", "m": season, "v": value}))
    out = peaks_over_threshold(df, "id", "s", "m", "v", 0.9, True).toPandas()
    level = np.quantile(value, 0.9)
    assert np.allclose(out.level, level)
    assert out[(out.v > 4 * level) | (out.v < level / 4)].is_peak.all()


def test_tail_cutoffs_are_passed_about_as_often_as_their_risk(spark):
    rng = np.random.default_rng(7)
    n, names = 40_000, np.array(["x", "y", "z"])
    source = rng.integers(0, 3, n)
    scale = np.array([0.1, 0.2, 0.1])[source]
    noise = np.where(source == 2, rng.laplace(0, 0.1, n), rng.normal(0, scale, n))
    df = spark.createDataFrame(pd.DataFrame({"fila": range(n), "fuente": names[source], "m": rng.integers(1, 5, n), "v": np.exp(noise) * (1 + source)}))
    readings = tail_readings(df, "m", "v", 0.5, True, risk=0.004)
    out = readings.where("fuera").toPandas()
    for name, size in zip(names, np.bincount(source)):
        own = out[out.fuente == name]
        for side in (own.residuo > 0, own.residuo < 0):
            assert 0.5 * 0.004 * size <= side.sum() <= 2 * 0.004 * size
    by = {r.fuente: r for r in tail_cutoffs(readings).collect()}
    assert {k: v.lecturas for k, v in by.items()} == dict(zip(names, np.bincount(source).tolist())) and all(v.picos >= v.fuera for v in by.values())


def season_readings(n=6000):
    """Readings whose level shifts with the season by more than the shift is allowed to take, with wrong ones among them."""
    rng = np.random.default_rng(9)
    source, season = rng.choice(list("abcde"), n, p=[0.5, 0.3, 0.15, 0.045, 0.005]), rng.integers(1, 13, n)
    value = np.round(rng.lognormal(1, 0.3, n) * np.where(season < 4, 6.0, 1.0) * rng.choice([1.0, 5.0, 0.1], n, p=[0.96, 0.02, 0.02]), 3)
    return pd.DataFrame({"fila": range(n), "fuente": source, "mes": season, "valor": value})


@pytest.mark.parametrize("times, two_sided", [(1.5, True), (4.0, False), (9.0, True)])
def test_candidates_lie_beyond_the_tail_cutoffs_and_hold_every_spike(spark, times, two_sided):
    pdf = season_readings()
    # a ratio beyond what a double holds, either way, and a source of a single reading
    far = pd.DataFrame({"fila": range(10_000, 10_043), "fuente": ["w"] * 21 + ["x"] * 21 + ["y"], "mes": 1, "valor": [1e200] * 20 + [1e-200] * 21 + [1e200, 3.0]})
    pdf = pd.concat([pdf, far])
    df = spark.createDataFrame(pdf)
    got = set(spikes.spike_candidates(df, "fila", "fuente", "mes", "valor", 0.9, two_sided, times).toPandas().fila)
    level = pdf.groupby("fuente").valor.transform(lambda v: v.quantile(0.9))
    assert got >= set(pdf[(pdf.valor > times * level) | (two_sided & (pdf.valor < level / times))].fila)
    if times >= 4:  # the cutoffs, held at what the season leaves of the multiple
        scored = peaks_over_threshold(df, "fila", "fuente", "mes", "valor", 0.9, two_sided, 0.05).toPandas()
        reach = np.log(times / 2) - 1e-8
        low = scored.residual < np.maximum(-reach, scored.tail_lower.astype(float)) if two_sided else False
        assert got == set(scored[(scored.residual > np.minimum(reach, scored.tail_upper)) | low].fila)
        assert got >= set(scored[scored.is_beyond].fila) and len(got) < len(pdf) / 2 and (scored.tail_upper < reach).any()


@pytest.mark.parametrize("small", [runtime.SMALL_TABLE_ROWS, 0])
def test_spikes_are_found_through_the_tail_cutoffs(spark, monkeypatch, small):
    monkeypatch.setattr(runtime, "SMALL_TABLE_ROWS", small)  # lookups by broadcast, and by a salted shuffle
    pdf = season_readings().assign(fecha=lambda x: pd.to_datetime("2020-01-01") + pd.to_timedelta(2 * x.fila, "D"), orden=lambda x: x.fila, hora=lambda x: x.mes, metros=1000.0, ritmo=lambda x: x.valor * 100 / 1000)
    rain = spark.createDataFrame(pdf[["fila", "fuente", "fecha", "mes", "valor"]]).withColumn("fecha", F.col("fecha").cast("date"))
    routes = spark.createDataFrame(pdf[["fila", "fuente", "orden", "hora", "metros", "ritmo"]].assign(valor=pdf.valor * 100))
    high, middle = (pdf.groupby("fuente").valor.transform(lambda v, p=p: v.quantile(p)) for p in (0.9, 0.5))
    over, off = set(pdf[pdf.valor > 4 * high].fila), set(pdf[((pdf.valor > 4 * middle) | (pdf.valor < middle / 4)) & (pdf.valor * 100 * 250 / 3600 >= 1)].fila)
    found = lambda flags: {r.fila for r in flags.where("clase = 'spike'").collect()}
    assert over and off and found(rain_flags(rain)) == over and found(route_flags(routes)) == off
    whole = spikes.peaks_over_threshold
    monkeypatch.setattr(spikes, "peaks_over_threshold", lambda *args, **kw: whole(*args, **kw).where("not is_peak"))
    assert not found(rain_flags(rain)) and not found(route_flags(routes))


def test_a_wide_bracket_is_narrowed(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "a", "b"], 60_000), "v": rng.normal(size=60_000)})
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 50)
    for values in (pdf, pdf.assign(v=pdf.v.round(1))):
        got = quantiles.exact_quantiles(spark.createDataFrame(values), "k", "v", {"q5": 0.5, "q9": 0.9}, accuracy=2000).toPandas().set_index("k").sort_index()
        want = values.groupby("k").v.quantile([0.5, 0.9]).unstack().sort_index()
        assert np.allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12)
