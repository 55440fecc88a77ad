"""Trailing totals against brute force."""

import datetime as dt
import random

from tesela.operators.rolling import zone_daily, zone_surges, zone_trailing

SCHEMA = "zona_id string, fecha date, reclamos_count bigint, costo_total_compuesto_ars double, lluvia_mm double, cargado_en timestamp_ntz, _first string"
D0, T0 = dt.date(2021, 1, 1), dt.datetime(2021, 1, 1)


def data(seed=1):
    rng = random.Random(seed)
    out = [(f"Z{rng.randrange(3)}", D0 + dt.timedelta(rng.randrange(120)), rng.choice([None, 0, 1, 5]), rng.choice([None, 0.0, 10.01, 3.07, float("nan")]), rng.choice([None, 0.1, 7.3]), T0 + dt.timedelta(rng.randrange(9)), "x") for _ in range(300)]
    return out + out[:20] + [(None, D0, 1, 1.0, 1.0, T0, "x"), ("Z9", None, 1, 1.0, 1.0, T0, "x"), ("solo", D0, 1, 1.0, 1.0, None, "x")]


def latest(rows):
    best = {}
    key = lambda v: tuple((x is not None, float("inf") if x != x else x) if x is not None else (False, 0) for x in v)
    for z, f, r, c, m, at, _ in rows:
        if z is not None and f is not None:
            v = (at, r, c, m)
            if (z, f) not in best or key((at.timestamp() if at else None, r, c, m)) > key((best[z, f][0].timestamp() if best[z, f][0] else None, *best[z, f][1:])):
                best[z, f] = v
    whole = lambda x, k: 0 if x is None or x != x else round(x * k)
    return {k: (whole(r, 1), whole(c, 100), whole(m, 10)) for k, (_, r, c, m) in best.items()}


def brute(rows):
    values = latest(rows)
    out = []
    for z in {z for z, _ in values}:
        days = [f for k, f in values if k == z]
        day = min(days)
        while day <= max(days):
            total = lambda n, i: sum(values.get((z, day - dt.timedelta(k)), (0, 0, 0))[i] for k in range(n))  # noqa: B023, E731
            out.append((z, day, (day - min(days)).days, [(total(7, i), total(30, i)) for i in range(3)]))
            day += dt.timedelta(1)
    return out


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.zona_id, r.fecha): r for r in zone_trailing(df).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for z, f, _, sums in want:
        r = got[z, f]
        for (a, b), name, k in zip(sums, ("reclamos_count", "costo_total_compuesto_ars", "lluvia_mm"), (1, 100, 10)):
            assert (r[f"{name}_total_7"], r[f"{name}_total_30"], r[f"{name}_media_30"]) == (a / k, b / k, b / k / 30)
    surges = {(r.zona_id, r.fecha, r.campo) for r in zone_surges(df).collect()}
    assert surges == {(z, str(f), name) for z, f, n, sums in want if n >= 29 for (a, b), name in zip(sums, ("reclamos_count", "costo_total_compuesto_ars", "lluvia_mm")) if 2 * a > b}


def test_versions_and_empty(spark):
    rows = [("Z", D0, 3, 1.0, 0.0, T0, "x"), ("Z", D0, 4, 2.0, 0.0, T0 + dt.timedelta(1), "x"), ("Z", D0, 9, 9.0, 9.0, None, "x"), ("Z", D0, 1, float("inf"), 0.0, T0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in zone_daily(df).collect()] == [("Z", D0, 4, 200, 0)]
    assert zone_trailing(df.limit(0)).count() == 0 and zone_surges(df.limit(0)).count() == 0
