"""Filling of rain cells: where from, against brute force; and how well, on held-out cells."""

import datetime as dt
import random

import numpy as np

from tesela.operators.filling import STATUSES, ChowLiu, fill_missing, fill_rain, filled_cells

SCHEMA = "row_id bigint, pluviometro string, cuenca string, fecha date, lluvia_mm double, observacion_codigo string, lluvia_status string, mm double"
D0 = dt.date(2021, 1, 1)


def test_where_from(spark):
    rng = random.Random(2)
    data = [(i, f"p{rng.randrange(4)}", "ab"[rng.randrange(2)], D0 + dt.timedelta(rng.randrange(60)), rng.choice([None, 0.0, 3.5, 900.0, -1.0, float("nan")]), None, rng.choice([None, "observed", " OBSERVED ", "-", "missing_source"]), 1.0) for i in range(150)]
    data += [(900, None, "a", D0, None, None, None, 1.0), (901, "p1", None, D0 + dt.timedelta(300), None, None, None, 1.0), (902, "p1", "a", None, None, None, None, 1.0)]
    mm = lambda v: v is not None and 0 <= v <= 500
    st = lambda s: s is not None and s.strip().lower() in STATUSES
    want = set()
    for i, p, c, f, v, _, s, _ in data:
        for campo, ok, k in (("lluvia_mm", mm, 4), ("lluvia_status", st, 6)):
            if ok(v if k == 4 else s):
                continue
            have = [r for r in data if ok(r[k]) and r[3] is not None and r[1] is not None]
            if f is None:
                continue
            if any(r[2] == c and c is not None and r[3] == f and r[1] != p for r in have):
                want.add((i, campo, "grupo"))
            elif any(r[1] == p and abs((r[3] - f).days) <= 3 for r in have):
                want.add((i, campo, "tiempo"))
    out = fill_rain(spark.createDataFrame(data, SCHEMA))
    got = {tuple(r) for r in filled_cells(out).collect()}
    # a row without a gauge has every gauge of its group as another one
    assert got == want
    assert out.count() == len(data)
    assert out.where("mm_via is not null and (mm_llena is null or mm_llena < 0 or mm_llena > 500)").count() == 0
    assert out.where(f"status_via is not null and status_llena not in {tuple(STATUSES)}").count() == 0
    assert fill_rain(spark.createDataFrame(data, SCHEMA).limit(0)).count() == 0


def test_posteriors_against_the_joint_of_the_tree():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, 3000)
    b = np.where(rng.random(3000) < 0.7, a, rng.integers(0, 3, 3000))
    c = np.where(rng.random(3000) < 0.6, b, rng.integers(0, 3, 3000))
    data = np.stack([a, b, c], 1)
    count = lambda i, j: [(i, j, x, y, int(((data[:, i] == x) & (data[:, j] == y)).sum())) for x in range(3) for y in range(3)]
    tree = ChowLiu([3, 3, 3], [r for i, j in ((0, 1), (0, 2), (1, 2)) for r in count(i, j)], [(i, x, int((data[:, i] == x).sum())) for i in range(3) for x in range(3)])
    assert tree.near == {0: [1], 1: [0, 2], 2: [1]}
    for row in ([-1, -1, -1], [-1, 1, -1], [-1, -1, 2], [2, 0, 1]):
        want = np.zeros(3)
        for x in range(3):
            for y in range(3):
                for z in range(3):
                    if row[1] in (-1, y) and row[2] in (-1, z):
                        want[x] += tree.own[0][x] * tree.joint[0, 1][x, y] / tree.joint[0, 1][x].sum() * tree.joint[1, 2][y, z] / tree.joint[1, 2][y].sum()
        assert np.allclose(tree.posterior(0, np.array([row]))[0], want / want.sum())


def test_other_fields_than_rain(spark):
    rng = random.Random(5)
    data, truth = [], {}
    for day in range(200):
        level, kind = rng.choice([2.0, 50.0]), rng.choice(["x", "y", "z"])
        for g in range(4):
            i, v = day * 4 + g, level + rng.random()
            gap, blank = rng.random() < 0.1, rng.random() < 0.1
            truth[i] = (v if gap else None, kind if blank else None)
            data.append((i, "g", f"s{g}", D0 + dt.timedelta(day), None if gap else v, None if blank else kind, None))
    df = spark.createDataFrame(data, "id bigint, zona string, sonda string, dia date, nivel double, clase string, own_nivel int")
    got = {r.id: r for r in fill_missing(df, "id", "zona", "sonda", "dia", {"nivel": [10.0]}, {"clase": ["x", "y", "z"]}).collect()}
    assert all(got[i].nivel_via == ("grupo" if v else None) and got[i].clase_via == ("grupo" if c else None) for i, (v, c) in truth.items())
    assert all(abs(got[i].nivel_llena - v) < 1 for i, (v, _) in truth.items() if v)
    right = [got[i].clase_llena == c for i, (_, c) in truth.items() if c]
    assert sum(right) / len(right) > 0.95


def test_fills_resemble_the_truth(spark):
    rng = random.Random(3)
    data, truth = [], {}
    for day in range(300):
        level = rng.choice([0.0, 0.0, 3.0, 15.0, 60.0])
        for g in range(5):
            i, v = day * 5 + g, round(level * rng.uniform(0.8, 1.2), 1)
            hidden = rng.random() < 0.1
            if hidden:
                truth[i] = v
            data.append((i, f"p{g}", "a", D0 + dt.timedelta(day), None if hidden else v, None, "observed", 0.0))
    got = {r.row_id: r.mm_llena for r in fill_rain(spark.createDataFrame(data, SCHEMA)).where("mm_via is not null").collect()}
    assert set(got) == set(truth)
    error = sum(abs(got[i] - v) for i, v in truth.items()) / len(truth)
    mean = sum(truth.values()) / len(truth)
    assert error < 0.25 * sum(abs(v - mean) for v in truth.values()) / len(truth)
