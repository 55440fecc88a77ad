"""Close pairs, ear clipping, the hierarchy and containment against brute force."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest

from tesela.operators import proximity
from tesela.operators.proximity import Hierarchy, claims_nearby, close_pairs, containing_regions, ear_clip, usable_coordinates


def star(rng, n, cx=0.0, cy=0.0):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(round(cx + math.cos(a) * r, 6), round(cy + math.sin(a) * r, 6)) for a, r in ((a, rng.uniform(0.2, 1)) for a in angles)]


def area(ring):
    return abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))) / 2


def inside(ring, x, y):
    hit = False
    for i in range(len(ring)):
        (ax, ay), (bx, by) = ring[i - 1], ring[i]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


@pytest.mark.parametrize("seed", range(12))
def test_triangles_cover_the_ring_once(seed):
    rng = random.Random(seed)
    ring = star(rng, rng.randrange(3, 40))
    if seed % 2:
        ring.reverse()
    if seed % 3 == 0:
        ring.append(ring[0])
    triangles = ear_clip([p[0] for p in ring], [p[1] for p in ring])
    assert sum(area([t[:2], t[2:4], t[4:]]) for t in triangles) == pytest.approx(area(ring))
    boxes = np.array([(min(t[0::2]), min(t[1::2]), max(t[0::2]), max(t[1::2])) for t in triangles])
    tree = Hierarchy([(t[0::2], t[1::2]) for t in triangles], boxes, np.zeros(len(triangles), int))
    points = np.array([(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(500)])
    got = set(tree.containing(points[:, 0], points[:, 1])[0].tolist())
    assert got == {i for i, p in enumerate(points) if inside(ring, *p)}


def test_degenerate_rings_give_nothing():
    assert ear_clip([], []) == [] and ear_clip([0, 1], [0, 1]) == [] and ear_clip([0, 1, 2, 0], [0, 1, 2, 0]) == [] and ear_clip([0, None, float("nan")], [0, 1, 2]) == []
    assert len(ear_clip([0, 1, 1, 1, 0], [0, 0, 0, 1, 1])) == 2


RINGS = "distrito_id string, nombre string, vert_lat array<double>, vert_lon array<double>"


def square(name, y, x, side=1.0):
    return (name, name, [y, y, y + side, y + side, y], [x, x + side, x + side, x, x])


def test_containing_regions(spark, rows, monkeypatch):
    regions = spark.createDataFrame([square("a", 0.0, 0.0), square("b", 0.0, 1.0), square("c", 0.5, 0.5), (None, "n", [0.0, 0.0, 1.0], [0.0, 1.0, 1.0]), ("e", "e", None, None)], RINGS)
    points = spark.createDataFrame([("in", 0.25, 0.25), ("in", 0.25, 0.25), ("edge", 0.25, 1.0), ("both", 0.75, 0.75), ("out", 5.0, 5.0), (None, 0.2, 0.2), ("null", None, 0.2), ("nan", float("nan"), 0.2)], "id string, la double, lo double")
    want = [("both", "a"), ("both", "c"), ("edge", "a"), ("edge", "b"), ("in", "a")]
    find = lambda p, r: containing_regions(p, r, "id", "distrito_id", "la", "lo", "vert_lat", "vert_lon")
    assert sorted(rows(find(points, regions))) == want
    monkeypatch.setattr(proximity, "SHAPES_PER_BLOCK", 2)
    assert sorted(rows(find(points, regions))) == want
    assert find(points, regions.limit(0)).count() == 0 and find(points.limit(0), regions).count() == 0


def test_a_ring_that_crosses_itself_is_searched_whole(spark, rows):
    bow = ("bow", "n", [0.0, 2.0, 0.0, 2.0], [0.0, 2.0, 2.0, 0.0])
    points = spark.createDataFrame([("west", 1.0, 0.5), ("east", 1.0, 1.5), ("north", 1.5, 1.0), ("south", 0.5, 1.0), ("middle", 1.0, 1.0), ("rim", 0.0, 1.0), ("vertex", 2.0, 2.0)], "id string, la double, lo double")
    assert ear_clip([0.0, 2.0, 2.0, 0.0], [0.0, 2.0, 0.0, 2.0]) is None
    found = containing_regions(points, spark.createDataFrame([bow, square("a", 0.0, 0.0)], RINGS), "id", "distrito_id", "la", "lo", "vert_lat", "vert_lon")
    assert sorted(rows(found.where("distrito_id = 'bow'"))) == [(x, "bow") for x in ("east", "middle", "vertex", "west")]


def test_large_rings_are_clipped_in_reasonable_time():
    rng = random.Random(3)
    ring = star(rng, 3000)
    began = time.process_time()
    triangles = ear_clip([p[0] for p in ring], [p[1] for p in ring])
    assert sum(area([t[:2], t[2:4], t[4:]]) for t in triangles) == pytest.approx(area(ring))
    assert time.process_time() - began < 20


def metres(a, b):
    (la, lo), (lb, ob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


def test_close_pairs(spark, monkeypatch):
    rng = random.Random(5)
    data = [(f"r{i}", rng.choice("xy"), -29.5 + rng.uniform(0, 0.02), -56.5 + rng.uniform(0, 0.02)) for i in range(400)]
    data += data[:30] + [("r1", "x", -29.5, -56.5), (None, "x", -29.5, -56.5), ("q", None, -29.5, -56.5), ("q", "x", None, -56.5)]
    got = {tuple(r) for r in close_pairs(spark.createDataFrame(data, "id string, g string, la double, lo double"), "id", "g", "la", "lo", 100.0).collect()}
    known = {p for p in data if None not in p}
    monkeypatch.setattr(proximity, "CROWDED", 3)
    split = {tuple(r) for r in close_pairs(spark.createDataFrame(data, "id string, g string, la double, lo double"), "id", "g", "la", "lo", 100.0).collect()}
    assert split == got
    assert got == {(a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and metres(a[2:], b[2:]) <= 100}


def test_claims(spark, rows):
    t = dt.datetime(2021, 1, 1, 10)
    data = [("a", t, -29.5, -56.5, "p"), ("b", t + dt.timedelta(hours=5), -56.5, -29.5, "p"), ("c", t + dt.timedelta(days=1), -29.5, -56.5, "p"), ("d", t, 0.0, 0.0, "p"), ("e", None, -29.5, -56.5, "p"), ("f", t, None, None, "p")]
    claims = spark.createDataFrame(data, "reclamo_id string, fecha_reclamo timestamp_ntz, lat double, lon double, tipo string")
    districts = spark.createDataFrame([square("D", -30.0, -57.0)], RINGS)
    assert rows(claims_nearby(claims, districts)) == [("distrito", x, "D") for x in "abce"] + [("par", "a", "b")]
    assert usable_coordinates(claims).count() == 4
    assert claims_nearby(claims.limit(0), districts.limit(0)).count() == 0
