"""Groups against union-find."""

import math
import random

import pytest

from tesela.llm import groups
from tesela.llm.groups import grow_clusters, looped, low_diameter_groups, territorial_groups


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def shapes():
    rng = random.Random(1)
    yield "pairs", [(2 * i, 2 * i + 1) for i in range(200)]
    yield "chain", [(i, i + 1) for i in range(400)]
    yield "star", [(0, i) for i in range(1, 400)]
    yield "random", [(rng.randrange(600), rng.randrange(600)) for _ in range(500)]
    yield "dirty", [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)]
    yield "nothing", [(1, 1), (None, None)]


@pytest.mark.parametrize("hot", [1_000_000, 5])
@pytest.mark.parametrize("name,edges", list(shapes()))
def test_components(spark, monkeypatch, name, edges, hot):
    monkeypatch.setattr(groups, "HOT_LINKS", hot)
    got = {}
    for r in low_diameter_groups(spark.createDataFrame([(a, b, 1) for a, b in edges], "a bigint, b bigint, label int")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(v) for v in got.values()} == components(edges)


def test_the_share_of_cut_edges_falls_with_beta(spark):
    side = 25
    at = lambda i, j: i * side + j
    edges = [(at(i, j), at(i + 1, j)) for i in range(side - 1) for j in range(side)] + [(at(i, j), at(i, j + 1)) for i in range(side) for j in range(side - 1)]
    links = looped(spark.createDataFrame(edges, "a bigint, b bigint"))
    shares = []
    for beta in (0.1, 0.4, 1.6):
        label = {r.node: r.label for r in grow_clusters(links, beta).collect()}
        assert len(label) == side * side and all(label[x] == x for x in set(label.values()))
        shares.append(sum(label[a] != label[b] for a, b in edges) / len(edges))
        assert shares[-1] <= 1.2 * (1 - math.exp(-beta)) + 0.02
        assert len(components([(a, b) for a, b in edges if label[a] == label[b]])) == len({x for x in label.values() if sum(v == x for v in label.values()) > 1})
    assert shares[0] < shares[1] < shares[2]


def test_territorial(spark):
    zones = spark.createDataFrame([(10, 9), (9, 9), (9, 9), (8, None), (7, 999), (100, 7), (None, 7)], "destino_id bigint, cluster_root bigint")
    pairs = spark.createDataFrame([(8, 10, " MATCH "), (8, 7, "no_match"), (8, 555, "match"), (555, 7, "match"), (8, 8, "match"), (7, 100, None)], "destino_a bigint, destino_b bigint, decision string")
    zoned = spark.createDataFrame([("c1", "Z3"), ("c1", "Z2"), ("c1", "Z2"), ("c2", "Z2"), ("c2", "Z10"), ("c3", "Z5"), ("c4", None), (None, "Z6"), (None, "Z7")], "reclamo_id string, zona_id string")
    got = {tuple(r) for r in territorial_groups(zones, pairs, zoned).collect()}
    want = {("destino", x, "8") for x in ("8", "9", "10")} | {("destino", "7", "7"), ("destino", "100", "7")}
    want |= {("zona", z, "Z10") for z in ("Z10", "Z2", "Z3")} | {("zona", z, z) for z in ("Z5", "Z6", "Z7")}
    assert got == want
    assert territorial_groups(zones.limit(0), pairs.limit(0), zoned.limit(0)).count() == 0
