"""Orphan references against brute force."""

import datetime as dt
import random

from tesela.operators.orphans import orphan_counts, orphan_references, task_orphans

T0 = dt.datetime(2021, 1, 1)
REFS, PARENTS = "ref_id bigint, campo string, key string, at timestamp_ntz", "campo string, key string, loaded timestamp_ntz, deleted boolean"


def brute(refs, parents):
    owners = {}
    for campo, key, loaded, deleted in parents:
        if key is not None:
            owners.setdefault((campo, key), []).append((loaded, bool(deleted)))
    out = []
    for ref, campo, key, at in refs:
        own = owners.get((campo, key)) if key is not None else None
        loads = [x for x, _ in own or [] if x is not None]
        kind = "missing" if not own else "deleted" if any(d for _, d in own) else "late" if loads and at is not None and min(loads) > at else None
        if kind:
            out.append((ref, campo, kind, at.strftime("%Y-%m") if at else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    when = lambda: T0 + dt.timedelta(minutes=rng.randrange(400_000)) if rng.random() > 0.02 else None
    parents = [(c, str(rng.randrange(300)), when(), rng.random() < 0.1) for c in "xy" for _ in range(200)] + [("x", None, when(), True)]
    refs = [(i, rng.choice("xy"), "7" if rng.random() < 0.4 else str(rng.randrange(330)) if rng.random() > 0.03 else None, when()) for i in range(3000)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(refs, parents)


def test_boundaries_and_empty(spark):
    parents = [("x", "1", T0, False)]
    refs = [(1, "x", "1", T0), (2, "x", "1", T0 - dt.timedelta(seconds=1)), (2, "x", "1", T0 - dt.timedelta(seconds=1))]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    assert sorted(x.ref_id for x in orphan_references(r, p).collect()) == [2, 2]
    assert orphan_references(r.limit(0), p).count() == 0
    assert {x.clase for x in orphan_references(r, p.limit(0)).collect()} == {"missing"}


def test_spellings_of_keys(spark):
    names = ["1000649-1", "0001000649-01", " 1000649 - 1 ", "1000649/1", "1000649.0-1.0", "1000649–1", "<NA>-<NA>", "S/N", "", "0-0", "1000649", None]
    tasks = spark.createDataFrame([(i, n, t, T0, "clash") for i, (n, t) in enumerate(zip(names, ["10", "010", " 10", "10.0", "00010 ", "11", "x", None, None, None, None, None]))], "tarea_row_id bigint, reclamo_id string, tarea_id string, cargado_en timestamp_ntz, gone string")
    claims = spark.createDataFrame([("1000649-1", 1000649, 1, T0, None)], "reclamo_id string, numero_tramite bigint, numero_orden bigint, cargado_en timestamp_ntz, baja_en timestamp_ntz")
    kinds = spark.createDataFrame([(10, "a", T0, None), (11, "b", T0, T0)], "tarea_id bigint, tarea string, alta_en timestamp_ntz, baja_en timestamp_ntz")
    out = task_orphans(tasks, claims, kinds)
    got = sorted((r.tarea_row_id, r.campo, r.clase) for r in out.collect())
    assert got == sorted([(i, "reclamo_id", "missing") for i in (6, 7, 8, 9, 10)] + [(5, "tarea_id", "deleted"), (6, "tarea_id", "missing")])
    assert sum(r.referencias for r in orphan_counts(out).collect()) == 7
