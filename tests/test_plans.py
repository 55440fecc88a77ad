"""Plans: what they read, and what they must not contain."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TESELA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(spark, name):
    # the whole column lists are needed
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>(?:,|\n|$)", text) for c in m.split(",")}


@pytest.mark.parametrize(
    "name,columns",
    [
        ("p1_found", {"row_idx", "canal", "dt_inicio", "fechainicio", "horainicio", "zona_horaria", "orden_fecha"}),
        ("p5_found", {"zona_id", "fecha", "cargado_en", "reclamos_count", "costo_total_compuesto_ars", "lluvia_mm"}),
        ("p6_found", {"reclamo_id", "fecha_reclamo", "lat", "lon"}),
        ("daily_summary", {"fecha", "zona_id", "distance_km", "traslado_min", "lluvia_mm"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    assert read_columns(plan(spark, name)) == columns


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "panel_supervised", "hotspots"])
def test_core_paths_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if re.match(r"p\d+_", n)])
def test_no_unbounded_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


@pytest.mark.parametrize("name", ["numeric_profile", "target_stats", "near_far", "resolution_median"])
def test_no_exact_percentile_in_one_aggregate(spark, name):
    assert not re.search(r"\bpercentile\(", plan(spark, name))


def test_no_window_gathers_a_table():
    # a window without partition is only let over one row per partition (row numbers) or per model
    root = Path(entry.__file__).parent / "tesela"
    found = [f"{p.name}: {line.strip()}" for p in root.rglob("*.py") for line in p.read_text().splitlines() if "Window.orderBy" in line]
    assert found == ['ranking.py: before = Window.orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1)']


def test_instants_do_not_shuffle_the_claims(spark):
    text = plan(spark, "p1_found")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(fecha,2022-01-01\)", plan(spark, "explore_filtered"))


def test_everything_else_works_without_the_text_operators():
    code = "import sys; sys.modules['tesela.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not [f for f in q.values() if f.__module__.startswith('tesela.llm')] and not [m for m in sys.modules if m.startswith('tesela.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from tesela.session import build_session
import __spark_entry__ as e
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
assert e.queries()["p6_found"](spark, {DATA!r}).count() > 0
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=environment, capture_output=True)
