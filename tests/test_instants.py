"""UTC instants: spellings, zones, calendar checks, fallbacks, and zone rules against the standard library."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tesela.operators.instants import claim_instants, utc_seconds

SCHEMA = "id int, s string, d string, h string, orden string, zona string"


def at(*parts, zone="UTC"):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp())


BA, MADRID = "America/Argentina/Buenos_Aires", "Europe/Madrid"
CASES = [
    ("2021-03-04 05:06:07", "DMY", BA, at(2021, 3, 4, 5, 6, 7, zone=BA)),
    ("2021-03-04T05:06:07Z", "DMY", BA, at(2021, 3, 4, 5, 6, 7)),
    ("  2021-03-04 05:06:07.999999 ", "DMY", "UTC", at(2021, 3, 4, 5, 6, 7)),
    ("04/03/2021 05:06", "DMY", "UTC", at(2021, 3, 4, 5, 6)),
    ("04/03/2021 05:06", "MDY", "UTC", at(2021, 4, 3, 5, 6)),
    ("21/03/04 05:06", "YMD", "UTC", at(2021, 3, 4, 5, 6)),
    ("04/03/21 05:06", "DMY", "UTC", at(2021, 3, 4, 5, 6)),
    ("4-3-2021 5:06", "DMY", "UTC", at(2021, 3, 4, 5, 6)),
    ("04/03/2021 12:06 a. m.", "DMY", "UTC", at(2021, 3, 4, 0, 6)),
    ("04/03/2021 12:06 p. m.", "DMY", "UTC", at(2021, 3, 4, 12, 6)),
    ("03/04/2021 05:06 PM", "MDY", "UTC", at(2021, 3, 4, 17, 6)),
    ("04-MAR-2021 05:06:07", "DMY", "UTC", at(2021, 3, 4, 5, 6, 7)),
    ("4 de setiembre de 2021, 05:06 hs", "DMY", "UTC", at(2021, 9, 4, 5, 6)),
    ("Mar 4, 2021 05:06:07 GMT", "DMY", BA, at(2021, 3, 4, 5, 6, 7)),
    ("20210304T050607", "DMY", "UTC", at(2021, 3, 4, 5, 6, 7)),
    ("20210304 05:06", "DMY", "UTC", at(2021, 3, 4, 5, 6)),
    ("20210304050607", "DMY", "UTC", at(2021, 3, 4, 5, 6, 7)),
    ("1614834367", "DMY", BA, 1614834367),
    ("1614834367123", "DMY", BA, 1614834367),
    ("1614834367123456", "DMY", BA, 1614834367),
    ("2021-03-04T05:06:07-0300", "DMY", "UTC", at(2021, 3, 4, 8, 6, 7)),
    ("2021-03-04T05:06:07 +05:30", "DMY", "UTC", at(2021, 3, 3, 23, 36, 7)),
    ("2021-03-04T05:06:07-03:00[America/Asuncion]", "DMY", "UTC", at(2021, 3, 4, 8, 6, 7)),
    ("2021-07-04 05:06:07 europe/madrid", "DMY", "UTC", at(2021, 7, 4, 5, 6, 7, zone=MADRID)),
    ("2021-07-04 12:06:07 America/Argentina/Buenos_Aires", "DMY", "UTC", at(2021, 7, 4, 12, 6, 7, zone=BA)),
    ("2021-07-04 12:06 PM America/Asuncion", "DMY", "UTC", at(2021, 7, 4, 12, 6, zone="America/Asuncion")),
    ("2021-07-04 12:06 America/Asuncion", "DMY", MADRID, at(2021, 7, 4, 12, 6, zone="America/Asuncion")),
    ("2021-10-31 02:30", "DMY", MADRID, at(2021, 10, 31, 0, 30)),  # occurs twice: the earlier
    ("2021-03-28 02:30", "DMY", MADRID, at(2021, 3, 28, 1, 30)),  # skipped: the offset before
    ("31/02/2021 05:06", "DMY", "UTC", None),
    ("2021-13-04 05:06", "DMY", "UTC", None),
    ("2021-03-04 25:06", "DMY", "UTC", None),
    ("2021-03-04", "DMY", "UTC", None),
    ("0000-00-00 00:00:00", "DMY", "UTC", None),
    ("sin dato", "DMY", "UTC", None),
    ("", "DMY", "UTC", None),
    (None, "DMY", "UTC", None),
    ("x" * 100_000, "DMY", "UTC", None),
    ("2021-03-04 05:06", "DMY", "Nowhere/Atall", None),
    ("2021-03-04 05:06", "DMY", None, None),
    ("04/03/2021 05:06", None, "UTC", at(2021, 3, 4, 5, 6)),
]


def test_spellings(spark):
    df = spark.createDataFrame([(i, s, None, None, o, z) for i, (s, o, z, _) in enumerate(CASES)], SCHEMA)
    got = {r.id: r.utc_s for r in utc_seconds(df, "s", "d", "h", "orden", "zona").collect()}
    assert {i: (CASES[i][0], v) for i, v in got.items()} == {i: (c[0], c[3]) for i, c in enumerate(CASES)}


CLOCKS = [("2037", 20, 37), ("747", 7, 47), ("38", 0, 38), ("8", 0, 8), ("747.0", 7, 47), ("10:38", 10, 38), ("18:06:42", 18, 6), ("16.50 hs", 16, 50), ("1:27 PM", 13, 27), ("12:05 a. m.", 0, 5), ("99:99", 0, 0), ("2460", 0, 0), ("s/h", 0, 0), (" ", 0, 0), (None, 0, 0)]


@pytest.mark.parametrize("date", ["2021-03-04", "04/03/2021", "20210304", "2021-03-04 00:00:00"])
def test_date_and_clock(spark, date):
    df = spark.createDataFrame([(i, "s/f", date, h, "DMY", "UTC") for i, (h, _, _) in enumerate(CLOCKS)], SCHEMA)
    got = {r.id: r.utc_s - r.utc_s % 60 for r in utc_seconds(df, "s", "d", "h", "orden", "zona").collect()}
    assert got == {i: at(2021, 3, 4, h, m) for i, (_, h, m) in enumerate(CLOCKS)}


def test_zone_rules_agree_with_the_standard_library(spark):
    zones = [BA, "America/Asuncion", MADRID, "UTC"]
    want = [(f"{d:%Y-%m-%d} {h:02d}:30", z, int(dt.datetime(d.year, d.month, d.day, h, 30, tzinfo=ZoneInfo(z)).timestamp())) for z in zones for d in (dt.date(2016, 1, 1) + dt.timedelta(7 * k) for k in range(560)) for h in (0, 2, 23)]
    df = spark.createDataFrame([(i, s, None, None, "YMD", z) for i, (s, z, _) in enumerate(want)], SCHEMA)
    got = {r.id: r.utc_s for r in utc_seconds(df, "s", "d", "h", "orden", "zona").collect()}
    assert [i for i, w in enumerate(want) if got[i] != w[2]] == []


def test_claims(spark, rows):
    claims = spark.createDataFrame(
        [(1, "a", "04/03/2021 05:06", None, None, "x"), (1, "a", "04/03/2021 05:06", None, None, "x"), (2, "zz", "2021-03-04 05:06", None, None, "x"), (3, "zz", "2021-03-04T05:06Z", None, None, "x"), (4, None, None, None, None, None)],
        "row_idx bigint, canal string, dt_inicio string, fechainicio string, horainicio string, zona_horaria string",
    )
    channels = spark.createDataFrame([("a", "UTC", "DMY"), ("a", "UTC", "MDY"), (None, "UTC", "DMY")], "canal string, zona_horaria string, orden_fecha string")
    assert rows(claim_instants(claims, channels)) == [(1, at(2021, 3, 4, 5, 6)), (1, at(2021, 3, 4, 5, 6)), (3, at(2021, 3, 4, 5, 6))]
    assert claim_instants(claims.limit(0), channels.limit(0)).count() == 0


def test_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "2021-03-04T05:06Z", None, None, "DMY", "UTC", "keep", 7)], SCHEMA + ", _t_a string, utc_s int")
    out = utc_seconds(df, "s", "d", "h", "orden", "zona").collect()[0]
    assert out["_t_a"] == "keep" and out["utc_s"] == at(2021, 3, 4, 5, 6)
