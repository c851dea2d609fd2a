from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from strandwork.operators.timestamps import normalise_timestamps

SCHEMA = "id int, value string, zone string, locale string"
UTC = dt.timezone.utc


def us(*parts: int, zone: str = "UTC", fold: int = 0) -> int:
    t = dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("2024-07-13T07:45:21Z", "Asia/Tokyo", None, us(2024, 7, 13, 7, 45, 21)),
    (" 2024-07-13 ", "Asia/Tokyo", None, us(2024, 7, 13)),
    ("2024/7/3", None, None, us(2024, 7, 3)),
    ("2023-11-12 20:36:55 +0530", None, None, us(2023, 11, 12, 15, 6, 55)),
    ("2022-04-15T01:10:03.431005999Z", None, None, us(2022, 4, 15, 1, 10, 3, 431005)),
    ("2023-02-01T20:26:38,710Z", None, None, us(2023, 2, 1, 20, 26, 38, 710000)),
    ("2019-11-03T01:57:37", "America/New_York", None, us(2019, 11, 3, 1, 57, 37, zone="America/New_York")),
    ("2021-03-28 01:30", "Europe/London", None, us(2021, 3, 28, 1, 30)),
    ("2021-03-28 01:30", "Nowhere/Land", None, us(2021, 3, 28, 1, 30)),
    ("20211219T172933Z", None, None, us(2021, 12, 19, 17, 29, 33)),
    ("20211219172933", "Asia/Tokyo", None, us(2021, 12, 19, 8, 29, 33)),
    ("202112191729", None, None, us(2021, 12, 19, 17, 29)),
    ("20211219", "Asia/Tokyo", None, us(2021, 12, 19)),
    ("1731108795", None, None, 1731108795_000000),
    ("1627011389321", "Asia/Tokyo", None, 1627011389_321000),
    ("45593", None, None, us(2024, 10, 28)),
    ("Sat, 10 Aug 2024 21:58:55 +0900", None, None, us(2024, 8, 10, 12, 58, 55)),
    ("Fri Jan 16 00:25:06 2026 +0100", None, None, us(2026, 1, 15, 23, 25, 6)),
    ("November 23, 2022 12:07 AM EST", None, None, us(2022, 11, 23, 5, 7)),
    ("November 23, 2022 12:07 PM CEST", None, None, us(2022, 11, 23, 10, 7)),
    ("22-Nov-25", None, None, us(2025, 11, 22)),
    ("03/04/2024", None, "en-US", us(2024, 3, 4)),
    ("03/04/2024", None, "en-GB", us(2024, 4, 3)),
    ("3.4.2024", None, "de-DE", us(2024, 4, 3)),
    ("2024-02-30", None, None, None),
    ("2024-13-01", None, None, None),
    ("13/13/2024", None, "en-GB", None),
    ("2024-05", None, None, None),
    ("2024", None, None, None),
    ("20241345193502", None, None, None),
    ("00000000000000", None, None, None),
    ("not available", None, None, None),
    ("", None, None, None),
    ("  ", None, None, None),
    (None, "Asia/Tokyo", "en-US", None),
    ("9" * 100_000, None, None, None),
    ("2024-01-01 " * 20_000, None, None, None),
    ("Mon " * 50_000, None, None, None),
    ("2024-01-01T10:00:00 QQQ", None, None, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, z, loc) for i, (v, z, loc, _) in enumerate(CASES)], SCHEMA)
    got = {r["id"]: r["utc_us"] for r in normalise_timestamps(df, "value", "zone", "locale").collect()}
    assert {i: got[i] for i in got} == {i: c[3] for i, c in enumerate(CASES)}


@pytest.mark.parametrize(("ambiguous", "fold"), [("first", 0), ("last", 1)])
def test_hour_that_occurs_twice(spark, ambiguous, fold):
    df = spark.createDataFrame([(1, "2021-10-31 01:30:00", "Europe/London", None)], SCHEMA)
    r = normalise_timestamps(df, "value", "zone", status="how", ambiguous=ambiguous).first()
    assert (r["utc_us"], r["how"]) == (us(2021, 10, 31, 1, 30, zone="Europe/London", fold=fold), "ambiguous")


def test_policies_of_missing_hours(spark):
    df = spark.createDataFrame([(1, "2021-03-28 01:30:00", "Europe/London", None)], SCHEMA)
    one = lambda **k: normalise_timestamps(df, "value", "zone", **k).first()["utc_us"]
    assert one() == us(2021, 3, 28, 1, 30)
    assert one(nonexistent="after") == us(2021, 3, 28, 0, 30)
    assert one(nonexistent="null") is None
    with pytest.raises(ValueError):
        one(nonexistent="later")


def test_local_times_as_the_standard_library_reads_them(spark):
    zones = ("Europe/Berlin", "America/Los_Angeles", "Australia/Sydney", "Asia/Kolkata")
    times = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * k, minutes=13) for k in range(1500)]
    rows = [(i, t.strftime("%Y-%m-%d %H:%M:%S"), zones[i % 4], None) for i, t in enumerate(times)]
    got = {r["id"]: r["utc_us"] for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "value", "zone").collect()}
    assert got == {i: us(*t.timetuple()[:6], zone=zones[i % 4]) for i, t in enumerate(times)}


def test_repeated_rows_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([("2024-01-01", "x", "y"), ("2024-01-01", "x", "y")], "value string, utc_us string, __tsv string")
    out = normalise_timestamps(df, "value")
    assert out.columns == ["value", "__tsv", "utc_us"] and [r["utc_us"] for r in out.collect()] == [us(2024, 1, 1)] * 2
    assert normalise_timestamps(df.limit(0), "value").count() == 0


def test_the_session_zone_does_not_matter(spark):
    df = spark.createDataFrame([(i, v, z, loc) for i, (v, z, loc, _) in enumerate(CASES)], SCHEMA)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["id"]: r["utc_us"] for r in normalise_timestamps(df, "value", "zone", "locale").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: c[3] for i, c in enumerate(CASES)}
