"""Instants of timestamp texts, against Python's own zone rules and by hand."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tickloom.operators.timestamps import is_plain, normalize_timestamps
from pyspark.sql import functions as F

FEEDS = [("ber", "Europe/Berlin", "dmy"), ("nyc", "America/New_York", "mdy"), ("utc", "UTC", "ymd"), ("kol", "Asia/Kolkata", "dmy"), ("syd", "Australia/Sydney", "dmy"), ("two", "Europe/Berlin", "dmy"), ("two", "Asia/Tokyo", "dmy"), ("odd", "No/Where", "dmy"), ("par", "Europe/Paris", "dmy"), ("lax", "America/Los_Angeles", "mdy"), ("mos", "Europe/Moscow", "dmy"), (None, "UTC", "ymd")]


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("ber", "2024-01-15T10:00:00Z", us(2024, 1, 15, 10), "ok"),
    ("ber", " 2024-01-15t10:00:00z\t", us(2024, 1, 15, 10), "ok"),
    ("ber", " 2024-01-15T10:00:00Z﻿", us(2024, 1, 15, 10), "ok"),
    ("ber", "2024-01-15T10:00:00", us(2024, 1, 15, 9), "ok"),
    ("ber", "2024-07-15 10:00:00.5", us(2024, 7, 15, 8) + 500_000, "ok"),
    ("ber", "2024-07-15T10:00:00,123456789Z", us(2024, 7, 15, 10) + 123_456, "ok"),
    ("nyc", "2024-07-15T10:00:00+05:30", us(2024, 7, 15, 4, 30), "ok"),
    ("nyc", "2024-07-15 10:00:00 -0400", us(2024, 7, 15, 14), "ok"),
    ("nyc", "2024-07-15T10:00:00+02:00[Europe/Berlin]", us(2024, 7, 15, 8), "ok"),
    ("nyc", "2024-07-15T10:00:00[Europe/Berlin]", us(2024, 7, 15, 8), "ok"),
    ("nyc", "2024-07-15T10:00:00[Not/AZone]", -1, "invalid"),
    # clock changes
    ("ber", "2024-03-31T02:30:00", -1, "nonexistent"),
    ("ber", "2024-10-27T02:30:00", -1, "ambiguous"),
    ("ber", "2024-10-27T03:00:00", us(2024, 10, 27, 2), "ok"),
    ("ber", "2024-10-27T02:00:00", -1, "ambiguous"),
    ("ber", "2024-10-27T01:59:59", us(2024, 10, 26, 23, 59, 59), "ok"),
    ("syd", "2024-10-06 02:15:00", -1, "nonexistent"),
    ("ber", "2024-10-27 02:30:00 CEST", us(2024, 10, 27, 0, 30), "ok"),
    ("ber", "2024-10-27 02:30:00 CET", us(2024, 10, 27, 1, 30), "ok"),
    ("kol", "2024-10-27 02:30:00 IST", us(2024, 10, 26, 21), "ok"),
    ("ber", "2024-10-27 02:30:00 XYZ", -1, "invalid"),
    # abbreviations come from the rules of each zone, and may have meant several offsets
    ("par", "2024-01-15 10:00:00 CET", us(2024, 1, 15, 9), "ok"),
    ("par", "2024-07-15 10:00:00 CEST", us(2024, 7, 15, 8), "ok"),
    ("lax", "2024-01-15 10:00:00 PST", us(2024, 1, 15, 18), "ok"),
    ("lax", "2024-11-03 01:30:00 PDT", us(2024, 11, 3, 8, 30), "ok"),
    ("lax", "2024-01-15 10:00:00 CET", -1, "invalid"),
    ("mos", "2024-01-15 10:00:00 MSK", us(2024, 1, 15, 7), "ok"),
    ("mos", "2012-01-15 10:00:00 MSK", us(2012, 1, 15, 6), "ok"),
    ("mos", "2024-01-15 10:00:00 MSD", us(2024, 1, 15, 6), "ok"),
    ("mos", "2024-01-15 10:00:00 UTC", us(2024, 1, 15, 10), "ok"),
    ("ber", "86399999", -1, "invalid"),
    ("ber", "-1705276800", -1, "invalid"),
    # orders of day and month
    ("ber", "03.02.2024 04:05", us(2024, 2, 3, 3, 5), "ok"),
    ("nyc", "02/03/2024 04:05", us(2024, 2, 3, 9, 5), "ok"),
    ("nyc", "02/03/2024 12:05 AM", us(2024, 2, 3, 5, 5), "ok"),
    ("nyc", "02/03/2024 13:05 PM", -1, "invalid"),
    ("utc", "31/01/2024 04:05", us(2024, 1, 31, 4, 5), "ok"),
    ("utc", "02/03/2024 04:05", -1, "invalid"),
    ("ber", "Mon, 15 Jan 2024 10:00:00 +0100", us(2024, 1, 15, 9), "ok"),
    ("ber", "Tue, 15 Jan 2024 10:00:00 +0100", -1, "invalid"),
    ("ber", "5 Jan 2024 10:00:00", us(2024, 1, 5, 9), "ok"),
    ("nyc", "Jan 5, 2024 1:00:00 PM", us(2024, 1, 5, 18), "ok"),
    ("ber", "2024/01/05 10:00:00.000", us(2024, 1, 5, 9), "ok"),
    ("ber", "2024.01.05 10:00:00", us(2024, 1, 5, 9), "ok"),
    ("ber", "2024-01/05 10:00:00", -1, "invalid"),
    ("ber", "20240105T100000Z", us(2024, 1, 5, 10), "ok"),
    ("ber", "20240105100000", us(2024, 1, 5, 9), "ok"),
    ("ber", "20241305100000", -1, "invalid"),
    ("ber", "2024-01-05", us(2024, 1, 5), "ok"),
    # numbers
    ("ber", "1705276800", us(2024, 1, 15), "ok"),
    ("ber", "1705276800.25", us(2024, 1, 15) + 250_000, "ok"),
    ("ber", "1705276800123", us(2024, 1, 15) + 123_000, "ok"),
    ("ber", "1705276800123456", us(2024, 1, 15) + 123_456, "ok"),
    ("ber", "1705276800123456789", us(2024, 1, 15) + 123_456, "ok"),
    ("ber", "1970", -1, "invalid"),
    # ends of days and what is no time
    ("ber", "2024-01-15T24:00:00Z", us(2024, 1, 16), "ok"),
    ("ber", "2024-01-15T24:00:00", us(2024, 1, 15, 23), "ok"),
    ("ber", "2024-01-15T24:00:01Z", -1, "invalid"),
    ("ber", "2024-02-30T10:00:00Z", -1, "invalid"),
    ("ber", "2023-02-29T10:00:00Z", -1, "invalid"),
    ("ber", "2024-02-29T10:00:00Z", us(2024, 2, 29, 10), "ok"),
    ("ber", "2024-01-15T10:00:60Z", -1, "invalid"),
    ("ber", "0000-00-00 00:00:00", -1, "invalid"),
    ("ber", "pending", -1, "invalid"),
    ("ber", "", -1, "invalid"),
    ("ber", "x" * 100_000, -1, "invalid"),
    ("ber", None, None, "null"),
    # sources without a zone
    ("two", "2024-01-15T10:00:00", -1, "invalid"),
    ("odd", "2024-01-15T10:00:00", -1, "invalid"),
    ("gone", "2024-01-15T10:00:00", -1, "invalid"),
    (None, "2024-01-15T10:00:00", -1, "invalid"),
    ("gone", "2024-01-15T10:00:00Z", us(2024, 1, 15, 10), "ok"),
]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame(FEEDS, "exchange string, zone string, day_order string")


def test_cases(spark, feeds):
    df = spark.createDataFrame([(i, e, t) for i, (e, t, *_) in enumerate(CASES)], "i int, exchange string, timestamp string")
    got = {r.i: (r.ts_us, r.ts_status) for r in normalize_timestamps(df, feeds).collect()}
    wrong = [(CASES[i], g) for i, g in got.items() if g != CASES[i][2:]]
    assert not wrong and len(got) == len(CASES)


def test_every_half_hour_of_a_year(spark, feeds):
    """All wall times around all clock changes, as Python's zones have them."""
    rows, want = [], {}
    for e, z in (("ber", "Europe/Berlin"), ("nyc", "America/New_York"), ("syd", "Australia/Sydney")):
        zone = ZoneInfo(z)
        for k in range(0, 2 * 24 * 366):
            w = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * k)
            if w.weekday() < 5 and w.day != 1:
                continue
            us_ = {u for f in (0, 1) if (u := w.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc)).astimezone(zone).replace(tzinfo=None) == w}
            i = len(rows)
            rows.append((i, e, w.isoformat()))
            want[i] = int(us_.pop().timestamp()) * 1_000_000 if len(us_) == 1 else -1
    df = spark.createDataFrame(rows, "i int, exchange string, timestamp string")
    got = {r.i: r.ts_us for r in normalize_timestamps(df, feeds).collect()}
    assert got == want


def test_names_that_clash_and_filters_on_the_result(spark, feeds):
    df = spark.createDataFrame([("ber", "2024-01-15T10:00:00", "old", 7, "x")], "exchange string, timestamp string, ts_us string, zone int, day_order string")
    out = normalize_timestamps(df, feeds).where((F.col("ts_us") > 0) & (F.col("zone") == 7))
    assert [r.asDict() for r in out.collect()] == [{"exchange": "ber", "timestamp": "2024-01-15T10:00:00", "zone": 7, "day_order": "x", "ts_us": us(2024, 1, 15, 9), "ts_status": "ok"}]


def test_empty(spark, feeds):
    df = spark.createDataFrame([], "exchange string, timestamp string")
    assert normalize_timestamps(df, feeds).count() == 0
    one = spark.createDataFrame([("ber", "2024-01-15T10:00:00"), ("ber", "2024-01-15T10:00:00Z")], "exchange string, timestamp string")
    assert [r.ts_us for r in normalize_timestamps(one, feeds.limit(0)).collect()] == [-1, us(2024, 1, 15, 10)]


def test_plain(spark):
    df = spark.createDataFrame([("2024-01-15T10:00:00Z",), ("2024-01-15T24:00:00Z",), ("2024-02-30T10:00:00Z",), (" 2024-01-15T10:00:00Z",), (None,)], "t string")
    assert [r[0] for r in df.select(is_plain(F.col("t"))).collect()] == [True, False, False, False, False]
