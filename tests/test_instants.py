import datetime as dt

import pytest

from pitlake.operators.instants import instants, offset_intervals

FEEDS = [("ny", "America/New_York", False), ("ldn", "Europe/London", True), ("utc", "UTC", False), ("syd", "Australia/Sydney", True), ("bad", "Nowhere/Else", None), (None, "UTC", False)]
SCHEMA = "feed string, tz_name string, day_first boolean"


def us(*a, **k):
    return int((dt.datetime(*a, tzinfo=dt.UTC, **k) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("2020-01-02T03:04:05Z", "ny", us(2020, 1, 2, 3, 4, 5)),
    ("2020-01-02T03:04:05.123456789Z", "ny", us(2020, 1, 2, 3, 4, 5, 123456)),
    (" 2020-01-02 03:04 ", "ny", us(2020, 1, 2, 8, 4)),
    ("2020-07-02 03:04:05,7", "ny", us(2020, 7, 2, 7, 4, 5, 700000)),
    ("2020-07-02 03:04+05:30", "ny", us(2020, 7, 1, 21, 34)),
    ("2020-07-02 03:04:05.250 -0400", "utc", us(2020, 7, 2, 7, 4, 5, 250000)),
    ("2020-07-02T03:04:05+09:00[Asia/Tokyo]", "utc", us(2020, 7, 1, 18, 4, 5)),
    ("2020-07-02T03:04:05[America/Chicago]", "utc", us(2020, 7, 2, 8, 4, 5)),
    ("2020-07-02 03:04:05 Asia/Kolkata", "utc", us(2020, 7, 1, 21, 34, 5)),
    ("2020-07-02 03:04:05 Not/AZone", "utc", None),
    ("03/04/2020 1:02:03 PM", "ny", us(2020, 3, 4, 18, 2, 3)),
    ("03/04/2020 1:02:03 PM", "ldn", us(2020, 4, 3, 12, 2, 3)),
    ("12/31/2020 12:00:00 AM", "ny", us(2020, 12, 31, 5)),
    ("31/12/2020 13:00", "ny", None),
    ("31.12.2020, 23:59:59", "utc", us(2020, 12, 31, 23, 59, 59)),
    ("Fri, 01 Apr 2022 02:29:32 GMT", "ny", us(2022, 4, 1, 2, 29, 32)),
    ("Fri, 01 May 2020 02:19:10 +1000", "ny", us(2020, 4, 30, 16, 19, 10)),
    ("10 Apr 2018 15:24:38 CEST", "ny", us(2018, 4, 10, 13, 24, 38)),
    ("Apr 11, 2017 8:19 AM AEST", "ny", us(2017, 4, 10, 22, 19)),
    ("10 April 2021 06:37 UTC+9", "ny", us(2021, 4, 9, 21, 37)),
    ("9 April 2021 06:37 UTC-3", "ny", us(2021, 4, 9, 9, 37)),
    ("20200102030405", "utc", us(2020, 1, 2, 3, 4, 5)),
    ("20200102T030405Z", "ny", us(2020, 1, 2, 3, 4, 5)),
    ("1396476301.5541239", "ny", 1396476301554123),
    ("1396476301554.9", "ny", 1396476301554900),
    ("1396476301554123", "ny", 1396476301554123),
    ("139647630155", "utc", None),
    # twice: the first; skipped: the offset before
    ("2021-11-07 01:30:00", "ny", us(2021, 11, 7, 5, 30)),
    ("2021-03-14 02:30:00", "ny", us(2021, 3, 14, 7, 30)),
    ("2021-10-31 01:30:00", "ldn", us(2021, 10, 31, 0, 30)),
    ("2021-10-03 02:30:00", "syd", us(2021, 10, 2, 16, 30)),
    ("1955-06-01 00:00:00", "utc", us(1955, 6, 1)),
    ("2150-07-01 00:00:00", "ny", us(2150, 7, 1, 4)), ("1890-01-01 00:00:00", "utc", us(1890, 1, 1)), ("1935-07-01 12:00:00", "ldn", us(1935, 7, 1, 11)),
    ("2400-03-12 01:59:59", "ny", us(2400, 3, 12, 6, 59, 59)), ("2400-03-12 03:00:00", "ny", us(2400, 3, 12, 7)), ("2101-07-01 00:00:00 Europe/Berlin", "utc", us(2101, 6, 30, 22)), ("9999-12-31 23:59:59 Asia/Tokyo", "utc", us(9999, 12, 31, 14, 59, 59)),
    ("1990-07-01 00:00:00 America/Argentina/Buenos_Aires", "utc", us(1990, 7, 1, 3)),
    ("2020-01-02T03:04:60Z", "utc", us(2020, 1, 2, 3, 5)),
    ("2020-02-30 00:00:00", "utc", None), ("0000-00-00 00:00:00", "utc", None), ("2023-13-41T25:61:00Z", "utc", None), ("2020-01-02 13:00 PM", "utc", None),
    ("2020-01-02", "utc", None), ("pending", "utc", None), ("T+1", "utc", None), ("", "utc", None), ("-", "utc", None), (None, "utc", None),
    ("2020-01-02 03:04:05", None, None), ("2020-01-02 03:04:05", "unheard", None), ("2020-01-02 03:04:05", "bad", None), ("2020-01-02 03:04:05Z", None, us(2020, 1, 2, 3, 4, 5)),
    ("x" * 200_000, "utc", None),
]


def test_cases(spark):
    feeds = spark.createDataFrame(FEEDS, SCHEMA)
    df = spark.createDataFrame([(i, t, f, "clash") for i, (t, f, _) in enumerate(CASES)], "i int, at string, feed string, tz_name string")
    rows = {r.i: r for r in instants(df, "at", feeds).collect()}
    assert len(rows) == len(CASES)
    for i, (text, _, want) in enumerate(CASES):
        assert rows[i].instant_us == want, (text and text[:60], rows[i].instant_us, want)
        assert rows[i].tz_name == "clash"  # further columns stay, clashing names too


def test_session_zone_makes_no_difference(spark):
    feeds = spark.createDataFrame(FEEDS, SCHEMA)
    df = spark.createDataFrame([("2021-03-14 02:30:00", "ny"), ("2150-07-01 00:00:00", "ny"), ("1396476301", "ny")], "at string, feed string")
    want = [r.instant_us for r in instants(df, "at", feeds).collect()]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r.instant_us for r in instants(df, "at", feeds).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_and_repeated(spark):
    feeds = spark.createDataFrame(FEEDS, SCHEMA)
    df = spark.createDataFrame([], "at string, feed string")
    assert instants(df, "at", feeds).count() == 0
    assert instants(df, "at", spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([("2020-01-02T03:04:05Z", "ny")] * 2, "at string, feed string")
    assert instants(twice, "at", feeds).count() == 2
    doubled = spark.createDataFrame(FEEDS * 2, SCHEMA)  # a repeated dimension doesn't multiply rows
    assert instants(twice, "at", doubled).count() == 2


def test_no_other_rules_than_the_intervals(spark):
    """Every zone, in the feeds or not, and every year goes through the join: the plan has no other conversion."""
    feeds = spark.createDataFrame(FEEDS, SCHEMA)
    plan = instants(spark.createDataFrame([("2020-01-02 03:04 Asia/Tokyo", "ny")], "at string, feed string"), "at", feeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_utc_timestamp" not in plan


@pytest.mark.parametrize("zone", ["Africa/Casablanca", "America/Toronto", "Antarctica/Troll", "Asia/Tehran", "Europe/Dublin"])
def test_intervals_agree_with_the_library(zone):
    import random
    import zoneinfo

    r, tz, spans = random.Random(zone), zoneinfo.ZoneInfo(zone), offset_intervals(zone)
    for _ in range(3000):
        at = dt.datetime(r.randrange(1900, 2101), r.randrange(1, 13), r.randrange(1, 29), r.randrange(24), r.randrange(60))
        sec = int((at - dt.datetime(1970, 1, 1)).total_seconds())
        hit = [o for s, e, o in spans if s <= sec < e]
        assert at.replace(tzinfo=tz).utcoffset().total_seconds() == (max(hit) if hit else max((e, o) for s, e, o in spans if e <= sec)[1]), at


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "UTC"])
def test_intervals_cover_time(zone):
    spans = offset_intervals(zone)
    for (_, end, off), (start, _, nxt) in zip(spans, spans[1:]):
        assert end - off == start - nxt  # in UTC they meet
        assert off != nxt
