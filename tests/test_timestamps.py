"""Problem 4 in small: forms, zones, changes of the clock, and rows that denote nothing."""

import datetime as dt

import pytest

from tidemark.operators import timestamps as ts

UTC = dt.timezone.utc
READ = dt.datetime(2025, 3, 10, 2, 30, 15, tzinfo=UTC)

CASES = [
    ("2025-02-01 13:16:07", None, "2025-02-01T05:16:07", True),
    ("2025-02-01 13:16:07", "Asia/Shanghai", "2025-02-01T05:16:07", True),
    ("2025-02-01 13:16:07", "Asia/Tokyo", "2025-02-01T04:16:07", False),
    ("2025-02-01 13:16:07\r", None, "2025-02-01T05:16:07", False),
    ("２０２５-02-01 １３:16:07", None, "2025-02-01T05:16:07", False),
    ("﻿2025-02-01 13:16:07", None, "2025-02-01T05:16:07", False),
    ("2025-2025年02-02 17:08:52", None, "2025-02-02T09:08:52", False),
    ("1738520720", "Europe/London", "2025-02-02T18:25:20", False),
    ("1738501450880", None, "2025-02-02T13:04:10", False),
    ("1738519519368974", None, "2025-02-02T18:05:19", False),
    ("51分钟前", None, "2025-03-10T01:39:15", False),
    ("9 小时前", None, "2025-03-09T17:30:15", False),
    ("昨天 12:56", None, "2025-03-09T04:56:00", False),
    ("今天 08:01", "America/New_York", "2025-03-09T12:01:00", False),
    ("2月3日 22:41", None, "2025-02-03T14:41:00", False),
    ("2025年02月05日 上午12:49", None, "2025-02-04T16:49:00", False),
    ("2025年02月03日 下午12:00", None, "2025-02-03T04:00:00", False),
    ("2025年2月10日 01時49分", "Asia/Tokyo", "2025-02-09T16:49:00", False),
    ("03.02.2025, 19:25:01 Uhr", "Europe/Berlin", "2025-02-03T18:25:01", False),
    ("Feb 2, 2025, 7:04 AM", "America/New_York", "2025-02-02T12:04:00", False),
    ("Sun Feb 02 09:51:28 CST 2025", None, "2025-02-02T01:51:28", False),
    ("Fri, 31 Jan 2025 20:15:07 GMT", None, "2025-01-31T20:15:07", False),
    ("20250204T072254+0800", None, "2025-02-03T23:22:54", False),
    ("2025-02-05T15:59:39[America/New_York]", None, "2025-02-05T20:59:39", False),
    ("2025-03-09 13:01:56 EDT", "America/New_York", "2025-03-09T17:01:56", False),
    # a repeated wall time means the earlier instant, a skipped one is read with the offset before the change
    ("2025/11/02 01:30:00", "America/New_York", "2025-11-02T05:30:00", False),
    ("2025-11-02 01:30:00 EST", "America/New_York", "2025-11-02T06:30:00", False),
    ("2025/03/09 02:30:00", "America/New_York", "2025-03-09T07:30:00", False),
    ("2025-02-30 10:00:00", None, None, True),
    ("2025/02/30 10:00", None, None, False),
    ("2025-02-01 24:00:00", None, None, True),
    ("NaT", None, None, False),
    ("—", None, None, False),
    ("", None, None, False),
    (None, None, None, False),
    ("刚刚" * 20_000, None, None, False),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_forms(spark, session_zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [(i, v, z, READ, "x") for i, (v, z, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, value string, client_tz string, crawled_at timestamp, utc_seconds string")
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        got = {r["i"]: r for r in ts.normalize(spark, df, "value").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(got) == len(CASES)
    for i, (v, _, want, standard) in enumerate(CASES):
        want_s = None if want is None else int(dt.datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp())
        assert (got[i]["utc_seconds"], got[i]["is_standard"]) == (want_s, standard), (v or "")[:40]


def test_empty_and_null_times(spark):
    schema = "value string, client_tz string, crawled_at timestamp"
    assert ts.normalize(spark, spark.createDataFrame([], schema), "value").count() == 0
    got = ts.normalize(spark, spark.createDataFrame([("5分钟前", None, None), ("2025-02-01 00:00", "No/Where", None)], schema), "value").collect()
    assert sorted((r["value"], r["utc_seconds"]) for r in got) == [("2025-02-01 00:00", 1738339200), ("5分钟前", None)]


def test_clashing_names(spark):
    """Columns named like the parser's own come through unchanged."""
    df = spark.createDataFrame([("2025-02-01 13:16:07", None, READ, 1, 2, "x", "y")], "value string, client_tz string, crawled_at timestamp, _wall int, _utc int, _form string, `a.b` string")
    r = ts.normalize(spark, df, "value").first()
    assert (r["_wall"], r["_utc"], r["_form"], r["a.b"], r["utc_seconds"]) == (1, 2, "x", "y", 1738386967)


def test_zone_is_estimated_from_the_order_of_events(spark):
    """A writer without a declared zone whose wall times lie after their ingestion is not in the default zone."""
    rows = []
    for k in range(200):
        read = dt.datetime(2025, 6, 1, tzinfo=UTC) + dt.timedelta(hours=7 * k)
        wall = (read - dt.timedelta(minutes=5 + k % 50)).astimezone(dt.timezone(dt.timedelta(hours=10))).replace(tzinfo=None)
        rows.append((wall.strftime("%Y/%m/%d %H:%M:%S"), "?", read))
    df = spark.createDataFrame(rows, "value string, client_tz string, crawled_at timestamp")
    got = ts.normalize(spark, df, "value").collect()
    assert all(0 <= r["crawled_at"].replace(tzinfo=UTC).timestamp() - r["utc_seconds"] <= 3300 for r in got)
    few = ts.normalize(spark, df.limit(ts.LEAST_VALUES - 1), "value").collect()  # too few to be estimated: the default zone
    assert all(r["utc_seconds"] > r["crawled_at"].replace(tzinfo=UTC).timestamp() for r in few)


@pytest.mark.parametrize("most", [0, 10])
def test_estimate_by_writer(spark, monkeypatch, most):
    """Each writer group has its own history, across a change of the clock too; joined by a shuffle or broadcast."""
    import zoneinfo

    monkeypatch.setattr(ts, "BROADCAST_GROUPS", most)
    rows = []
    for k in range(400):
        read = dt.datetime(2025, 3, 1, tzinfo=UTC) + dt.timedelta(hours=3 * k)
        sent = read - dt.timedelta(minutes=2 + 37 * k % 900)
        for who, zone, declared in (("a", "Europe/Berlin", None), ("b", "Asia/Shanghai", None), ("c", "America/New_York", "nowhere"), (None, "Asia/Tokyo", None), ("d", "Europe/London", "Europe/London")):
            rows.append((who, sent.astimezone(zoneinfo.ZoneInfo(zone)).strftime("%d.%m.%Y %H:%M:%S"), declared, read, int(sent.timestamp())))
    df = spark.createDataFrame(rows, "who string, value string, client_tz string, crawled_at timestamp, want bigint")
    got = ts.normalize(spark, df, "value", writer=["who"]).collect()
    assert len(got) == len(rows) and sum(r["utc_seconds"] != r["want"] for r in got) <= 4  # the repeated hour
    blind = {(r["who"], r["declared"]): r["estimated"] for r in ts.zone_estimates(df, "value", "client_tz", "crawled_at", ["who"]).collect()}
    assert blind["", None] == "Asia/Tokyo" and blind["c", "nowhere"] == "America/New_York" and blind["d", "Europe/London"] == "Europe/London"


def test_brute_force_of_abbreviations():
    table = ts.abbreviations()
    assert table["CEST"] == 7200 and table["JST"] == 32400 and table["Asia/Shanghai|CST"] == 28800 and table["America/Chicago|CST"] == -21600


def test_query_equals_an_independent_reader(spark, data):
    from tests.time_reader import ref
    from tidemark.plans.core_problems import FIELDS, p4_found
    from tidemark.sources.tables import table

    want = set()
    for name, key, fields in FIELDS:
        for r in table(spark, data, name).select(key, "client_tz", "crawled_at", *fields).collect():
            for f in fields:
                # Row gives naive local times of the driver, which the tests run in UTC
                u = ref(r[f], r["client_tz"], r["crawled_at"].replace(tzinfo=UTC))
                if u is not None:
                    want.add((name, str(r[key]), f, u))
    got = [tuple(r) for r in p4_found(spark, data).collect()]
    assert set(got) == want and len(got) == len(set(got))
