import pytest

from quarterloom.operators.timestamps import dirty_time_values, with_norm

NY, LONDON, TOKYO = "America/New_York", "Europe/London", "Asia/Tokyo"
CASES = [
    ("2024-04-16T15:15:00Z", NY, "mdy", "2024-04-16T15:15:00Z"),
    ("January 10, 2023, 11:30 am", NY, "mdy", "2023-01-10T16:30:00Z"),
    ("14. Januar 2023, 13:15 Uhr", "Europe/Berlin", "dmy", "2023-01-14T12:15:00Z"),
    ("10. März 2022", "Europe/Berlin", "dmy", "2022-03-10"),
    ("20210315T211500Z", NY, "mdy", "2021-03-15T21:15:00Z"),
    ("2024-10-21T09:00:00-04:00[America/New_York]", TOKYO, "ymd", "2024-10-21T13:00:00Z"),
    ("2022-02-15 13:30 JST", TOKYO, "ymd", "2022-02-15T04:30:00Z"),
    ("07/12/2023 11:15 EDT", NY, "mdy", "2023-07-12T15:15:00Z"),
    ("12/10/2021", LONDON, "dmy", "2021-10-12"),
    ("12/10/2021", NY, "mdy", "2021-12-10"),
    ("13/10/2021", None, None, "2021-10-13"),
    ("12/10/2021", None, None, None),
    ("13/13/2021", LONDON, "dmy", None),
    ("1689253200", NY, "mdy", "2023-07-13T13:00:00Z"),
    ("1657265400753", NY, "mdy", "2022-07-08T07:30:00Z"),
    ("1621182600.0", NY, "mdy", "2021-05-16T16:30:00Z"),
    ("25-JUL-25", NY, "mdy", "2025-07-25"),
    ("2026-5-17 ", NY, "mdy", "2026-05-17"),
    ("20220421", NY, "mdy", "2022-04-21"),
    ("Fri, 21 Jan 2022 11:00:00 -0500", LONDON, "dmy", "2022-01-21T16:00:00Z"),
    ("2022年4月27日 9時00分", TOKYO, "ymd", "2022-04-27T00:00:00Z"),
    ("07/18/2022 12:15PM", NY, "mdy", "2022-07-18T16:15:00Z"),
    ("01/13/2021 1:00 PM", NY, "mdy", "2021-01-13T18:00:00Z"),
    ("May 9, 2024 at 12:00 a.m. GMT+05:30", NY, "mdy", "2024-05-08T18:30:00Z"),
    ("2023-08-16 10:30 UTC+5:30", "Asia/Kolkata", "dmy", "2023-08-16T05:00:00Z"),
    ("March 20, 2022 4:00 p.m. ET", LONDON, "dmy", "2022-03-20T20:00:00Z"),
    # Daylight saving: a time that occurs twice is its first occurrence, one in a gap moves on.
    ("2021-11-07 01:30", NY, "mdy", "2021-11-07T05:30:00Z"),
    ("2021-03-14 02:30", NY, "mdy", "2021-03-14T07:30:00Z"),
    ("2024-02-29", NY, "mdy", "2024-02-29"),
    ("2023-02-29", NY, "mdy", None),
    ("2023-04-31", NY, "mdy", None),
    ("2023-04-30 25:00", NY, "mdy", None),
    ("2023-04-30 13:00 pm", NY, "mdy", None),
    ("00/00/0000", NY, "mdy", None),
    ("TBD", NY, "mdy", None),
    ("", NY, "mdy", None),
    (None, NY, "mdy", None),
    ("2017Q5", NY, "mdy", None),
    ("2015Q4", NY, "mdy", "2015Q4"),
    ("CY2017Q4", NY, "mdy", "2017Q4"),
    ("2014-Q1", NY, "mdy", "2014Q1"),
    ("Jan-Mar 2021", NY, "mdy", "2021Q1"),
    ("q1-2016", NY, "mdy", "2016Q1"),
    ("Q4'18", NY, "mdy", "2018Q4"),
    ("4Q16", NY, "mdy", "2016Q4"),
    ("CQ2 2014", NY, "mdy", "2014Q2"),
    ("2020.1", NY, "mdy", "2020Q1"),
    ("2017Q1 (cal.)", NY, "mdy", "2017Q1"),
    ("fourth quarter 2016", NY, "mdy", "2016Q4"),
    ("FY2023-2Q", NY, "mdy", "2023Q2"),
    ("F4Q23", NY, "mdy", "2023Q4"),
    ("FY23Q2", NY, "mdy", "2023Q2"),
    ("Q2 FY22", NY, "mdy", "2022Q2"),
    ("9" * 4000, NY, "mdy", None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, value string, zone string, ord string")
    got = {r.i: r.norm for r in with_norm(df, "value", "zone", "ord").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


@pytest.mark.parametrize("zone", [NY, LONDON, TOKYO, "Australia/Sydney"])
def test_zones_against_plain_python(spark, zone):
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    times = [datetime(2015, 1, 1) + timedelta(hours=37 * k) for k in range(1500)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"), zone, "ymd") for t in times], "value string, zone string, ord string")
    got = {r.value: r.norm for r in with_norm(df, "value", "zone", "ord").collect()}
    for t in times:
        there = t.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
        assert got[t.strftime("%Y-%m-%d %H:%M:%S")] == there.strftime("%Y-%m-%dT%H:%M:%SZ")


def test_cases_of_tables(spark):
    rows = spark.createDataFrame([(1, "a", " 2022-02-25 ", "x"), (1, "a", " 2022-02-25 ", "x"), (2, "a", "2022-02-25", "x"), (3, None, "Q1 2020", "x"), (4, "zz", None, "x")], "id bigint, feed string, when string, norm string")
    feeds = spark.createDataFrame([("a", NY, "mdy")], "feed string, home_zone string, date_order string")
    got = sorted(map(tuple, dirty_time_values({"t": (rows, "id", ["when"])}, feeds).collect()))
    assert got == [("t", 1, "when", "2022-02-25"), ("t", 1, "when", "2022-02-25"), ("t", 3, "when", "2020Q1")]
    assert dirty_time_values({"t": (rows.limit(0), "id", ["when"])}, feeds).count() == 0
