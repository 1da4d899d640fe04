from datetime import date, datetime, timezone
from email.utils import parsedate, parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from heedline.functions import dates

HEADERS = [
    "Mon, 20 Apr 2026 10:11:12 +0200",
    "20 Apr 2026 10:11:12 +0200",
    "Mon, 20 Apr 2026 10:11:12 GMT",
    "Mon, 20 Apr 2026 10:11:12 -0000",
    "Mon, 20 Apr 2026 10:11 +0000",
    "Mon, 20 Apr 2026 10:11:12 -0700 (PDT)",
    "Mon, 20 Apr 2026 10:11:12 EST",
    "Mon, 20 Apr 2026 10:11:12 ADT",
    "2026-04-20T10:11:12",
    "garbage",
    "",
    "Mon, 20 Apr 26 10:11:12 +0000",
    "Mon, 20 Apr 99 10:11:12 +0000",
    "20-Apr-2026 10:11:12 +0000",
    "Sat, 31 Feb 2026 10:11:12 +0000",
    "Mon, 20 Apr 2026 10:11:12 +0530",
    "Mon, 20 April 2026 10:11:12 +0000",
    "Mon, 20 Aprx 2026 10:11:12 +0000",
    "Mon, 20 Apr 2026 10:11:12",
    "Apr 20 2026 10:11:12 +0100",
    "mon 20 apr 2026 1:2:3 z",
    "Mon, 20 Apr 2026 25:11:12 +0000",
    "Mon, 20 Apr 2026 10:11:60 +0000",
    "Mon,20 Apr 2026 10:11:12 +0200",
    "  Mon, 20 Apr 2026   10:11:12   +0200  ",
    "Mon, 20 Apr 2026 10:11:12 QQQ",
    "Thu, 29 Feb 2024 23:59:59 -1130",
]


def _python(header):
    try:
        return parsedate_to_datetime(header)
    except Exception:
        return None


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(h,) for h in HEADERS], "h string")
    rows = df.select(
        "h",
        F.date_format(dates.mail_wall("h"), "yyyy-MM-dd HH:mm:ss").alias("wall"),
        dates.mail_epoch("h").alias("epoch"),
        dates.date_sort_key("h").alias("key"),
        dates.simple_date("h").alias("simple"),
        dates.short_date("h", date(2026, 5, 1)).alias("short"),
    ).collect()
    return {row["h"]: row for row in rows}


@pytest.mark.parametrize("header", HEADERS)
def test_agrees_with_the_standard_library(read, header):
    expected, row = _python(header), read[header]
    if expected is None:
        assert (row["wall"], row["epoch"], row["key"], row["short"]) == (None, None, "", header[:10])
        return
    as_utc = expected if expected.tzinfo else expected.replace(tzinfo=timezone.utc)
    assert row["wall"] == expected.strftime("%Y-%m-%d %H:%M:%S")
    assert row["epoch"] == int(as_utc.timestamp())
    assert row["key"] == expected.isoformat()
    this_year = expected.year == 2026
    assert row["short"] == expected.strftime("%a %b %d" if this_year else "%Y-%m-%d")


@pytest.mark.parametrize("header", [h for h in HEADERS if ":60" not in h and "25:" not in h])
def test_simple_date(read, header):
    t = parsedate(header)
    assert read[header]["simple"] == (f"{t[0]}-{t[1]:02d}-{t[2]:02d}" if t else header[:10])


def test_week_buckets(spark):
    as_of = date(2024, 1, 31)
    days = {
        date(2024, 2, 5): (-1, "upcoming"),
        date(2024, 2, 4): (0, "this week"),
        date(2024, 1, 29): (0, "this week"),
        date(2024, 1, 28): (1, "last week"),
        date(2024, 1, 15): (2, "2 weeks ago"),
        date(2023, 12, 10): (8, "2 months ago"),
        date(2023, 1, 1): (57, "14 months ago"),
        None: (9999, "sometime"),
    }
    df = spark.createDataFrame([(d and datetime(d.year, d.month, d.day, 23, 59),) for d in days], "w timestamp_ntz")
    index = dates.week_index("w", as_of)
    got = [tuple(r) for r in df.select(index.alias("i")).select("i", dates.week_label("i")).collect()]
    assert got == list(days.values())
