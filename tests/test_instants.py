"""Written times against the zone database and hand-made cases."""

from __future__ import annotations

import datetime as dt
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.operators.instants import offset_intervals, post_instants, resolve_instants

UTC = dt.timezone.utc
POST = "row_no long, source struct<platform:string,captured_at:string,published_at:string>, utc_us string, r_text string, seg_zone string, field string"
ZONES = "platform string, home_zone string, date_order string"


def us(text: str) -> int:
    t = dt.datetime.fromisoformat(text)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)


def one(spark, values: list[tuple[str, str, str]]) -> list[int | None]:
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, written string, zone string, ord string")
    rows = resolve_instants(df, "written", "zone", "ord").orderBy("i").collect()
    return [(r.utc_us, r.instant_status) for r in rows]


def test_notations(spark):
    ny, berlin, kolkata = "America/New_York", "Europe/Berlin", "Asia/Kolkata"
    cases = [
        (("2024-04-19T23:24:38Z", ny, "mdy"), "2024-04-19T23:24:38+00:00"),
        (("20231105T143045Z", ny, "mdy"), "2023-11-05T14:30:45+00:00"),
        (("2024-12-31T16:30:20+05:45", ny, "mdy"), "2024-12-31T10:45:20+00:00"),
        (("2023-08-03T13:25:35+0530", ny, "mdy"), "2023-08-03T07:55:35+00:00"),
        (("2024-05-26 17:36:11 -03:30", ny, "mdy"), "2024-05-26T21:06:11+00:00"),
        (("1678601129", ny, "mdy"), "2023-03-12T06:05:29+00:00"),
        (("1697230375569", ny, "mdy"), "2023-10-13T20:52:55.569+00:00"),
        (("1675535692892172", ny, "mdy"), "2023-02-04T18:34:52.892172+00:00"),
        (("7/5/2023, 22:18", berlin, "dmy"), "2023-05-07T20:18:00+00:00"),
        (("7/5/2023, 22:18", ny, "mdy"), "2023-07-06T02:18:00+00:00"),
        (("8/10/2023, 8:50 AM", ny, "mdy"), "2023-08-10T12:50:00+00:00"),
        (("4/21/2023, 12:04 am", ny, "mdy"), "2023-04-21T04:04:00+00:00"),
        (("22.10.23, 21:07", berlin, "dmy"), "2023-10-22T19:07:00+00:00"),
        (("20. Juni 2023, 16:33 Uhr", berlin, "dmy"), "2023-06-20T14:33:00+00:00"),
        (("Oct 3, 2023 at 11:16 PM", ny, "mdy"), "2023-10-04T03:16:00+00:00"),
        (("October 20, 2023, 23:17", ny, "mdy"), "2023-10-21T03:17:00+00:00"),
        (("20 Oct 2025, 05:24 EDT", ny, "mdy"), "2025-10-20T09:24:00+00:00"),
        (("2024-09-16 03:53:42 IST", kolkata, "dmy"), "2024-09-15T22:23:42+00:00"),
        (("Wed, 12 Apr 2023 20:00:16 GMT", ny, "mdy"), "2023-04-12T20:00:16+00:00"),
        (("Sat, 06 Jan 2024 03:07:36 -0500", ny, "mdy"), "2024-01-06T08:07:36+00:00"),
        (("2023-07-04 02:32:07 Europe/Berlin", kolkata, "dmy"), "2023-07-04T00:32:07+00:00"),
        (("2023-05-28 08:17:10[America/New_York]", berlin, "dmy"), "2023-05-28T12:17:10+00:00"),
        (("2025-11-02T01:49:50-05:00[America/New_York]", ny, "mdy"), "2025-11-02T06:49:50+00:00"),
        (("2023-10-31", ny, "mdy"), "2023-10-31T04:00:00+00:00"),
        (("2024/08/31 07:48", "UTC", "ymd"), "2024-08-31T07:48:00+00:00"),
    ]
    got = one(spark, [c for c, _ in cases])
    for (c, want), (have, _) in zip(cases, got, strict=True):
        assert have == us(want), c


def test_ambiguous_and_skipped(spark):
    ny = "America/New_York"
    got = one(spark, [("2025-11-02 01:17", ny, "mdy"), ("2024-03-10 02:46", ny, "mdy"), ("2024-03-10 03:00", ny, "mdy"), ("2025-11-02 02:00", ny, "mdy")])
    assert got[0] == (us("2025-11-02T05:17:00+00:00"), "ambiguous")
    assert got[1] == (us("2024-03-10T07:46:00+00:00"), "nonexistent")
    assert got[2] == (us("2024-03-10T07:00:00+00:00"), "unique")
    assert got[3] == (us("2025-11-02T07:00:00+00:00"), "unique")


@pytest.mark.parametrize("bad", [None, "", "  ", "pending", "2024-02-30T10:15:00Z", "2023-13-05 08:00", "31/04/2024 10:00", "0000-00-00 00:00:00", "25:00", "2024-01-01 24:30", "13:00 PM", "x" * 20000])
def test_senseless_is_unresolvable(spark, bad):
    assert one(spark, [(bad, "Europe/Berlin", "dmy")]) == [(None, "unresolvable")]


def test_relative_counts_back_from_capture(spark):
    rows = [
        (1, ("a", "2024-05-01T00:00:00Z", "3 days ago")), (2, ("a", "2024-05-01T00:00:00Z", "2mo • Edited")), (3, ("a", None, "5h")), (4, ("a", "2 weeks ago", "a minute ago")),
        (5, ("a", "2024-05-01T00:00:00Z", "vor 2 Wochen")), (6, ("a", "2024-05-01T00:00:00Z", "il y a 2 jours")), (7, (None, "2024-05-01 00:00", "2024-05-01T00:00:00Z")), (8, None),
    ]
    df = spark.createDataFrame([(n, s, "x", "y", "z", "w") for n, s in rows], POST)
    out = {(r.row_no, r.field): r.utc_us for r in post_instants(df, spark.createDataFrame([("a", "UTC", "dmy")], ZONES)).collect()}
    assert len(out) == 16
    assert out[1, "published_at"] == us("2024-04-28T00:00:00+00:00")
    assert out[2, "published_at"] == us("2024-03-02T00:00:00+00:00")
    assert out[3, "published_at"] is None and out[4, "published_at"] is None and out[4, "captured_at"] is None
    assert out[5, "published_at"] == us("2024-04-17T00:00:00+00:00")
    assert out[6, "published_at"] == us("2024-04-29T00:00:00+00:00")
    assert out[7, "captured_at"] is None and out[7, "published_at"] == us("2024-05-01T00:00:00+00:00")


def test_empty_table(spark):
    assert post_instants(spark.createDataFrame([], POST), spark.createDataFrame([], ZONES)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2_000_000_000), st.sampled_from(["America/New_York", "Europe/Lisbon", "Australia/Sydney", "Asia/Kolkata"]))
def test_intervals_hold_the_zone_database(seconds, zone):
    at = dt.datetime.fromtimestamp(seconds, UTC).astimezone(zoneinfo.ZoneInfo(zone))
    hit = [o for a, b, o, _ in offset_intervals(zone) if a <= seconds < b]
    assert hit == [int(at.utcoffset().total_seconds())]


def test_wall_clock_against_brute_force(spark):
    zone = "Australia/Sydney"
    z = zoneinfo.ZoneInfo(zone)
    wall = [dt.datetime(2024, 4, 7, 1, 0) + dt.timedelta(minutes=13 * k) for k in range(20)] + [dt.datetime(2024, 10, 6, 1, 0) + dt.timedelta(minutes=13 * k) for k in range(20)]
    got = one(spark, [(w.isoformat(sep=" "), zone, "dmy") for w in wall])
    for w, (have, _) in zip(wall, got, strict=True):
        assert have == us(w.replace(tzinfo=z, fold=0).astimezone(UTC).isoformat()), w
