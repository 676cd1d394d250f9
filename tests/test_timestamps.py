import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from threadmill.operators.timestamps import normalise_timestamps, read_text, read_zone, site_host

UTC = dt.timezone.utc


def micros(*a, tz=UTC):
    return int((dt.datetime(*a, tzinfo=tz) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    "text, want",
    [
        ("2023-07-03 08:14:52", (micros(2023, 7, 3, 8, 14, 52), "")),
        ("1688262130488", (1688262130488000, "Z")),
        ("1688300663", (1688300663000000, "Z")),
        ("1688313103487394", (1688313103487394, "Z")),
        ("2023-07-03T12:50:49Z", (micros(2023, 7, 3, 12, 50, 49), "Z")),
        ("2023-06-27T16:56:39.339", (micros(2023, 6, 27, 16, 56, 39, 339000), "")),
        ("2023年07月02日 01:15", (micros(2023, 7, 2, 1, 15), "")),
        ("20230630113047", (micros(2023, 6, 30, 11, 30, 47), "")),
        ("2023-07-01", (micros(2023, 7, 1), "")),
        ("Fri Jun 30 14:40:35 +0800 2023", (micros(2023, 6, 30, 14, 40, 35), "+08:00")),
        ("Mon, 3 Jul 2023 04:33:06 -0400", (micros(2023, 7, 3, 4, 33, 6), "-04:00")),
        ("2023-07-03 15:55:19.583969 +08:00", (micros(2023, 7, 3, 15, 55, 19, 583969), "+08:00")),
        ("2023-07-02 06:11:32 Asia/Shanghai", (micros(2023, 7, 2, 6, 11, 32), "Asia/Shanghai")),
        ("2023-07-02 06:11:32 America/New_York", (micros(2023, 7, 2, 6, 11, 32), "America/New_York")),
        ("2023/07/06 09:07:31 (UTC+8)", (micros(2023, 7, 6, 9, 7, 31), "+08:00")),
        ("2023-11-16 23:34:00.235815 GMT+11", (micros(2023, 11, 16, 23, 34, 0, 235815), "+11:00")),
        ("2023年6月26日 下午6:46", (micros(2023, 6, 26, 18, 46), "")),
        ("2023年6月26日 上午12:05", (micros(2023, 6, 26, 0, 5), "")),
        ("2023年7月21日 午後12:18", (micros(2023, 7, 21, 12, 18), "")),
        ("2023. 7. 13. 오후 1:25", (micros(2023, 7, 13, 13, 25), "")),
        ("2023년 7월 21일 7시 8분", (micros(2023, 7, 21, 7, 8), "")),
        ("2023年7月31日 19時15分", (micros(2023, 7, 31, 19, 15), "")),
        ("Jun 24, 2023 12:52 AM", (micros(2023, 6, 24, 0, 52), "")),
        *[(x, None) for x in (None, "", " ", "0", "0000-00-00 00:00:00", "N/A", "刚刚", "2023-02-30", "2023-07-02 06:11 Mars/Base", "2023-07-02 25:00")],
    ],
)
def test_read_text(text, want):
    assert read_text(text) == want


def test_read_zone():
    assert [read_zone(z) for z in ("Z", "+8", "-0730", "(UTC+9)", "JST", "+19", "Nowhere/City")] == ["Z", "+08:00", "-07:30", "+09:00", "+09:00", None, None]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_instants_and_daylight_saving(spark, monkeypatch, bound):
    monkeypatch.setattr("threadmill.operators.timestamps.MAX_BROADCAST_SITES", bound)
    sites = spark.createDataFrame([("ny.example", "America/New_York"), ("cn.example", "Asia/Shanghai")], "site string, zone string")
    rows = [
        (1, "2024-11-03 01:30:00", "2024-11-05 00:00:00", "HTTPS://M.NY.example/x"),  # occurs twice: the earlier
        (2, "2024-03-10 02:30:00", None, "http://www.ny.example/x"),  # skipped: the offset before
        (3, "2024-07-01 10:00", "", ""),
        (4, "2024-07-01 10:00 Europe/Berlin", "刚刚", None),
        (None, None, "1719800000", "http://ny.example"),
    ]
    df = spark.createDataFrame(rows, "id long, p string, c string, url string")
    got = {(r[0], r[1]): r[2] for r in normalise_timestamps(df, "id", "p", "c", "url", sites).collect()}
    assert got == {
        (1, "p"): micros(2024, 11, 3, 5, 30), (1, "c"): micros(2024, 11, 5), (2, "p"): micros(2024, 3, 10, 7, 30), (3, "p"): micros(2024, 7, 1, 2), (4, "p"): micros(2024, 7, 1, 8), (None, "c"): 1719800000000000,
    }
    assert normalise_timestamps(df.limit(0), "id", "p", "c", "url", sites).count() == 0


def test_zone_of_an_undeclared_site_is_estimated(spark):
    sites = spark.createDataFrame([("a", "Asia/Tokyo"), ("b", "Europe/London"), ("c", "America/Los_Angeles")], "site string, zone string")
    rows = []
    for k in range(60):
        at = dt.datetime(2024, 1 + k % 12, 1 + k % 28, 9, 0, tzinfo=UTC)
        rows.append((k, at.astimezone(ZoneInfo("Europe/London")).strftime("%Y-%m-%d %H:%M:%S"), (at + dt.timedelta(minutes=20)).strftime("%Y-%m-%d %H:%M:%S"), "http://new.example/x"))
    got = normalise_timestamps(spark.createDataFrame(rows, "id long, p string, c string, url string"), "id", "p", "c", "url", sites)
    assert {r[2] for r in got.where("id = 6 and field = 'p'").collect()} == {micros(2024, 7, 7, 9)}


def test_site_host(spark):
    df = spark.createDataFrame([("HTTPS://M.Note.Example/explore/x",), ("http://u:p@www.a.b:80/",), ("",), (None,), ("nonsense",)], "u string")
    assert [r[0] for r in df.select(site_host(df.u)).collect()] == ["note.example", "a.b", "", "", ""]


def test_hidden_zones_are_found_again(spark):
    import random

    from threadmill.operators.timestamps import check_zones

    rng = random.Random(3)
    zones = {"a.example": ("Asia/Shanghai", 8), "b.example": ("Asia/Tokyo", 9), "c.example": ("UTC", 0)}
    rows = []
    for site, (_, offset) in zones.items():
        for _ in range(300):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(200_000))
            # No post is collected less than an hour after it; a few rows are odd.
            lag = rng.choice([-7, -3]) * 60 if rng.random() < 0.02 else 60 + rng.expovariate(1 / 300)
            rows.append((f"https://{site}/x", at.strftime("%Y-%m-%d %H:%M:%S"), (at - dt.timedelta(hours=offset) + dt.timedelta(minutes=lag)).strftime("%Y-%m-%d %H:%M:%S")))
    df = spark.createDataFrame(rows, "url string, local string, utc string")
    sites = spark.createDataFrame([(s, z) for s, (z, _) in zones.items()], "site string, zone string")
    got = {r["site"]: (r["estimated"], r["n_same"]) for r in check_zones(df, "local", "utc", "url", sites).collect()}
    assert got == {s: (z, 300) for s, (z, _) in zones.items()}
    assert check_zones(df.limit(0), "local", "utc", "url", sites).count() == 0
