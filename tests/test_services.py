"""Cached regions, fetch steps, uploaded cycles, member requests, names of messages and progress against plain Python."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from galeframe.functions import text, wind
from galeframe.operators import grids, regions
from galeframe.plans import forecast
from galeframe.sources import models
from galeframe.streaming import ingest

T0 = dt.datetime(2026, 6, 1)
BOX = "min_lat double, max_lat double, min_lon double, max_lon double"


def box(rng, span):
    lat, lon = rng.uniform(-90, 80), rng.uniform(-180, 170)
    return lat, lat + rng.choice([0.0, rng.uniform(0, span)]), lon, lon + rng.choice([0.0, rng.uniform(0, span)])


def test_requests_meet_the_newest_region_that_holds_them(spark):
    rng = random.Random(11)
    held = [(k, *box(rng, rng.choice([1, 10, 60, 300])), T0 + dt.timedelta(minutes=rng.randrange(0, 900))) for k in range(120)]
    held += [(1000, *held[0][1:5], held[0][5]), (1001, 0.0, 0.0, 0.0, 0.0, T0)]
    asked = [(k, *box(rng, 4), T0 + dt.timedelta(minutes=rng.randrange(0, 1500))) for k in range(400)]
    for n, h in enumerate(held[:60]):  # close to the edge, in and out
        out = rng.choice([0.0, 0.49, 0.5, 0.51])
        asked.append((500 + n, h[1] - out, h[2], h[3], h[4] + 0.5, h[5] + dt.timedelta(minutes=rng.choice([0, 359, 360, -1]))))
    asked.append((900, 0.3, 0.4, 0.2, 0.2, T0))

    def brute(q):
        fit = [(-h[5].timestamp(), h[0]) for h in held if q[1] >= h[1] - 0.5 and q[2] <= h[2] + 0.5 and q[3] >= h[3] - 0.5 and q[4] <= h[4] + 0.5 and dt.timedelta(0) <= q[5] - h[5] < dt.timedelta(hours=6)]
        return min(fit)[1] if fit else None

    r = spark.createDataFrame(held, f"region_id int, {BOX}, fetched_at timestamp_ntz")
    got = {x["id"]: x["region"] for x in regions.cached(spark.createDataFrame(asked, f"id int, {BOX}, at timestamp_ntz"), r, "id").collect()}
    assert got == {q[0]: brute(q) for q in asked}
    assert len({v for v in got.values()}) > 10 and got[900] == 1001
    assert regions.cover(r).groupBy("region_id").count().agg(F.max("count")).first()[0] <= 9


def test_requests_go_on_to_older_regions_only_where_no_younger_one_holds_them(spark, monkeypatch):
    left = []
    kept = lambda df: left.append(df := df.sparkSession.createDataFrame(df.collect(), df.schema)) or df
    monkeypatch.setattr(regions, "durable", kept)
    ages = [e + d for e in regions.AGES for d in (-1, 0, 1) if e + d >= 0] + [0, 0]
    at = T0 + dt.timedelta(hours=7)
    held = [(n, 0.0, 10.0, 20.0 * n, 20.0 * n + 10, at - dt.timedelta(microseconds=a)) for n, a in enumerate(ages)]
    held += [(100 + n, *h[1:5], at - dt.timedelta(hours=5, minutes=59)) for n, h in enumerate(held)]  # an older one for each
    asked = [(n, h[1] + 1, h[2] - 1, h[3] + 1, h[4] - 1, at) for n, h in enumerate(held[: len(ages)])]
    r, q = spark.createDataFrame(held, f"region_id int, {BOX}, fetched_at timestamp_ntz"), spark.createDataFrame(asked, f"id int, {BOX}, at timestamp_ntz")
    got = {x["id"]: x["region"] for x in regions.cached(q, r, "id").collect()}
    assert got == {n: n if a < min(regions.AGES[-1], (5 * 60 + 59) * 60_000_000) else n + 100 for n, a in enumerate(ages)}
    by_round = [sum(a < b for a in ages if a >= c) for c, b in zip(regions.AGES[:-1], regions.AGES[1:], strict=True)]
    assert [x.count() for x in left[:3]] == by_round[:3] and len(left) == 4


def test_steps_widen_until_few_points_are_left(spark):
    rng = random.Random(4)
    rows = [(k, 0.0, rng.uniform(0, 60), 0.0, rng.uniform(0, 120), rng.choice([0.0, 1.5, -1.0, 0.25]), rng.choice([0.0, 1.5])) for k in range(200)]
    got = {r["id"]: r for r in regions.fetch_steps(spark.createDataFrame(rows, f"id int, {BOX}, lat_step double, lon_step double")).collect()}
    for k, _, a, _, b, sa, sb in rows:
        sa, sb = (max(sa, 2.0) if a > 15 else sa), (max(sb, 2.5) if b > 20 else sb)
        sa, sb = (2.0 if sa <= 0 else sa), (2.5 if sb <= 0 else sb)
        n = lambda span, s: int(span / s + 0.5) + 1
        while n(a, sa) * n(b, sb) > 120:
            sa, sb = sa * 1.2, sb * 1.2
        assert (got[k]["lat_step"], got[k]["lon_step"], got[k]["n_lat"], got[k]["n_lon"]) == (sa, sb, n(a, sa), n(b, sb))


def test_the_region_query_has_hits_and_misses(spark):
    got = forecast.I04_B05_region_fetch(spark, "/root/testdata/sf0.01").agg(F.count("region"), F.count("*")).first()
    assert 0 < got[0] < got[1]


def test_uploaded_cycles_step_back(spark):
    now = spark.createDataFrame([(1, T0 + dt.timedelta(hours=16)), (2, T0 + dt.timedelta(hours=21)), (3, T0 + dt.timedelta(days=9)), (3, T0 + dt.timedelta(days=9)), (4, T0 + dt.timedelta(hours=15, minutes=29))], "id int, now timestamp_ntz")
    listing = spark.createDataFrame([(T0 + dt.timedelta(hours=6), 240), (T0 + dt.timedelta(hours=12), 237), (T0 + dt.timedelta(hours=18), 240), (T0 + dt.timedelta(hours=6), 240)], "cycle timestamp_ntz, step int")
    got = sorted((r["id"], (r["cycle"] - T0).total_seconds() / 3600, r["found"]) for r in models.uploaded_cycles(now, "now", listing).collect())
    assert got == [(1, 6.0, True), (2, 6.0, True), (3, 210.0, False), (3, 210.0, False), (4, 6.0, True)]


def test_member_requests(spark):
    nan = float("nan")
    members = spark.createDataFrame([(1, 1, 5, 10.0), (1, 2, 5, 11.0), (1, 1, 0, 1.0)], "cell int, step int, member int, value double")
    means = spark.createDataFrame([(1, 1, 7.0), (1, 2, 8.0), (2, 2, 9.0)], "cell int, step int, value double")
    asked = [(1, 5, True), (1, 0, True), (1, 9, True), (2, 0, True), (1, 0, False), (1, 5, False), (9, 0, True), (3, 0, False)]
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell int")
    got = {tuple(r[:3]): (r["error"], r["values"]) for r in grids.member_requests(spark.createDataFrame(asked, "cell int, member int, stored boolean"), members, means, [1, 2], cells).collect()}
    want = {(1, 5, True): [10.0, 11.0], (1, 0, True): [1.0, nan], (1, 9, True): [nan, nan], (2, 0, True): [nan, 9.0], (1, 0, False): [7.0, 8.0], (3, 0, False): [nan, nan]}
    for k, v in want.items():
        assert got[k][0] is None and str(got[k][1]) == str(v), k
    assert got[1, 5, False] == ("members are not stored", None) and got[9, 0, True] == ("beyond the grid", None)


def test_messages_are_named_by_their_numbers(spark):
    df = spark.createDataFrame([(2, 2), (2, 3), (3, 1), (0, 0), (1, 8), (2, 99), (None, 2)], "category int, number int")
    assert [r[0] for r in df.select(models.variable(F.col("category"), F.col("number"))).collect()] == ["wind_u_10m", "wind_v_10m", "mslp", "temp_2m", "precip_accum", None, None]


def test_progress_is_kept_once_for_each_batch(spark):
    root = ingest.landing(spark, []) + "-progress"
    each = ingest.tracked(root, "model")
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "model string")
    each(batch, 0)
    each(batch, 0)
    each(batch.where("model = 'b'"), 1)
    got = sorted((r["batch"], r["model"], r["rows"]) for r in spark.read.parquet(root).collect())
    assert got == [(0, "a", 2), (0, "b", 1), (1, "b", 1)]


def test_night_arrivals_show_no_sixtieth_minute(spark):
    """Hours as sums of minutes and longitudes fall short of a whole one by rounding."""
    rows = [(19, 28, -157.0), (9, 44, -41.0), (9, 40, -115.0), (23, 60 - 1, 0.0), (12, 30, 45.25), (0, 0, 0.0)]
    at = [(T0 + dt.timedelta(hours=h, minutes=m), (h + m / 60 + lon / 15) % 24) for h, m, lon in rows]
    got = [r[0].split("~")[1][:5] for r in spark.createDataFrame([*at, (T0, 24 - 1e-14), (T0, 9 - 1e-14)], "t timestamp_ntz, h double").select(text.night_warning(F.col("t"), F.col("h"))).collect()]
    assert got == ["09:00", "07:00", "02:00", "23:59", "15:31", "00:00", "00:00", "09:00"]


def test_calm_winds_come_from_where_the_signs_of_their_zeros_say(spark):
    rows = [(0.0, 0.0), (0.0, -0.0), (-0.0, 0.0), (-0.0, -0.0), (3.0, 0.0), (0.0, 3.0), (0.0, -3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "u double, v double").select(wind.condition(F.col("u"), F.col("v"))[1]).collect()]
    assert got == [math.degrees(math.atan2(-u, -v)) % 360 for u, v in rows] == [180.0, 0.0, 180.0, 0.0, 270.0, 180.0, 0.0]
