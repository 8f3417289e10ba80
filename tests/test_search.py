"""Route search against plain Python, and scores of windows and members."""

import math

import pytest
from pyspark.sql import functions as F

from galeframe.functions import sailing
from galeframe.operators import passage, search
from galeframe.plans import registry
from galeframe.plans import search as plans

R, NM, MS = 6371000.0, 1852.0, 1852.0 / 3600.0


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def bearing(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def go(a, m, h):
    p, d, b = math.radians(a[0]), m / R, math.radians(h)
    q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
    x = math.radians(a[1]) + math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
    return math.degrees(q), (math.degrees(x) + 180) % 360 - 180


def fold(x):
    x %= 360
    return 360 - x if x > 180 else x


def speed(tws, twa):
    if tws <= 3 or twa <= 22:
        return 0.0
    scale = (tws - 3) / 3 if tws < 6 else 1.0

    def place(axis, x):
        k = max(i for i in range(len(axis) - 1) if i == 0 or axis[i] <= x)
        return k, min(max((x - axis[k]) / (axis[k + 1] - axis[k]), 0), 1)

    i, f = place(sailing.TWS, max(tws, 6))
    j, g = place(sailing.TWA, twa)
    at = lambda a, b: sailing.SPEEDS[a][b] * (1 - g) + sailing.SPEEDS[a][b + 1] * g
    s = (at(i, j) * (1 - f) + at(i + 1, j) * f) * scale
    s = s * ((twa - 22) / 6) ** 2 if twa < 28 else s
    return s if s >= 0.05 else 0.0


def turn(h, n, d):
    a, b = ((x - d + 180) % 360 - 180 for x in (h, n))
    if a * b >= 0 or abs(a) < 1 or abs(b) < 1:
        return "none"
    return "tack" if (abs(a) + abs(b)) / 2 < 90 else "gybe"


def plain(start, dest, tws, twd, cfg, wind=None):
    wind = wind or (lambda p, hour: (tws, twd))
    front = [{"p": start, "d": distance(start, dest), "h": bearing(start, dest), "nm": 0.0, "root": True}]
    closest, step = front[0], 0
    while True:
        for n in front:
            n["step"] = step
        near = [n for n in front if n["d"] <= cfg.arrival_m]
        if near:
            return min(near, key=lambda n: n["d"]), True
        closest = min([closest, *front], key=lambda n: n["d"])
        if step * cfg.step_hours >= min(cfg.max_hours, max(36, distance(start, dest) / NM / 4 * 3)):
            return closest, False
        made = []
        for n in front:
            tws, twd = wind(n["p"], step * cfg.step_hours)
            for off in range(-cfg.spread_deg, cfg.spread_deg + 1, cfg.fan_deg):
                h = (bearing(n["p"], dest) + off) % 360
                v = speed(tws, fold(h - twd))
                if fold(h - twd) < 28 or v <= 0.3:
                    continue
                lost = {"none": 0, "tack": cfg.tack_minutes, "gybe": cfg.gybe_minutes}["none" if n["root"] else turn(n["h"], h, twd)] * 60
                m = v * MS * max(0.1, cfg.step_hours * 3600 - lost)
                p = go(n["p"], m, h)
                made.append({"p": p, "d": distance(p, dest), "h": h, "nm": n["nm"] + m / NM, "root": False})
        if len(made) > 20:
            cell, best = max(0.015, cfg.reach_nm / 60 * 0.75), {}
            for n in made:
                k = math.floor((n["p"][0] + 90) / cell), math.floor((n["p"][1] + 180) / cell), int(n["h"] // 90) % 4
                if k not in best or n["d"] < best[k]["d"]:
                    best[k] = n
            made = sorted(best.values(), key=lambda n: n["d"])[: cfg.max_nodes]
            made.sort(key=lambda n: (n["p"][1], n["p"][0]))
        front, step = made, step + 1


def routes(spark):
    rows = [(1, 12.0, -45.0, 13.5, -46.5, 0.0), (2, 20.0, -30.0, 19.0, -30.3, 0.0), (3, 5.0, 5.0, 5.001, 5.0, 0.0)]
    return spark.createDataFrame(rows, "route_id long, start_lat double, start_lon double, dest_lat double, dest_lon double, dep_h double")


def test_search_is_that_of_plain_python(spark):
    cfg = search.Config(step_hours=4.0, max_nodes=25, fan_deg=15)
    steady = lambda lat, lon, hour: (F.lit(14.0), F.lit(0.0))
    found = search.route_search(routes(spark), steady, cfg)
    got = {r["route_id"]: r for r in search.outcomes(found).collect()}
    assert set(got) == {1, 2}  # the third is shorter than half a mile
    for r in routes(spark).where("route_id < 3").collect():
        best, reached = plain((r["start_lat"], r["start_lon"]), (r["dest_lat"], r["dest_lon"]), 14.0, 0.0, cfg)
        g = got[r["route_id"]]
        assert g["reached"] == reached and math.isclose(g["duration_hours"], best["step"] * cfg.step_hours)
        assert math.isclose(g["distance_nm"], best["nm"], rel_tol=1e-9)
    way = search.waypoints(found).orderBy("route_id", "wp").collect()
    assert all(w["twa"] >= 28 for w in way if w["wp"] > 0)
    for i in got:
        own = [w for w in way if w["route_id"] == i]
        assert [w["wp"] for w in own] == list(range(len(own))) and math.isclose(own[-1]["distance_nm"], got[i]["distance_nm"])
        assert all(a["distance_nm"] < b["distance_nm"] for a, b in zip(own, own[1:], strict=False))


def test_search_in_a_wind_of_place_and_time(spark):
    cfg = search.Config(step_hours=4.0, max_nodes=25, fan_deg=15)
    columns = lambda lat, lon, hour: (F.lit(12.0) + 4.0 * F.sin(lat / 3.0 + hour / 20.0), F.lit(180.0) + 60.0 * F.cos(lon / 2.0 + hour / 30.0))
    numbers = lambda p, hour: (12.0 + 4.0 * math.sin(p[0] / 3.0 + hour / 20.0), 180.0 + 60.0 * math.cos(p[1] / 2.0 + hour / 30.0))
    found = search.route_search(routes(spark), columns, cfg)
    got = {r["route_id"]: r for r in search.outcomes(found).collect()}
    for r in routes(spark).where("route_id < 3").collect():
        best, reached = plain((r["start_lat"], r["start_lon"]), (r["dest_lat"], r["dest_lon"]), None, None, cfg, numbers)
        g = got[r["route_id"]]
        assert g["reached"] == reached and math.isclose(g["duration_hours"], best["step"] * cfg.step_hours)
        assert math.isclose(g["distance_nm"], best["nm"], rel_tol=1e-9)


def test_a_staged_wind_is_the_field_and_stays_small(spark):
    """Stages give the same wind as one expression, and a stage's columns are not written out again in the next."""
    from galeframe.functions import wind
    from galeframe.operators.weather import Field, Staged

    nodes = spark.range(60).selectExpr("id % 31 as member", "id * 1.7d - 20 as y", "-id * 2.9d as x", "id * 1.5d as hour")
    one, two = (f.over("y", "x", F.col("hour"))(nodes) for f in (Field(plans.synthetic), Staged((wind.synthetic_uv, lambda u, v, hour: wind.condition(u, v)))))
    assert one.columns == two.columns and one.collect() == two.collect()
    members = plans.perturbed(31).over("y", "x", F.col("hour"))(nodes)
    assert members._jdf.queryExecution().optimizedPlan().toString().lower().count("atan2") < 40
    rows = {r["member"]: r for r in members.collect() if r["hour"] <= 45}
    plain = {r["member"]: r for r in one.collect() if r["hour"] <= 45}
    assert rows[15]["wind_tws"] == pytest.approx(max(plain[15]["wind_tws"], 1.0)) and rows[15]["wind_twd"] == pytest.approx(plain[15]["wind_twd"])
    assert rows[30]["wind_tws"] > plain[30]["wind_tws"]


def test_registered_searches(spark, sf):
    way = plans.I07_route_search(spark, sf).collect()
    assert {r["route_id"] for r in way} == set(range(25)) and all(r["twa"] >= 28 for r in way if r["wp"])
    ranked = plans.I15_departure_windows(spark, sf).collect()
    for batch in {r["batch"] for r in ranked}:
        own = sorted((r for r in ranked if r["batch"] == batch), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and all(a["comfort"] >= b["comfort"] for a, b in zip(own, own[1:], strict=False))
    spread = plans.I19_ensemble_confidence(spark, sf).collect()
    assert len(spread) == 5 and all(r["members"] == 31 and r["min_hours"] <= r["mean_hours"] <= r["max_hours"] for r in spread)
    by = {(r["route_id"], r["strategy"]): r for r in plans.I42_strategy_matrix(spark, sf).collect()}
    assert len(by) == 25
    field = lambda p, hour: synthetic_wind(spark, p, hour)
    best, reached = plain((12.0, -45.0), (13.5, -47.0), None, None, search.Config(step_hours=6.0, max_nodes=40, arrival_nm=30.0), field)
    r = by[0, "spatial_grid"]
    assert (r["reached"], r["duration_hours"]) == (reached, best["step"] * 6.0) and math.isclose(r["distance_nm"], best["nm"], abs_tol=1e-5)


def synthetic_wind(spark, p, hour, known={}):  # noqa: B006
    """The field at a place, north of the equator and under 30 degrees, far from its systems: trade winds, and what is left of two highs."""
    if not known:
        from galeframe.functions import wind

        known["trade"] = lambda lat: (9.5 + 2.0 * math.sin(lat * math.pi / 30.0)) * MS
        known["systems"] = [(n, *s[2:]) for n, s in enumerate(wind.SYSTEMS)]
        known["at"] = {}
        for h in range(0, 60, 6):
            row = spark.range(1).select(*[f(F.lit(float(h))).alias(f"{i}{k}") for i, s in enumerate(wind.SYSTEMS) for k, f in (("a", s[0]), ("b", s[1]))]).first()
            known["at"][h] = [(row[f"{i}a"], row[f"{i}b"]) for i in range(len(wind.SYSTEMS))]
    lat, lon = p
    u, v = -known["trade"](lat) * math.sin(math.radians(65)), -known["trade"](lat) * math.cos(math.radians(65))
    for (n, turn, kts, spread, reach), (y, x) in zip(known["systems"], known["at"][round(hour)], strict=True):
        dy, dx = lat - y, lon - x
        d = math.hypot(dy, dx)
        s = kts * math.exp(-d * d / spread) * MS if d < reach else 0.0
        u, v = u - turn * s * math.sin(math.atan2(dy, dx)), v + turn * s * math.cos(math.atan2(dy, dx))
    return math.hypot(u, v) / MS, math.degrees(math.atan2(-u, -v)) % 360


def test_calm_and_land_end_a_route_early(spark):
    cfg = search.Config(step_hours=6.0, max_nodes=10, fan_deg=30)
    calm = search.route_search(routes(spark), lambda *_: (F.lit(2.0), F.lit(0.0)), cfg)
    assert [(r["duration_hours"], r["reached"]) for r in search.outcomes(calm).collect()] == [(0.0, False)] * 2
    wall = spark.createDataFrame([(1, 0, -60.0, 0.0, -20.0, 0.0), (1, 1, -20.0, 0.0, -20.0, 40.0), (1, 2, -20.0, 40.0, -60.0, 40.0), (1, 3, -60.0, 40.0, -60.0, 0.0)], "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    shut = search.route_search(routes(spark), lambda *_: (F.lit(14.0), F.lit(0.0)), cfg, wall)
    assert not any(r["reached"] for r in search.outcomes(shut).collect())


def test_few_candidates_stay_in_their_order(spark):
    c = plans.candidates(spark, "/root/testdata/sf0.001").where("seq <= 40")
    got = search.prune(c, search.Config(strategy="no such rule")).orderBy("route_id", "idx").collect()
    assert len(got) == c.count() and all(a["seq"] < b["seq"] for a, b in zip(got, got[1:], strict=False) if a["route_id"] == b["route_id"])


def test_members_where_none_arrived(spark):
    rows = [(1, m, 10.0 + m, 1.0, 100.0, False) for m in range(3)] + [(2, 0, 10.0, 60.0, 100.0, False), (2, 1, 90.0, 10.0, 100.0, False)]
    m = spark.createDataFrame(rows, "k int, member int, duration_hours double, distance_nm double, direct_nm double, reached boolean")
    got = {r["k"]: r for r in passage.member_confidence(m, ["k"]).collect()}
    assert (got[1]["mean_hours"], got[1]["fastest"]) == (11.0, 0)
    assert (got[2]["mean_hours"], got[2]["max_hours"], got[2]["members"]) == (10.0, 10.0, 2)


def test_fans_are_looked_up_on_arrays_and_nothing_is_exploded(spark, sf):
    plan = registry.queries()["C12_B06_heading_fan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
