"""Stored winds against plain Python, searches in them, and ways by parent."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galeframe.functions import sailing
from galeframe.operators import joins, search
from galeframe.operators.weather import Chosen, Field, Lattice, StoredWinds
from galeframe.plans import forecast, registry, relational
from galeframe.plans import search as plans
from tests.test_search import plain, routes

MS = 1852.0 / 3600.0
CELLS = "i int, j int, hour double, u double, v double"


def stored(spark, rows, at=(0.0, 2.0, -20.0, 5.0), **more):
    cells = spark.createDataFrame(rows, CELLS)
    return StoredWinds(cells, Lattice.of(cells, *at), **more)


def look(cells, lattice, lat, lon, hour):
    """(tws, twd) by the eight corners that have a value, as a plain loop."""
    y = min(max((lat - lattice.lat) / lattice.lat_step, 0), lattice.n_lat - 1)
    x = (lon - lattice.lon) % 360.0 / lattice.lon_step
    x = 0.0 if x > lattice.n_lon - 1 else x
    hours = lattice.hours
    k = max([n for n in range(len(hours)) if hours[n] <= hour], default=0)
    k = min(k, max(len(hours) - 2, 0))
    f = min(max((hour - hours[k]) / (hours[k + 1] - hours[k]), 0), 1) if len(hours) > 1 else 0.0
    uv = []
    for c in (0, 1):
        total = weight = 0.0
        for s, fs in ((k, 1 - f), (k + 1, f)):
            for i, fi in ((math.floor(y), 1 - y % 1), (math.floor(y) + 1, y % 1)):
                for j, fj in ((math.floor(x), 1 - x % 1), (math.floor(x) + 1, x % 1)):
                    w = fs * fi * fj
                    value = cells.get((i, j, hours[s] if s < len(hours) else None), (None, None))[c]
                    if w > 0 and value is not None and not math.isnan(value):
                        total, weight = total + w * value, weight + w
        uv.append(total / weight if weight >= 1e-6 else None)
    return None if None in uv else (math.hypot(*uv) / MS, math.degrees(math.atan2(-uv[0], -uv[1])) % 360)


def cells_of(rows):
    found = {}
    for i, j, h, u, v in rows:
        found.setdefault((i, j, h), ([], []))
        for x, own in zip((u, v), found[i, j, h], strict=True):
            if x is not None and not math.isnan(x):
                own.append(x)
    return {k: tuple(sum(x) / len(x) if x else None for x in v) for k, v in found.items()}


@pytest.mark.parametrize("size", [2, 3, 16])
@pytest.mark.parametrize("hours", [(0.0,), (0.0, 3.0, 12.0, 15.0)])
def test_stored_winds_at_any_place(spark, size, hours):
    rng = random.Random(3)
    odd = lambda: rng.choice([None, float("nan"), *[rng.uniform(-9, 9) for _ in range(8)]])
    rows = [(i, j, h, odd(), odd()) for i in range(7) for j in range(9) for h in hours if rng.random() < 0.9]
    rows += [(6, 8, hours[-1], 1.0, 2.0), (6, 8, hours[-1], 3.0, None), (0, 0, None, 1.0, 1.0)]  # a cell given twice, a row without an hour
    winds = stored(spark, rows, size=size)
    cells, n = cells_of(rows), winds.lattice
    places = [(rng.uniform(-10, 25), rng.uniform(-400, 400), rng.uniform(-5, 30)) for _ in range(200)] + [(12.0, 20.0, 15.0), (0.0, -20.0, 0.0), (90.0, 180.0, 99.0), (4.0, -10.0, 3.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "k int, lat double, lon double, h double")
    got = {r["k"]: r for r in winds.over("lat", "lon", F.col("h"))(df, (-5.0, 99.0)).collect()}
    assert len(got) == len(places)
    for k, p in enumerate(places):
        want = look(cells, n, *p)
        if want is None:
            assert got[k]["wind_tws"] is None and got[k]["wind_twd"] is None
        else:
            assert math.isclose(got[k]["wind_tws"], want[0], abs_tol=1e-9)
            assert abs((got[k]["wind_twd"] - want[1] + 180) % 360 - 180) < 1e-6


def test_empty_grid_is_a_breeze(spark):
    winds = stored(spark, [])
    df = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    assert [tuple(r) for r in winds.over("lat", "lon", F.lit(0.0))(df).collect()] == [(1.0, 2.0, 12.0, 45.0)]


def test_providers_by_name(spark):
    field = Field(lambda lat, lon, hour: (lat * 1.0, lon * 1.0))
    winds = Chosen({"a": stored(spark, [(0, 0, 0.0, 0.0, -MS)]), "b": field}, "who")
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, "b"), (5.0, 6.0, "z"), (7.0, 8.0, None)], "lat double, lon double, who string")
    got = {r["lat"]: (r["wind_tws"], r["wind_twd"]) for r in winds.over("lat", "lon", F.lit(0.0))(df).collect()}
    assert got[3.0] == (3.0, 4.0) and got[5.0] == got[7.0] == (None, None) and math.isclose(got[1.0][0], 1.0) and got[1.0][1] == 0.0


def test_search_on_stored_wind_is_that_of_plain_python(spark):
    rng = random.Random(8)
    rows = [(i, j, h, -rng.uniform(3, 8), -rng.uniform(1, 6)) for i in range(14) for j in range(8) for h in (0.0, 6.0, 24.0)]
    winds = stored(spark, rows, size=4)
    cells, cfg = cells_of(rows), search.Config(step_hours=4.0, max_nodes=25, fan_deg=15)
    found = search.route_search(routes(spark), winds, cfg)
    got = {r["route_id"]: r for r in search.outcomes(found).collect()}
    for r in routes(spark).where("route_id < 3").collect():
        best, reached = plain((r["start_lat"], r["start_lon"]), (r["dest_lat"], r["dest_lon"]), None, None, cfg, lambda p, hour: look(cells, winds.lattice, *p, hour))
        g = got[r["route_id"]]
        assert g["reached"] == reached and math.isclose(g["duration_hours"], best["step"] * cfg.step_hours)
        assert math.isclose(g["distance_nm"], best["nm"], rel_tol=1e-9)
    assert "path" not in found.nodes.columns


def test_no_wind_no_way_on(spark):
    calm = stored(spark, [(i, j, 0.0, None, 1.0) for i in range(3) for j in range(3)])
    out = search.outcomes(search.route_search(routes(spark), calm, search.Config(step_hours=4.0, max_nodes=5))).collect()
    assert [(r["duration_hours"], r["reached"]) for r in out] == [(0.0, False)] * 2


@pytest.mark.parametrize("steps", [0, 1, 2, 7, 20])
def test_ancestors_by_pointer_doubling(spark, steps):
    rng = random.Random(steps)
    parent = {(r, s, i): (rng.randrange(5) if s else None) for r in range(3) for s in range(steps + 1) for i in range(5)}
    ends = [(r, rng.randrange(steps + 1), rng.randrange(5)) for r in range(3)]
    want = set()
    for r, s, i in ends:
        while s >= 0:
            want.add((r, s, i))
            s, i = s - 1, parent[r, s, i]
    nodes = spark.createDataFrame([(*k, p) for k, p in parent.items()], "route_id int, step int, idx int, parent int")
    got = [tuple(r) for r in search.ancestors(nodes, spark.createDataFrame(ends, "route_id int, step int, idx int"), steps).collect()]
    assert len(got) == len(want) and set(got) == want


def test_interpolation_in_time_leaves_gaps_out(spark):
    spec = {"lat_start": 10.0, "lat_step": 1.0, "nlats": 3, "lon_start": 0.0, "lon_step": 1.0, "nlons": 3}
    grid = spark.createDataFrame([(0, 0, 0, 10.0), (0, 1, 0, 10.0), (1, 0, 0, None), (1, 1, 0, 10.0), (0, 0, 3, float("nan")), (0, 1, 3, 10.0)], "i int, j int, step int, u double")
    p = spark.createDataFrame([(1, 9.5, 0.5, 0.0), (2, 9.5, 0.5, 3.0), (3, 9.0, 0.0, 0.0)], "id int, lat double, lon double, hour double")
    got = {r["id"]: r["u"] for r in joins.interpolate_in_time(p, grid, spec, ["id"], "hour", 3.0, 3.0, ["u"]).collect()}
    assert math.isclose(got[1], 10.0) and math.isclose(got[2], 10.0) and got[3] is None


def test_boxes_have_their_own_lattices(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.5, None, 0.0), (2, 5.0, 5.0, 0.0, 0.0, 2.0, 0.0), (3, 0.0, 0.0, 1.0, 2.0, -1.0, 0.0)], "k int, min_lat double, min_lon double, lat_span double, lon_span double, step double, hour double")
    got = search.weather_grid(boxes, lambda lat, lon, hour: (lat, lon), "k").collect()
    assert sorted((r["k"], r["gi"], r["gj"]) for r in got) == [(1, i, j) for i in range(3) for j in range(2)] + [(2, 0, 0)] + [(3, i, j) for i in range(2) for j in range(2)]


def test_windows_fall_back_to_the_synthetic_field(spark, sf):
    lattice = Lattice(0.0, 1.0, 41, -80.0, 1.0, 61, (0.0,))
    r = spark.createDataFrame([(1, 10.0, -50.0, 12.0, -52.0), (2, 4.0, -50.0, 12.0, -52.0), (3, 10.0, -25.0, 12.0, -52.0)], "route_id int, start_lat double, start_lon double, dest_lat double, dest_lon double")
    assert [x["provider"] for x in search.with_provider(r, lattice).orderBy("route_id").collect()] == ["stored", "synthetic", "synthetic"]
    ranked = forecast.I15_I21_windows_with_fallback(spark, sf).collect()
    assert ranked and all(x["provider"] in ("stored", "synthetic") for x in ranked)


def test_models_are_sailed_apart(spark, sf):
    """A model's passage alone, in plain Python on the same cells, is that of the query."""
    from galeframe.plans import services

    got = {(r["passage"], r["model"]): r for r in services.I20_route_by_model(spark, sf).collect()}
    assert len(got) == 75
    rows = [(r["i"], r["j"], r["hour"], r["u"], r["v"]) for r in forecast.stored_cells(spark, sf).collect()]
    lattice = Lattice.of(spark.createDataFrame(rows, CELLS), *forecast.STORED)
    cells, cfg = cells_of(rows), search.Config(step_hours=6.0, max_nodes=40, arrival_nm=30.0)
    p = next(r for r in plans.passages(spark, sf).collect() if r["route_id"] == 1)
    best, reached = plain((p["start_lat"], p["start_lon"]), (p["dest_lat"], p["dest_lon"]), None, None, cfg, lambda at, hour: look(cells, lattice, *at, p["dep_h"] + hour))
    r = got[1, "gfs_0p25"]
    assert r["reached"] == reached and r["duration_hours"] == best["step"] * 6.0 and math.isclose(r["distance_nm"], best["nm"], abs_tol=1e-5)
    assert r["ensemble"] == "gefs_0p50" and len({got[1, m]["distance_nm"] for m in ("gfs_0p25", "ifs_0p25", "icon_global")}) == 3


def test_plans_of_the_polar_stay_short(spark, sf):
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert plan(plans.C12_B06_heading_fan(spark, sf)) < 60_000
    x = spark.range(3).select(sailing.polar_speed(F.col("id") * 3.0, F.col("id") * 40.0).alias("s")).select(sailing.polar_speed(F.col("s"), F.col("s") + 30.0))
    assert plan(x) < 60_000


def broadcasts(df):
    """The broadcasts of a plan, as text; none of them may hold rows that grow."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]


def test_no_points_are_broadcast_to_polygons(spark, sf):
    """An exploded table is estimated from its file, and is far larger."""
    assert registry.queries()["I18_G04_envelope"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 3
    assert broadcasts(registry.queries()["I18_G04_envelope"](spark, sf)) == []


@pytest.mark.parametrize("of", ["place", "time"])
def test_no_more_of_a_grid_is_joined_than_its_lattice_has(spark, of):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    spec = {**relational.SPEC, "nlats": 4, "nlons": 5}
    grid = spark.range(4000).selectExpr("cast(id div 50 - 2 as int) as i", "cast(id % 50 as int) as j", "0 as step", "double(id) as x").withColumn("value", counted("x"))
    points = spark.createDataFrame([(1, 9.75, -11.75, 0.0), (2, 9.0, -10.5, 0.0)], "id int, lat double, lon double, hour double")
    if of == "place":
        got = joins.interpolate(points, grid, spec, ["id"])
    else:
        got = joins.interpolate_in_time(points, grid, spec, ["id"], "hour", 3.0, 3.0, ["value"])
    assert sorted((r["id"], r["value"]) for r in got.select("id", "value").collect()) == [(1, 125.5), (2, 203.0)]
    assert 0 < seen.value <= 20 * 2  # the plan may read the grid twice, not the rest of it


@pytest.mark.parametrize("name", ["I01_point_forecast", "A51_store_dump", "H24_wind_in_time", "I21_wind_or_synthetic"])
def test_broadcasts_of_stepped_grids_are_bounded_by_the_lattice(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 40" in plan and "<= 49" in plan


def test_pairs_of_points_and_polygons_are_not_shuffled(spark):
    sides = spark.createDataFrame([(1, 0.0, 0.0, 2.5, 0.0), (1, 2.5, 0.0, 2.5, 2.5), (1, 2.5, 2.5, 0.0, 2.5), (1, 0.0, 2.5, 0.0, 0.0)], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 1.5, 1.5), (2, 1.5, 1.5), (3, 2.6, 1.0), (4, 2.4, 2.4)], "id int, lat double, lon double")
    got = joins.points_in_polygons(points, sides, ["id"])
    assert "hashpartitioning(id" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 1), (4, 1)]  # repeated points stay
