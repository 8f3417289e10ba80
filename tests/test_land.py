"""Points, legs and polygons on inputs that the small tables lack."""

import os

from pyspark.sql import functions as F

from galeframe import tables
from galeframe.operators import joins
from galeframe.plans import registry
from tests.compare import TABLES, difference


def with_events(sf, folder, events):
    """The tables of ``sf`` with other events, as a folder."""
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", folder / f"{t}.parquet")
    events.coalesce(1).write.parquet(str(folder / "made"))
    part = next(n for n in os.listdir(folder / "made") if n.endswith(".parquet"))
    os.link(folder / "made" / part, folder / "events.parquet")
    return str(folder)


def test_a_leg_without_length_is_not_blocked(spark, sf, tmp_path):
    calm = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5 * 40.0).otherwise(F.col("value"))  # a wind of 0
    at = with_events(sf, tmp_path, tables.read(spark, sf, "events").withColumn("value", calm))
    query = registry.queries()["C11_segment_land"]
    still = query(spark, at).where("event_id % 3 = 0")
    on_land = registry.queries()["C10_points_in_polygons"](spark, at).where("event_id % 3 = 0")
    assert on_land.count() > 20 and still.where("blocked").count() == 0 and still.count() == 334
    assert difference(query(spark, at), registry.oracle_sql()["C11_segment_land"], at) == ""


def test_points_of_a_place_are_compared_with_polygons_once(spark, sf, tmp_path):
    events = tables.read(spark, sf, "events")
    copies = [events.withColumns({"event_id": F.col("event_id") + 3600 * k, "user_id": F.col("user_id") + 15 * k}) for k in range(3)]  # the same places
    at = with_events(sf, tmp_path, copies[0].unionByName(copies[1]).unionByName(copies[2]))
    got = registry.queries()["A41_C10_shore_points"](spark, at)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(_keys" in plan.split("SortMergeJoin")[0] and "BroadcastHashJoin" not in plan  # points come back after the join
    assert difference(got, registry.oracle_sql()["A41_C10_shore_points"], at) == ""


def test_places_are_dealt_in_rows_of_bounded_length(spark, monkeypatch):
    box = [(1, 0.0, 0.0, 2.5, 0.0), (1, 2.5, 0.0, 2.5, 2.5), (1, 2.5, 2.5, 0.0, 2.5), (1, 0.0, 2.5, 0.0, 0.0)]
    sides = spark.createDataFrame(box + [(2, *x[1:]) for x in box], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    at = [(k, "a", 1.5, 1.5) for k in range(7)] + [(7, "b", 1.5, 2.6), (8, "b", 0.2, 0.3), (8, "b", 0.2, 0.3), (9, None, 0.2, 0.3), (10, "c", None, 0.3)]
    points = spark.createDataFrame(at, "id int, name string, lat double, lon double")
    want, met, plain = joins.points_in_polygons(points, sides, ["id", "name"]), [], joins.points_in_polygons
    monkeypatch.setattr(joins, "points_in_polygons", lambda p, *rest: met.append(p) or plain(p, *rest))
    got = joins.places_in_polygons(points, sides, ["id", "name"], each=3)
    assert got.columns == want.columns == ["id", "name", "poly_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.count() == 2 * 10
    assert sorted(len(r["_keys"]) for r in met[0].where("lat is not null").collect()) == [1, 1, 3, 3, 3]
