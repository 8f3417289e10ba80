"""Compact shorelines: written in two phases, read by box, and rings across the antimeridian."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

from galeframe.operators import joins, regions
from galeframe.operators.common import listed, shared_folder
from galeframe.sources import land, shore


def circle(pid, lat, lon, n=40, r=2.0):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return [(pid, k, float((lon + r * np.cos(x) + 180) % 360 - 180), float(lat + r * np.sin(x))) for k, x in enumerate(t)]


def points(spark, *rings):
    return spark.createDataFrame([p for r in rings for p in r], "poly_id int, seq int, lon double, lat double")


@pytest.fixture
def path(spark):
    shore.register(spark)
    return f"{shared_folder(spark)}/shore-{uuid.uuid4().hex}"


def written(spark, path, *rings, mode="append"):
    shore.rings(points(spark, *rings)).repartition(2).write.format("shoreline").mode(mode).save(path)
    return spark.read.format("shoreline").load(path)


def test_round_trip_append_and_overwrite(spark, path):
    e = written(spark, path, circle(1, 10, 20), circle(2, -30, 40, n=16))
    got = e.groupBy("poly_id", "name").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("c")).orderBy("poly_id").collect()
    assert [tuple(r) for r in got] == [(1, "Land #1", 40, 3), (2, "Land #2", 16, 1)]
    first = e.where("poly_id = 1").orderBy("seq").collect()
    want = circle(1, 10, 20)
    for k, r in enumerate(first):
        assert np.allclose((r["x1"], r["y1"], r["x2"], r["y2"]), (*want[k][2:], *want[(k + 1) % 40][2:]), atol=1e-5)
        own = [x for x in first if x["chunk"] == r["chunk"]]
        assert r["min_lat"] == min(min(x["y1"], x["y2"]) for x in own) and r["max_lon"] == max(max(x["x1"], x["x2"]) for x in own)
    assert written(spark, path, circle(3, 0, 0)).select("poly_id").distinct().count() == 3
    assert written(spark, path, circle(4, 0, 0), mode="overwrite").select("poly_id").distinct().count() == 1
    assert [n for n in listed(spark, path) if not n.startswith(".")] == ["_committed", *shore.committed(path)]


def test_a_failed_write_is_not_seen(spark, path):
    written(spark, path, circle(1, 10, 20))
    bad = shore.rings(points(spark, circle(2, 0, 0), circle(3, 0, 0))).withColumn("name", F.when(F.col("poly_id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(2).write.format("shoreline").mode("append").save(path)
    assert spark.read.format("shoreline").load(path).select("poly_id").distinct().collect()[0][0] == 1
    task = shore.ShoreWriter(path, False)
    staged = task.write(iter(shore.rings(points(spark, circle(5, 0, 0))).toArrow().to_batches()))
    assert spark.read.format("shoreline").load(path).count() == 40  # not committed yet
    task.abort([staged, None])
    assert [n for n in listed(spark, path) if n.startswith("part-")] == shore.committed(path)


def test_boxes_are_pushed_down_and_skipped(spark, path):
    e = written(spark, path, *[circle(k, -60 + 6 * k, 10 * k, n=64) for k in range(20)])
    near = shore.near(spark, path, 31.0, 33.0, 140.0, 160.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # the source does it all
    got = {tuple(r) for r in near.select("poly_id", "chunk", "seq").collect()}
    want = {tuple(r) for r in e.cache().where("max_lat >= 31 and min_lat <= 33 and max_lon >= 140 and min_lon <= 160").select("poly_id", "chunk", "seq").collect()}
    assert got == want and 0 < len(got) < 64
    reader = shore.ShoreReader(path)
    assert list(reader.pushFilters([GreaterThanOrEqual(("max_lat",), 31.0), LessThanOrEqual(("min_lat",), 33.0), LessThanOrEqual(("seq",), 3)])) == [LessThanOrEqual(("seq",), 3)]
    built = []
    reader.edges, real = (lambda *a: built.append(a[0]) or real(*a)), reader.edges
    for p in reader.partitions():
        list(reader.read(p))
    assert sorted(built) == [15]  # the other nineteen were passed over by their own boxes


def test_rings_across_the_antimeridian(spark):
    rings = [circle(1, 0, 179.5, n=30), circle(2, 10, -179.0, n=30), circle(3, 0, 170, n=30), circle(4, -20, 0, n=30)]
    u = land.unwrapped(points(spark, *rings))
    assert {r["poly_id"]: r["n"] for r in u.groupBy("poly_id").agg(F.count_distinct("copy").alias("n")).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    from pyspark.sql import Window

    w = Window.partitionBy("poly_id", "copy").orderBy("seq")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda x: F.coalesce(F.lead(x).over(w), F.first(x).over(ring))
    sides = u.select("poly_id", "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))
    rng = random.Random(2)
    places = [(k, rng.uniform(-25, 15), rng.choice([rng.uniform(165, 180), rng.uniform(-180, -175), rng.uniform(-3, 3)])) for k in range(600)]
    got = {tuple(r) for r in joins.points_in_polygons(spark.createDataFrame(places, "id int, lat double, lon double"), sides, ["id"]).collect()}

    def inside(lat, lon, ring):
        near = [(lat2 - lat, (lon2 - lon + 180) % 360 - 180) for _, _, lon2, lat2 in ring]  # the rings are small
        if any(abs(x) > 90 for _, x in near):
            return False
        hits = 0
        for (y1, x1), (y2, x2) in zip(near, near[1:] + near[:1], strict=True):
            if (y1 > 0) != (y2 > 0) and 0 < (x2 - x1) * -y1 / (y2 - y1) + x1:
                hits += 1
        return hits % 2 == 1

    want = {(k, ring[0][0]) for k, lat, lon in places for ring in rings if inside(lat, lon, ring)}
    assert got == want and len({p for _, p in want}) == 4


def test_thinning_closes_rings_and_keeps_three(spark):
    flat = [(9, k, k * 1e-6, 0.0) for k in range(5)]
    line = [(1, k, float(k), 0.0 if k != 3 else 2.0) for k in range(7)]
    got = {}
    for r in land.thinned(points(spark, flat, line)).orderBy("seq").collect():
        got.setdefault(r["poly_id"], []).append((r["lon"], r["lat"]))
    assert len(got[9]) == 4 and got[9][0] == got[9][-1]
    assert got[1] == [(0.0, 0.0), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0), (6.0, 0.0), (0.0, 0.0)]


def test_boxes_of_any_size_meet_polygons_once(spark):
    """Against plain Python; pairs are decided where they meet: nothing is exchanged after the join."""
    rng = random.Random(7)
    corner = lambda low, high, most: (a := rng.uniform(low, high), a + rng.choice((0.0, 0.3, 1.0, most)) * rng.random())
    boxes = [(k, *corner(-90, 80, 100.0), *corner(-180, 170, 360.0)) for k in range(300)] + [(300, -3.0, -3.0, 5.0, 5.0), (301, -90.0, 90.0, -180.0, 180.0)]
    chunks = [(pid, n, *(x + d for x, d in zip(at, (0, n, 0, n), strict=True))) for pid in range(120) for at in [(*corner(-90, 80, 20.0), *corner(-180, 170, 40.0))] for n in range(3)]
    want = set()
    for pid in range(120):
        own = [c[2:] for c in chunks if c[0] == pid]
        low_lat, high_lat, west, east = (f(c[k] for c in own) for k, f in enumerate((min, max, min, max)))
        for key, a, b, w, e in boxes:
            meets = high_lat >= a and low_lat <= b and east >= w and west <= e
            if meets and any(np.floor(c[0]) <= np.floor(b) and np.floor(c[1]) >= np.floor(a) and np.floor(c[2]) <= np.floor(e) and np.floor(c[3]) >= np.floor(w) for c in own):
                want.add((key, pid))
    sides = ", ".join(f"{x} double" for x in regions.BOX)
    df = regions.touched(spark.createDataFrame(boxes + boxes[:9], f"k int, {sides}"), "k", spark.createDataFrame(chunks, f"poly_id int, chunk int, {sides}"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin")[0] and "BroadcastExchange" not in plan
