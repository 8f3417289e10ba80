"""Whole cycles that are committed or not seen, and state that ends."""

import uuid

import pytest
from pyspark.sql import functions as F

from galeframe.operators.common import listed, put_once, read_text, shared_folder
from galeframe.plans import registry
from galeframe.streaming import cycles, ingest, steps
from tests.compare import difference

SCHEMA = "model string, cycle string, variable string, value double"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA).coalesce(1)


def seen(spark, root):
    return sorted((r["model"], r["cycle"], r["variable"], r["value"]) for r in cycles.visible(spark, root, SCHEMA).collect())


def fails_on(variable):
    return lambda b: b.withColumn("value", F.when(F.col("variable") == variable, F.raise_error(F.lit("unreadable"))).otherwise(F.col("value")))


def test_a_batch_is_published_once_or_not_at_all(spark):
    root = f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}"
    one, two = ("gfs", "2026-06-01", "u", 1.0), ("gfs", "2026-06-01", "v", 2.0)
    assert seen(spark, root) == []
    with pytest.raises(Exception, match="unreadable"):
        cycles.commit_cycles(root, fails_on("v"))(rows(spark, one, two), 0)
    assert seen(spark, root) == [] and listed(spark, f"{root}/staged") == []  # not the variable that was read either
    publish = cycles.commit_cycles(root, lambda b: b)
    publish(rows(spark, one, two), 0)
    publish(rows(spark, one, two), 0)  # again, as after a failure before the stream's own commit
    assert seen(spark, root) == [one, two]
    assert cycles.high_water(spark, root) == {"gfs": "2026-06-01"}
    publish(rows(spark, ("gfs", "2026-05-31", "u", 3.0), ("gfs", "2026-06-01", "w", 3.0), ("gfs", "2026-06-02", "u", 4.0), ("icon", "2026-01-01", "u", 5.0)), 1)
    assert seen(spark, root) == [one, two, ("gfs", "2026-06-02", "u", 4.0), ("icon", "2026-01-01", "u", 5.0)]
    publish(rows(spark), 2)
    publish(rows(spark, ("gfs", "2020-01-01", "u", 9.0)), 3)
    assert len(seen(spark, root)) == 4 and sorted(cycles.manifests(spark, root)) == [0, 1, 2, 3]


def test_staged_files_without_a_manifest_are_not_seen(spark):
    root = f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}"
    rows(spark, ("gfs", "2026-06-01", "u", 1.0)).write.partitionBy("model", "cycle").parquet(f"{root}/staged/batch=0")
    assert seen(spark, root) == []
    cycles.commit_cycles(root, lambda b: b)(rows(spark, ("gfs", "2026-06-01", "u", 2.0)), 0)  # what a killed driver left is replaced
    assert seen(spark, root) == [("gfs", "2026-06-01", "u", 2.0)]


def test_a_name_is_put_once(spark):
    path = f"{shared_folder(spark)}/put-{uuid.uuid4().hex}"
    assert put_once(spark, path, "first é") and not put_once(spark, path, "second")
    assert read_text(spark, path) == "first é"


def test_a_restarted_stream_goes_on_with_the_batch_that_failed(spark):
    folder = ingest.landing(spark, [rows(spark, ("a", f"c{k}", v, float(k))) .unionByName(rows(spark, ("a", f"c{k}", "u", 0.5))).coalesce(1) for k, v in enumerate(("v", "bad", "v"))])
    root, slices = f"{folder}-store", ingest.stream_of(spark, folder, "*.parquet")
    with pytest.raises(Exception, match="unreadable"):
        cycles.start(slices, root, fails_on("bad")).awaitTermination()
    assert [r[1] for r in seen(spark, root)] == ["c0", "c0"]
    cycles.start(slices, root, lambda b: b).awaitTermination()
    assert sorted(r[1] for r in seen(spark, root)) == ["c0", "c0", "c1", "c1", "c2", "c2"]


def arrivals(spark, deliveries, delay):
    made = [spark.createDataFrame(d, "step string, member int, value double, t string").withColumn("t", F.to_timestamp("t")).coalesce(1) for d in deliveries]
    return ingest.stream_of(spark, ingest.landing(spark, made), "*.parquet").withWatermark("t", delay)


def run(spark, stream):
    base = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    out = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{base}/out").orderBy("step", "mean").collect()]
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_of_steps_ends(spark):
    day = "2026-06-0{} 00:00"
    deliveries = [
        [("a", 0, 3.0, day.format(1)), ("a", 1, 5.0, day.format(1)), ("a", 1, 4.0, day.format(1)), ("b", 0, 1.0, day.format(1))],
        [("a", 0, -1.0, day.format(1)), ("a", 1, -1.0, day.format(1)), ("b", 0, 7.0, day.format(1))],  # late copies within the limit
        [("z", 0, 0.0, day.format(3)), ("z", 1, 0.0, day.format(3))],  # the watermark passes the limit of a and b
        [("z", 1, 9.0, day.format(3)), ("y", 0, 0.0, day.format(9))],
        [("x", 0, 0.0, "2026-07-01 00:00")],
    ]
    with steps.timed_state(spark):
        out, rows_kept = run(spark, steps.expiring_steps(arrivals(spark, deliveries, "1 hour"), 2, keep_hours=12.0))
    assert out == [("a", 2, 3.5, 3.0, 4.0), ("z", 2, 0.0, 0.0, 0.0)]
    assert max(rows_kept) >= 4 and rows_kept[-1] <= 2  # x alone: a value and its limit
    assert spark.conf.get(steps.STORE) != steps.ROCKS


def test_rows_of_one_delivery_are_not_late_by_each_other(spark):
    """A delivery of several files, the last hours in the first of them."""
    hour = lambda h: f"2026-06-01 {h:02d}:30"
    delivery = lambda hours: spark.createDataFrame([("a", 1.0, hour(h)) for h in hours], "k string, value double, t string").withColumn("t", F.to_timestamp("t")).repartitionByRange(4, F.desc("t"))
    w = ingest.in_turn(spark, [delivery(range(23, -1, -1)), delivery([0, 1, 23])], lambda s: ingest.windows(s, "k"))
    assert sorted((r["start"].hour, r["n"], r["total"]) for r in w.collect()) == [(0, 6, 6.0), (6, 6, 6.0), (12, 6, 6.0)]


def test_streams_read_deliveries_of_many_files(spark, sf, monkeypatch):
    """Nothing whole goes through one task on its way into a landing folder, and no row is lost for it."""
    landed, whole = [], ingest.landing

    def cut(spark, deliveries, folder=None):
        landed.extend(d._jdf.queryExecution().optimizedPlan().toString().count("Repartition 1, false") for d in deliveries)
        return whole(spark, [d.repartition(3) for d in deliveries], folder)

    monkeypatch.setattr(ingest, "landing", cut)
    for name in ("J10_event_windows", "J05_expiring_steps", "J02_J06_whole_cycles", "J01_J08_polled_progress"):
        assert difference(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf) == "", name
    assert len(landed) == 12 and not any(landed)
