"""Messages, shorelines, stores, streams."""

import struct

import numpy as np

from galeframe.operators import grids
from galeframe.operators.common import shared_folder
from galeframe.sources import catalogue, grib2, land
from galeframe.streaming import ingest
from pyspark.sql import functions as F


def test_packings_round_trip():
    rng = np.random.default_rng(1)
    for packing in (0, 2, 3, 4):
        for v in (rng.normal(0, 30, 77).round(1), np.full(6, -3.5), np.where(rng.random(50) < 0.3, np.nan, rng.normal(100, 5, 50).round(1)), np.array([7.0])):
            got = list(grib2.messages(b"junk" + grib2.encode(v, 1, packing) + b"GRIBbroken" + grib2.encode(v + 1, 1, packing, step=6, member=3)))
            assert [(m["message"], m["step"], m["member"]) for m in got] == [(0, 0, 0), (1, 6, 3)]
            np.testing.assert_allclose(got[0]["values"], v, atol=1e-4)


def test_second_differences_are_summed_twice():
    x = np.array([5, 9, 4, 4, 30, 28], np.int64)
    d = np.diff(x, 2)
    low = int(d.min())
    body = b"".join(struct.pack(">I", abs(k) | (1 << 31 if k < 0 else 0)) for k in (5, 9, low))
    body += grib2._pack(np.array([0]), 1) + grib2._pack(np.array([6]), 3) + grib2._pack(np.concatenate([[0, 0], d - low]), 6)
    s5 = struct.pack(">IBIHfhhBB", 49, 5, 6, 3, 0.0, 0, 0, 1, 0) + struct.pack(">BBIIIBBIBIB", 1, 0, 0, 0, 1, 0, 3, 6, 0, 6, 0) + bytes([2, 4])
    assert grib2.field(s5, b"\0\0\0\6\6\xff", body, 6).tolist() == x.tolist()


def test_cells_of_a_file(spark, tmp_path):
    v = np.arange(12, dtype=float)
    (tmp_path / "a.grib2").write_bytes(grib2.encode(v, 4, 0, corners=(10.0, 20.0, 8.0, 23.0)))
    (tmp_path / "b.grib2").write_bytes(b"nothing")
    got = {(r["i"], r["j"]): (r["lat"], r["lon"], r["value"]) for r in grib2.cells(grib2.read_files(spark, str(tmp_path))).collect()}
    assert len(got) == 12 and got[(0, 0)] == (10.0, 20.0, 0.0) and got[(2, 3)] == (8.0, 23.0, 11.0) and got[(1, 0)][0] == 9.0


def test_lines_are_thinned_within_the_tolerance():
    rng = np.random.default_rng(2)
    xy = np.cumsum(rng.normal(0, 1, (200, 2)), axis=0)
    keep = land.far_points(xy, 1.5)
    at = np.flatnonzero(keep)
    assert keep[0] and keep[-1] and 2 < keep.sum() < 200
    for a, b in zip(at, at[1:], strict=False):
        d = xy[b] - xy[a]
        off = np.abs(d[0] * (xy[a:b, 1] - xy[a, 1]) - d[1] * (xy[a:b, 0] - xy[a, 0])) / np.hypot(*d)
        assert off.max() <= 1.5 + 1e-9


def test_shorelines(spark):
    def polygon(pid, level, points):
        return struct.pack(">11i", pid, len(points), level, *[0] * 8) + b"".join(struct.pack(">ii", int(x * 1e6), int(y * 1e6)) for x, y in points)

    ring = [(350.0, 1.0), (2.0, 1.0), (2.0, 3.0), (1.0, 4.0), (0.0, 3.0), (0.0, 2.0)]
    data = polygon(1, 1, ring[:3]) + polygon(99, 1, ring[:3]) + polygon(100, 2, ring) + polygon(101, 6, ring) + polygon(102, 1, ring)[:50]
    got = land.shorelines(spark.createDataFrame([(bytearray(data),), (None,)], "content binary")).collect()
    assert {r["poly_id"] for r in got} == {1, 101} and {r["lon"] for r in got if r["seq"] == 0} == {-10.0}
    e = land.edge_table(spark.createDataFrame(got)).where("poly_id = 101").orderBy("seq").collect()
    assert len(e) == 6 and (e[-1]["x2"], e[-1]["y2"]) == (-10.0, 1.0)


def test_publishing_and_retention(spark):
    root = f"{shared_folder(spark)}/store"
    cells = spark.range(64).select(F.lit("gfs").alias("model"), F.lit("20260601_00Z").alias("cycle"), F.lit("u").alias("variable"), F.lit(0).alias("step"), (F.col("id") / 8).cast("int").alias("i"), (F.col("id") % 8).cast("int").alias("j"), F.col("id").cast("double").alias("value"))
    catalogue.write_cycle(cells, f"{root}/cells")
    assert spark.read.parquet(f"{root}/cells").where("i = 3 and j = 2").first()["value"] == 26.0
    catalogue.publish(spark, root, "gfs", "20260601_00Z")
    catalogue.publish(spark, root, "gfs", "20260601_06Z")
    assert [tuple(r) for r in catalogue.latest(spark, root).collect()] == [("gfs", "20260601_06Z")]
    c = spark.createDataFrame([("a", f"2026060{k}_00Z") for k in range(1, 6)], "model string, cycle string")
    assert {r["cycle"] for r in catalogue.expired(c, 0).collect()} == {"20260601_00Z", "20260602_00Z", "20260603_00Z"}


def test_only_newer_cycles_are_written(spark):
    base = f"{shared_folder(spark)}/newer"
    each = ingest.newer_cycles(None, f"{base}/done", lambda df: df.write.mode("append").parquet(f"{base}/out"))
    row = lambda *cycles: spark.createDataFrame([("gfs", x, 1.0) for x in cycles], "model string, cycle string, value double")
    each(row("20260601_06Z"), 0)
    each(row("20260601_00Z", "20260601_12Z"), 1)
    assert sorted(r["cycle"] for r in spark.read.parquet(f"{base}/out").collect()) == ["20260601_06Z", "20260601_12Z"]


def test_steps_complete_once_over_several_batches(spark):
    folder = f"{shared_folder(spark)}/landing"
    for k, rows in enumerate(([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 5.0)], [("a", 2, 3.0), ("b", 0, 4.0)], [("a", 1, 9.0), ("b", 1, 6.0)])):
        spark.createDataFrame(rows, "step string, member int, value double").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    s = spark.readStream.schema("step string, member int, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    assert [tuple(r) for r in ingest.to_table(ingest.complete_steps(s, 3)).collect()] == [("a", 3, 2.0, 1.0, 3.0)]


def test_regions_are_coarsened():
    s = grids.region_steps(10, 25, -70, -55)
    assert s > 0.25 and (round(15 / s) + 1) ** 2 <= 120 < (round(15 / (s / 1.2)) + 1) ** 2


def test_entry_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for gone in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("galeframe.llm.")]:
        monkeypatch.delitem(sys.modules, gone)
    for name in ("galeframe.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # an import of it fails
    names = entry.queries()
    assert "I01_point_forecast" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(names)
