"""Shorelines: reading, thinning, and the tables that point tests join."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS, ALWAYS, FEWEST = (1, 6), 50, 6


def shorelines(files: DataFrame, content: str = "content") -> DataFrame:
    """(poly_id, level, seq, lon, lat) of files of polygons: 11 big-endian integers, then points in millionths of a degree.

    Levels 1 and 6 stay; polygons under six points go unless their number is 50 or less. A truncated last polygon is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                at = 0
                while data and at + 44 <= len(data):
                    pid, n, flag = struct.unpack_from(">iii", data, at)
                    level, end = flag & 0xFF, at + 44 + 8 * n
                    if n < 0 or end > len(data):
                        break
                    if level in LEVELS and (n >= FEWEST or pid <= ALWAYS):
                        xy = np.frombuffer(data, ">i4", 2 * n, at + 44).reshape(n, 2) / 1e6
                        lon = np.where(xy[:, 0] > 180, xy[:, 0] - 360, xy[:, 0])
                        cols = [np.full(n, pid, np.int32), np.full(n, level, np.int32), np.arange(n, dtype=np.int32), lon, xy[:, 1].copy()]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["poly_id", "level", "seq", "lon", "lat"])
                    at = end

    return files.select(content).mapInArrow(run, "poly_id int, level int, seq int, lon double, lat double")


def raw_rings(rings: DataFrame) -> DataFrame:
    """(content): each ring (poly_id, level, points array of (lon, lat)) as the bytes that ``shorelines`` reads; longitudes from 0 to 360."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for pid, level, points in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                xy = np.round(np.array([(p["lon"] % 360.0, p["lat"]) for p in points]).reshape(-1, 2) * 1e6).astype(">i4")
                box = [f(xy[:, k]) for k in (0, 1) for f in (np.min, np.max)] if len(xy) else [0] * 4
                made.append(struct.pack(">11i", pid, len(xy), level, *map(int, box), 0, 0, -1, -1) + xy.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["content"])

    return rings.select("poly_id", "level", "points").mapInArrow(run, "content binary")


def tolerance(poly_id: Column, points: Column) -> Column:
    """How far a thinned ring may be off, degrees: coarse for the six continents, fine for small islands."""
    return F.when(poly_id <= 5, 0.022).when(points > 1000, 0.004).when(points > 100, 0.0012).otherwise(0.0008)


def thinned(points: DataFrame) -> DataFrame:
    """Rings (poly_id, seq, lon, lat) thinned by ``tolerance``, closed by their first point; a ring that would have under three points keeps its first three. A ring is one group."""

    def thin(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        xy = np.stack([table.column(c).to_numpy() for c in ("lon", "lat")], 1)
        kept = xy[far_points(xy, table.column("_off")[0].as_py())] if len(xy) > 2 else xy
        kept = kept if len(kept) >= 3 else xy[:3]
        if len(kept) and (kept[0] != kept[-1]).any():
            kept = np.concatenate([kept, kept[:1]])
        cols = [pa.array(np.full(len(kept), key[0].as_py(), np.int32)), pa.array(np.arange(len(kept), dtype=np.int32)), pa.array(kept[:, 0].copy()), pa.array(kept[:, 1].copy())]
        return pa.table(cols, ["poly_id", "seq", "lon", "lat"])

    n = F.count(F.lit(1)).over(Window.partitionBy("poly_id"))
    sized = points.select(F.col("poly_id").cast("int"), "seq", F.col("lon").cast("double"), F.col("lat").cast("double"), tolerance(F.col("poly_id"), n).alias("_off"))
    return sized.groupBy("poly_id").applyInArrow(thin, "poly_id int, seq int, lon double, lat double")


def unwrapped(points: DataFrame) -> DataFrame:
    """Rings (poly_id, seq, lon, lat) without jumps at the antimeridian, where point tests go on as ever.

    Longitudes go on past 180 or -180 where the next point is nearer that way;
    a ring that does so is there twice, once on either side of the map (with
    ``copy`` 1 for the second), so that a longitude from -180 to 180 meets it
    from both sides.
    """
    w = Window.partitionBy("poly_id").orderBy("seq")
    turns = F.sum(F.round((F.col("lon") - F.coalesce(F.lag("lon").over(w), F.col("lon"))) / 360.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = points.withColumn("_turns", turns).withColumn("lon", F.col("lon") - F.col("_turns") * 360.0)
    ring = Window.partitionBy("poly_id")
    p = p.withColumns({"_low": F.min("lon").over(ring), "_high": F.max("lon").over(ring)})
    shifts = F.when(F.col("_high") > 180.0, F.array(F.lit(0.0), F.lit(-360.0))).when(F.col("_low") < -180.0, F.array(F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0)))
    p = p.select("*", F.posexplode(shifts).alias("copy", "_shift")).withColumn("lon", F.col("lon") + F.col("_shift"))
    return p.select(*points.columns, "copy")


def far_points(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points a line keeps so that none of the others is further off than ``tolerance``: the furthest is kept, and both halves are looked at again."""
    keep, todo = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = xy[a], xy[b], xy[a + 1 : b]
        d, span = q - p, float(np.hypot(*(q - p)))
        off = np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / span if span else np.hypot(*(mid - p).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, keys: list[str], order: str, tolerance: float) -> DataFrame:
    """Thins each line or ring (keys, order, lon, lat); a line, which has some thousand points, is one group."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[far_points(pdf[["lon", "lat"]].to_numpy(), tolerance)] if len(pdf) > 2 else pdf

    return points.groupBy(*keys).applyInPandas(thin, points.schema)


def edge_table(points: DataFrame) -> DataFrame:
    """(poly_id, seq, x1, y1, x2, y2): each point of a ring with the next, the last with the first."""
    w = Window.partitionBy("poly_id").orderBy("seq")
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(ring))
    return points.select("poly_id", "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))


def chunk_boxes(edges: DataFrame, each: int = 16) -> DataFrame:
    """Bounds of every ``each`` edges of a polygon."""
    return edges.groupBy("poly_id", F.floor(F.col("seq") / each).cast("int").alias("chunk")).agg(
        F.min(F.least("x1", "x2")).alias("min_lon"), F.max(F.greatest("x1", "x2")).alias("max_lon"), F.min(F.least("y1", "y2")).alias("min_lat"), F.max(F.greatest("y1", "y2")).alias("max_lat"),
    )


def cell_index(boxes: DataFrame) -> DataFrame:
    """(cell, poly_id, chunk): the one-degree cells that a box touches."""
    at = lambda x, low: F.floor(x + low).cast("int")
    b = boxes.withColumn("_i", F.explode(F.sequence(at(F.col("min_lat"), 90), at(F.col("max_lat"), 90)))).withColumn("_j", F.explode(F.sequence(at(F.col("min_lon"), 180), at(F.col("max_lon"), 180))))
    return b.select((F.col("_i") * 360 + F.col("_j")).alias("cell"), "poly_id", "chunk")
