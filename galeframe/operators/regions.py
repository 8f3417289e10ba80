"""Boxes that lie in boxes: requests met with cached regions by cells of several sizes, and the steps of those to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.units import let
from galeframe.operators.common import durable

#: Degrees a request may stick out, hours that a region stays fresh, points of a fetched grid: fixed values.
SLACK_DEG, FRESH_HOURS, MOST_POINTS = 0.5, 6.0, 120
#: Ages of regions, microseconds, from one of which to the next requests look for one at a time.
AGES = tuple(round(h * 3.6e9) for h in (0.0, 0.1, 0.5, 2.0, FRESH_HOURS))
#: Sizes of cells, degrees, from coarse to fine.
SIZES = tuple(360.0 / 2**k for k in range(10))
#: Sizes of the tiles in which boxes meet polygons, cells of a degree, and tasks that share a tile.
SPANS, DEALT = (4, 8, 16, 64, 1 << 20), 16
BOX = ("min_lat", "max_lat", "min_lon", "max_lon")


def _cell(x: Column, size: Column) -> Column:
    return F.floor((x + 360.0) / size).cast("int")


def cover(regions: DataFrame) -> DataFrame:
    """``regions`` with (level, i, j) of the cells that each touches, of the smallest size that is as long as the region's longer side (nine cells at most)."""
    side = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(0.0))
    r = regions.withColumn("level", F.size(F.filter(F.array(*map(F.lit, SIZES)), lambda s: s >= side)) - 1).withColumn("level", F.greatest("level", F.lit(0)))
    r = r.withColumn("_size", F.get(F.array(*map(F.lit, SIZES)), F.col("level")))
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low), F.col("_size")), _cell(F.col(high), F.col("_size"))))
    return r.withColumn("i", span("min_lat", "max_lat")).withColumn("j", span("min_lon", "max_lon")).drop("_size")


def cached(requests: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, box, at, ..) with ``region``: the cached one that holds it, the newest of several (ties: the least id), or null.

    ``regions``: (region_id, box, fetched_at). A region holds a box that sticks
    out by half a degree at most, from when it was fetched until six hours
    after. A region is listed under the cells of its size that it touches with
    its slack, a request under the cell of its middle at every size that is as
    long as itself; so each pair of them that can fit meets once, in an
    equi-join. Ages are taken from young to old: rows meet by bucket of time
    too, and only requests that no younger region holds go on to older ones.
    """
    micros = lambda t: F.unix_micros(F.col(t).cast("timestamp"))
    wide = regions.select("region_id", micros("fetched_at").alias("_t"), *[(F.col(c) - SLACK_DEG if c.startswith("min") else F.col(c) + SLACK_DEG).alias(c) for c in BOX])
    held = cover(wide).select("level", "i", "j", "region_id", "_t", *[F.col(c).alias(f"r_{c}") for c in BOX])
    side = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"))
    middle = lambda a, b: _cell((F.col(a) + F.col(b)) / 2, F.col("_size"))
    inside = (F.col("min_lat") >= F.col("r_min_lat")) & (F.col("max_lat") <= F.col("r_max_lat")) & (F.col("min_lon") >= F.col("r_min_lon")) & (F.col("max_lon") <= F.col("r_max_lon"))
    asked, found = requests.select(key, micros("at").alias("_at"), *BOX), None
    for youngest, oldest in zip(AGES[:-1], AGES[1:], strict=True):
        bucket = lambda t, width=oldest - youngest: F.floor(t / width)
        seen = F.explode(F.sequence(bucket(F.col("_t") + youngest), bucket(F.col("_t") + oldest)))
        q = asked.select("*", F.posexplode(F.array(*map(F.lit, SIZES))).alias("level", "_size")).where((F.col("level") == 0) | (F.col("_size") >= side))
        q = q.withColumns({"i": middle("min_lat", "max_lat"), "j": middle("min_lon", "max_lon"), "_b": bucket(F.col("_at"))})
        age = F.col("_at") - F.col("_t")
        met = q.join(held.withColumn("_b", seen), ["level", "i", "j", "_b"]).where(inside & (age >= youngest) & (age < oldest))
        best = durable(met.groupBy(key).agg(F.min_by("region_id", F.struct((-F.col("_t")).alias("t"), "region_id")).alias("region")))
        found = best if found is None else found.unionByName(best)
        asked = asked.join(best, key, "left_anti")
    return requests.join(found, key, "left")


def fetch_steps(box: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """``box`` with lat_step, lon_step, n_lat and n_lon of the grid to fetch: steps of large boxes are coarse to begin with, and both grow by a fifth until the grid has ``most`` points at most."""
    lat_span, lon_span = F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")
    first = lambda step, span, over, least: let(F.when(span > over, F.greatest(step, F.lit(least))).otherwise(step), lambda s: F.when(s <= 0, F.lit(least)).otherwise(s))
    n = lambda span, s: F.round(span / s).cast("int") + 1
    b = box.withColumns({"lat_step": first(F.col("lat_step"), lat_span, 15.0, 2.0), "lon_step": first(F.col("lon_step"), lon_span, 20.0, 2.5)})
    wider = lambda s, _: F.when(n(lat_span, s["a"]) * n(lon_span, s["b"]) > most, F.struct((s["a"] * 1.2).alias("a"), (s["b"] * 1.2).alias("b"))).otherwise(s)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.col("lat_step").alias("a"), F.col("lon_step").alias("b")), wider)
    b = b.withColumn("_s", s).withColumns({"lat_step": F.col("_s.a"), "lon_step": F.col("_s.b")}).drop("_s")
    return b.withColumns({"n_lat": n(lat_span, F.col("lat_step")), "n_lon": n(lon_span, F.col("lon_step"))})


def touched(boxes: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """(key, poly_id), each once: polygons that a box (key, box) touches, by one-degree cell; a key has one box, however often it is there.

    ``chunks``: (poly_id, chunk, box), the boxes of runs of edges. A polygon
    counts where a chunk of it is in a cell of the box and its own box meets it.
    A box is in the tile of its lower corner, of the least size of SPANS that
    is as long as the box, so that it ends in the next tile at the latest; a
    polygon is one row of a tile, with its chunks in that tile and the next.
    So a pair meets once and is decided there, and pairs aren't shuffled.
    Boxes of a tile meet its polygons in DEALT tasks.
    """
    deal = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda x: F.floor(F.col(x)).cast("int")
    tile = lambda x, size: F.floor(x / size).cast("int")
    whole = Window.partitionBy("poly_id")
    p = chunks.select("poly_id", *[(F.min(x) if x.startswith("min") else F.max(x)).over(whole).alias(f"p_{x}") for x in BOX], *[cell(x).alias(f"c_{x}") for x in BOX])
    p = p.withColumn("_size", F.explode(F.array(*map(F.lit, SPANS))))
    for at, side in (("_i", "lat"), ("_j", "lon")):
        p = p.withColumn(at, F.explode(F.sequence(tile(F.col(f"c_min_{side}"), F.col("_size")) - 1, tile(F.col(f"c_max_{side}"), F.col("_size")))))
    own = [f"p_{x}" for x in BOX]
    p = p.groupBy("poly_id", "_size", "_i", "_j").agg(*[F.first(x).alias(x) for x in own], F.collect_list(F.struct(*[F.col(f"c_{x}").alias(x) for x in BOX])).alias("_chunks"))
    p = p.withColumn("_deal", F.pmod(F.xxhash64("poly_id"), F.lit(DEALT)).cast("int")).repartition(deal, "_size", "_i", "_j", "_deal")
    b = boxes.select(key, *BOX).distinct().withColumns({f"b_{x}": cell(x) for x in BOX})
    longest = F.greatest(F.col("b_max_lat") - F.col("b_min_lat"), F.col("b_max_lon") - F.col("b_min_lon"))
    b = b.withColumn("_size", F.get(F.filter(F.array(*map(F.lit, SPANS)), lambda x: x >= longest), F.lit(0)))
    b = b.withColumns({"_i": tile(F.col("b_min_lat"), F.col("_size")), "_j": tile(F.col("b_min_lon"), F.col("_size")), "_deal": F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))})
    meets = (F.col("p_max_lat") >= F.col("min_lat")) & (F.col("p_min_lat") <= F.col("max_lat")) & (F.col("p_max_lon") >= F.col("min_lon")) & (F.col("p_min_lon") <= F.col("max_lon"))
    shared = lambda x: (x["min_lat"] <= F.col("b_max_lat")) & (x["max_lat"] >= F.col("b_min_lat")) & (x["min_lon"] <= F.col("b_max_lon")) & (x["max_lon"] >= F.col("b_min_lon"))
    met = p.hint("merge").join(b.repartition(deal, "_size", "_i", "_j", "_deal"), ["_size", "_i", "_j", "_deal"])
    return met.where(meets & F.exists("_chunks", shared)).select(key, "poly_id")
