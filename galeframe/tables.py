"""Loaders of the test tables and the domain views that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import sailing


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in space and time with a wind: one for each event."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").alias("t"), (F.lit(-60.0) + (F.col("event_id") % 1200) / 10.0).alias("lat"), (F.lit(-180.0) + (F.col("event_id") * 7 % 3600) / 10.0).alias("lon"),
        (F.col("value") % 40.0).alias("tws"), (F.col("event_id") * 37 % 360).cast("double").alias("twd"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with their waypoints: a user's events in order; a leg is a tenth of the wind speed in miles."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tws = F.col("value") % 40.0
    return e.select(
        F.col("user_id").alias("route_id"), (F.row_number().over(w) - 1).alias("idx"), F.col("ts").alias("t"), (F.col("event_id") * 13 % 181).cast("double").alias("twa"), tws.alias("tws"),
        F.sum(tws / 10.0).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("distance_nm"),
        (F.lit(-60.0) + (F.col("event_id") % 1200) / 10.0).alias("lat"), (F.lit(-180.0) + (F.col("event_id") * 7 % 3600) / 10.0).alias("lon"), (F.col("event_id") * 37 % 360).cast("double").alias("twd"),
    )


def ens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble values: cell, step, member, u and v."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("cell"), F.col("l_linenumber").alias("step"), (F.col("l_orderkey") % 31).cast("int").alias("member"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100.0).alias("v"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice 50 cells wide with one value a cell."""
    return read(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("i"), (F.col("p_partkey") % 50).cast("int").alias("j"), F.col("p_retailprice").alias("value"))


def polar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sailing.polar_rows(), "tws double, twa double, speed double")


def fleet_polars(spark: SparkSession, sf: str) -> DataFrame:
    """A table of speeds for each supplier: the test polar, faster for those with more on account.

    Suppliers are dealt before each has its 144 cells: their file is small, and
    one task would have all tables of it.
    """
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = read(spark, sf, "supplier").repartition(deal, "s_suppkey").select("s_suppkey", (F.lit(0.8) + (F.col("s_acctbal") + 1000.0) / 50000.0).alias("_share"))
    cells = F.array(*[F.struct(F.lit(w).alias("tws"), F.lit(a).alias("twa"), F.lit(x).alias("x")) for w, a, x in sailing.polar_rows()])
    return s.withColumn("c", F.explode(cells)).select("s_suppkey", "c.tws", "c.twa", (F.col("c.x") * F.col("_share")).alias("speed"))


def fleet(spark: SparkSession, sf: str) -> DataFrame:
    """A boat for each supplier, by number: a preset with another mass and mainsail."""
    from galeframe.physics import boats

    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier").select(k, F.element_at(F.array(*map(F.lit, boats.PRESETS)), (k % 4 + 1).cast("int")).alias("boat"))
    b = s.join(boats.presets(spark).drop("name"), "boat").withColumns({"mass": F.col("mass") * (F.lit(1.0) + k % 7 / 50.0), "main_p": F.col("main_p") * (F.lit(1.0) + k % 5 / 40.0)})
    return b.withColumnsRenamed({"boat": "preset", "s_suppkey": "boat"})


#: Four test polygons: (id, name, vertices as (lon, lat)).
POLYGONS = (
    (1, "west", ((-120.0, -20.0), (-90.0, -25.0), (-80.0, 10.0), (-100.0, 25.0), (-125.0, 5.0))),
    (2, "mid", ((-20.0, -30.0), (15.0, -30.0), (20.0, 0.0), (0.0, 15.0), (-25.0, 5.0))),
    (3, "east", ((60.0, 0.0), (100.0, 5.0), (95.0, 40.0), (70.0, 45.0))),
    (4, "islet", ((150.0, -40.0), (152.5, -40.5), (153.0, -38.0), (150.5, -37.5))),
)


def edges(spark: SparkSession) -> DataFrame:
    """Polygon edges (poly_id, seq, x1, y1, x2, y2)."""
    rows = [(k, n, *p, *q) for k, _, v in POLYGONS for n, (p, q) in enumerate(zip(v, [*v[1:], v[0]], strict=True))]
    return spark.createDataFrame(rows, "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
