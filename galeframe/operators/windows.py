"""Operators over ordered rows: legs, calm spells, fills, resampling, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def legs(track: DataFrame, key: str = "route_id", order: str = "idx") -> DataFrame:
    """Adds leg_nm and leg_hours since the row before; 0 on the first."""
    w = Window.partitionBy(key).orderBy(order)
    hours = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lag("t").over(w).cast("timestamp"))) / F.lit(3.6e9)
    return track.withColumns({"leg_nm": F.coalesce(F.col("distance_nm") - F.lag("distance_nm").over(w), F.lit(0.0)), "leg_hours": F.coalesce(hours, F.lit(0.0))})


def calm_spells(track: DataFrame, below: float = 6.0, key: str = "route_id", order: str = "idx") -> DataFrame:
    """Longest and total hours of consecutive calm rows; a first row adds nothing, a windy row ends a spell."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = legs(track, key, order).withColumn("_calm", F.col("tws") < below)
    t = t.withColumn("_spell", F.sum(F.when(F.col("_calm"), 0).otherwise(1)).over(w))
    spells = t.groupBy(key, "_spell").agg(F.sum(F.when(F.col("_calm"), F.col("leg_hours")).otherwise(0.0)).alias("h"))
    return spells.groupBy(key).agg(F.max("h").alias("longest_calm"), F.sum("h").alias("calm_hours"))


def linear_fill(df: DataFrame, keys: list[str], x: str, y: str, good: Column, out: str) -> DataFrame:
    """Rows that aren't good take the line between the nearest good ones on either side; none outside them."""
    before = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(x).rowsBetween(1, Window.unboundedFollowing)
    pick = lambda c: F.when(good, F.col(c))
    d = df.withColumns({
        "_x0": F.last(pick(x), ignorenulls=True).over(before), "_y0": F.last(pick(y), ignorenulls=True).over(before),
        "_x1": F.first(pick(x), ignorenulls=True).over(after), "_y1": F.first(pick(y), ignorenulls=True).over(after),
    })
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    both = F.col("_x0").isNotNull() & F.col("_x1").isNotNull()
    return d.withColumn(out, F.when(~good & both, line).otherwise(F.col(y))).drop("_x0", "_x1", "_y0", "_y1")


def thin(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row of a key, and its last."""
    w = Window.partitionBy(key)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = F.ceil(F.col("_n") / most)
    return d.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def progress(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds progress from 0 to 1 along a key's rows and the taper of an envelope that closes at both ends."""
    w = Window.partitionBy(key)
    s = (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    end = F.least(F.lit(1.0), (1 - F.col("progress")) / 0.25)
    taper = F.least(F.lit(1.0), F.col("progress") / 0.08) * end * end * (F.lit(3.0) - 2.0 * end)
    return df.withColumn("progress", s).withColumn("taper", taper)


def resample(track: DataFrame, hours: Column, key: str = "route_id") -> DataFrame:
    """Rows every ``hours`` from a key's first time to its last: values on the line between the rows around each time.

    Each row covers the times from its own up to the next row's, so that no
    range join is needed: times are generated from the interval they fall in.
    """
    from galeframe.functions.geo import mix_angle

    w = Window.partitionBy(key).orderBy("idx")
    whole = Window.partitionBy(key)
    sec = F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6)
    t = track.withColumns({"s": sec, "t0": F.min(sec).over(whole), "t1": F.max(sec).over(whole)})
    t = t.withColumns({"step": hours * 3600.0, "s2": F.lead("s").over(w), "lat2": F.lead("lat").over(w), "tws2": F.lead("tws").over(w), "twd2": F.lead("twd").over(w)})
    first = F.ceil((F.col("s") - F.col("t0")) / F.col("step")).cast("long")
    last = F.coalesce(F.ceil((F.col("s2") - F.col("t0")) / F.col("step")).cast("long") - 1, first)
    last = F.when(F.col("s2").isNull(), F.floor((F.col("s") - F.col("t0")) / F.col("step")).cast("long")).otherwise(last)
    k = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)")))
    t = t.withColumn("k", k)
    f = F.coalesce((F.col("t0") + F.col("k") * F.col("step") - F.col("s")) / F.nullif(F.col("s2") - F.col("s"), F.lit(0.0)), F.lit(0.0))
    mix = lambda a, b: F.col(a) + (F.coalesce(b, a) - F.col(a)) * F.col("_f")
    t = t.withColumn("_f", f)
    return t.select(key, "k", mix("lat", "lat2").alias("lat"), mix("tws", "tws2").alias("tws"), mix_angle(F.col("twd"), F.coalesce("twd2", "twd"), F.col("_f")).alias("twd"))
