"""Ensemble statistics, weighted means, exceedance, passage summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import sailing
from galeframe.functions.units import KNOTS, round_to


def valid(x: str) -> Column:
    return F.when(~F.isnan(x), F.col(x))


def ensemble_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact mean, sample deviation (0 for one member) and linear percentiles over members, NaN left out.

    Mean and deviation combine before the shuffle; exact percentiles send one
    (value, count) for each distinct value and key.
    """
    x = valid(value)
    p = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) > 0, F.lit(0.0))).alias("std"), p.alias("_p"))
    return out.select(*keys, "mean", "std", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def wind_exceedance(df: DataFrame, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """Mean speed over members and the shares at 25 and 34 knots and more, of speeds narrowed to floats; pairs with NaN left out."""
    s = F.hypot(u, v).cast("float")
    df = df.where(~F.isnan(u) & ~F.isnan(v)).withColumn("_s", s)
    share = lambda kts: F.avg(F.when(F.col("_s") >= F.lit(kts / KNOTS).cast("float"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return df.groupBy(*keys).agg(F.avg(F.col("_s").cast("double")).alias("mean_speed"), share(25.0).alias("prob_25"), share(34.0).alias("prob_34"))


def passage_summary(track: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the points of sail (percent), mean and greatest wind, sea and heel of each route."""
    t = track.withColumns({"_w": sailing.wave_height(F.col("tws")), "_p": sailing.wave_period(F.col("tws")), "_h": sailing.heel(F.col("tws"), F.col("twa")), "_pos": sailing.point_of_sail(F.col("twa"), True)})
    share = lambda n: round_to(F.count_if(F.col("_pos") == n) / F.count("*") * 100, 1).alias(n)
    mean = lambda x, digits: round_to(round_to(F.avg(x), 9), digits)  # noqa: E731  a sum's order doesn't move a tie
    return t.groupBy(*keys).agg(
        *[share(n) for n in ("close_hauled", "close_reach", "beam_reach", "broad_reach", "downwind")], mean("tws", 1).alias("avg_wind"), F.max("tws").alias("max_wind"),
        mean("_w", 2).alias("avg_wave"), F.max("_w").alias("max_wave"), mean("_p", 1).alias("avg_period"), F.max("_h").alias("max_heel"),
    )


def wind_rose(track: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve sectors of 15 degrees: rows, distance, mean and greatest wind of each; all twelve for every key, in one pass over the rows."""
    sector = F.least(F.lit(11), F.floor(F.col("twa") / 15)).cast("int")
    some = track.groupBy(*keys, sector.alias("sector")).agg(F.count("*").alias("n"), F.sum("leg_nm").alias("dist"), F.avg("tws").alias("avg_wind"), F.max("tws").alias("max_wind"))
    every = some.select(*keys).distinct().withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(11))))
    out = every.join(some, [*keys, "sector"], "left")
    return out.select(*keys, "sector", *[F.coalesce(x, F.lit(z)).alias(x) for x, z in (("n", 0), ("dist", 0.0), ("avg_wind", 0.0), ("max_wind", 0.0))])


def argmin(df: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The row with the least ``order`` of each key, as a hash aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def current_weather(series: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each series (keys, t, speed in m/s, direction, temperature): 20 degrees where it has none."""
    first = series.groupBy(*keys).agg(F.min_by(F.struct("t", "speed", "direction", "temperature"), "t").alias("r"))
    return first.select(
        *keys, F.date_format("r.t", "yyyy-MM-dd'T'HH:mm").alias("time"), round_to(F.coalesce("r.temperature", F.lit(20.0)), 1).alias("temperature"), round_to(F.col("r.speed") * KNOTS, 2).alias("windspeed"),
        round_to(F.col("r.direction"), 1).alias("winddirection"), F.lit(0).alias("weathercode"), F.lit(1).alias("is_day"),
    )
