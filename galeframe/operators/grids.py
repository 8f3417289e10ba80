"""Grids as rows: chunks, padding, rotation, series of a cell, request-driven columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(cells: DataFrame, keys: list[str], size: int = 16, value: str = "value") -> DataFrame:
    """(keys, ci, cj, values): square chunks, row by row; missing cells are NaN; chunks without any value are left out.

    A chunk has ``size`` squared cells, so that gathering one is bounded.
    """
    n = size * size
    at = (F.col("i") % size) * size + F.col("j") % size
    some = cells.where(F.col(value).isNotNull() & ~F.isnan(value))
    g = some.groupBy(*keys, F.floor(F.col("i") / size).cast("int").alias("ci"), F.floor(F.col("j") / size).cast("int").alias("cj"))
    filled = g.agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.col(value).cast("double").alias("v")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(float("nan"))))
    return filled.select(*keys, "ci", "cj", values.alias("values"))


def series(cells: DataFrame, keys: list[str], steps: list[int], value: str = "value") -> DataFrame:
    """(keys, values): the value of every step in order, NaN where there is none. Steps are a cycle's, some hundred."""
    g = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("step"), F.col(value).alias("v")))).alias("_m"))
    return g.select(*keys, F.transform(F.array(*map(F.lit, steps)), lambda s: F.coalesce(F.element_at("_m", s), F.lit(float("nan")))).alias("values"))


def member_requests(requests: DataFrame, members: DataFrame, means: DataFrame, steps: list[int], cells: DataFrame) -> DataFrame:
    """``requests`` (cell, member, stored, ..) with ``values``, a value for each step or NaN, or with ``error``.

    ``members``: (cell, step, member, value), ``means``: (cell, step, value),
    ``cells``: those of the grid. Where members aren't stored, member 0 is the
    mean and others are refused; where they are, a member that isn't there is
    the mean if it is member 0, else NaN at every step. A cell beyond the grid
    is refused.
    """
    own = series(members, ["cell", "member"], steps).withColumnRenamed("values", "_own")
    mean = series(means, ["cell"], steps).withColumnRenamed("values", "_mean")
    q = requests.join(cells.select("cell").distinct().withColumn("_there", F.lit(True)), "cell", "left").join(own, ["cell", "member"], "left").join(mean, "cell", "left")
    none = F.array(*[F.lit(float("nan")) for _ in steps])
    error = F.when(F.col("_there").isNull(), F.lit("beyond the grid")).when(~F.col("stored") & (F.col("member") != 0), F.lit("members are not stored"))
    first = F.coalesce("_mean", none)
    values = F.when(F.col("stored"), F.coalesce("_own", F.when(F.col("member") == 0, first), none)).otherwise(first)
    return q.select(*requests.columns, error.alias("error"), F.when(error.isNull(), values).alias("values"))


def rotate_half(j: Column, nlons: int) -> Column:
    """Columns of a grid that starts at 180 degrees as those of one that starts at 0."""
    return ((j + nlons // 2) % nlons).cast("int")


def step_at_least(steps: list[int], wanted: Column) -> Column:
    """The first step at or after the wanted hour; the first of all where there is none."""
    later = F.filter(F.array(*map(F.lit, sorted(steps))), lambda s: s >= wanted)
    return F.coalesce(F.get(later, F.lit(0)), F.lit(steps[0]))


def lattice(spark, min_lat: float, max_lat: float, min_lon: float, max_lon: float, lat_step: float, lon_step: float) -> DataFrame:
    """(gi, gj, lat, lon): round(span / step) + 1 rows and columns."""
    rows, cols = round((max_lat - min_lat) / lat_step) + 1, round((max_lon - min_lon) / lon_step) + 1
    g = spark.range(rows).select(F.col("id").cast("int").alias("gi"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("gj"))
    return g.withColumns({"lat": F.lit(min_lat) + F.col("gi") * lat_step, "lon": F.lit(min_lon) + F.col("gj") * lon_step})


def region_steps(min_lat: float, max_lat: float, min_lon: float, max_lon: float, step: float = 0.25, most: int = 120) -> float:
    """The step, widened by a fifth at a time, at which a region has ``most`` points at most."""
    count = lambda s: (round((max_lat - min_lat) / s) + 1) * (round((max_lon - min_lon) / s) + 1)
    while count(step) > most:
        step *= 1.2
    return step


def member_columns(cells: DataFrame, keys: list[str], members: list[int]) -> DataFrame:
    """Wind speed of each requested member as a column of its own: wind_speed_10m_memberNN."""
    speed = F.hypot("u", "v")
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col("member") == m, speed)).alias(f"wind_speed_10m_member{m:02d}") for m in members])
