"""Requests, boat files and profiles as text, read into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.text import csv_list

#: Names of requested columns and what they stand for.
ALIASES = {"windspeed_10m": "wind_speed_10m", "winddirection_10m": "wind_direction_10m", "surface_pressure": "pressure_msl"}
DEFAULT_HOURLY = ("wind_speed_10m", "wind_direction_10m", "pressure_msl")


def coordinates(requests: DataFrame, id_col: str, lats: str, lons: str) -> DataFrame:
    """(id, place, lat, lon, error): a row for each pair of the two lists.

    Requests whose lists differ in length, are empty or hold something that
    isn't a number have one row with the error and no place.
    """
    numbers = lambda x: F.transform(csv_list(F.coalesce(F.col(x), F.lit(""))), lambda v: v.try_cast("double"))
    r = requests.select(id_col, numbers(lats).alias("_a"), numbers(lons).alias("_o"))
    bad = lambda x: F.exists(x, lambda v: v.isNull())
    error = F.when((F.size("_a") == 0) | (F.size("_o") == 0), F.lit("missing coordinates")).when(F.size("_a") != F.size("_o"), F.lit("lists differ in length")).when(bad(F.col("_a")) | bad(F.col("_o")), F.lit("not a number"))
    r = r.withColumn("error", error)
    pairs = F.when(F.col("error").isNull(), F.arrays_zip(F.col("_a").alias("lat"), F.col("_o").alias("lon")))
    return r.select(id_col, "error", F.posexplode_outer(pairs).alias("place", "p")).select(id_col, "place", "p.lat", "p.lon", "error")


def hourly(requested: Column) -> Column:
    """Distinct columns of a list, by their proper names; the default set for an empty one."""
    proper = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    named = F.transform(csv_list(F.coalesce(requested, F.lit(""))), lambda v: F.coalesce(F.element_at(proper, v), v))
    return F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.array(*map(F.lit, DEFAULT_HOURLY)))


def points_of(reply: Column, schema: str) -> Column:
    """A reply that is one object or an array of them, as an array."""
    return F.when(F.ltrim(reply).startswith("["), F.from_json(reply, f"array<struct<{schema}>>")).otherwise(F.array(F.from_json(reply, f"struct<{schema}>")))


BOAT = "name string, loa double, lwl double, b_max double, b_wl double, draft_total double, draft_canoe double, fore_i double, mast double"


def boat(text: Column) -> Column:
    """A boat file's fields; those left out or zero follow from the others. Null where the text isn't JSON, has no name or no length."""
    j = F.from_json(text, BOAT)
    given = lambda f, other: F.coalesce(F.nullif(j[f], F.lit(0.0)), other)
    made = F.struct(
        F.trim(j["name"]).alias("name"), j["loa"].alias("loa"), given("lwl", j["loa"] * 0.85).alias("lwl"), j["b_max"].alias("b_max"), given("b_wl", j["b_max"] * 0.88).alias("b_wl"), j["draft_total"].alias("draft_total"),
        given("draft_canoe", j["draft_total"] * 0.35).alias("draft_canoe"), j["fore_i"].alias("fore_i"), given("mast", j["fore_i"] * 1.15).alias("mast"),
    )
    return F.when((F.trim(j["name"]) != "") & (j["loa"] > 0), made)


def milliseconds(text: Column) -> Column:
    """Durations such as 1.5s, 20ms, 7us, 2m; null for anything else."""
    n, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([a-zµ]+)\s*$", 1).try_cast("double"), F.regexp_extract(text, r"^\s*([0-9.]+)\s*([a-zµ]+)\s*$", 2)
    scale = F.when(unit == "ns", 1e-6).when(unit.isin("us", "µs"), 1e-3).when(unit == "ms", 1.0).when(unit == "s", 1000.0).when(unit.isin("m", "min"), 60000.0)
    return n * scale


def stack_weights(traces: DataFrame, stack: str, weight: str) -> DataFrame:
    """(path, depth, weight): the sum over all stacks (frames from the root, parted by semicolons) that pass through each path."""
    frames = F.split(F.col(stack), ";")
    paths = F.transform(F.sequence(F.lit(1), F.size(frames)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(frames, 1, k), ";").alias("path")))
    return traces.select(F.col(weight).alias("_w"), F.explode(paths).alias("p")).groupBy("p.path", "p.depth").agg(F.sum("_w").alias("weight"))
