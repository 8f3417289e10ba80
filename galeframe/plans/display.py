"""Queries of what reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions import display
from galeframe.plans import duck as d
from galeframe.plans.scalar import r6

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _ramp(k: int) -> str:
    cases = " ".join(f"when tws < {b[0]} then round({a[k]} + (tws - {a[0]}) / {b[0] - a[0]}e0 * {b[k] - a[k]})" for a, b in zip(display.WIND_RAMP, display.WIND_RAMP[1:], strict=False))
    return f"cast(case when tws <= 0 then {display.WIND_RAMP[0][k]} {cases} else {display.WIND_RAMP[-1][k]} end as integer)"


def _stop(k: int) -> str:
    stops = [s[k] for s in display.SEQUENTIAL_RAMP]
    return f"printf('%02x', cast(round({stops}[cast(floor(pos) as integer) + 1] + ({stops}[cast(least(floor(pos) + 1, 10) as integer) + 1] - {stops}[cast(floor(pos) as integer) + 1]) * (pos - floor(pos))) as integer))"


@query(f"""with {d.OBS}, s as (select event_id, tws * 2 as tws, tws * 2.4e0 as pct, (0.1e0 + (event_id % 8) / 7e0 * 0.8e0) * 10 as pos from obs), r as (select *, case when greatest(pct, 10e0) > 60 then 20 when greatest(pct, 10e0) > 35 then 15 when greatest(pct, 10e0) > 20 then 10 else 5 end as ring_step from s)
select event_id, 'rgb(' || {_ramp(1)} || ', ' || {_ramp(2)} || ', ' || {_ramp(3)} || ')' as color, '#' || {_stop(0)} || {_stop(1)} || {_stop(2)} as series, ring_step, cast(greatest(3, ceil(greatest(pct, 10e0) / ring_step)) as integer) as rings,
case when pct >= 80 then 'best' when pct >= 65 then 'good' when pct >= 50 then 'fair' else 'poor' end as score_class from r""")
def H33_H41_colors_and_scales(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.obs(spark, sf).select("event_id", (c("tws") * 2).alias("tws"), (c("tws") * 2.4).alias("pct"))
    step, n = display.rings(c("pct"))
    return o.select("event_id", display.wind_color(c("tws")).alias("color"), display.series_color(c("event_id") % 8, F.lit(8)).alias("series"), step.alias("ring_step"), n.alias("rings"), display.score_class(c("pct")).alias("score_class"))


_H = "(o_custkey % 300 + o_orderkey % 8 * 0.125e0)"


@query(f"""select o_orderkey, case when {_H} >= 24 then cast(floor({_H} / 24) as integer) || 'd ' else '' end || cast(floor({_H} % 24) as integer) || 'h ' || cast(round(({_H} * 60) % 60) as integer) || 'm (' || printf('%.1f', round({_H} * 10) / 10) || ' hrs)' as duration,
greatest(least(o_custkey % 180 - 90, o_orderkey % 180 - 90) - 5e0, -90e0) as south, least(greatest(o_custkey % 180 - 90, o_orderkey % 180 - 90) + 5e0, 90e0) as north,
strftime(o_orderdate, '%Y%m%d%H%M') <> strftime(o_orderdate + to_seconds(o_orderkey % 90), '%Y%m%d%H%M') or o_orderkey % 7 = 0 or abs((o_custkey % 3) * 0.006e0 - 0) > 0.01e0 or abs((o_custkey % 5) * 0.00004e0 - 0) > 0.0001e0 as outdated from orders""")
def H42_H57_B13_bounds_and_durations(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders")
    k, h = c("o_orderkey"), c("o_custkey") % 300 + c("o_orderkey") % 8 * 0.125
    south, north = display.padded(c("o_custkey") % 180 - 90.0, k % 180 - 90.0, 5.0, -90.0, 90.0)
    later = c("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 90).cast("decimal(18,6)"))
    old = display.outdated((c("o_orderdate"), later), (F.lit("a"), F.when(k % 7 != 0, F.lit("a"))), [(c("o_custkey") % 3 * 0.006, F.lit(0.0))], [(c("o_custkey") % 5 * 0.00004, F.lit(0.0))])
    return o.select("o_orderkey", display.duration(h).alias("duration"), south.alias("south"), north.alias("north"), old.alias("outdated"))


def _names() -> str:
    numbers = " ".join(f"when n = {k} then '{v}'" for k, v in display.LAND_BY_NUMBER.items())
    corners = " ".join(f"when lat between {a} and {b} and lon between {w} and {e} then '{n}'" for a, b, w, e, n in display.LAND_BY_CORNER)
    return f"case {numbers} {corners} else 'Land #' || n end"


@query(f"""with {d.OBS}, n as (select event_id, event_id % 900 as n, lat, lon from obs) select event_id, {_names()} as name from n""")
def H64_land_names(spark: SparkSession, sf: str) -> DataFrame:
    return tables.obs(spark, sf).select("event_id", display.land_name((c("event_id") % 900).cast("int"), c("lat"), c("lon")).alias("name"))


@query(f"""with {d.OBS}, w as (select event_id % 16 as cell, -tws * sin(radians(twd)) as u, -tws * cos(radians(twd)) as v, twd from obs) select cell, {d.r6("avg(u)")} as u, {d.r6("avg(v)")} as v, {d.r6("sqrt(avg(u) * avg(u) + avg(v) * avg(v))")} as mean_vector_speed from w group by cell""")
def B08_mean_wind_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Speed of an ensemble as that of its mean components, which isn't the mean of its speeds."""
    from galeframe.functions import wind

    u, v = wind.to_uv(c("tws"), c("twd"))
    o = tables.obs(spark, sf).select((c("event_id") % 16).alias("cell"), u.alias("u"), v.alias("v")).groupBy("cell").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return o.select("cell", r6(c("u")).alias("u"), r6(c("v")).alias("v"), r6(F.hypot("u", "v")).alias("mean_vector_speed"))
