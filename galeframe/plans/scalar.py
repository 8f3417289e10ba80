"""Queries of the scalar functions (units, angles, geodesy, wind, sailing, text) over the observation view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions import geo, sailing, text, units, wind
from galeframe.plans import duck as d

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def r6(x: Column) -> Column:
    return units.round_to(x, 6)


def whole(x: Column) -> Column:
    """Rounded so that 359.9999999999 is 0."""
    return geo.norm360(r6(x))


@query(f"""with {d.OBS}, u as (select event_id, tws, case event_id % 4 when 0 then 'kn' when 1 then 'kmh' when 2 then 'mph' else 'ms' end as unit,
 case event_id % 3 when 0 then 'celsius' when 1 then 'fahrenheit' else 'kelvin' end as tunit, case event_id % 3 when 0 then 'hPa' when 1 then 'kPa' else 'bar' end as punit from obs)
select event_id, {d.r6("case unit when 'kn' then tws * 1.943844e0 when 'kmh' then tws * 3.6e0 when 'mph' then tws * 2.236936e0 else tws end")} as speed,
{d.r6("case tunit when 'celsius' then (tws + 270e0) - 273.15e0 when 'fahrenheit' then ((tws + 270e0) - 273.15e0) * 1.8e0 + 32e0 else tws + 270e0 end")} as temp,
{d.r6("case punit when 'kPa' then (100000e0 + tws * 100) / 1000e0 when 'bar' then (100000e0 + tws * 100) / 100000e0 else (100000e0 + tws * 100) / 100e0 end")} as pressure,
{d.r6("tws / 25.4e0")} as inches, {d.r6("tws * 1852e0 / 3600e0")} as ms, {d.r6("tws * 0.3048e0")} as metres, {d.r6("tws * 0.45359237e0")} as kg, {d.r1("tws")} as r1,
{d.r6("least(greatest(tws, 5e0), 30e0)")} as clamped, cast(round(tws / 0.25e0) as integer) + 1 as cells from u""")
def H01_H09_units(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (c("event_id") % n + 1).cast("int"))
    return tables.obs(spark, sf).select(
        "event_id", r6(units.speed(c("tws"), pick(4, "kn", "kmh", "mph", "ms"))).alias("speed"), r6(units.temperature(c("tws") + 270.0, pick(3, "celsius", "fahrenheit", "kelvin"))).alias("temp"),
        r6(units.pressure(F.lit(100000.0) + c("tws") * 100, pick(3, "hPa", "kPa", "bar"))).alias("pressure"), r6(c("tws") / units.MM_PER_INCH).alias("inches"), r6(units.knots_to_ms(c("tws"))).alias("ms"),
        r6(c("tws") * units.FEET_TO_M).alias("metres"), r6(c("tws") * units.POUNDS_TO_KG).alias("kg"), units.round_to(c("tws"), 1).alias("r1"), r6(units.clamp(c("tws"), 5.0, 30.0)).alias("clamped"),
        units.lattice_size(c("tws"), F.lit(0.25)).alias("cells"),
    )


_D = d.dist("lat", "lon", "48.5e0", "-5e0")
_DR = f"({_D} / 6371000e0)"


@query(f"""with {d.OBS}, p as (select event_id, lat, lon, tws, twd, {_DR} as dr, 0.35e0 as f from obs),
x as (select *, sin((1 - f) * dr) / sin(dr) as a, sin(f * dr) / sin(dr) as b from p),
y as (select *, a * cos(radians(lat)) * cos(radians(lon)) + b * cos(radians(48.5e0)) * cos(radians(-5e0)) as x1,
 a * cos(radians(lat)) * sin(radians(lon)) + b * cos(radians(48.5e0)) * sin(radians(-5e0)) as y1, a * sin(radians(lat)) + b * sin(radians(48.5e0)) as z1 from x)
select event_id, {d.r6(d.norm("twd * 3 - 500e0"))} as a360, {d.r6("(" + d.norm("lon * 3 + 180e0") + " - 180e0)")} as lon180, round({_D} * 1e3) / 1e3 as metres, {d.r6(_D + " / 1852e0")} as nm,
{d.norm(d.r6(d.bearing("lat", "lon", "48.5e0", "-5e0")))} as bearing, {d.r6(d.dest_lat("lat", "tws * 1852e0", "twd"))} as to_lat, {d.r6(d.dest_lon("lat", "lon", "tws * 1852e0", "twd"))} as to_lon,
{d.r6("degrees(atan2(z1, sqrt(x1 * x1 + y1 * y1)))")} as mid_lat, {d.r6("(" + d.norm("degrees(atan2(y1, x1)) + 180e0") + " - 180e0)")} as mid_lon,
round(abs(asin(sin({d.dist("10e0", "20e0", "lat", "lon")} / 6371000e0) * sin(radians({d.bearing("10e0", "20e0", "lat", "lon")}) - radians({d.bearing("10e0", "20e0", "48.5e0", "-5e0")}))) * 6371000e0) * 1e3) / 1e3 as xtd from y""")
def H10_H15_geodesy(spark: SparkSession, sf: str) -> DataFrame:
    to = F.lit(48.5), F.lit(-5.0)
    at = c("lat"), c("lon")
    lat, lon = geo.destination(*at, c("tws") * 1852.0, c("twd"))
    mlat, mlon = geo.along(*at, *to, F.lit(0.35))
    return tables.obs(spark, sf).select(
        "event_id", r6(geo.norm360(c("twd") * 3 - 500.0)).alias("a360"), r6(geo.norm_lon(c("lon") * 3)).alias("lon180"), units.round_to(geo.distance_m(*at, *to), 3).alias("metres"),
        r6(geo.distance_nm(*at, *to)).alias("nm"), whole(geo.bearing(*at, *to)).alias("bearing"), r6(lat).alias("to_lat"), r6(lon).alias("to_lon"), r6(mlat).alias("mid_lat"), r6(mlon).alias("mid_lon"),
        units.round_to(geo.cross_track_m(*at, F.lit(10.0), F.lit(20.0), *to), 3).alias("xtd"),
    )


_MIX = "((twd - tws * 9) % 360e0)"


@query(f"""with {d.OBS}, m as (select event_id, tws, twd, lat, lon, {_MIX} as k from obs), n as (select *, case when k > 180 then k - 360 when k < -180 then k + 360 else k end as k2 from m),
w as (select *, -tws * sin(radians(twd)) as u, -tws * cos(radians(twd)) as v from n)
select event_id, {d.r6("(tws * 9 + k2 * 0.25e0 + 360e0) % 360e0")} as mixed, {d.r6(d.fold(d.norm("tws * 9 - twd")))} as twa, cast((event_id % 1440 + 720) % 1440 as integer) as rotated,
{d.r6("u")} as u, {d.r6("v")} as v, {d.r6("case when sqrt(u*u+v*v) < 1e-6 then 0e0 else sqrt(u*u+v*v) end")} as speed,
{("case when tws < 1e-6 then 0e0 else " + d.norm(d.r6("270e0 - degrees(atan2(v, u))")) + " end")} as direction,
{d.r6("sqrt(u*u+v*v) / (1852e0 / 3600e0)")} as knots, {d.norm(d.r6("degrees(atan2(-u, -v))"))} as twd2 from w""")
def H16_H22_wind_angles(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.obs(spark, sf)
    u, v = wind.to_uv(c("tws"), c("twd"))
    o = o.withColumns({"u": u, "v": v})
    s, direction = wind.from_uv(c("u"), c("v"))
    k, twd = wind.condition(c("u"), c("v"))
    return o.select(
        "event_id", r6(geo.mix_angle(c("tws") * 9, c("twd"), F.lit(0.25))).alias("mixed"), r6(geo.angle_between(c("tws") * 9, c("twd"))).alias("twa"), ((c("event_id") % 1440 + 720) % 1440).cast("int").alias("rotated"),
        r6(c("u")).alias("u"), r6(c("v")).alias("v"), r6(s).alias("speed"), whole(direction).alias("direction"), r6(k).alias("knots"), whole(twd).alias("twd2"),
    )


@query(f"""with {d.OBS}, g as (select event_id, (90e0 - least(greatest(lat, -90e0), 90e0)) / 0.25e0 as y, {d.norm("lon")} / 0.25e0 as x from obs)
select event_id, cast(least(floor(y), 719) as integer) as i0, cast(least(floor(y), 719) as integer) + 1 as i1, cast(floor(x) % 1440 as integer) as j0, cast((floor(x) + 1) % 1440 as integer) as j1,
{d.r6("y - least(floor(y), 719)")} as u, {d.r6("x - floor(x)")} as v from g""")
def H23_grid_coords(spark: SparkSession, sf: str) -> DataFrame:
    g = wind.grid_coords(c("lat"), c("lon"), 90.0, 0.25, 721, 0.0, 0.25, 1440)
    return tables.obs(spark, sf).select("event_id", *[(r6(x) if k in "uv" else x.cast("int")).alias(k) for k, x in g.items()])


_LAG = "lag(twd) over (partition by event_id % 50 order by event_id)"


@query(f"""with {d.OBS}, m as (select event_id, tws, twd, {_LAG} as prev, {d.fold("twd")} as twa from obs),
n as (select *, round((tws * 1.25e0 + 1.5e0) * 10) / 10 as gust, greatest(0.3e0, round(pow(tws / 10e0, 1.3e0) * 0.5e0 * 10) / 10) as wave, greatest(4e0, round((3.5e0 + sqrt(tws) * 1.2e0) * 10) / 10) as period from m),
q as (select *, wave * pow(7.5e0 / period, 0.9e0) as wi, cast(round(tws / 5e0) * 5 as integer) as b from n)
select event_id, case when prev is null then 'none' else {d.maneuver("coalesce(prev, 0)", "twd", "tws * 9")} end as maneuver,
{d.r6("case when twa < 20 then 3e0 when twa <= 50 then least(tws * 1.3e0, 24e0) when twa <= 110 then least(tws * 1.1e0, 20e0) else least(tws * 0.35e0, 8e0) end")} as heel,
gust, wave, period, {d.pos("twa")} as pos, {d.pos("twa", True)} as pos_closed, case when wi < 0.9e0 then 0 when wi < 1.7e0 then 1 when wi < 2.6e0 then 2 when wi < 3.8e0 then 3 else 4 end as intensity,
b // 50 as pennants, b % 50 // 10 as barbs, b % 10 // 5 as halves,
case when tws * 3 >= 85 then 'Very High' when tws * 3 >= 70 then 'High' when tws * 3 >= 50 then 'Moderate' when tws * 3 >= 35 then 'Low' else 'High Uncertainty' end as category from q""")
def H25_H38_sailing(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(c("event_id") % 50).orderBy("event_id")
    o = tables.obs(spark, sf).select("event_id", "tws", "twd", F.lag("twd").over(w).alias("prev"), geo.fold180(c("twd")).alias("twa"))
    o = o.withColumns({"gust": sailing.gust(c("tws")), "wave": sailing.wave_height(c("tws")), "period": sailing.wave_period(c("tws"))})
    p, b, h = sailing.barb(c("tws"))
    return o.select(
        "event_id", F.when(c("prev").isNull(), F.lit("none")).otherwise(sailing.maneuver(c("prev"), c("twd"), c("tws") * 9)).alias("maneuver"), r6(sailing.heel(c("tws"), c("twa"))).alias("heel"), "gust", "wave", "period",
        sailing.point_of_sail(c("twa")).alias("pos"), sailing.point_of_sail(c("twa"), True).alias("pos_closed"), sailing.wave_intensity(c("wave"), c("period")).alias("intensity"),
        p.alias("pennants"), b.alias("barbs"), h.alias("halves"), sailing.confidence_category(c("tws") * 3).alias("category"),
    )


@query(f"with {d.OBS}, {d.polar_speed('obs', 'event_id', 'tws', 'twd')} select event_id, {d.r6('speed')} as speed from sped")
def H29_polar_speed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.obs(spark, sf).select("event_id", r6(sailing.polar_speed(c("tws"), c("twd"))).alias("speed"))


@query("""select event_id, strftime(ts, '%Y%m%d_%HZ') as slug, strftime(ts, '%Y-%m-%dT%H:%M') as iso_minute, ts + to_hours(cast(event_id % 120 as integer)) as valid_time,
date_trunc('day', ts - to_minutes(210)) + to_hours(cast(hour(ts - to_minutes(210)) // 6 * 6 as integer)) as cycle,
round(((hour(ts) + minute(ts) / 60e0 + (-180e0 + (event_id * 7 % 3600) / 10e0) / 15e0 + 24e0) % 24e0) * 1e6) / 1e6 as local_hour,
strptime(strftime(ts, '%Y%m%d_%HZ'), '%Y%m%d_%HZ') as parsed from events""")
def H51_H55_times(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events")
    lon = F.lit(-180.0) + (c("event_id") * 7 % 3600) / 10.0
    return e.select(
        "event_id", text.cycle_slug(c("ts")).alias("slug"), text.iso_minute(c("ts")).alias("iso_minute"), text.valid_time(c("ts"), c("event_id") % 120).alias("valid_time"),
        text.cycle_floor(c("ts"), 210, 6).alias("cycle"), r6(text.local_hour(c("ts"), lon)).alias("local_hour"), text.parse_slug(text.cycle_slug(c("ts"))).alias("parsed"),
    )


_H = "value * 1.7e0"


@query(f"""select event_id, cast(floor({_H} / 24) as integer) || 'd ' || cast(floor({_H} % 24) as integer) || 'h' as short_text,
case when {_H} < 24 then '+' || printf('%.1f', {d.r1(_H)}) || 'h' else 'd' || cast(floor({_H} / 24) as integer) || '+' || cast(floor({_H} % 24) as integer) || 'h' end as elapsed,
list_filter(list_transform(string_split(event_type || ' , ,' || cast(user_id as varchar), ','), lambda x: trim(x)), lambda x: x <> '') as parts,
case when length(event_type) > 5 then substr(event_type, 1, 4) || '…' else event_type end as cut, regexp_replace(lower(event_type || ' #' || cast(user_id as varchar)), '[^a-z0-9]+', '_', 'g') as safe,
case lower(event_type) when 'click' then 'gfs_0p25' when 'view' then 'ifs_0p25' when 'purchase' then 'icon_global' else lower(event_type) end as model,
cast(json_extract_string(props, '$.k') as integer) as k, greatest(ts, timestamp '2024-01-15 00:00:00') as revived from events""")
def H50_H67_text(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events")
    h = c("value") * 1.7
    return e.select(
        "event_id", text.days_hours(h).alias("short_text"), text.elapsed(h).alias("elapsed"), text.csv_list(F.concat("event_type", F.lit(" , ,"), c("user_id").cast("string"))).alias("parts"),
        text.truncate(c("event_type"), 5).alias("cut"), text.safe_name(F.concat("event_type", F.lit(" #"), c("user_id").cast("string"))).alias("safe"),
        text.alias_of(c("event_type"), {"click": "gfs_0p25", "view": "ifs_0p25", "purchase": "icon_global"}).alias("model"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.greatest("ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("revived"),
    )


@query(f"""with {d.OBS} select event_id, tws, twd, {d.fold("twd")} as twa from obs where {d.fold("twd")} >= 28 and tws > 0.3""")
def B06_sailable(spark: SparkSession, sf: str) -> DataFrame:
    return tables.obs(spark, sf).select("event_id", "tws", "twd", geo.fold180(c("twd")).alias("twa")).where("twa >= 28 and tws > 0.3")


@query(f"""with {d.OBS} select event_id, coalesce(nullif(case when event_id % 7 = 0 then 'nan'::double else tws end, 'nan'::double), 0e0) as filled, lat between -30 - 0.5e0 and 20 + 0.5e0 as inside,
abs(lon - 12.3e0) < 0.005e0 as near_preset, regexp_matches(lower('Error ' || case event_id % 3 when 0 then 'NoSuchKey' when 1 then '404' else 'timeout' end), '404|not found|nosuchkey') as missing,
(case when event_id % 2 = 0 then null else 'v1' end) is distinct from 'v1' as stale from obs""")
def B03_B14_predicates(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(c("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(c("tws"))
    kind = F.element_at(F.array(F.lit("NoSuchKey"), F.lit("404"), F.lit("timeout")), (c("event_id") % 3 + 1).cast("int"))
    return tables.obs(spark, sf).select(
        "event_id", F.nanvl(raw, F.lit(0.0)).alias("filled"), c("lat").between(-30.5, 20.5).alias("inside"), (F.abs(c("lon") - 12.3) < 0.005).alias("near_preset"),
        F.lower(F.concat(F.lit("Error "), kind)).rlike("404|not found|nosuchkey").alias("missing"), (~F.when(c("event_id") % 2 != 0, F.lit("v1")).eqNullSafe("v1")).alias("stale"),
    )
