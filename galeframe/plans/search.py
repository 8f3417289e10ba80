"""Queries of route search, pruning, departure windows and route confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions import geo, sailing, wind
from galeframe.functions.units import round_to
from galeframe.operators import aggregates, passage, sail, search, weather
from galeframe.plans import duck as d
from galeframe.plans.scalar import r6, whole

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def synthetic(lat, lon, hour):
    """True wind in knots and its direction, of the closed-form field."""
    return wind.condition(*wind.synthetic_uv(lat, lon, hour))


START, DEST = (10.0, -40.0), (25.0, -75.0)
_HEADS = f"""{d.OBS}, h as (select event_id, tws, twd, unnest(range(-165, 166, 10)) as off, {d.bearing("lat", "lon", "25e0", "-75e0")} as b from obs),
a as (select event_id, tws, twd, off, {d.norm("b + off")} as heading from h), w as (select event_id, off, tws, twd, heading, {d.fold(d.norm("heading - twd"))} as twa from a)"""


@query(f"""with {_HEADS}, k as (select event_id * 1000 + off as id, tws, twa, heading from w where twa >= 28.000001e0), {d.polar_speed("k", "id")}
select id // 1000 + case when id % 1000 > 500 then 1 else 0 end as event_id, cast(count(*) as integer) as headings, {d.r6("max(speed)")} as best from sped where speed > 0.3 group by 1""")
def C12_B06_heading_fan(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of each observation's fan that can be sailed, and the best speed among them."""
    o = tables.obs(spark, sf).select("event_id", "tws", "twd", geo.bearing(c("lat"), c("lon"), F.lit(DEST[0]), F.lit(DEST[1])).alias("toward"))
    fans = o.mapInArrow(_fans(np.arange(-165.0, 166.0, 10.0), 28.000001, 0.3), "event_id long, headings int, best double")
    return fans.groupBy("event_id").agg(F.sum("headings").cast("int").alias("headings"), r6(F.max("best")).alias("best"))


def _fans(offsets: np.ndarray, no_go: float, least_kts: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(event_id, headings, best) of rows with a wind and a bearing; rows without a heading that can be sailed are left out."""

    def fans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tws, twd, toward = (b.column(n).to_numpy(zero_copy_only=False).astype(float)[:, None] for n in ("tws", "twd", "toward"))
            twa = sail.fold((toward + offsets) % 360.0 - twd)
            speed = sail.polar_speed(np.broadcast_to(tws, twa.shape), twa)
            good = (twa >= no_go) & (speed > least_kts)
            n = good.sum(1)
            best = np.where(good, speed, 0.0).max(1, initial=0.0)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(n.astype(np.int32)), pa.array(best)], ["event_id", "headings", "best"]).filter(pa.array(n > 0))

    return fans


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The observations as candidates of eight routes."""
    o = tables.obs(spark, sf)
    return o.select(
        (c("event_id") % 8).alias("route_id"), c("event_id").alias("seq"), "lat", "lon", c("twd").alias("heading"), ((c("twd") * 3 + 40.0) % 360.0).alias("twd"), c("tws").alias("speed"), geo.fold180(c("twd")).alias("twa"),
        F.lit(START[0]).alias("start_lat"), F.lit(START[1]).alias("start_lon"), F.lit(DEST[0]).alias("dest_lat"), F.lit(DEST[1]).alias("dest_lon"), round_to(geo.distance_m(c("lat"), c("lon"), F.lit(DEST[0]), F.lit(DEST[1])), 3).alias("dist_m"),
    )


_REL = d.signed(d.norm(f"{d.bearing('10e0', '-40e0', 'lat', 'lon')} - {d.bearing('10e0', '-40e0', '25e0', '-75e0')}"))
_CAND = f"""{d.OBS}, cand as (select event_id % 8 as route_id, event_id as seq, lat, lon, twd as heading, (twd * 3 + 40e0) % 360e0 as twd, {d.fold("twd")} as twa, round({d.dist("lat", "lon", "25e0", "-75e0")} * 1e3) / 1e3 as dist_m, {_REL} as rel from obs)"""
CELL = 13.0 / 60.0 * 0.75
GRID = f"floor((lat + 90) / {CELL!r}::double), floor((lon + 180) / {CELL!r}::double)"
BEAM = 13.0 / 60.0 * 0.5
QUAD = "cast(floor(heading / 90) as integer) % 4"


def _prune_sql(keys: str, each: int = 1, more: str = "cand", top: int = 60) -> str:
    return f"""with {_CAND}, src as (select * from {more}),
k as (select *, row_number() over (partition by route_id, {keys} order by dist_m, seq) as rn from src), t as (select *, row_number() over (partition by route_id order by dist_m, lon, lat, seq) as top from k where rn <= {each})
select route_id, seq, cast(row_number() over (partition by route_id order by lon, lat, seq) - 1 as integer) as idx from t where top <= {top}"""


def _pruned(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    return search.prune(candidates(spark, sf), search.Config(strategy=strategy, max_nodes=60), bounded=False).select("route_id", "seq", "idx")


@query(_prune_sql("least(greatest(floor((rel - lo) / greatest(hi - lo, 0.1e0) * 60), 0), 59)", more="(select *, min(rel) over (partition by route_id) as lo, max(rel) over (partition by route_id) as hi from cand)"))
def I09_prune_radial_sector(spark: SparkSession, sf: str) -> DataFrame:
    return _pruned(spark, sf, "radial_sector")


@query(_prune_sql(f"{GRID}, {QUAD}"))
def I10_prune_spatial_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _pruned(spark, sf, "spatial_grid")


@query(_prune_sql(f"floor((lat + 90) / {BEAM!r}::double), floor((lon + 180) / {BEAM!r}::double)", 2))
def I11_prune_astar_beam(spark: SparkSession, sf: str) -> DataFrame:
    return _pruned(spark, sf, "astar_beam")


@query(_prune_sql(f"floor({d.dist('10e0', '-40e0', 'lat', 'lon')} / 1852e0 * sin(radians(rel)) / {13.0 * 0.8!r}::double), {QUAD}"))
def I12_prune_pareto_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _pruned(spark, sf, "pareto_envelope")


@query(_prune_sql(f"{GRID}, {QUAD}, {d.signed(d.norm('heading - twd'))} >= 0, case when twa < 60 then 0 when twa > 135 then 2 else 1 end"))
def I13_I14_prune_state_space_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _pruned(spark, sf, "state_space_grid")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """A passage of about 300 miles for each nation, by region and departure."""
    n = tables.read(spark, sf, "nation")
    lat, lon = F.lit(12.0) + c("n_regionkey") * 6.0, F.lit(-45.0) - c("n_regionkey") * 4.0
    return n.select(
        c("n_nationkey").cast("long").alias("route_id"), c("n_regionkey").cast("long").alias("batch"), lat.alias("start_lat"), lon.alias("start_lon"), (lat + 3.0).alias("dest_lat"), (lon - 4.0).alias("dest_lon"), (c("n_nationkey") * 6.0).alias("dep_h"),
    )


#: Ocean steps for tests and benchmarks; a step covers 39 miles.
COARSE = search.Config(step_hours=6.0, max_nodes=100, arrival_nm=30.0)


@query()
def I07_route_search(spark: SparkSession, sf: str) -> DataFrame:
    """All nations' passages, searched together, as waypoints."""
    return search.waypoints(search.route_search(passages(spark, sf), synthetic, COARSE))


def _track_of(found: search.Found) -> DataFrame:
    w = search.waypoints(found)
    t = F.lit("2026-06-01").cast("timestamp") + F.make_dt_interval(F.lit(0), c("hour").cast("int"))
    return w.select("route_id", c("wp").alias("idx"), t.alias("t"), "tws", "twa", "distance_nm", "speed", "lat", "lon")


@query()
def I15_departure_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Departures of each region's passage, searched together and ranked by comfort."""
    found = search.route_search(passages(spark, sf), synthetic, COARSE)
    o = search.outcomes(found).where("reached").join(passages(spark, sf).select("route_id", "batch"), "route_id")
    routes = o.select("route_id", "batch", c("dep_h").alias("lead_hours"), "dest_lon", "tacks", "gybes")
    return passage.window_scores(_track_of(found).join(routes.select("route_id"), "route_id", "left_semi"), routes)


def perturbed(members: int) -> weather.Staged:
    """The closed-form field as each of ``members`` has it; a node's own is in the column member."""
    of_member = lambda u, v, hour: passage.member_wind(u, v, c("member"), F.lit(members), hour)
    return weather.Staged((wind.synthetic_uv, of_member, lambda u, v, hour: wind.condition(u, v)))


@query()
def I19_ensemble_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every region's passage solved for 31 members, and the score of their spread beside that of the wind statistics."""
    base = tables.read(spark, sf, "region").select(c("r_regionkey").cast("long").alias("batch"))
    lat, lon = F.lit(12.0) + c("batch") * 6.0, F.lit(-45.0) - c("batch") * 4.0
    routes = base.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(30)))).select(
        (c("batch") * 100 + c("member")).alias("route_id"), lat.alias("start_lat"), lon.alias("start_lon"), (lat + 2.0).alias("dest_lat"), (lon - 2.5).alias("dest_lon"), F.lit(0.0).alias("dep_h"), "batch", "member",
    )

    found = search.route_search(routes, perturbed(31), search.Config(step_hours=6.0, max_nodes=40, arrival_nm=30.0))
    out = search.outcomes(found).join(routes.select("route_id", "batch", "member"), "route_id")
    b = passage.member_confidence(out, ["batch"])
    middle = _track_of(found).where("route_id % 100 = 15")
    a = passage.route_confidence(passage.waypoint_confidence(middle), ["route_id"]).select(F.floor(c("route_id") / 100).alias("batch"), c("score").alias("score_a"), c("mean_hours").alias("mean_a"), c("std_hours").alias("std_a"))
    both = b.join(a, "batch")
    total = round_to((c("score_a") + c("score")) / 2, 1)
    return both.select("batch", "members", r6(c("mean_hours")).alias("mean_hours"), r6(c("std_hours")).alias("std_hours"), "min_hours", "max_hours", "fastest", "slowest", r6(c("score")).alias("score_b"), r6(c("score_a")).alias("score_a"), total.alias("score"),
                       sailing.confidence_category(total).alias("category"), r6(passage.agreement(c("mean_a"), c("std_a"), c("mean_hours"), c("std_hours"), c("mean_hours"))).alias("agreement"))


_SEA = f"""w as (select *, greatest(0.3e0, {d.r1("pow(tws / 10e0, 1.3e0) * 0.5e0")}) as wv, greatest(4e0, {d.r1("3.5e0 + sqrt(tws) * 1.2e0")}) as pd, {d.pos("twa", True)} as pos from track)"""
_CLASSES = ("close_hauled", "close_reach", "beam_reach", "broad_reach", "downwind")
_PCT = ", ".join(f"round(count(*) filter (pos = '{n}') / count(*) * 100 * 10e0) / 10e0 as {n}_pct" for n in _CLASSES)
_PTS = " + ".join(f"count(*) filter (pos = '{n}') * {v}::double" for n, v in passage.COMFORT.items())
_HOURS = "(epoch_us(t) - epoch_us(lag(t) over (partition by route_id order by idx))) / 3.6e9"


@query(f"""with {d.TRACK}, {_SEA}, l as (select route_id, idx, tws, coalesce({_HOURS}, 0e0) as h from track), m as (select *, sum(case when tws < 6 then 0 else 1 end) over (partition by route_id order by idx rows unbounded preceding) as spell from l),
sp as (select route_id, spell, sum(case when tws < 6 then h else 0e0 end) as h from m group by 1, 2), calm as (select route_id, max(h) as longest, sum(h) as total from sp group by 1),
s as (select route_id, ({_PTS}) / count(*) as ps, {_PCT}, {d.r1("round(avg(tws) * 1e9) / 1e9")} as avg_wind, max(tws) as max_wind, round(round(avg(wv) * 1e9) / 1e9 * 100) / 100 as avg_wave, max(wv) as max_wave, {d.r1("round(avg(pd) * 1e9) / 1e9")} as avg_period,
 (max(epoch_us(t)) - min(epoch_us(t))) / 3.6e9 as hours, max(t) as arrives from w group by 1),
q as (select *, (hour(arrives) + minute(arrives) / 60e0 + (route_id % 360 - 180e0) / 15e0) % 24e0 as lh0, least(greatest(96e0 - 0.16e0 * greatest(route_id * 3e0, 0e0), 35e0), 98e0) as conf from s join calm using (route_id)),
n as (select *, case when lh0 < 0 then lh0 + 24 else lh0 end as lh from q), x as (select *, hours < 48 and (lh >= 20 or lh < 6) as night,
 least(greatest(100 - 22e0 * pow(greatest(0.1e0, avg_wave), 1.15e0) + least(greatest((avg_period - 6) * 2.8e0, -15e0), 15e0) - 12e0 * greatest(max_wave - 2.5e0, 0e0), 5e0), 100e0) as sw,
 least(greatest(case when avg_wind > 30 then greatest(10e0, 55 - (avg_wind - 30) * 4e0) when avg_wind > 24 then 85 - (avg_wind - 24) * 5e0 when avg_wind > 18 then 100 - (avg_wind - 18) * 2.5e0 when avg_wind >= 12 then 100e0 else 100 - (12 - avg_wind) * 4e0 end - 2e0 * greatest(max_wind - 28, 0e0), 5e0), 100e0) as sd from n),
z as (select *, {d.r1("least(greatest(round((ps * 0.40e0 + sw * 0.30e0 + sd * 0.15e0 + conf * 0.15e0 - case when night then 8e0 else 0e0 end) * 1e9) / 1e9, 0e0), 100e0)")} as comfort from x)
select route_id % 5 as batch, route_id, cast(row_number() over (partition by route_id % 5 order by comfort desc, hours, route_id) as integer) as rank, comfort, {d.r1("conf")} as confidence, {d.r1("hours")} as duration_hours, {", ".join(f"{n}_pct" for n in _CLASSES)},
avg_wind, {d.r1("max_wind")} as max_wind, avg_wave, max_wave, avg_period, max_wind >= 30 or max_wave >= 3.5 as gale, avg_wind < 8 or longest >= 4 or total > hours * 0.25 as low_wind, night, case when max_wind >= 22 then 'peak_wind' else 'mid_passage' end as event from z""")
def I16_window_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.track(spark, sf)
    routes = t.select("route_id").distinct().select("route_id", (c("route_id") % 5).alias("batch"), (c("route_id") * 3.0).alias("lead_hours"), (c("route_id") % 360 - 180.0).alias("dest_lon"), F.lit(0).alias("tacks"), F.lit(0).alias("gybes"))
    return passage.window_scores(t, routes)


@query(f"""with {d.TRACK}, p as (select route_id, idx, tws, twa, lat, lon, distance_nm, idx / greatest(count(*) over (partition by route_id) - 1, 1)::double as s, idx = 0 as first, idx = max(idx) over (partition by route_id) as last,
 greatest((epoch_us(t) - min(epoch_us(t)) over (partition by route_id)) / 3.6e9, 0e0) as h, distance_nm - lag(distance_nm) over w as leg, {d.dist("lag(lat) over w", "lag(lon) over w", "lat", "lon")} / 1852e0 as gap from track window w as (partition by route_id order by idx)),
q as (select *, least(1e0, (1 - s) / 0.25e0) as e, case when first then 0e0 when leg > 0 then leg else gap end as leg_nm, greatest(tws, 8e0) as mean, greatest(tws, 8e0) * least(0.45e0, 0.12e0 + 0.003e0 * h) as std, least(45e0, 5e0 + 0.18e0 * h) as spread from p),
r as (select *, least(greatest(100e0 * exp(-2e0 * std / greatest(mean, 5e0)) * exp(-spread / 40e0) * exp(-h / 360e0), 5e0), 99e0) as score,
 case when first or last then 0e0 else least(60e0, greatest(1e0, (distance_nm + 5) * 0.045e0 * spread / 20e0 * (1 + 0.008e0 * h))) * least(1e0, s / 0.08e0) * e * e * (3 - 2 * e) end as latnm from q),
k as (select route_id * 1000000 + idx * 10 + 1 as id, mean as kts, twa from r union all select route_id * 1000000 + idx * 10 + 2, greatest(1e0, mean - std), twa from r union all select route_id * 1000000 + idx * 10 + 3, mean + std, twa from r), {d.polar_speed("k", "id", "kts")},
v as (select id // 10 as rid, max(speed) filter (id % 10 = 1) as vm, max(speed) filter (id % 10 = 2) as lo, max(speed) filter (id % 10 = 3) as hi from sped group by 1),
u as (select r.*, case when vm < 1 then 1e0 else vm end as vm, abs(hi - lo) / 2 as dv from r join v on v.rid = r.route_id * 100000 + r.idx),
g as (select *, case when leg_nm > 0 then leg_nm / vm else 0e0 end as lh from u), s as (select route_id, sum(score * case when leg_nm > 0 then leg_nm else 1e0 end) / greatest(sum(case when leg_nm > 0 then leg_nm else 1e0 end), 1e0) as score, sum(lh) as m,
 0.5e0 * sum(lh * dv / vm) + 0.5e0 * sqrt(sum(lh * dv / vm * lh * dv / vm)) as sd, max(latnm) as lat_nm from g group by 1), f as (select *, case when sd <= 0.1 then m * 0.04e0 else sd end as d from s)
select route_id, {d.r6("score")} as score, case when score >= 85 then 'Very High' when score >= 70 then 'High' when score >= 50 then 'Moderate' when score >= 35 then 'Low' else 'High Uncertainty' end as category, {d.r6("m")} as mean_hours, {d.r6("d")} as std_hours,
{d.r6("greatest(m * 0.7e0, m - 1.28e0 * d)")} as min_hours, {d.r6("m + 1.28e0 * d")} as max_hours, {d.r6("1.349e0 * d")} as iqr_hours, {d.r6("lat_nm")} as max_lateral_nm from f""")
def I17_route_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = passage.waypoint_confidence(tables.track(spark, sf).withColumn("speed", F.lit(0.0)))
    s = passage.route_confidence(p, ["route_id"])
    return s.select("route_id", "category", *[r6(c(k)).alias(k) for k in ("score", "mean_hours", "std_hours", "min_hours", "max_hours", "iqr_hours", "max_lateral_nm")])


@query(f"""with {d.TRACK}, m as (select route_id % 7 as batch, route_id as member, max(idx) * 1.5e0 + route_id % 3 as h, max(distance_nm) as dist, route_id % 4 <> 0 as reached from track group by route_id),
a as (select *, reached or dist >= 150e0 as ok from m), b as (select *, bool_or(ok) over (partition by batch) as anyone from a), q as (select *, case when ok or not anyone then h end as x from b)
select batch, count(*) as members, {d.r6("avg(x)")} as mean_hours, {d.r6("stddev_pop(x)")} as std_hours, min(x) as min_hours, max(x) as max_hours, {d.r6("quantile_cont(x, 0.1)")} as p10_hours, {d.r6("quantile_cont(x, 0.9)")} as p90_hours, {d.r6("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")} as iqr_hours,
coalesce(arg_min(member, {{'h': h, 'i': member}}) filter (ok), 0) as fastest, coalesce(arg_max(member, {{'h': h, 'i': -member}}) filter (ok), 0) as slowest,
{d.r6("least(greatest(least(greatest(100e0 * exp(-2.2e0 * stddev_pop(x) / greatest(avg(x), 1e0)), 15e0), 98e0) * count(x) / count(*), 10e0), 98e0)")} as score from q group by batch""")
def D08_B08_member_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.track(spark, sf).groupBy("route_id").agg((F.max("idx") * 1.5 + c("route_id") % 3).alias("duration_hours"), F.max("distance_nm").alias("distance_nm"))
    m = m.select((c("route_id") % 7).alias("batch"), c("route_id").alias("member"), "duration_hours", "distance_nm", F.lit(300.0).alias("direct_nm"), (c("route_id") % 4 != 0).alias("reached"))
    s = passage.member_confidence(m, ["batch"])
    return s.select("batch", "members", "min_hours", "max_hours", "fastest", "slowest", *[r6(c(k)).alias(k) for k in ("mean_hours", "std_hours", "p10_hours", "p90_hours", "iqr_hours", "score")])


@query(f"""with {d.OBS}, m as (select event_id, -tws * 0.5144e0 * sin(radians(twd)) as u, -tws * 0.5144e0 * cos(radians(twd)) as v, event_id % 31 as member, (event_id % 200)::double as lead from obs where tws > 0.01),
p as (select *, (member - 15e0) / 15e0 as p, sqrt(u*u+v*v) / (1852e0/3600) as kts, {d.norm("degrees(atan2(-u, -v))")} as dir from m),
q as (select *, greatest(1e0, kts * (1 + p * least(0.40e0, 0.08e0 + 0.003e0 * lead))) * (1852e0/3600) as ms, radians(dir + p * least(40e0, 4 + 0.16e0 * lead) * 0.7e0) as t from p)
select event_id, {d.r6("-ms * sin(t)")} as u, {d.r6("-ms * cos(t)")} as v from q""")
def I05_member_winds(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.obs(spark, sf).where("tws > 0.01")
    u, v = wind.to_uv(c("tws") * 0.5144, c("twd"))
    mu, mv = passage.member_wind(u, v, (c("event_id") % 31).cast("double"), F.lit(31.0), (c("event_id") % 200).cast("double"))
    return o.select("event_id", r6(mu).alias("u"), r6(mv).alias("v"))


_SIDE = "sc as (select * from (values (1.0::double), (0.85::double), (0.7::double), (0.55::double), (0.4::double), (0.25::double), (0.1::double), (0.0::double)) v(scale)), sd as (select * from (values ('left', -90::double), ('right', 90::double)) v(side, turn))"


@query(f"""with {d.OBS}, {d.edges()}, {_SIDE}, q as (select event_id, side, scale, lat, lon, tws * 30 * 1852e0 as m, {d.norm("twd + turn")} as head from obs, sd, sc),
e as (select *, {d.dest_lat("lat", "m * scale", "head")} as y, {d.dest_lon("lat", "lon", "m * scale", "head")} as x from q),
pr as (select event_id, side, scale, 0 as k, y, x from e where m > 50 union all select event_id, side, scale, 1, (lat + y) / 2, (lon + x) / 2 from e where m > 50),
h as (select event_id, side, scale, k, poly_id from pr join edges on {"((y1 > y) <> (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"} group by all having count(*) % 2 = 1),
b as (select e.*, (event_id, side, scale) in (select (event_id, side, scale) from h) as land from e)
select event_id, side, {d.r6("coalesce(arg_max(y, scale) filter (not land), any_value(lat))")} as lat, {d.r6("coalesce(arg_max(x, scale) filter (not land), any_value(lon))")} as lon from b group by event_id, side""")
def I18_G04_envelope(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.obs(spark, sf).select("event_id", "lat", "lon", c("twd").alias("heading"), (c("tws") * 30).alias("lateral_nm"))
    return passage.envelope(p, tables.edges(spark), ["event_id"]).select("event_id", "side", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"))


@query(f"""with {d.TRACK}, g as (select route_id % 3 as model, (epoch_us(max(t)) - epoch_us(min(t))) / 3.6e9 as h, max(round((tws * 1.25e0 + 1.5e0) * 10) / 10) as gust, max(greatest(0.3e0, {d.r1("pow(tws / 10e0, 1.3e0) * 0.5e0")})) as wave, max(greatest(4e0, {d.r1("3.5e0 + sqrt(tws) * 1.2e0")})) as period from track group by route_id)
select case model when 0 then 'gfs_0p25' when 1 then 'ifs_0p25' else 'icon_global' end as model, cast(floor(max(h) / 24) as integer) || 'd ' || cast(floor(max(h) % 24) as integer) || 'h' as duration, max(gust) as gust, max(wave) as wave, max(period) as period,
case model when 0 then 'gefs_0p50' when 1 then 'ifs_ens_0p25' else 'icon_eps_global' end as ensemble, case model when 0 then 31 when 1 then 50 else 40 end as members from g group by g.model""")
def I43_C16_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    from galeframe.functions import text

    t = tables.track(spark, sf).withColumn("us", F.unix_micros(c("t").cast("timestamp")))
    r = t.groupBy("route_id").agg(((F.max("us") - F.min("us")) / 3.6e9).alias("h"), F.max(sailing.gust(c("tws"))).alias("gust"), F.max(sailing.wave_height(c("tws"))).alias("wave"), F.max(sailing.wave_period(c("tws"))).alias("period"))
    model = F.element_at(F.array(*map(F.lit, ("gfs_0p25", "ifs_0p25", "icon_global"))), (c("route_id") % 3 + 1).cast("int"))
    m = r.groupBy(model.alias("model")).agg(F.max("h").alias("h"), F.max("gust").alias("gust"), F.max("wave").alias("wave"), F.max("period").alias("period"))
    return m.withColumn("e", passage.ensemble_of(c("model"))).select("model", text.days_hours(c("h")).alias("duration"), "gust", "wave", "period", "e.ensemble", "e.members")


def coarseness(direct_nm, window_hours):
    """(hours between departures, hours a step, arrival radius, degrees between headings, nodes) for a search, by distance and window."""
    fields = ("departure_hours", "step_hours", "arrival_nm", "fan_deg", "max_nodes")
    row = lambda *v: F.struct(*[x.alias(n) if hasattr(x, "alias") else F.lit(x).alias(n) for x, n in zip(v, fields, strict=True)])
    by = lambda *steps: F.when(window_hours <= steps[0][0], steps[0][1]).when(window_hours <= steps[1][0], steps[1][1]).otherwise(steps[-1][1]) if len(steps) == 3 else F.when(window_hours <= steps[0][0], steps[0][1]).otherwise(steps[1][1])
    return (
        F.when(direct_nm <= 100, row(by((48, 3.0), (120, 6.0), (0, 12.0)), 1 / 3, 1.8, 10.0, 200)).when(direct_nm <= 350, row(by((96, 6.0), (0, 12.0)), 0.75, 4.0, 12.0, 220))
        .when(direct_nm <= 800, row(by((168, 12.0), (0, 24.0)), 1.5, 8.0, 14.0, 220)).otherwise(row(by((168, 12.0), (0, 24.0)), 2.0, 12.0, 15.0, 250))
    )


@query("""with o as (select o_orderkey, o_custkey % 1000::double as nm, o_orderkey % 240::double as win from orders)
select o_orderkey, case when nm <= 100 then case when win <= 48 then 3e0 when win <= 120 then 6e0 else 12e0 end when nm <= 350 then case when win <= 96 then 6e0 else 12e0 end when win <= 168 then 12e0 else 24e0 end as departure_hours,
round(case when nm <= 100 then 1e0 / 3 when nm <= 350 then 0.75e0 when nm <= 800 then 1.5e0 else 2e0 end * 1e6) / 1e6 as step_hours, case when nm <= 100 then 1.8e0 when nm <= 350 then 4e0 when nm <= 800 then 8e0 else 12e0 end as arrival_nm,
case when nm <= 100 then 10e0 when nm <= 350 then 12e0 when nm <= 800 then 14e0 else 15e0 end as fan_deg, case when nm <= 100 then 200 when nm <= 800 then 220 else 250 end as max_nodes,
case when nm <= 100 then 1 / 12e0 when nm <= 250 then 0.25e0 when nm <= 500 then 0.5e0 when nm <= 1200 then 1e0 else 2e0 end as default_step from o""")
def H36_H37_search_settings(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders").select("o_orderkey", (c("o_custkey") % 1000).cast("double").alias("nm"), (c("o_orderkey") % 240).cast("double").alias("win"))
    step = F.when(c("nm") <= 100, 1 / 12).when(c("nm") <= 250, 0.25).when(c("nm") <= 500, 0.5).when(c("nm") <= 1200, 1.0).otherwise(2.0)
    return o.select("o_orderkey", coarseness(c("nm"), c("win")).alias("s"), step.alias("default_step")).select("o_orderkey", "s.departure_hours", r6(c("s.step_hours")).alias("step_hours"), "s.arrival_nm", "s.fan_deg", "s.max_nodes", "default_step")


@query()
def I42_strategy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every pruning rule on one passage of each region: legs, hours and miles."""
    r = tables.read(spark, sf, "region").select(c("r_regionkey").cast("long").alias("route_id"), (F.lit(12.0) + c("r_regionkey") * 6.0).alias("start_lat"), (F.lit(-45.0) - c("r_regionkey") * 4.0).alias("start_lon"), F.lit(0.0).alias("dep_h"))
    r = r.withColumns({"dest_lat": c("start_lat") + 1.5, "dest_lon": c("start_lon") - 2.0})
    parts = [search.outcomes(search.route_search(r, synthetic, search.Config(step_hours=6.0, max_nodes=40, arrival_nm=30.0, strategy=s))).withColumn("strategy", F.lit(s)) for s in sorted(search.STRATEGIES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("route_id", "strategy", "reached", r6(c("duration_hours")).alias("duration_hours"), r6(c("distance_nm")).alias("distance_nm"))
