"""Queries that sail in, or look up, winds of a stored forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.operators import passage, regions, search
from galeframe.operators.weather import Chosen, Field, Lattice, StoredWinds
from galeframe.plans import duck as d
from galeframe.plans.relational import field_sql
from galeframe.plans.scalar import r6
from galeframe.plans.search import COARSE, _track_of, passages, synthetic

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Hours of the steps of the stored forecast, and where its lattices begin and how far apart their cells are (latitude, longitude).
HOURS = (0.0, 3.0, 6.0, 12.0, 24.0, 48.0)
STORED, LIVE = (8.0, 1.0, -68.0, 1.0), (-30.0, 2.0, 100.0, 2.5)


def stored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast of the parts, 50 cells a row, with gaps: now and then a component is null or NaN."""
    p = tables.read(spark, sf, "part").withColumn("hour", F.explode(F.array(*map(F.lit, HOURS))))
    u = -(F.lit(5.0) + c("p_retailprice") * 10.0 % 70.0 / 10.0) + c("hour") * 0.02
    v = -(F.lit(2.0) + c("p_partkey") % 17 / 4.0) + c("hour") * 0.03
    gap = lambda x, k: ((c("p_partkey") * x + c("hour")) % k == 0)
    return p.select(F.expr("cast(p_partkey div 50 as int)").alias("i"), (c("p_partkey") % 50).cast("int").alias("j"), "hour", F.when(~gap(7, 23), u).alias("u"), F.when(gap(1, 29), F.lit(float("nan"))).otherwise(v).alias("v"))


def live_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A region as a live service gives it: knots and degrees by supplier, 10 cells a row."""
    s = tables.read(spark, sf, "supplier").withColumn("hour", F.explode(F.array(*map(F.lit, HOURS))))
    ms, at = (c("s_acctbal") + 1000.0) % 25.0 * (1852.0 / 3600.0), F.radians(c("s_suppkey") * 37 % 360 + c("hour"))
    return s.select(F.expr("cast(s_suppkey div 10 as int)").alias("i"), (c("s_suppkey") % 10).cast("int").alias("j"), "hour", (-ms * F.sin(at)).alias("u"), (-ms * F.cos(at)).alias("v"))


def _stored(cells: DataFrame, at: tuple[float, float, float, float]) -> StoredWinds:
    return StoredWinds(cells, Lattice.of(cells, *at))


_HOURS = f"[{', '.join(f'{h}::double' for h in HOURS)}]"
_CELLS = {
    "stored": f"""select p_partkey // 50 as i, p_partkey % 50 as j, hour, case when (p_partkey * 7 + hour) % 23 <> 0 then -(5e0 + p_retailprice * 10e0 % 70e0 / 10e0) + hour * 0.02e0 end as u,
 case when (p_partkey + hour) % 29 = 0 then 'nan'::double else -(2e0 + p_partkey % 17 / 4e0) + hour * 0.03e0 end as v from part, unnest({_HOURS}) t(hour)""",
    "live": f"""select s_suppkey // 10 as i, s_suppkey % 10 as j, hour, -((s_acctbal + 1000e0) % 25e0) * (1852e0 / 3600) * sin(radians(s_suppkey * 37 % 360 + hour)) as u,
 -((s_acctbal + 1000e0) % 25e0) * (1852e0 / 3600) * cos(radians(s_suppkey * 37 % 360 + hour)) as v from supplier, unnest({_HOURS}) t(hour)""",
}


def _blown_sql(name: str, places: str, at: tuple[float, float, float, float]) -> str:
    """CTEs from ``places`` (id, lat, lon, hour) to ``<name>_wind`` (id, tws, twd): eight corners for each place."""
    lat, dlat, lon, dlon = at
    good = lambda v: f"sum(w * {v}) filter ({v} is not null and not isnan({v})) / sum(w) filter ({v} is not null and not isnan({v}))"
    enough = lambda v: f"case when sum(w) filter ({v} is not null and not isnan({v})) >= 1e-6 then {good(v)} end as {v}"
    n = name
    return f"""{n}_cells as ({_CELLS[name]}), {n}_size as (select max(i) as ni, max(j) as nj from {n}_cells),
{n}_axes as (select id, least(greatest((lat - {lat}::double) / {dlat}::double, 0), ni) as y, ((lon - {lon}::double) % 360e0 + 360e0) % 360e0 / {dlon}::double as x0, nj, hour,
 least(greatest(len(list_filter({_HOURS}, lambda s: s <= hour)) - 1, 0), {len(HOURS) - 2}) as k from {places}, {n}_size),
{n}_at as (select id, y, case when x0 > nj then 0e0 else x0 end as x, {_HOURS}[k + 1] as h0, {_HOURS}[k + 2] as h1, least(greatest((hour - {_HOURS}[k + 1]) / ({_HOURS}[k + 2] - {_HOURS}[k + 1]), 0e0), 1e0) as f from {n}_axes),
{n}_met as (select id, floor(y) + di as i, floor(x) + dj as j, case when ds = 0 then h0 else h1 end as hour, (case when di = 0 then 1 - (y - floor(y)) else y - floor(y) end) * (case when dj = 0 then 1 - (x - floor(x)) else x - floor(x) end) * (case when ds = 0 then 1 - f else f end) as w
 from {n}_at, range(2) a(di), range(2) b(dj), range(2) e(ds)),
{n}_uv as (select id, {enough("u")}, {enough("v")} from {n}_met join {n}_cells using (i, j, hour) where w > 0 group by id),
{n}_wind as (select id, {d.r6("sqrt(u * u + v * v) / (1852e0 / 3600)")} as tws, {d.r6(d.norm("degrees(atan2(-u, -v))"))} as twd from {places} left join {n}_uv using (id))"""


_SPOTS = f"{d.OBS}, spots as (select event_id as id, lat, lon, (event_id % 60)::double as hour, case event_id % 3 when 0 then 'stored' when 1 then 'live' else 'synthetic' end as provider from obs)"


def spots(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("stored", "live", "synthetic"))), (c("event_id") % 3 + 1).cast("int"))
    return tables.obs(spark, sf).select(c("event_id").alias("id"), "lat", "lon", (c("event_id") % 60).cast("double").alias("hour"), name.alias("provider"))


@query(f"with {_SPOTS}, {_blown_sql('stored', 'spots', STORED)} select id, tws, twd from stored_wind")
def H24_stored_wind(spark: SparkSession, sf: str) -> DataFrame:
    """The wind of a stored forecast anywhere: beyond the lattice its edge, beyond the steps the first or last."""
    p = spots(spark, sf)
    return _stored(stored_cells(spark, sf), STORED).over("lat", "lon", c("hour"))(p).select("id", r6(c("wind_tws")).alias("tws"), r6(c("wind_twd")).alias("twd"))


@query(f"""with {_SPOTS}, {_blown_sql('stored', 'spots', STORED)}, {_blown_sql('live', 'spots', LIVE)}, drawn as (select id as event_id, lat, lon, hour from spots), {field_sql("drawn")},
synthetic_wind as (select event_id as id, {d.r6("sqrt(u * u + v * v) / (1852e0 / 3600)")} as tws, {d.r6(d.norm("degrees(atan2(-u, -v))"))} as twd from field)
select id, provider, w.tws, w.twd from spots join (select *, 'stored' as provider from stored_wind union all select *, 'live' from live_wind union all select *, 'synthetic' from synthetic_wind) w using (id, provider)""")
def I06_K02_three_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Points, each by the provider it names: a stored forecast, a live region, the synthetic field."""
    winds = Chosen({"stored": _stored(stored_cells(spark, sf), STORED), "live": _stored(live_cells(spark, sf), LIVE), "synthetic": Field(synthetic)}, "provider")
    return winds.over("lat", "lon", c("hour"))(spots(spark, sf)).select("id", "provider", r6(c("wind_tws")).alias("tws"), r6(c("wind_twd")).alias("twd"))


_BOXES = """boxes as (select s_suppkey, -10e0 + s_suppkey % 40 as min_lat, -75e0 + s_suppkey % 60 as min_lon, 2e0 + s_suppkey % 5 as lat_span, 3e0 + s_suppkey % 7 as lon_span, case when s_suppkey % 3 > 0 then s_suppkey % 3::double end as step, (s_suppkey % 50)::double as hour from supplier),
stepped as (select *, case when step > 0 then step else 1.5e0 end as s from boxes), sized as (select *, cast(round(lat_span / s) as integer) + 1 as n, cast(round(lon_span / s) as integer) + 1 as m from stepped),
nodes as (select s_suppkey * 10000 + gi * 100 + gj as id, min_lat + gi * s as lat, min_lon + gj * s as lon, hour from sized, range(20) a(gi), range(20) b(gj) where gi < n and gj < m)"""


@query(f"with {_BOXES}, {_blown_sql('stored', 'nodes', STORED)} select id // 10000 as s_suppkey, id % 10000 // 100 as gi, id % 100 as gj, tws, twd from stored_wind")
def I22_weather_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The winds of boxes, as many rows and columns as their steps have in their spans; a box without a step has one of 1.5 degrees."""
    k = c("s_suppkey")
    b = tables.read(spark, sf, "supplier").select("s_suppkey", (F.lit(-10.0) + k % 40).alias("min_lat"), (F.lit(-75.0) + k % 60).alias("min_lon"), (F.lit(2.0) + k % 5).alias("lat_span"), (F.lit(3.0) + k % 7).alias("lon_span"),
                                                  F.when(k % 3 > 0, (k % 3).cast("double")).alias("step"), (k % 50).cast("double").alias("hour"))
    winds = _stored(stored_cells(spark, sf), STORED)
    return search.weather_grid(b, winds, "s_suppkey").select("s_suppkey", "gi", "gj", r6(c("wind_tws")).alias("tws"), r6(c("wind_twd")).alias("twd"))


@query()
def I07_search_on_stored_wind(spark: SparkSession, sf: str) -> DataFrame:
    """All nations' passages in the stored forecast, as waypoints."""
    return search.waypoints(search.route_search(passages(spark, sf), _stored(stored_cells(spark, sf), STORED), COARSE))


@query()
def I15_I21_windows_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Departures of each region's passage ranked by comfort: in the stored forecast where it covers the passage and six degrees around it, else in the synthetic field."""
    winds = _stored(stored_cells(spark, sf), STORED)
    routes = search.with_provider(passages(spark, sf), winds.lattice)
    found = search.route_search(routes, Chosen({"stored": winds, "synthetic": Field(synthetic)}, "provider"), COARSE)
    o = search.outcomes(found).where("reached").join(routes.select("route_id", "batch"), "route_id")
    scored = o.select("route_id", "batch", c("dep_h").alias("lead_hours"), "dest_lon", "tacks", "gybes")
    ranked = passage.window_scores(_track_of(found).join(scored.select("route_id"), "route_id", "left_semi"), scored)
    return ranked.join(routes.select("route_id", "provider"), "route_id")


_REGION = """boxes as (select user_id * 10 + case event_type when 'click' then 1 when 'view' then 2 when 'error' then 3 when 'purchase' then 4 else 5 end as region_id, arg_min({'e': event_id, 'v': value, 't': ts}, event_id) as x from events group by user_id, event_type, 1),
regions as (select region_id, x.t as fetched_at, -60e0 + x.e % 110 as min_lat, -60e0 + x.e % 110 + 10 + x.v % 40 as max_lat, -175e0 + x.e * 7 % 300 as min_lon, -175e0 + x.e * 7 % 300 + 12 + x.v % 50 as max_lon from boxes),
q as (select event_id, ts as at, -55e0 + event_id % 110 as min_lat, -55e0 + event_id % 110 + 1 + value % 25 as max_lat, -170e0 + event_id * 13 % 320 as min_lon, -170e0 + event_id * 13 % 320 + 2 + value % 30 as max_lon, case when event_id % 4 = 0 then 0e0 else 1.5e0 end as lat_step, 1.5e0 as lon_step from events)"""


@query(f"""with {_REGION}, hit as (select event_id, arg_min(region_id, {{'t': -epoch_us(fetched_at), 'r': region_id}}) as region from q join regions r on q.min_lat >= r.min_lat - 0.5 and q.max_lat <= r.max_lat + 0.5 and q.min_lon >= r.min_lon - 0.5 and q.max_lon <= r.max_lon + 0.5
 and fetched_at <= q.at and epoch_us(q.at) - epoch_us(fetched_at) < 6 * 3600000000 group by event_id),
f as (select event_id, max_lat - min_lat as a, max_lon - min_lon as b, case when max_lat - min_lat > 15 then greatest(lat_step, 2e0) else lat_step end as sa, case when max_lon - min_lon > 20 then greatest(lon_step, 2.5e0) else lon_step end as sb from q),
g as (select event_id, a, b, case when sa <= 0 then 2e0 else sa end as sa, sb from f), k as (select event_id, min(x) as x from g, range(0, 61) r(x) where (round(a / (sa * pow(1.2e0, x))) + 1) * (round(b / (sb * pow(1.2e0, x))) + 1) <= 120 group by event_id)
select event_id, region, {d.r6("sa * pow(1.2e0, x)")} as lat_step, {d.r6("sb * pow(1.2e0, x)")} as lon_step, cast(round(a / (sa * pow(1.2e0, x))) as integer) + 1 as n_lat, cast(round(b / (sb * pow(1.2e0, x))) as integer) + 1 as n_lon from g join k using (event_id) left join hit using (event_id)""")
def I04_B05_region_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Requests met with regions fetched up to six hours before, and the grid to fetch where there is none."""
    e = tables.read(spark, sf, "events")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, k in enumerate(("click", "view", "error", "purchase")) for x in (k, n + 1)]), c("event_type")), F.lit(5))
    first = e.groupBy((c("user_id") * 10 + kind).alias("region_id"), "event_type").agg(F.min_by(F.struct("event_id", "value", "ts"), "event_id").alias("x"))
    low, west = F.lit(-60.0) + c("x.event_id") % 110, F.lit(-175.0) + c("x.event_id") * 7 % 300
    held = first.select("region_id", c("x.ts").alias("fetched_at"), low.alias("min_lat"), (low + 10 + c("x.value") % 40).alias("max_lat"), west.alias("min_lon"), (west + 12 + c("x.value") % 50).alias("max_lon"))
    low, west = F.lit(-55.0) + c("event_id") % 110, F.lit(-170.0) + c("event_id") * 13 % 320
    q = e.select("event_id", c("ts").alias("at"), low.alias("min_lat"), (low + 1 + c("value") % 25).alias("max_lat"), west.alias("min_lon"), (west + 2 + c("value") % 30).alias("max_lon"), F.when(c("event_id") % 4 == 0, 0.0).otherwise(1.5).alias("lat_step"), F.lit(1.5).alias("lon_step"))
    found = regions.fetch_steps(regions.cached(q, held, "event_id"))
    return found.select("event_id", "region", r6(c("lat_step")).alias("lat_step"), r6(c("lon_step")).alias("lon_step"), "n_lat", "n_lon")
