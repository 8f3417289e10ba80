"""Queries of sources, sinks, catalogues, grids and streams."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions.units import round_to
from galeframe.operators import grids, joins, search
from galeframe.operators.common import durable, shared_folder
from galeframe.plans import duck as d
from galeframe.plans.scalar import r6
from galeframe.sources import catalogue, grib2, index, land, models, requests, shore, versions
from galeframe.streaming import cycles, ingest, steps

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select p_partkey // 100 as id, cast((row_number() over (partition by p_partkey // 100 order by p_partkey) - 1) // 10 as integer) as i, cast((row_number() over (partition by p_partkey // 100 order by p_partkey) - 1) % 10 as integer) as j, round(p_retailprice * 10) / 10 as value from part""")
def A01_grib_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as grids of a hundred points, written as messages in four packings, and read back cell by cell."""
    p = tables.read(spark, sf, "part").select(F.floor(c("p_partkey") / 100).alias("id"), "p_partkey", c("p_retailprice").alias("v"))
    g = p.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "v"))), lambda s: s["v"]).alias("values"))  # a hundred values
    packing = F.get(F.array(*map(F.lit, (0, 2, 3, 4))), (c("id") % 4).cast("int"))
    read = grib2.cells(grib2.decode(grib2.encode_rows(g.withColumn("packing", packing), "id", "values", 10, "packing"), "id", "content"))
    return read.select("id", "i", "j", round_to(c("value").cast("double"), 1).alias("value"))


@query("""with p as (select p_partkey // 400 as id, p_partkey % 400 as k, p_retailprice, p_size, p_partkey from part),
v as (select id, k, case when id % 3 = 0 then round((250 + p_size / 10e0) * 10) / 10 when id % 3 = 1 then case when k % 50 < 35 then 101325e0 else p_retailprice end else case when (k * 7) % 13 > 0 then p_retailprice * (p_partkey % 5) end end as v from p)
select id, cast(k // 20 as integer) as i, cast(k % 20 as integer) as j, round(v * 10) / 10 as value from v""")
def A06_rice_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as fields that are smooth, flat in long runs, or rough with gaps, in messages of adaptive Rice codes, read back cell by cell."""
    p = tables.read(spark, sf, "part").select(F.expr("p_partkey div 400").alias("id"), (c("p_partkey") % 400).alias("k"), "p_retailprice", "p_size", "p_partkey")
    smooth, flat = round_to(F.lit(250.0) + c("p_size") / 10.0, 1), F.when(c("k") % 50 < 35, 101325.0).otherwise(c("p_retailprice"))
    rough = F.when((c("k") * 7) % 13 > 0, c("p_retailprice") * (c("p_partkey") % 5)).otherwise(F.lit(float("nan")))
    v = F.when(c("id") % 3 == 0, smooth).when(c("id") % 3 == 1, flat).otherwise(rough)
    g = p.select("id", "k", v.alias("v")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("values"))  # four hundred values
    read = grib2.cells(grib2.decode(grib2.encode_rows(g.withColumn("packing", F.lit(42)), "id", "values", 20, "packing"), "id", "content"))
    return read.select("id", "i", "j", F.when(~F.isnan("value"), round_to(c("value").cast("double"), 1)).alias("value"))


@query("""with l as (select p_partkey // 50 as file, p_partkey as ord, cast(sum(p_size * 1000) over (partition by p_partkey // 50 order by p_partkey rows unbounded preceding) as bigint) as first, p_brand || ':' || p_type as name from part),
r as (select *, coalesce(lead(first) over (partition by file order by ord) - 1, 0) as last from l), m as (select file, min(ord) as ord from r where contains(name, 'Brand#1') group by file)
select r.file, r.ord as "order", first, last, name from r join m using (file, ord)""")
def A10_E08_byte_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The first message of each index file whose name matches."""
    p = tables.read(spark, sf, "part").withColumn("file", F.floor(c("p_partkey") / 50))
    at = F.sum(c("p_size").cast("long") * 1000).over(Window.partitionBy("file").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    lines = p.select("file", "p_partkey", F.concat_ws(":", c("p_partkey").cast("string"), at.cast("string"), F.lit("d=2026060100"), "p_brand", "p_type").alias("line"))
    return index.first_match(index.byte_ranges(lines, "file", "p_partkey", "line"), F.lit("Brand#1"))


_LINES = "k as (select l_suppkey as file, lower(l_returnflag || l_linestatus) as param, cast(l_linenumber % 2 as varchar) as member, l_partkey as first, cast(l_quantity as bigint) as length, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} as o from lineitem)"


def _json_lines(spark: SparkSession, sf: str) -> DataFrame:
    l = tables.read(spark, sf, "lineitem")  # noqa: E741
    line = F.to_json(F.struct(F.concat("l_returnflag", "l_linestatus").alias("param"), (c("l_linenumber") % 2).cast("string").alias("number"), c("l_partkey").alias("_offset"), c("l_quantity").cast("long").alias("_length")))
    return l.select(c("l_suppkey").alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("o"), line.alias("line"))


@query(f"""with {_LINES} select file, param, member, arg_max(first, o) as first, arg_max(length, o) as length from k group by file, param, member""")
def A11_A12_json_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.json_ranges(_json_lines(spark, sf), "file", "o", "line")


@query(f"""with {_LINES}, b as (select file, param, member, arg_max(first, o) as first, arg_max(length, o) as length from k group by file, param, member), p as (select *, list_position(['xx', 'rf', 'af', 'no'], param) as r from b where param in ('rf', 'af', 'no'))
select file, member, arg_min(param, r) as param, arg_min(first, r) as first, arg_min(length, r) as length from p group by file, member""")
def A11_index_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return index.with_fallback(index.json_ranges(_json_lines(spark, sf), "file", "o", "line"), ["xx", "rf", "af", "no"])


def _models_sql() -> str:
    rows = []
    for m, hours, lag, spans, lo, hi, bundled in models.MODELS:
        steps = " || ".join(f"range({a}, {b + 1}, {e})" for a, b, e in spans)
        rows.append(f"select '{m}' as model, {hours} as every, {lag} as lag, {steps} as steps, {'[-1]' if bundled else f'range({lo}, {hi + 1})'} as members")
    return "m as (" + " union all ".join(rows) + ")"


@query(f"""with {_models_sql()}, v as (select unnest({list(models.VARIABLES)!r}) as variable), n as (select r_regionkey, timestamp '2026-06-01 05:30:00' + to_hours(r_regionkey * 7) as now from region),
cy as (select r_regionkey, model, steps, members, date_trunc('day', now - to_minutes(lag)) + to_hours(cast(hour(now - to_minutes(lag)) // every * every as integer)) as cycle from n, m),
t as (select r_regionkey, model, cycle, unnest(steps) as step, members from cy), u as (select t.*, variable from t, v where not (model = 'icon_global' and variable = 'wind_gust' and step = 0))
select r_regionkey, model, cycle, variable, sum(len(members))::bigint as tasks, cast(min(step) as integer) as first, cast(max(step) as integer) as last, count(distinct step) as steps, (sum(case when step = 0 and variable = 'precip_accum' then len(members) else 0 end))::bigint as zeros from u group by 1, 2, 3, 4""")
def A13_A20_fetch_tasks(spark: SparkSession, sf: str) -> DataFrame:
    now = tables.read(spark, sf, "region").select("r_regionkey", (F.lit("2026-06-01 05:30:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), c("r_regionkey").cast("int") * 7)).alias("now"))
    t = models.tasks(models.latest_cycles(now, "now"))
    return t.groupBy("r_regionkey", "model", "cycle", "variable").agg(F.count("*").alias("tasks"), F.min("step").alias("first"), F.max("step").alias("last"), F.count_distinct("step").alias("steps"), F.count_if("zero").alias("zeros"))


@query("""with now as (select o_orderkey, o_orderdate + to_minutes(cast(o_orderkey * 37 % 1440 as integer)) - to_minutes(210) as t from orders), n as (select o_orderkey, date_trunc('day', t) + to_hours(cast(hour(t) // 6 * 6 as integer)) as newest from now),
listing as (select distinct o_orderdate + to_hours(cast(o_custkey % 4 * 6 as integer)) as cycle from orders where o_orderkey % 5 > 0), k as (select o_orderkey, newest, newest - to_hours(cast(6 * x as integer)) as cycle from n, range(4) r(x))
select o_orderkey, coalesce(max(listing.cycle), any_value(newest)) as cycle, max(listing.cycle) is not null as found from k left join listing using (cycle) group by o_orderkey""")
def A14_uploaded_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """For a time of each order the newest cycle whose last step is in a listing with gaps, at most three cycles back."""
    o = tables.read(spark, sf, "orders")
    listing = o.select((c("o_orderdate") + F.make_dt_interval(F.lit(0), (c("o_custkey") % 4 * 6).cast("int"))).alias("cycle"), F.when(c("o_orderkey") % 5 > 0, 240).otherwise(237).alias("step"))
    now = o.select("o_orderkey", (c("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (c("o_orderkey") * 37 % 1440).cast("int"))).alias("now"))
    return models.uploaded_cycles(now, "now", listing).select("o_orderkey", "cycle", "found")


@query(f"""with {d.ENS}, steps as (select unnest(range(1, 8)) as step), q as (select o_orderkey, o_custkey % 2500 as cell, cast(o_orderkey % 40 as integer) as member, o_orderkey % 3 > 0 as stored from orders),
m as (select cell, step, member, round(avg(u) * 1e6) / 1e6 as value from ens where member < 31 group by all), a as (select cell, step, round(avg(u) * 1e6) / 1e6 as value from ens group by all), have as (select distinct cell, member from m), known as (select p_partkey as cell from part),
e as (select q.*, case when cell not in (select cell from known) then 'beyond the grid' when not stored and member <> 0 then 'members are not stored' end as error, case when stored then (cell, member) in (select (cell, member) from have) else false end as own, member = 0 as first from q),
v as (select o_orderkey, list(case when own then coalesce(m.value, 'nan'::double) when first then coalesce(a.value, 'nan'::double) else 'nan'::double end order by steps.step) as values from e cross join steps left join m on e.cell = m.cell and e.member = m.member and steps.step = m.step left join a on e.cell = a.cell and steps.step = a.step group by o_orderkey)
select o_orderkey, e.cell, e.member, e.stored, error, case when error is null then v.values end as values from e join v using (o_orderkey)""")
def A25_member_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Series of single members as requests ask for them: given, replaced by the mean, empty, or refused."""
    o = tables.read(spark, sf, "orders")
    q = o.select("o_orderkey", (c("o_custkey") % 2500).alias("cell"), (c("o_orderkey") % 40).cast("int").alias("member"), (c("o_orderkey") % 3 > 0).alias("stored"))
    ens = tables.ens(spark, sf)
    members = ens.groupBy("cell", "step", "member").agg(r6(F.avg("u")).alias("value"))
    means = ens.groupBy("cell", "step").agg(r6(F.avg("u")).alias("value"))
    return grids.member_requests(q, members, means, list(range(1, 8)), tables.read(spark, sf, "part").select(c("p_partkey").alias("cell")))


_CELLS = f"{d.ENS}, cl as (select cell, step, avg(u) as value from ens group by cell, step)"


@query(f"""with {_CELLS}, s as (select unnest(range(1, 9)) as step), k as (select distinct cell from cl) select k.cell, list(coalesce(round(value * 1e6) / 1e6, 'nan'::double) order by step) as values from k cross join s left join cl using (cell, step) group by k.cell""")
def A24_A27_cell_series(spark: SparkSession, sf: str) -> DataFrame:
    cells = tables.ens(spark, sf).groupBy("cell", "step").agg(r6(F.avg("u")).alias("value"))
    return grids.series(cells, ["cell"], list(range(1, 9)))


@query(f"""with {d.ENS}, g as (select cell, member, step, avg(u) as value from ens group by 1, 2, 3) select cell, member, list(step order by step) as steps, list(round(value * 1e6) / 1e6 order by step) as values from g group by 1, 2""")
def A25_A26_member_series(spark: SparkSession, sf: str) -> DataFrame:
    g = tables.ens(spark, sf).groupBy("cell", "member", "step").agg(r6(F.avg("u")).alias("value"))
    s = g.groupBy("cell", "member").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("s"))  # a cycle's steps
    return s.select("cell", "member", F.transform("s", lambda x: x["step"]).alias("steps"), F.transform("s", lambda x: x["value"]).alias("values"))


@query(f"""with {d.GRID}, h as (select i // 16 as ci, j // 16 as cj, (i % 16) * 16 + j % 16 as k, value from grid where i % 3 > 0 or j % 5 = 0), e as (select distinct ci, cj, unnest(range(0, 256)) as k from h)
select e.ci, e.cj, list(coalesce(value, 'nan'::double) order by e.k) as values from e left join h using (ci, cj, k) group by e.ci, e.cj""")
def A28_chunks(spark: SparkSession, sf: str) -> DataFrame:
    g = tables.grid(spark, sf).withColumn("value", F.when((c("i") % 3 > 0) | (c("j") % 5 == 0), c("value")).otherwise(float("nan")))
    return grids.chunks(g, [])


@query("""with c as (select distinct o_orderpriority as model, strftime(o_orderdate, '%Y%m%d_%HZ') as cycle from orders), r as (select *, row_number() over (partition by model order by cycle desc) as n from c)
select model, cast(count(*) filter (n > 2) as bigint) as expired, max(cycle) filter (n > 2) as newest_expired, max(strptime(cycle, '%Y%m%d_%HZ')) as reference from r group by model""")
def A33_A35_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    from galeframe.functions import text

    cy = tables.read(spark, sf, "orders").select(c("o_orderpriority").alias("model"), text.cycle_slug(c("o_orderdate")).alias("cycle"))
    gone = catalogue.expired(cy).groupBy("model").agg(F.count("*").alias("expired"), F.max("cycle").alias("newest_expired"))
    return catalogue.newest(cy).join(gone, "model", "left").select("model", F.coalesce("expired", F.lit(0)).alias("expired"), "newest_expired", "reference")


@query()
def A34_D19_store_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes of the test tables' folder, from its listing."""
    return catalogue.sizes(spark, sf, "*.parquet").select("files", "bytes")


@query("""with e as (select event_id, case event_id % 4 when 0 then cast(event_id as varchar) || ', ' || cast(event_id + 1 as varchar) when 1 then '1,2,3' when 2 then '' else '4,x' end as lats from events),
n as (select event_id, case event_id % 4 when 0 then 2 else 0 end as n, case event_id % 4 when 1 then 'lists differ in length' when 2 then 'missing coordinates' when 3 then 'not a number' end as error from e)
select event_id, cast(p.range as integer) as place, case when p.range = 0 then event_id else event_id + 1 end::double as lat, case when p.range = 0 then 5.5 else 6.5 end::double as lon, error from n, range(0, 2) p where n.n = 2
union all select event_id, null, null, null, error from n where n.n = 0""")
def A36_request_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    k, e = c("event_id") % 4, c("event_id")
    r = tables.read(spark, sf, "events").select("event_id", F.when(k == 0, F.concat(e.cast("string"), F.lit(", "), (e + 1).cast("string"))).when(k == 1, F.lit("1,2,3")).when(k == 2, F.lit("")).otherwise(F.lit("4,x")).alias("lats"), F.lit(" 5.5 ,6.5,").alias("lons"))
    return requests.coordinates(r, "event_id", "lats", "lons")


@query("""select event_id, case event_id % 3 when 0 then ['wind_speed_10m', 'temp_2m', 'pressure_msl'] when 1 then ['wind_speed_10m', 'wind_direction_10m', 'pressure_msl'] else ['pressure_msl'] end as hourly,
case when event_id % 2 = 0 then [value, value + 1] else [value] end as speeds from events""")
def A37_B01_G03_reply_and_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns asked for by any of their names, and replies of one object or several."""
    k = c("event_id") % 3
    asked = F.when(k == 0, F.lit("windspeed_10m, temp_2m,,surface_pressure,wind_speed_10m")).when(k == 2, F.lit("surface_pressure,pressure_msl"))
    one = lambda v: F.to_json(F.struct(v.alias("speed")))
    reply = F.when(c("event_id") % 2 == 0, F.concat(F.lit(" ["), one(c("value")), F.lit(","), one(c("value") + 1), F.lit("]"))).otherwise(one(c("value")))
    return tables.read(spark, sf, "events").select("event_id", requests.hourly(asked).alias("hourly"), F.transform(requests.points_of(reply, "speed: double"), lambda p: p["speed"]).alias("speeds"))


@query("""select p_partkey, p_name as name, loa, case when p_size % 2 = 0 then round(loa * 0.85e0 * 1e6) / 1e6 else 9e0 end as lwl, round(loa * 0.3e0 * 0.88e0 * 1e6) / 1e6 as b_wl, round(1.9e0 * 0.35e0 * 1e6) / 1e6 as draft_canoe, round(p_size * 1.15e0 * 1e6) / 1e6 as mast
from (select *, 5 + p_size * 0.25e0 as loa from part) where p_partkey % 5 > 0""")
def A47_boat_files(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.read(spark, sf, "part").withColumn("loa", F.lit(5.0) + c("p_size") * 0.25)
    text = F.to_json(F.struct(c("p_name").alias("name"), "loa", F.when(c("p_size") % 2 != 0, F.lit(9.0)).otherwise(0.0).alias("lwl"), (c("loa") * 0.3).alias("b_max"), F.lit(1.9).alias("draft_total"), c("p_size").cast("double").alias("fore_i")))
    p = p.select("p_partkey", requests.boat(F.when(c("p_partkey") % 5 > 0, text).otherwise(F.lit("{broken"))).alias("b")).where("b is not null")
    return p.select("p_partkey", "b.name", "b.loa", *[r6(c(f"b.{x}")).alias(x) for x in ("lwl", "b_wl", "draft_canoe", "mast")])


@query("""with o as (select o_orderpriority || ';' || o_orderstatus || ';' || cast(o_custkey % 7 as varchar) as stack, (o_orderkey % 50) * 0.5e0 * case o_orderkey % 3 when 0 then 1 when 1 then 1000 else 0.001 end as w, o_orderpriority as a, o_orderstatus as b, cast(o_custkey % 7 as varchar) as c from orders),
p as (select a as path, 1 as depth, w from o union all select a || ';' || b, 2, w from o union all select stack, 3, w from o) select path, depth, round(sum(w) * 1e3) / 1e3 as weight from p group by 1, 2""")
def A49_H65_flame_stacks(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders")
    unit = F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("us")), (c("o_orderkey") % 3 + 1).cast("int"))
    took = F.concat(((c("o_orderkey") % 50) * 0.5).cast("string"), unit)
    t = o.select(F.concat_ws(";", "o_orderpriority", "o_orderstatus", (c("o_custkey") % 7).cast("string")).alias("stack"), requests.milliseconds(took).alias("w"))
    return requests.stack_weights(t, "stack", "w").select("path", "depth", round_to(c("weight"), 3).alias("weight"))


@query(f"""with {d.TRACK}, n as (select route_id, idx, lat, lon, count(*) over (partition by route_id) as n from track) select route_id, idx, round(lat * 1e4) / 1e4 as lat, round(lon * 1e4) / 1e4 as lon from n where idx % greatest(1, n // 50) = 0 or idx = n - 1""")
def A50_wave_compaction(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("route_id"))
    t = tables.track(spark, sf).withColumn("n", n)
    t = t.where((c("idx") % F.greatest(F.lit(1), F.floor(c("n") / 50)) == 0) | (c("idx") == c("n") - 1))
    return t.select("route_id", "idx", round_to(c("lat"), 4).alias("lat"), round_to(c("lon"), 4).alias("lon"))


@query(f"""with {d.TRACK} select route_id, cast(idx // 100 as bigint) as part, string_agg('<trkpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lon) || '"><time>' || strftime(t, '%Y-%m-%dT%H:%M') || '</time></trkpt>', chr(10) order by idx) as gpx from track group by 1, 2""")
def A46_gpx(spark: SparkSession, sf: str) -> DataFrame:
    """Track points as GPX, a segment for each hundred."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"><time>%s</time></trkpt>', "lat", "lon", F.date_format("t", "yyyy-MM-dd'T'HH:mm"))
    g = tables.track(spark, sf).groupBy("route_id", F.floor(c("idx") / 100).alias("part")).agg(F.sort_array(F.collect_list(F.struct("idx", point.alias("p")))).alias("l"))
    return g.select("route_id", "part", F.array_join(F.transform("l", lambda s: s["p"]), "\n").alias("gpx"))


@query()
def A40_simplified_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of 64 points, thinned to within a degree."""
    t = tables.track(spark, sf).select("route_id", F.floor(c("idx") / 64).alias("part"), "idx", "lon", "lat")
    return land.simplify(t, ["route_id", "part"], "idx", 1.0).select("route_id", "idx")


_STARS = """n0 as (select user_id as pid, event_id, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as m from events),
stars as (select pid, k, least(m, 24) as n, -55e0 + pid % 100 + (1 + k % 2 * 0.5e0) * sin(2 * pi() * k / least(m, 24)) as lat, 170e0 + pid * 7 % 20 + (1 + k % 2 * 0.5e0) * cos(2 * pi() * k / least(m, 24)) as lon from n0 where k < 24 and pid % 9 > 0),
micro as (select pid, k, n, round(lat * 1e6) / 1e6 as lat, round(((lon % 360 + 360) % 360) * 1e6) / 1e6 as lon from stars where n >= 6 or pid <= 50),
shore as (select pid, k, n, lat::float::double as lat, (case when lon > 180 then lon - 360 else lon end)::float::double as lon from micro)"""


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """A star for each user, with as many points as the user has events, 24 at most, about the antimeridian; every ninth is a lake."""
    e = tables.read(spark, sf, "events")
    e = e.select(c("user_id").cast("int").alias("poly_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("k"), F.least(F.count("*").over(Window.partitionBy("user_id")), F.lit(24)).alias("n")).where("k < 24")
    turn, far = F.lit(2.0) * F.pi() * c("k") / c("n"), F.lit(1.0) + c("k") % 2 * 0.5
    p = e.select("poly_id", F.when(c("poly_id") % 9 == 0, 2).otherwise(1).alias("level"), "k", (F.lit(170.0) + c("poly_id") * 7 % 20 + far * F.cos(turn)).alias("lon"), (F.lit(-55.0) + c("poly_id") % 100 + far * F.sin(turn)).alias("lat"))
    return p.groupBy("poly_id", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))  # 24 at most


def _built(spark: SparkSession, sf: str) -> str:
    """The stars as raw bytes, read, thinned and written as a compact shoreline."""
    shore.register(spark)
    path = f"{shared_folder(spark)}/shore-{uuid.uuid4().hex}"
    points = land.thinned(land.shorelines(land.raw_rings(stars(spark, sf))))
    shore.rings(points).write.format("shoreline").mode("append").save(path)
    return path


@query(f"""with {_STARS} select cast(pid as integer) as poly_id, 'Land #' || pid as name, count(*) as edges, cast((count(*) + 15) // 16 as integer) as chunks, round(min(lat) * 1e4) / 1e4 as min_lat, round(max(lat) * 1e4) / 1e4 as max_lat, round(min(lon) * 1e4) / 1e4 as min_lon, round(max(lon) * 1e4) / 1e4 as max_lon
from shore group by pid having count(*) >= 3""")
def A39_B09_shoreline_build(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rings to a compact shoreline and back: what each polygon has of edges, chunks and extent. Lakes and specks are left out."""
    e = spark.read.format("shoreline").load(_built(spark, sf))
    r4 = lambda x: round_to(x, 4)
    return e.groupBy("poly_id", "name").agg(F.count("*").alias("edges"), F.count_distinct("chunk").cast("int").alias("chunks"), r4(F.min("y1")).alias("min_lat"), r4(F.max("y1")).alias("max_lat"), r4(F.min("x1")).alias("min_lon"), r4(F.max("x1")).alias("max_lon")).where("edges >= 3")


@query(f"""with {_STARS}, sides as (select pid as poly_id, k as seq, lon as x1, lat as y1, coalesce(lead(lon) over w, first_value(lon) over w) as x2, coalesce(lead(lat) over w, first_value(lat) over w) as y2 from shore window w as (partition by pid order by k)), b as (select poly_id, seq // 16 as chunk, min(least(x1, x2)) as a, max(greatest(x1, x2)) as b, min(least(y1, y2)) as c, max(greatest(y1, y2)) as d from sides group by 1, 2),
i as (select *, unnest(range(cast(floor(c + 90) as integer), cast(floor(d + 90) as integer) + 1)) as i from b), j as (select *, unnest(range(cast(floor(a + 180) as integer), cast(floor(b + 180) as integer) + 1)) as j from i)
select cast(i * 360 + j as integer) as cell, cast(poly_id as integer) as poly_id, cast(chunk as integer) as chunk from j""")
def A41_land_index(spark: SparkSession, sf: str) -> DataFrame:
    """The one-degree cells that the chunks of the built shoreline touch."""
    e = spark.read.format("shoreline").load(_built(spark, sf))
    return land.cell_index(e.select("poly_id", "chunk", "min_lat", "max_lat", "min_lon", "max_lon").distinct())


@query(f"""with {d.OBS}, {_STARS}, jumps as (select pid, k, lat, lon, round((lon - coalesce(lag(lon) over w, lon)) / 360) as jump from shore window w as (partition by pid order by k)),
turned as (select pid, k, lat, lon, sum(jump) over (partition by pid order by k rows unbounded preceding) as turns from jumps),
whole as (select pid, k, lat, lon - 360 * turns as lon from turned), copies as (select pid, k, 0 as copy, lat, lon from whole union all select pid, k, 1, lat, lon - 360 from whole where pid in (select pid from whole group by pid having max(lon) > 180)
 union all select pid, k, 1, lat, lon + 360 from whole where pid in (select pid from whole group by pid having max(lon) <= 180 and min(lon) < -180)),
sides as (select pid, lat as y1, lon as x1, coalesce(lead(lat) over w, first_value(lat) over w) as y2, coalesce(lead(lon) over w, first_value(lon) over w) as x2 from copies window w as (partition by pid, copy order by k)),
p as (select event_id, lat, case when lon > 0 then 150e0 + lon / 6 else -150e0 + lon / 6 end as lon from obs)
select event_id, cast(pid as integer) as poly_id from p join sides on ((y1 > lat) <> (y2 > lat)) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by all having count(*) % 2 = 1""")
def A41_C10_shore_points(spark: SparkSession, sf: str) -> DataFrame:
    """Observations near the antimeridian and the polygons that hold them; of the compact shoreline only chunks of the latitudes in question are read."""
    p = tables.obs(spark, sf).select("event_id", "lat", F.when(c("lon") > 0, F.lit(150.0) + c("lon") / 6).otherwise(F.lit(-150.0) + c("lon") / 6).alias("lon"))
    path = _built(spark, sf)
    # rings are read whole: a chunk left out would leave a ring open
    touched = shore.near(spark, path, -60.0, 60.0, -180.0, 180.0).select("poly_id").distinct()
    e = spark.read.format("shoreline").load(path).join(touched, "poly_id", "left_semi")
    ring = land.unwrapped(e.select("poly_id", "seq", c("x1").alias("lon"), c("y1").alias("lat")))
    w = Window.partitionBy("poly_id", "copy").orderBy("seq")
    nxt = lambda x: F.coalesce(F.lead(x).over(w), F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sides = ring.select("poly_id", "seq", c("lon").alias("x1"), c("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))
    return joins.places_in_polygons(p, durable(sides), ["event_id"])  # the index reads them twice


@query("""with one as (select c_custkey as id, c_name as name, c_acctbal as x from customer), last as (select o_custkey as id, arg_max({'t': o_totalprice, 's': o_orderstatus}, {'k': o_orderkey}) as o from orders group by 1),
two as (select id, coalesce(name, 'order') as name, coalesce(o.t, x) as x from one full join last using (id)), three as (select two.* from two left join last using (id) where o.s is distinct from 'F'),
v as (select 1 as version, * from one union all select 2, * from two union all select 3, * from three)
select version, id % 10 as part, count(*) as n, round(sum(x) * 100) / 100 as total, count(*) filter (name = 'order') as unnamed from v group by all""")
def A48_stored_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a table of versions: loaded, upserted by the last order of each, and without those whose last order is finished; every version is read back."""
    t = versions.Versioned(spark, f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}", "id long, name string, x double", ("id",))
    own = tables.read(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("x"))
    o = tables.read(spark, sf, "orders").select(c("o_custkey").alias("id"), "o_orderkey", c("o_totalprice").alias("x"), "o_orderstatus")
    t.upsert(own)
    t.upsert(o.join(own.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", F.lit("order"))), order="o_orderkey")
    last = o.groupBy("id").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s")).where("s = 'F'")
    t.upsert(last.select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("gone")), deleted="gone")
    parts = [t.read(v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    v = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return v.groupBy("version", (c("id") % 10).alias("part")).agg(F.count("*").alias("n"), round_to(F.sum("x"), 2).alias("total"), F.count_if(c("name") == "order").alias("unnamed"))


@query(f"""with {d.GRID} select i, cast((g.j + 25) % 50 as integer) as j, value, coalesce((select min(s) from unnest([0, 3, 6, 12]) t(s) where s >= g.j), 0) as step from grid g""")
def H18_B11_rotation_and_step(spark: SparkSession, sf: str) -> DataFrame:
    g = tables.grid(spark, sf).withColumn("step", grids.step_at_least([0, 3, 6, 12], c("j")))
    return g.select("i", grids.rotate_half(c("j"), 50).alias("j"), "value", "step")


@query(f"""with {d.ENS}, g as (select cell, step, member, max(sqrt(u*u+v*v)) as s from ens group by 1, 2, 3) select cell, step, round(max(s) filter (member = 0) * 1e6) / 1e6 as wind_speed_10m_member00, round(max(s) filter (member = 7) * 1e6) / 1e6 as wind_speed_10m_member07 from g group by 1, 2""")
def B02_member_columns(spark: SparkSession, sf: str) -> DataFrame:
    m = grids.member_columns(tables.ens(spark, sf), ["cell", "step"], [0, 7])
    return m.select("cell", "step", *[r6(c(x)).alias(x) for x in m.columns[2:]])


def _lattice_sql() -> str:
    """That of the synthetic field, over the lattice of the data source."""
    from galeframe.plans import relational

    whole = relational.FIELD_SQL
    k = "(1852e0 / 3600)"
    whole = whole.replace("range(-180, 180, 30) b, range(0, 97, 24) h", "range(-180, 180, 20) b, range(0, 25, 3) h")
    asked = "with asked as (select cast(o_orderkey % 9 * 3 as integer) as hour, count(*) as asked from orders group by 1), "
    whole = whole.replace("with l as", asked + "l as", 1).replace(" from b", " , asked from b join asked using (hour)") if whole.endswith(" as v from b") else whole
    return whole.replace("select lat, lon, hour, round(", f"select lat, lon, hour, round(sqrt(pow((bu + du) * {k}, 2) + pow((bv + dv) * {k}, 2)) / {k} * 1e6) / 1e6 as tws, round(")


@query(_lattice_sql())
def I06_K01_wind_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """The synthetic field sampled by the engine's own data source, as a table, at the hours that orders ask for, and how many do."""
    from galeframe.sources.wind import SyntheticWind, with_wind

    spark.dataSource.register(SyntheticWind)
    w = with_wind(spark.read.format("synthetic_wind_lattice").option("step", 20).option("hours", 24).load())
    asked = tables.read(spark, sf, "orders").groupBy((c("o_orderkey") % 9 * 3).cast("int").alias("hour")).agg(F.count("*").alias("asked"))
    return w.join(asked, "hour").select("hour", "lat", "lon", *[r6(c(k)).alias(k) for k in ("u", "v", "tws")], "asked")


_ARRIVALS = "select cast(user_id as varchar) as step, cast(event_id % 16 as integer) as member, value from events"


@query(f"""with m as (select step, member, min(value) as v from ({_ARRIVALS}) group by 1, 2) select step, cast(count(*) as integer) as n, round(avg(v) * 1e6) / 1e6 as mean, min(v) as low, max(v) as high from m group by step having count(*) = 16""")
def J03_J05_complete_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of arrivals; a step is reduced once, when its sixteen members are there."""
    s = ingest.stream_of(spark, sf, "events.parquet")
    a = s.select(c("user_id").cast("string").alias("step"), (c("event_id") % 16).cast("int").alias("member"), "value")
    out = ingest.to_table(ingest.complete_steps(a, 16))
    return out.select("step", "n", r6(c("mean")).alias("mean"), "low", "high")


@query("""select event_type as model, strftime(ts, '%Y-%m-%d') as cycle, cast(event_id % 3 as integer) as variable, count(*) as n, round(sum(value) * 1e4) / 1e4 as total, ts < timestamp '2024-01-10' as seen_after_failure from events group by all""")
def J02_J06_whole_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries of daily cycles. One variable of the second fails the first time: what a reader sees then is of the first alone; the retry publishes the second, and old cycles that come again in the third are left out."""
    e = tables.read(spark, sf, "events").select(c("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("cycle"), (c("event_id") % 3).cast("int").alias("variable"), "value")
    cut = lambda low, high: e.where(c("cycle").between(low, high))
    folder = ingest.landing(spark, [cut("2024-01-01", "2024-01-09")])
    root = f"{folder}-store"
    slices = ingest.stream_of(spark, folder, "*.parquet", None)  # a delivery is a batch: the next one lands when it is read
    broken = F.when((c("variable") == 1) & (c("cycle") == "2024-01-15"), F.raise_error(F.lit("a slice can't be read"))).otherwise(c("value"))
    unsteady = lambda b: b.withColumn("value", broken)
    cycles.start(slices, root, unsteady).awaitTermination()
    ingest.landing(spark, [cut("2024-01-10", "2024-01-19")], folder)
    try:
        cycles.start(slices, root, unsteady).awaitTermination()
    except StreamingQueryException:
        pass
    schema = slices.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    early = cycles.visible(spark, root, schema).select("model", "cycle").distinct()
    early = durable(early)
    ingest.landing(spark, [e.where((c("cycle") > "2024-01-19") | (c("cycle") < "2024-01-05"))], folder)
    cycles.start(slices, root, lambda b: b).awaitTermination()
    rows = cycles.visible(spark, root, schema).groupBy("model", "cycle", "variable").agg(F.count("*").alias("n"), round_to(F.sum("value"), 4).alias("total"))
    return rows.join(early.withColumn("_seen", F.lit(True)), ["model", "cycle"], "left").select("model", "cycle", "variable", "n", "total", F.coalesce("_seen", F.lit(False)).alias("seen_after_failure"))


@query(f"""with m as (select step, member, min(value) as v from ({_ARRIVALS}) group by 1, 2) select step, cast(count(*) as integer) as n, round(avg(v) * 1e6) / 1e6 as mean, min(v) as low, max(v) as high from m group by step having count(*) = 16""")
def J05_expiring_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals, then copies of them with smaller values, then an arrival long after: each step is reduced once, and its state ends."""
    e = tables.read(spark, sf, "events").select(c("user_id").cast("string").alias("step"), (c("event_id") % 16).cast("int").alias("member"), "value", c("ts").cast("timestamp").alias("t"))
    complete = e.groupBy("step").agg(F.count_distinct("member").alias("n")).where("n = 16").select("step")
    copies = e.join(complete, "step", "left_semi").withColumn("value", c("value") - 1.0)
    later = e.limit(1).select(F.lit("later").alias("step"), "member", "value", F.expr("timestamp '2024-12-01'").alias("t"))
    with steps.timed_state(spark):
        out = ingest.in_turn(spark, [e, copies, later], lambda s: steps.expiring_steps(s.withWatermark("t", "60 days"), 16, keep_hours=24.0))
    return out.select("step", "n", r6(c("mean")).alias("mean"), "low", "high")


@query("""select a.user_id as cell, a.ts::timestamptz::timestamp as t, round(sqrt(a.value * a.value + (a.value / 2) * (a.value / 2)) * 1e6) / 1e6 as speed from events a""")
def J04_rendezvous(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams of components joined on cell and time."""
    part = lambda k: ingest.stream_of(spark, sf, "events.parquet").select(c("user_id").alias("cell"), c("ts").cast("timestamp").alias("t"), (c("value") / k).alias("value"))
    out = ingest.to_table(ingest.rendezvous(part(1.0), part(2.0), "60 days"))
    return out.select("cell", c("t").cast("timestamp_ntz").alias("t"), r6(c("speed")).alias("speed"))


_LATE = "event_id % 50 = 0 and ts < timestamp '2024-01-05'"


@query(f"""with e as (select event_type, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, value from events where not ({_LATE}))
select event_type, start, count(*) as n, round(sum(value) * 1e4) / 1e4 as total from e where start + interval '6 hours' <= (select max(ts) - interval '1 hour' from events) group by 1, 2""")
def J10_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows of event time over a stream of three deliveries, the last of which is late and dropped; windows come out when the watermark has passed them. An extension of the engine."""
    e = tables.read(spark, sf, "events").select("event_type", "event_id", c("ts").cast("timestamp").alias("t"), "value")
    late = F.expr(_LATE.replace("ts <", "cast(t as timestamp_ntz) <").replace("timestamp '", "timestamp_ntz '"))
    first = c("t") < F.lit("2024-01-20").cast("timestamp")
    w = ingest.in_turn(spark, [e.where(~late & first), e.where(~late & ~first), e.where(late)], lambda s: ingest.windows(s, "event_type"))
    return w.select("event_type", c("start").cast("timestamp_ntz").alias("start"), "n", round_to(c("total"), 4).alias("total"))


@query(f"with {d.TRACK} select route_id, idx from track where idx % 4 = 0")
def E13_recorded_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Fronts of about every hour of searches with steps of a quarter of an hour."""
    nodes = tables.track(spark, sf).select("route_id", c("idx").alias("step"), "lat", "lon")
    return search.waves(search.Found(nodes, nodes, search.Config(step_hours=0.25))).select("route_id", c("step").alias("idx"))


@query("select case when event_id % 3 = 0 then 'a' when event_id % 3 = 1 then 'b' else 'c' end as model, cast(count(*) as integer) as n from events group by 1")
def J01_J08_polled_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of three models, polled one after the other: the rows of each, from the table of progress that the poll keeps."""
    model = F.element_at(F.array(*map(F.lit, "abc")), (c("event_id") % 3 + 1).cast("int"))
    e = tables.read(spark, sf, "events").withColumn("model", model)
    folder = ingest.landing(spark, [])
    for m in "abc":
        ingest.landing(spark, [e.where(c("model") == m)], folder)
        ingest.polled(ingest.stream_of(spark, folder, "*.parquet", None), ingest.tracked(f"{folder}-progress", "model"), base=f"{folder}-poll").awaitTermination()
    return spark.read.parquet(f"{folder}-progress").groupBy("model").agg(F.sum("rows").cast("int").alias("n"))


@query(f"""with {d.GRID} select i, j, list(round((value + 0.5e0 * s) * 1e6) / 1e6 order by s) as series from grid, unnest([0, 3, 6]) t(s) group by i, j""")
def A23_A32_open_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two cycles written and published one after the other; the series of the newer one, read from the opened store."""
    root = ingest.landing(spark, []) + "-store"
    g = tables.grid(spark, sf).withColumn("step", F.explode(F.array(F.lit(0), F.lit(3), F.lit(6))))
    for cycle, rise in (("20260601_00Z", 9.0), ("20260601_06Z", 0.5)):
        cells = g.select(F.lit("gfs_0p25").alias("model"), F.lit(cycle).alias("cycle"), F.lit("mslp").alias("variable"), "step", "i", "j", (c("value") + c("step") * rise).alias("value"))
        catalogue.write_cycle(cells, f"{root}/cells")
        catalogue.publish(spark, root, "gfs_0p25", cycle)
    opened = catalogue.open_latest(spark, root, f"{root}/cells", "gfs_0p25")
    s = opened.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("l"))
    return s.select("i", "j", F.transform("l", lambda x: r6(x["value"])).alias("series"))


@query("""select p_partkey // 100 as id, any_value(['wind_u_10m', 'mslp'][cast(p_partkey // 100 % 2 + 1 as integer)]) as variable, 0 as member, cast(10 as integer) as nlons, round(avg(round(p_retailprice * 10) / 10) * 1e3) / 1e3 as mean from part group by 1""")
def A09_canonical_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as slices of named variables, and the mean of each one's data."""
    p = tables.read(spark, sf, "part").select(F.floor(c("p_partkey") / 100).alias("id"), "p_partkey", c("p_retailprice").alias("v"))
    g = p.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "v"))), lambda s: s["v"]).alias("values"))  # a hundred values
    decoded = grib2.decode(grib2.encode_rows(g.withColumn("packing", F.lit(0)), "id", "values", 10, "packing"), "id", "content")
    s = grib2.canonical(decoded, F.get(F.array(F.lit("wind_u_10m"), F.lit("mslp")), (c("id") % 2).cast("int")))
    mean = F.aggregate("data", F.lit(0.0), lambda a, x: a + round_to(x.cast("double"), 1)) / F.size("data")
    return s.select("id", "variable", "member", c("nlons").cast("int").alias("nlons"), round_to(mean, 3).alias("mean"))
