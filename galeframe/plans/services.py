"""Queries of what the services answer: current weather, slices by member, file names, store plans, warnings, exports and shorelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions import sailing, text, wind
from galeframe.functions.units import round_to
from galeframe.operators import aggregates, joins, passage, search
from galeframe.plans import duck as d
from galeframe.plans import relational
from galeframe.plans.relational import _CORNERS, _POINTS, SPEC, points
from galeframe.plans.scalar import r6
from galeframe.plans.search import passages, synthetic
from galeframe.sources import models

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STEPPED = """stepped as (select i, j, s as step, case when (i * 7 + j * 3 + s) % 11 <> 0 then value - 899.95e0 + s * 0.1e0 end as u,
 case when (i + j + s) % 13 = 0 then 'nan'::double else (value - 899.93e0) * 0.5173e0 - s * 0.2e0 end as v from grid, unnest(range(0, 25, 3)) t(s))"""
_GOOD = lambda v: f"case when sum(w) filter ({v} is not null and not isnan({v})) >= 1e-6 then sum(w * {v}) filter ({v} is not null and not isnan({v})) / sum(w) filter ({v} is not null and not isnan({v})) end as {v}"


def stepped(spark: SparkSession, sf: str) -> DataFrame:
    g = tables.grid(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(24), F.lit(3))))
    u, v = c("value") - 899.95 + c("step") * 0.1, (c("value") - 899.93) * 0.5173 - c("step") * 0.2
    u = F.when((c("i") * 7 + c("j") * 3 + c("step")) % 11 != 0, u)  # gaps: null in one component, NaN in the other
    return g.select("i", "j", "step", u.alias("u"), F.when((c("i") + c("j") + c("step")) % 13 == 0, F.lit(float("nan"))).otherwise(v).alias("v"))


@query(f"""with {_POINTS}, {d.GRID}, {_CORNERS}, {_STEPPED}, h as (select *, least(event_id % 30, 24)::double as hr from corners), b as (select *, least(floor(hr / 3) * 3, 21) as lo from h),
w as (select event_id, i, j, cast(lo as integer) as step, w * (1 - (hr - lo) / 3) as w from b union all select event_id, i, j, cast(lo + 3 as integer), w * ((hr - lo) / 3) from b),
f as (select event_id, {_GOOD('u')}, {_GOOD('v')} from w join stepped using (i, j, step) group by event_id), a as (select event_id, u, v from pts left join f using (event_id))
select event_id, {d.r6("coalesce(sqrt(u * u + v * v) / (1852e0 / 3600), 12e0)")} as tws, coalesce({d.r6(d.norm("degrees(atan2(-u, -v))"))}, 45e0) as twd from a""")
def H24_wind_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Wind of a stepped grid at places and times; beyond the grid a breeze of 12 knots from the north-east."""
    p = points(spark, sf).select("event_id", "lat", "lon", (c("event_id") % 30).cast("double").alias("hour"))
    uv = joins.interpolate_in_time(p, stepped(spark, sf), SPEC, ["event_id"], "hour", 3.0, 24.0, ["u", "v"])
    tws, twd = wind.condition(c("u"), c("v"))
    return uv.select("event_id", F.coalesce(r6(tws), F.lit(12.0)).alias("tws"), F.coalesce(r6(twd), F.lit(45.0)).alias("twd"))


@query("""with s as (select user_id, ts, value / 10 as speed, cast(event_id * 37 % 360 as double) as direction, case when event_id % 3 > 0 then value / 20 end as temp from events),
n as (select user_id, arg_min({'t': ts, 's': speed, 'd': direction, 'c': temp}, ts) as r from s group by user_id)
select user_id, strftime(r.t, '%Y-%m-%dT%H:%M') as time, round(coalesce(r.c, 20e0) * 10) / 10 as temperature, round(r.s * 1.943844e0 * 100) / 100 as windspeed, round(r.d * 10) / 10 as winddirection, 0 as weathercode, 1 as is_day from n""")
def I03_current_weather(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of each series, 20 degrees where it has no temperature."""
    e = tables.read(spark, sf, "events")
    s = e.select("user_id", c("ts").alias("t"), (c("value") / 10).alias("speed"), (c("event_id") * 37 % 360).cast("double").alias("direction"), F.when(c("event_id") % 3 > 0, c("value") / 20).alias("temperature"))
    return aggregates.current_weather(s, ["user_id"])


@query(f"""with {d.GRID}, q as (select cast(a.range as integer) as i, cast(b.range as integer) as j from range(0, 11) a, range(0, 11) b), pts as (select i * 100 + j as event_id, 0e0 as tws, 0e0 as twd, null as t, 9e0 - i * 0.6e0 as lat, -11e0 + j * 0.7e0 as lon from q),
{_CORNERS}, m as (select i, j, member, value + 2 * member + (i * member) % 3 as x from grid, unnest(range(0, 10)) t(member)), s as (select i, j, quantile_cont(x, 0.9) as p90, max(x) filter (member = 3) as m3 from m group by i, j)
select cast(event_id // 100 as integer) as gi, cast(event_id % 100 as integer) as gj, {d.r6("sum(w * m3) / sum(w)")} as member_3, {d.r6("sum(w * p90) / sum(w)")} as p90 from corners join s using (i, j) group by event_id having sum(w) >= 1e-6""")
def I02_C02_member_and_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of one member, and one of a statistic of all."""
    lattice = spark.range(11).select(c("id").cast("int").alias("gi"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("gj"))
    lattice = lattice.select("gi", "gj", (F.lit(9.0) - c("gi") * 0.6).alias("lat"), (F.lit(-11.0) + c("gj") * 0.7).alias("lon"))
    m = tables.grid(spark, sf).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("i", "j", "member", (c("value") + c("member") * 2 + c("i") * c("member") % 3).alias("value"))
    one = joins.interpolate(lattice, m.where("member = 3"), SPEC, ["gi", "gj"]).withColumnRenamed("value", "member_3")
    many = joins.interpolate(lattice, aggregates.ensemble_stats(m, ["i", "j"], "value"), SPEC, ["gi", "gj"], "p90")
    return one.join(many, ["gi", "gj"]).where("member_3 is not null").select("gi", "gj", r6(c("member_3")).alias("member_3"), r6(c("p90")).alias("p90"))


_NAMED = d.values([(m, v, p, e, n[at] if at < 3 else None, n[2 if at == 3 else 4], n[at]) for m, (p, e, at) in models.FILES.items() for v, n in models.NAMES.items() if n[at] is not None], "k(model, variable, p, e, index_name, folder, part)")
_TASKS = d.values([(m, v, n) for n, (m, v) in enumerate((m, v) for m in models.FILES for v in models.NAMES)], "t(model, variable, place)")


@query(f"""with t as (select model, variable, timestamp '2024-01-01' + to_hours(cast(o_orderkey % 4 * 6 as integer)) as cycle, cast(o_orderkey % 40 * 3 as integer) as step, cast(o_orderkey % 31 as integer) as member, o_orderkey from orders join (select * from {_TASKS}) on place = o_orderkey % {len(models.FILES) * len(models.NAMES)}),
n as (select t.*, k.p, k.e, k.index_name, k.folder, k.part from t left join (select * from {_NAMED}) k using (model, variable)),
r as (select *, replace(replace(replace(replace(replace(replace(replace(replace(p, '{{day}}', strftime(cycle, '%Y%m%d')), '{{hour}}', strftime(cycle, '%H')), '{{step3}}', printf('%03d', step)), '{{step}}', step::varchar),
 '{{member}}', case when member = 0 then 'gec00' else printf('gep%02d', member) end), '{{set}}', case when variable = 'wind_gust_10m' then 'b' else 'a' end), '{{folder}}', coalesce(folder, '')), '{{part}}', coalesce(part, '')) as path from n)
select o_orderkey, model, variable, member, path, path || e as index_path, index_name from r""")
def H62_H63_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Files, indexes and variable names of a task for each order, of all models and variables in turn."""
    o = tables.read(spark, sf, "orders")
    cycle = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (c("o_orderkey") % 4 * 6).cast("int"))
    every = [(m, v) for m in models.FILES for v in models.NAMES]
    pairs = F.get(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("variable")) for m, v in every]), (c("o_orderkey") % len(every)).cast("int")).alias("t")
    t = o.select("o_orderkey", cycle.alias("cycle"), (c("o_orderkey") % 40 * 3).cast("int").alias("step"), (c("o_orderkey") % 31).cast("int").alias("member"), pairs).select("*", "t.*")
    return models.named(t).select("o_orderkey", "model", "variable", "member", "path", "index_path", "index_name")


_STORES = "(select n_nationkey as store, ['wind_u_10m', 'mslp'] as variables, n_nationkey % 2 = 1 as ensemble, n_nationkey % 3 = 0 as wind, n_nationkey % 5 = 0 as keep_members from nation)"
_STATS = "['mean', 'std', 'p10', 'p50', 'p90']"


@query(f"""with s as {_STORES}, e as (select *, unnest(variables) as v from s), p as (select store, v as array_name, v as source, false as members from e where not ensemble
union all select store, v || '_' || x, v || '_' || x, false from e, unnest({_STATS}) t(x) where ensemble union all select store, v, v || '_mean', keep_members from e where ensemble
union all select store, x, x, false from s, unnest(['wind_speed_mean', 'wind_speed_std', 'wind_speed_p10', 'wind_speed_p50', 'wind_speed_p90', '{models.EXCEEDANCES[0]}', '{models.EXCEEDANCES[1]}']) t(x) where ensemble and wind)
select store, array_name, source, members from p""")
def A29_array_plan(spark: SparkSession, sf: str) -> DataFrame:
    return models.array_plan(_stores(spark, sf))


def _stores(spark: SparkSession, sf: str) -> DataFrame:
    n = tables.read(spark, sf, "nation")
    k = c("n_nationkey")
    return n.select(k.alias("store"), F.array(F.lit("wind_u_10m"), F.lit("mslp")).alias("variables"), (k % 2 == 1).alias("ensemble"), (k % 3 == 0).alias("wind"), (k % 5 == 0).alias("keep_members"))


@query(f"""with s as {_STORES}, e as (select *, unnest(variables) as v from s), p as (select store, v as array_name from e union select store, v || '_' || x from e, unnest({_STATS}) t(x) where ensemble
union select store, x from s, unnest(['wind_speed_mean', 'wind_speed_std', 'wind_speed_p10', 'wind_speed_p50', 'wind_speed_p90', '{models.EXCEEDANCES[0]}', '{models.EXCEEDANCES[1]}']) t(x) where ensemble and wind), l as (select store, list(array_name order by array_name) as names from p group by store)
select store, to_json({{'model_name': 'store ' || store, 'steps': [0, 3, 6], 'is_ensemble': ensemble, 'store_members': keep_members and ensemble, 'variables': names}})::varchar as metadata from s join l using (store)""")
def A30_store_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A store's description as JSON, with the arrays of its plan."""
    s = _stores(spark, sf)
    names = models.array_plan(s).groupBy("store").agg(F.sort_array(F.collect_set("array_name")).alias("variables"))
    m = s.drop("variables").join(names, "store")
    fields = F.struct(F.concat(F.lit("store "), c("store").cast("string")).alias("model_name"), F.array(F.lit(0), F.lit(3), F.lit(6)).alias("steps"), c("ensemble").alias("is_ensemble"), (c("keep_members") & c("ensemble")).alias("store_members"), c("variables"))
    return m.select("store", F.to_json(fields).alias("metadata"))


@query(f"""with {d.TRACK}, w as (select *, greatest(0.3e0, {d.r1("pow(tws / 10e0, 1.3e0) * 0.5e0")}) as wave, {d.r1("tws * 1.25e0 + 1.5e0")} as gust from track), m as (select route_id, arg_max({{'w': tws, 'd': twd, 'g': gust, 'h': wave, 't': t}}, {{'w': tws, 'i': -idx}}) as p, avg(tws) as mean, max(t) as arrives from w group by route_id),
h as (select *, (hour(arrives) + minute(arrives) / 60e0 + (route_id % 360 - 180) / 15e0 + 48e0) % 24e0 as local from m)
select route_id, 'Gale Warning: Peak wind ' || printf('%.0f', p.w) || ' kts (gusts ' || printf('%.0f', p.g) || ' kts), seas ' || printf('%.1f', p.h) || 'm forecast around ' || strftime(p.t, '%a %b %d %H:%M') || ' UTC' as gale,
'Low Wind Warning: Extended light airs (<6 kts) for up to ' || printf('%.0f', (route_id % 9)::double) || ' consecutive hours (avg ' || printf('%.1f', round(mean * 10) / 10) || ' kts). Motoring likely required.' as calm,
'Night Arrival Warning: Estimated arrival at ' || strftime(arrives, '%H:%M') || ' UTC (~' || printf('%02d:%02d', cast(floor(local) as integer), cast(floor(round((local - floor(local)) * 6000e0) / 100) as integer)) || ' local time) in darkness. Harbor entry and coastal navigation in the dark.' as night,
'Peak Wind Event: ' || printf('%.0f', p.w) || ' kts from ' || printf('%03.0f', p.d) || chr(176) as peak, strftime(arrives, '%a, %b ') || day(arrives) as shown_date, strftime(arrives, '%H:%M') || ' UTC' as shown_time from h""")
def H56_H59_warnings_and_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings of a passage as text, and how its arrival is shown."""
    t = tables.track(spark, sf).select("route_id", "idx", "t", "tws", "twd", sailing.wave_height(c("tws")).alias("wave"), sailing.gust(c("tws")).alias("gust"))
    m = t.groupBy("route_id").agg(F.max_by(F.struct("tws", "twd", "gust", "wave", "t"), F.struct("tws", -c("idx"))).alias("p"), F.avg("tws").alias("mean"), F.max("t").alias("arrives"))
    local = passage.geo_hour(c("arrives"), (c("route_id") % 360 - 180).cast("double"))
    return m.select(
        "route_id", text.gale_warning(c("p.tws"), c("p.gust"), c("p.wave"), c("p.t")).alias("gale"), text.calm_warning((c("route_id") % 9).cast("double"), round_to(c("mean"), 1)).alias("calm"), text.night_warning(c("arrives"), local).alias("night"),
        text.peak_event(c("p.tws"), c("p.twd")).alias("peak"), text.shown_date(c("arrives")).alias("shown_date"), text.shown_time(c("arrives")).alias("shown_time"),
    )


@query(f"""with {d.TRACK}, f as (select route_id, min(t) + (max(t) - min(t)) / 3 as focus from track group by route_id), n as (select route_id, arg_min(idx, {{'d': abs(epoch_us(t) - epoch_us(focus)), 'i': idx}}) as nearest from track join f using (route_id) group by route_id),
k as (select route_id, idx, (route_id * 7 + idx * 3) % 100 as score from track where idx % 4 > 0)
select t.route_id, t.idx, k.score, t.idx = n.nearest as in_focus from track t left join k using (route_id, idx) join n on n.route_id = t.route_id""")
def C15_C20_route_with_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Waypoints with the confidence of the same position, where there is one, and which of them is nearest to a time in focus."""
    t = tables.track(spark, sf).select("route_id", "idx", F.unix_micros(c("t").cast("timestamp")).alias("us"))
    conf = t.where("idx % 4 > 0").select("route_id", "idx", ((c("route_id") * 7 + c("idx") * 3) % 100).alias("score"))
    ends = t.groupBy("route_id").agg((F.min("us") + F.expr("(max(us) - min(us)) div 3")).alias("focus"))
    near = joins.nearest(ends, t.withColumnRenamed("idx", "nearest"), ["route_id"], "focus", "us", ["nearest"])
    return t.join(conf, ["route_id", "idx"], "left").join(near.select("route_id", "nearest"), "route_id").select("route_id", "idx", "score", (c("idx") == c("nearest")).alias("in_focus"))


@query("""with k as (select o_custkey as parent, o_orderkey as child, o_totalprice as weight, o_orderdate as cycle, o_orderpriority as model from orders)
select parent, child, cast(row_number() over (partition by parent order by weight desc, child) as integer) as place, cast(row_number() over (partition by parent order by cycle desc, model, child) as integer) as listed from k""")
def F05_F07_child_and_catalogue_order(spark: SparkSession, sf: str) -> DataFrame:
    """Children of a stack by falling weight; a catalogue by falling cycle, then model."""
    o = tables.read(spark, sf, "orders").select(c("o_custkey").alias("parent"), c("o_orderkey").alias("child"), "o_totalprice", "o_orderdate", "o_orderpriority")
    order = lambda *by: F.row_number().over(Window.partitionBy("parent").orderBy(*by)).cast("int")
    return o.select("parent", "child", order(F.desc("o_totalprice"), "child").alias("place"), order(F.desc("o_orderdate"), "o_orderpriority", "child").alias("listed"))


@query("""with b as (select p_partkey as poly_id, p_size - 25e0 as lat, p_partkey % 60 - 30e0 as lon from part), h as (select *, row_number() over (order by poly_id) as n from b where lat between -20 and 20 and lon between -25 and 25) select poly_id, lat, lon from h where n <= 1500""")
def F04_I22_polygons_shown(spark: SparkSession, sf: str) -> DataFrame:
    """At most 1,500 polygons of a region, in the index's order: the feature of the endpoint."""
    b = tables.read(spark, sf, "part").select(c("p_partkey").alias("poly_id"), (c("p_size") - 25.0).alias("lat"), (c("p_partkey") % 60 - 30.0).alias("lon"))
    return b.where(c("lat").between(-20, 20) & c("lon").between(-25, 25)).orderBy("poly_id").limit(1500)


@query("""with old as (select s_suppkey as id, s_name as name, s_acctbal as mass from supplier), new as (select s_suppkey as id, upper(s_name) as name, s_acctbal * 2 as mass from supplier where s_suppkey % 3 = 0 union all select s_suppkey + 1000000, s_name, s_acctbal from supplier where s_suppkey % 10 = 0)
select id, name, mass from (select * from old where id not in (select id from new) union all select * from new) where id % 7 <> 0""")
def A48_boats_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Saved boats after others were saved over them and some deleted."""
    s = tables.read(spark, sf, "supplier")
    old = s.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("mass"))
    new = old.where("id % 3 = 0").select("id", F.upper("name").alias("name"), (c("mass") * 2).alias("mass")).unionByName(old.where("id % 10 = 0").withColumn("id", c("id") + 1000000))
    gone = old.unionByName(new).where("id % 7 = 0").select("id").distinct()
    return old.join(new, "id", "left_anti").unionByName(new).join(gone, "id", "left_anti")


@query(f"""with {_POINTS}, {d.GRID}, {_STEPPED}, n as (select event_id, cast(floor((10e0 - lat) / 0.5e0) as integer) as i, cast(floor((lon + 12e0) / 0.5e0) as integer) as j from pts)
select event_id, i, j, count(*) as n, {d.r6("arg_min(u, step)")} as first, list({d.r6("u")} order by step)[1:5]::varchar as head from n join stepped using (i, j) group by event_id, i, j""")
def A51_store_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The series of the nearest lower cell of each point: its length, the first value there is, and the first five steps, gaps as NULL."""
    p = points(spark, sf).select("event_id", F.floor((F.lit(10.0) - c("lat")) / 0.5).cast("int").alias("i"), F.floor((c("lon") + 12.0) / 0.5).cast("int").alias("j"))
    s = p.join(joins.on_lattice(stepped(spark, sf), SPEC).select("i", "j", "step", r6(c("u")).alias("u")), ["i", "j"]).groupBy("event_id", "i", "j").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("step", "u"))).alias("l"))
    first = F.transform(F.slice("l", 1, 5), lambda x: x["u"].cast("string"))
    return s.select("event_id", "i", "j", "n", F.get(F.filter("l", lambda x: x["u"].isNotNull()), F.lit(0))["u"].alias("first"), F.concat(F.lit("["), F.array_join(first, ", ", "NULL"), F.lit("]")).alias("head"))


@query(f"""with {d.TRACK}, r as (select route_id, count(*) as points, list(distance_nm order by idx) as legs, sum(tws) as total from track group by route_id)
select route_id, to_json({{'points': points, 'id': route_id}})::varchar as kept, {d.r6("list_sum(legs)")} as miles, {d.r6("list_sum(list_transform(legs, lambda x: x * 0.81e0))")} as reefed from r""")
def H68_H69_nested_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A route without its wave fronts, and sums over its nested legs."""
    t = tables.track(spark, sf).groupBy("route_id").agg(F.count("*").alias("points"), F.sort_array(F.collect_list(F.struct("idx", "distance_nm"))).alias("legs"))
    route = F.struct("points", c("route_id").alias("id"), c("legs").alias("isochrones")).dropFields("isochrones")
    total = lambda k: F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["distance_nm"] * k)
    return t.select("route_id", F.to_json(route).alias("kept"), r6(total(1.0)).alias("miles"), r6(total(0.81)).alias("reefed"))


@query()
def I20_route_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage by three models' winds, all searched together: two stored forecasts and the synthetic field; the outcome of each model and the ensemble that goes with it."""
    from galeframe.operators.weather import Chosen, Field
    from galeframe.plans import forecast

    cells = forecast.stored_cells(spark, sf)
    winds = Chosen({"gfs_0p25": forecast._stored(cells, forecast.STORED), "ifs_0p25": forecast._stored(cells.withColumns({"u": c("u") * 1.08, "v": c("v") * 0.9}), forecast.STORED), "icon_global": Field(synthetic)}, "model")
    names = F.posexplode(F.array(*map(F.lit, winds.providers))).alias("n", "model")
    r = passages(spark, sf).select("*", names).withColumn("route_id", c("route_id") * 8 + c("n")).drop("n", "batch")
    out = search.outcomes(search.route_search(r, winds, search.Config(step_hours=6.0, max_nodes=40, arrival_nm=30.0))).join(r.select("route_id", "model"), "route_id")
    return out.select(F.floor(c("route_id") / 8).alias("passage"), "model", passage.ensemble_of(c("model")).alias("e"), "reached", r6(c("duration_hours")).alias("duration_hours"), r6(c("distance_nm")).alias("distance_nm")).select("*", "e.*").drop("e")


@query(f"""with {_POINTS}, {d.GRID}, {_CORNERS}, {_STEPPED}, hh as (select *, (event_id % 24)::double as hr from corners), bb as (select *, least(floor(hr / 3) * 3, 21) as lo from hh),
ww as (select event_id, i, j, cast(lo as integer) as step, w * (1 - (hr - lo) / 3) as w from bb union all select event_id, i, j, cast(lo + 3 as integer), w * ((hr - lo) / 3) from bb),
ff as (select event_id, {_GOOD('u')}, {_GOOD('v')} from ww join stepped using (i, j, step) group by event_id), spots as (select event_id, lat, lon, event_id % 24 as hour from pts), {relational.field_sql("spots")}
select event_id, ff.u is not null as stored, {d.r6("coalesce(ff.u, field.u)")} as u, {d.r6("coalesce(ff.v, field.v)")} as v from field left join ff using (event_id)""")
def I21_wind_or_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """The stored wind where the region has one, else the synthetic field."""
    p = points(spark, sf).select("event_id", "lat", "lon", (c("event_id") % 24).cast("double").alias("hour"))
    uv = joins.interpolate_in_time(p, stepped(spark, sf), SPEC, ["event_id", "lat", "lon", "hour"], "hour", 3.0, 24.0, ["u", "v"])
    su, sv = wind.synthetic_uv(c("lat"), c("lon"), c("hour"))
    return uv.select("event_id", c("u").isNotNull().alias("stored"), r6(F.coalesce("u", su)).alias("u"), r6(F.coalesce("v", sv)).alias("v"))
