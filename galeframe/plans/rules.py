"""Queries of small rules: scores, aliases, stale polars, presets nearby, sampled waypoints, polygons in a box, route documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions import rules
from galeframe.operators import joins, regions
from galeframe.plans import duck as d
from galeframe.plans.sources import _STARS, stars
from galeframe.sources import land

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _case(x: str, steps, part=lambda v: v) -> str:
    return "case " + " ".join(f"when {x} >= {least} then '{part(v)}'" for least, v in steps[:-1]) + f" else '{part(steps[-1][1])}' end"


_STYLES = ", ".join(f"{_case('score', rules.CONFIDENCE_STYLES, lambda v, k=k: v[k])} as {n}" for k, n in enumerate(("color", "ground", "border")))


@query(f"""with s as (select event_id, value % 100 as score, case when event_id % 5 > 0 then value % 100 end as own from events)
select event_id, {_case("score", rules.SCORE_COLORS)} as score_color, {_case("coalesce(own, 85)", rules.TIMELINE_COLORS)} as timeline, {_STYLES} from s""")
def H39_score_styles(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events").select("event_id", (c("value") % 100).alias("score"))
    e = e.withColumn("own", F.when(c("event_id") % 5 > 0, c("score")))
    return e.select("event_id", rules.score_color(c("score")).alias("score_color"), rules.timeline_color(c("own")).alias("timeline"), rules.confidence_style(c("score")).alias("s")).select("event_id", "score_color", "timeline", "s.*")


_NAMES = [n for names in rules.ROUTING_MODELS.values() for n in names] + ["GFS", "other"]


@query(f"""with n as (select o_orderkey, {[*_NAMES]!r}[o_orderkey % {len(_NAMES)} + 1] as name from orders)
select o_orderkey, name, coalesce(m.model, name) as model from n left join {d.values([(n, m) for m, names in rules.ROUTING_MODELS.items() for n in names], "m(alias, model)")} on alias = name""")
def H50_routing_models(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (c("o_orderkey") % len(_NAMES)).cast("int"))
    return tables.read(spark, sf, "orders").select("o_orderkey", name.alias("name")).withColumn("model", rules.routing_model(c("name")))


@query("""with b as (select o_orderkey, case o_orderkey % 4 when 0 then null when 1 then 'v1' else 'v2' end as version, case o_custkey % 3 when 0 then null when 1 then '' else 'v2' end as current, o_orderkey % 5 > 0 as geometry, o_orderkey % 7 = 0 as of_file from orders)
select o_orderkey, coalesce(current, '') <> '' and geometry and not of_file and version is distinct from current as stale from b""")
def B10_stale_polars(spark: SparkSession, sf: str) -> DataFrame:
    k, q = c("o_orderkey"), c("o_custkey") % 3
    version, current = F.when(k % 4 == 1, "v1").when(k % 4 > 1, "v2"), F.when(q == 1, "").when(q == 2, "v2")
    return tables.read(spark, sf, "orders").select("o_orderkey", rules.polar_stale(version, current, k % 5 > 0, k % 7 == 0).alias("stale"))


_SPOTS = """presets as (select n_nationkey as preset, n_nationkey * 0.01e0 as a, n_nationkey * 0.02e0 - 3 as b, n_nationkey % 3 * 0.007e0 as e, 1e0 as g from nation),
q as (select o_orderkey, o_custkey % 30 * 0.01e0 + o_orderkey % 3 * 0.003e0 as a, o_custkey % 30 * 0.02e0 - 3 + o_orderkey % 4 * 0.002e0 as b, o_custkey % 30 % 3 * 0.007e0 as e, case when o_orderkey % 5 > 0 then 1.004e0 else 1.2e0 end as g from orders)"""


@query(f"""with {_SPOTS} select o_orderkey, min(preset) as preset from q left join presets p on abs(q.a - p.a) < 0.005 and abs(q.b - p.b) < 0.005 and abs(q.e - p.e) < 0.005 and abs(q.g - p.g) < 0.005 group by o_orderkey""")
def B14_preset_routes(spark: SparkSession, sf: str) -> DataFrame:
    """The first preset route whose four coordinates are those of a request, to within 0.005 degrees."""
    n, o = tables.read(spark, sf, "nation"), tables.read(spark, sf, "orders")
    k, m = c("n_nationkey"), c("o_custkey") % 30
    presets = n.select(k.alias("preset"), (k * 0.01).alias("start_lat"), (k * 0.02 - 3).alias("start_lon"), (k % 3 * 0.007).alias("dest_lat"), F.lit(1.0).alias("dest_lon"))
    q = o.select("o_orderkey", (m * 0.01 + c("o_orderkey") % 3 * 0.003).alias("start_lat"), (m * 0.02 - 3 + c("o_orderkey") % 4 * 0.002).alias("start_lon"), (m % 3 * 0.007).alias("dest_lat"), F.when(c("o_orderkey") % 5 > 0, 1.004).otherwise(1.2).alias("dest_lon"))
    return joins.within_tolerance(q, presets, ["o_orderkey"], "preset", ["start_lat", "start_lon", "dest_lat", "dest_lon"], 0.005)


@query(f"""with {d.TRACK}, n as (select route_id, idx, count(*) over (partition by route_id) as n from track), s as (select route_id, idx as sample from n where idx % cast(ceil(n / 30) as bigint) = 0 or idx = n - 1)
select n.route_id, n.idx, arg_min(sample, {{'d': abs(sample - n.idx), 's': sample}}) as sample from n join s using (route_id) group by n.route_id, n.idx""")
def C07_nearest_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Each waypoint with the nearest of its route's sampled waypoints, by number; the earlier of two as near."""
    from galeframe.operators import windows

    t = tables.track(spark, sf).select("route_id", "idx")
    s = windows.thin(t, "route_id", ["idx"], 30).select("route_id", c("idx").alias("at"), c("idx").alias("sample"))
    return joins.nearest(t, s, ["route_id"], "idx", "at", ["sample"]).select("route_id", "idx", "sample")


@query(f"""with {_STARS}, sides as (select pid as poly_id, k as seq, lon as x1, lat as y1, coalesce(lead(lon) over w, first_value(lon) over w) as x2, coalesce(lead(lat) over w, first_value(lat) over w) as y2 from micro window w as (partition by pid order by k)),
ch as (select poly_id, seq // 16 as chunk, min(least(x1, x2)) as a, max(greatest(x1, x2)) as b, min(least(y1, y2)) as c, max(greatest(y1, y2)) as e from sides group by 1, 2), p as (select poly_id, min(a) as a, max(b) as b, min(c) as c, max(e) as e from ch group by 1),
q as (select s_suppkey, -60e0 + s_suppkey % 100 as lo, -60e0 + s_suppkey % 100 + s_suppkey % 7 as hi, 165e0 + s_suppkey % 25 as w, 165e0 + s_suppkey % 25 + s_suppkey % 4 as x from supplier)
select distinct s_suppkey, cast(p.poly_id as integer) as poly_id from q join p on p.e >= lo and p.c <= hi and p.b >= w and p.a <= x join ch on ch.poly_id = p.poly_id
 and floor(ch.c) <= floor(hi) and floor(ch.e) >= floor(lo) and floor(ch.a) <= floor(x) and floor(ch.b) >= floor(w)""")
def G02_polygons_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The polygons that a box touches, each once: those with a chunk in one of the box's cells whose own box meets it."""
    p = stars(spark, sf).where("level = 1 and (size(points) >= 6 or poly_id <= 50)").select("poly_id", F.posexplode("points").alias("seq", "p"))
    lon = F.round(F.pmod(c("p.lon"), F.lit(360.0)) * 1e6) / 1e6
    edges = land.edge_table(p.select("poly_id", "seq", lon.alias("lon"), (F.round(c("p.lat") * 1e6) / 1e6).alias("lat")))
    k = c("s_suppkey")
    low, west = F.lit(-60.0) + k % 100, F.lit(165.0) + k % 25
    boxes = tables.read(spark, sf, "supplier").select("s_suppkey", low.alias("min_lat"), (low + k % 7).alias("max_lat"), west.alias("min_lon"), (west + k % 4).alias("max_lon"))
    return regions.touched(boxes, "s_suppkey", land.chunk_boxes(edges))


@query(f"""with {d.TRACK}, l as (select route_id, '<rtept lat="' || printf('%.4f', round(lat * 1e4) / 1e4) || '" lon="' || printf('%.4f', round(lon * 1e4) / 1e4) || '"><time>' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '</time><name>Spd ' || printf('%.1f', round(tws * 10) / 10) || 'k</name></rtept>' as line, idx, t from track)
select route_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="galeframe" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <metadata>' || chr(10) || '    <name>Boat &lt;' || route_id || '&gt; (gfs_0p25) Route</name>' || chr(10) || '    <time>' || strftime(min(t), '%Y-%m-%dT%H:%M:%SZ')
 || '</time>' || chr(10) || '  </metadata>' || chr(10) || '  <rte>' || chr(10) || '    <name>Boat &lt;' || route_id || '&gt; Optimal Weather Route [gfs_0p25]</name>' || chr(10) || '    ' || string_agg(line, chr(10) || '    ' order by idx) || chr(10) || '  </rte>' || chr(10) || '</gpx>' as gpx from l group by route_id""")
def A46_route_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A whole document for each route; a route has some hundred waypoints."""
    t = tables.track(spark, sf)
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    r4 = lambda x: F.format_string("%.4f", F.round(c(x) * 1e4) / 1e4)
    point = F.struct("idx", r4("lat").alias("lat"), r4("lon").alias("lon"), stamp("t").alias("time"), (F.round(c("tws") * 10) / 10).alias("speed"))
    g = t.groupBy("route_id").agg(F.sort_array(F.collect_list(point)).alias("points"), stamp(F.min("t")).alias("begins"))
    name = F.concat(F.lit("Boat <"), c("route_id").cast("string"), F.lit(">"))
    return g.select("route_id", rules.route_document(name, F.lit("gfs_0p25"), c("begins"), c("points")).alias("gpx"))
