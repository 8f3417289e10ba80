"""Wave-front route search for many routes at once: each step is one plan over all routes' frontiers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from galeframe.functions import geo, sailing
from galeframe.functions.units import clamp
from galeframe.operators import sail
from galeframe.operators.common import durable, shared_folder
from galeframe.operators.joins import points_in_polygons
from galeframe.operators.weather import Field, Lattice, Staged, StoredWinds, Wind

NO_GO_DEG, LEAST_KTS, UNPRUNED, CRUISE_KTS = 28.0, 0.3, 20, 6.5
#: A candidate's ``seq`` is its parent's idx, shifted by so many bits, plus the heading's place in the fan.
SEQ_BITS = 10


@dataclass(frozen=True)
class Config:
    step_hours: float = 2.0
    max_hours: float = 400.0
    arrival_nm: float = 15.0
    spread_deg: int = 165
    fan_deg: int = 10
    max_nodes: int = 400
    tack_minutes: float = 5.0
    gybe_minutes: float = 8.0
    strategy: str = "spatial_grid"

    @property
    def reach_nm(self) -> float:
        """Estimated distance of a step, the scale of the pruning cells."""
        return max(0.8, self.step_hours * CRUISE_KTS)

    @property
    def arrival_m(self) -> float:
        return max(800.0, min(1.2 * self.step_hours * CRUISE_KTS * geo.NM_M, self.arrival_nm * geo.NM_M))


def _relative(lat: Column, lon: Column) -> Column:
    """Bearing from the start, off the direct one, in (-180, 180]."""
    direct = geo.bearing(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon"))
    return geo.signed(geo.norm360(geo.bearing(F.col("start_lat"), F.col("start_lon"), lat, lon) - direct))


def _cell(share: float, cfg: Config) -> list[Column]:
    size = max(0.015, cfg.reach_nm / 60.0 * share)
    return [F.floor((F.col("lat") + 90.0) / size), F.floor((F.col("lon") + 180.0) / size)]


def _quadrant() -> Column:
    return F.floor(F.col("heading") / 90.0) % 4


def _of_route(c: DataFrame, bounded: bool, **values: Column) -> DataFrame:
    """Adds aggregates of each route: by a window where a route's rows fit a task, else by an aggregation that combines before the shuffle."""
    if bounded:
        return c.withColumns({k: v.over(Window.partitionBy("route_id")) for k, v in values.items()})
    return c.join(c.groupBy("route_id").agg(*[v.alias(k) for k, v in values.items()]), "route_id")


def radial_sector(c: DataFrame, cfg: Config, bounded: bool) -> tuple[DataFrame, list[Column], int]:
    """Sectors of the angle seen from the start, between a route's least and greatest."""
    n = min(cfg.max_nodes, 300) if cfg.max_nodes > 0 else 100
    c = _of_route(c.withColumn("_rel", _relative(F.col("lat"), F.col("lon"))), bounded, _low=F.min("_rel"), _high=F.max("_rel"))
    at = F.floor((F.col("_rel") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(0.1)) * n)
    return c.withColumn("_k", clamp(at, 0, n - 1)).drop("_rel", "_low", "_high"), [F.col("_k")], 1


def spatial_grid(c: DataFrame, cfg: Config, bounded: bool) -> tuple[DataFrame, list[Column], int]:
    return c, [*_cell(0.75, cfg), _quadrant()], 1


def astar_beam(c: DataFrame, cfg: Config, bounded: bool) -> tuple[DataFrame, list[Column], int]:
    """Two of each cell; all candidates of a step have sailed equally long, so that the estimate's order is that of the distance left."""
    return c, _cell(0.5, cfg), 2


def pareto_envelope(c: DataFrame, cfg: Config, bounded: bool) -> tuple[DataFrame, list[Column], int]:
    """Bins of the distance off the direct course."""
    off = geo.distance_nm(F.col("start_lat"), F.col("start_lon"), F.col("lat"), F.col("lon")) * F.sin(F.radians(_relative(F.col("lat"), F.col("lon"))))
    return c, [F.floor(off / max(1.5, cfg.reach_nm * 0.8)), _quadrant()], 1


def state_space_grid(c: DataFrame, cfg: Config, bounded: bool) -> tuple[DataFrame, list[Column], int]:
    """The grid's cells by tack and by how the boat sails."""
    tack = geo.signed(geo.norm360(F.col("heading") - F.col("twd"))) >= 0
    mode = F.when(F.col("twa") < 60, 0).when(F.col("twa") > 135, 2).otherwise(1)
    return c, [*_cell(0.75, cfg), _quadrant(), tack, mode], 1


#: Pruning rules by name: candidates to candidates, the columns of a cell, and how many of a cell stay.
STRATEGIES = {f.__name__: f for f in (radial_sector, spatial_grid, astar_beam, pareto_envelope, state_space_grid)}


def prune(candidates: DataFrame, cfg: Config, bounded: bool = True) -> DataFrame:
    """The next frontier of every route, with ``idx``, its order: by cell the nearest to the destination, at most ``max_nodes`` of a route.

    Up to 20 candidates stay as they are. An unknown strategy is the spatial
    grid. ``bounded``: a route has max_nodes times the headings of a fan
    candidates at most, as in a search, so that its rows fit a task and all
    windows share one exchange by route. Else the best of each cell, then of
    each route, are cut down before each shuffle, and only ``max_nodes`` rows
    of a route meet in a task.
    """
    c, cell, each = STRATEGIES.get(cfg.strategy, spatial_grid)(candidates, cfg, bounded)
    names = [f"_k{i}" for i in range(len(cell))]
    c = _of_route(c.withColumns(dict(zip(names, cell, strict=True))), bounded, _n=F.count(F.lit(1))).withColumn("_few", F.col("_n") <= UNPRUNED)
    ranks = [("_in_cell", Window.partitionBy("route_id", *names).orderBy("dist_m", "seq"), each)]
    if cfg.max_nodes > 0:
        ranks.append(("_top", Window.partitionBy("route_id").orderBy("dist_m", "lon", "lat", "seq"), cfg.max_nodes))
    few, c = (None, c) if bounded else (c.where("_few"), c.where("not _few"))
    for name, window, most in ranks:
        keep = F.col(name) <= most
        c = c.withColumn(name, F.row_number().over(window)).where(F.col("_few") | keep if bounded else keep).drop(name)
    c = c if few is None else c.unionByName(few)
    order = [F.when(F.col("_few"), F.col("seq")).otherwise(F.lit(0)), F.col("lon"), F.col("lat"), F.col("seq")]
    return c.withColumn("idx", (F.row_number().over(Window.partitionBy("route_id").orderBy(*order)) - 1).cast("int")).select(*candidates.columns, "idx")


def expand(frontier: DataFrame, cfg: Config) -> DataFrame:
    """Candidates of the next step: every node sails a fan of headings about its bearing to the destination.

    The wind is that of the node's place and time (wind_tws, wind_twd).
    Headings in the no-go zone or too slow are left out; a tack or gybe costs
    its minutes. ``seq`` is the order: by node, then heading. A step's formulas
    are one function on arrays: as nested column expressions they take longer
    to compile than to run.
    """
    read = ("lat", "lon", "dest_lat", "dest_lon", "wind_tws", "wind_twd", "step", "heading", "traveled_nm", "tacks", "gybes", "idx")
    new = {"seq": "long", "from_lat": "double", "from_lon": "double"}
    fields = [f for f in frontier.schema.fields if f.name not in ("idx", "parent", "stop", "wind_tws", "wind_twd")]
    schema = StructType([*fields, *[StructField(n, LongType() if t == "long" else DoubleType()) for n, t in new.items()]])
    offsets = np.arange(-cfg.spread_deg, cfg.spread_deg + 1, cfg.fan_deg, dtype=float)

    def sail_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in read}  # a null wind is NaN, in which no heading can be sailed
            at, made = sail.fan(node, offsets, cfg.step_hours, cfg.tack_minutes, cfg.gybe_minutes, NO_GO_DEG, LEAST_KTS, SEQ_BITS)
            taken = batch.take(pa.array(at))
            own = [pa.array(made[f.name], to_arrow_type(f.dataType)) if f.name in made else taken.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(own, schema.names)

    return frontier.mapInArrow(sail_on, schema)


def off_land(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates whose leg neither ends on land nor has its middle there."""
    ends = F.array(F.struct(F.col("lat").alias("y"), F.col("lon").alias("x")), F.struct(((F.col("from_lat") + F.col("lat")) / 2).alias("y"), ((F.col("from_lon") + F.col("lon")) / 2).alias("x")))
    probes = candidates.select("route_id", "seq", F.explode(ends).alias("p")).select("route_id", "seq", "p.*")
    hit = points_in_polygons(probes, edges, ["route_id", "seq", "y", "x"], lat="y", lon="x").select("route_id", "seq").distinct()
    return candidates.join(hit, ["route_id", "seq"], "left_anti")


def start_nodes(routes: DataFrame, wind: Field | Staged | StoredWinds) -> DataFrame:
    """Step 0 of every route; a start has no parent."""
    r = wind.over("start_lat", "start_lon", F.col("dep_h"))(routes)
    b = geo.bearing(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon"))
    r = r.withColumns({"tws": F.col("wind_tws"), "twd": F.col("wind_twd"), "heading": b, "dist_m": geo.distance_m(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon"))})
    zero = {"speed": 0.0, "traveled_nm": 0.0, "maneuver": "none", "tacks": 0, "gybes": 0, "step": 0, "idx": 0, "stop": False}
    r = r.withColumns({"lat": F.col("start_lat"), "lon": F.col("start_lon"), "twa": geo.angle_between(F.col("heading"), F.col("twd")), **{k: F.lit(v) for k, v in zero.items()}})
    return r.withColumn("parent", F.lit(None).cast("int"))


@dataclass
class Found:
    """nodes: every kept node of every step, with ``parent``, its idx in the step before; best: the end of each route, with ``reached``; steps: how many were written."""

    nodes: DataFrame
    best: DataFrame
    cfg: Config
    steps: int = 0


def route_search(routes: DataFrame, wind: Wind | Field | Staged | StoredWinds, cfg: Config = Config(), land: DataFrame | None = None) -> Found:
    """Searches all ``routes`` (route_id, start_lat, start_lon, dest_lat, dest_lon, dep_h, more columns) together, step by step.

    A step expands and prunes all frontiers, asks for the wind where they are
    (an expression, or a join with the stored forecast's tiles) and writes
    them, one job each, so that the number of jobs depends on the longest
    route and not on the number of routes. A route ends at the first step with
    a node inside the arrival radius, or at its time limit; then its nearest
    node is the result, ``reached`` false. Where the wind is null a node can't
    go on. Routes of under half a mile are left out. A node knows its parent's
    idx alone; ``ancestors`` finds the winners' ways.
    """
    wind = wind if hasattr(wind, "over") else Field(wind)
    routes = routes.where(geo.distance_nm(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon")) >= 0.5)
    spark = routes.sparkSession
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    first, last = routes.agg(F.min("dep_h"), F.max("dep_h")).first()
    front = start_nodes(routes, wind)
    cols = front.columns
    front = durable(front, f"{folder}/0")
    limit = F.least(F.lit(cfg.max_hours), F.greatest(F.lit(36.0), geo.distance_nm(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon")) / 4.0 * 3.0))
    # the hour by the column step, not by a number, so that every step's code is the same and compiled once
    blow = wind.over("lat", "lon", F.col("dep_h") + F.col("step") * F.lit(cfg.step_hours))
    near, parent = F.max(F.col("dist_m") <= cfg.arrival_m).over(Window.partitionBy("route_id")), F.shiftright("seq", SEQ_BITS).cast("int")
    done = 0
    while True:
        c = expand(front.where(~F.col("stop") & (F.col("step") * F.lit(cfg.step_hours) < limit)), cfg)
        c = prune(off_land(c, land) if land is not None else c, cfg)
        c = c.withColumns({"stop": near, "parent": parent})
        sailed = (done + 1) * cfg.step_hours
        c = blow(c, None if first is None else (first + sailed, last + sailed))
        written = Observation()
        front = durable(c.select(*cols).observe(written, F.count(F.lit(1)).alias("n")), f"{folder}/{done + 1}")
        if not written.get["n"]:
            break
        done += 1
    nodes = spark.read.schema(front.schema).parquet(*[f"{folder}/{k}" for k in range(done + 1)])
    reached = F.col("dist_m") <= cfg.arrival_m
    best = nodes.withColumn("reached", reached).groupBy("route_id").agg(F.min_by(F.struct(*cols, "reached"), F.struct(~reached, "dist_m", "step", "idx")).alias("n")).select("n.*")
    return Found(nodes, durable(best), cfg, done)


def ancestors(nodes: DataFrame, ends: DataFrame, steps: int) -> DataFrame:
    """(route_id, step, idx) of ``ends`` and of all nodes before them, by pointer doubling.

    ``nodes`` (route_id, step, idx, parent), ``ends`` (route_id, step, idx),
    ``steps`` the greatest step. Table d holds each node's ancestor 2^d steps
    before it and is the join of table d-1 with itself; then, from the
    greatest d, every node of a way adds the ancestor that table d has for it.
    That is about 2 log2(steps) joins for all ways together, and a node keeps
    one number whatever its step.
    """
    up = nodes.where("step > 0").select("route_id", "step", "idx", F.col("parent").alias("up"))
    tables, reach = [up], 1
    while 2 * reach <= steps:
        near = tables[-1]
        far = near.select("route_id", (F.col("step") + reach).alias("step"), F.col("idx").alias("up"), F.col("up").alias("_far"))
        tables.append(durable(near.join(far, ["route_id", "step", "up"]).select("route_id", "step", "idx", F.col("_far").alias("up"))))
        reach *= 2
    way = ends.select("route_id", "step", "idx")
    for d in reversed(range(len(tables))):
        met = way.join(tables[d], ["route_id", "step", "idx"], "left")
        pair = F.array(F.struct("step", "idx"), F.when(F.col("up").isNotNull(), F.struct((F.col("step") - (1 << d)).alias("step"), F.col("up").alias("idx"))))
        way = met.select("route_id", F.explode(F.array_compact(pair)).alias("n")).select("route_id", "n.step", "n.idx")
    return way


def waypoints(found: Found) -> DataFrame:
    """The route of each winner, from its start: one row for each step, with the sea and heel that its wind implies."""
    way = ancestors(found.nodes, found.best, found.steps)
    w = way.join(found.nodes.drop("parent", "stop"), ["route_id", "step", "idx"])
    tws, twa = F.col("tws"), F.col("twa")
    return w.select(
        "route_id", F.col("step").alias("wp"), (F.col("dep_h") + F.col("step") * F.lit(found.cfg.step_hours)).alias("hour"), "lat", "lon", "heading", "speed", "tws", "twd", "twa", F.col("traveled_nm").alias("distance_nm"),
        (F.col("dist_m") / geo.NM_M).alias("distance_to_dest_nm"), sailing.heel(tws, twa).alias("heel_deg"), "maneuver", sailing.gust(tws).alias("gust"), sailing.wave_height(tws).alias("wave_m"), sailing.wave_period(tws).alias("period_s"),
    )


def outcomes(found: Found) -> DataFrame:
    """A row for each route: its length, hours, mean speed, manoeuvres, whether it arrived."""
    hours = F.col("step") * F.lit(found.cfg.step_hours)
    extra = [c for c in found.best.columns if c not in found.nodes.columns or c in ("start_lat", "start_lon", "dest_lat", "dest_lon", "dep_h", "route_id")]
    return found.best.select(
        *[c for c in extra if c != "reached"], hours.alias("duration_hours"), F.col("traveled_nm").alias("distance_nm"), geo.distance_nm(F.col("start_lat"), F.col("start_lon"), F.col("dest_lat"), F.col("dest_lon")).alias("direct_nm"),
        F.when(hours > 0.01, F.col("traveled_nm") / hours).otherwise(0.0).alias("average_kts"), "tacks", "gybes", "reached",
    )


def with_provider(routes: DataFrame, lattice: Lattice, buffer_deg: float = 6.0, stored: str = "stored", other: str = "synthetic") -> DataFrame:
    """``routes`` with ``provider``: the stored forecast where its lattice covers the box of a route and ``buffer_deg`` around it, else the other."""
    inside = lambda a, b, low, step, n: (F.least(a, b) - buffer_deg >= low) & (F.greatest(a, b) + buffer_deg <= low + step * (n - 1))
    covered = inside("start_lat", "dest_lat", lattice.lat, lattice.lat_step, lattice.n_lat) & inside("start_lon", "dest_lon", lattice.lon, lattice.lon_step, lattice.n_lon)
    return routes.withColumn("provider", F.when(covered, stored).otherwise(other))


def weather_grid(boxes: DataFrame, wind: Wind | Field | StoredWinds, key: str, default_step: float = 1.5) -> DataFrame:
    """(key, gi, gj, lat, lon, wind_tws, wind_twd): the winds of each box (key, min_lat, min_lon, lat_span, lon_span, step, hour) on its own lattice.

    A box has round(span / step) + 1 rows and columns; a null or non-positive
    step is ``default_step``.
    """
    wind = wind if hasattr(wind, "over") else Field(wind)
    b = boxes.withColumn("_s", F.when(F.col("step") > 0, F.col("step")).otherwise(F.lit(default_step)))
    axis = lambda span: F.explode(F.sequence(F.lit(0), F.round(F.col(span) / F.col("_s")).cast("int")))
    nodes = b.withColumn("gi", axis("lat_span")).withColumn("gj", axis("lon_span"))
    nodes = nodes.select(key, "gi", "gj", (F.col("min_lat") + F.col("gi") * F.col("_s")).alias("lat"), (F.col("min_lon") + F.col("gj") * F.col("_s")).alias("lon"), "hour")
    return wind.over("lat", "lon", F.col("hour"))(nodes).drop("hour")


def waves(found: Found) -> DataFrame:
    """The frontiers of about every hour (every step, where a step is longer)."""
    every = max(1, round(1.0 / found.cfg.step_hours)) if found.cfg.step_hours < 1 else 1
    return found.nodes.where(F.col("step") % every == 0).select("route_id", "step", "lat", "lon")
