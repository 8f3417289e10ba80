"""Joins that the relational engine lacks a word for: grid corners, brackets, nearest rows, points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.wind import grid_coords


def corner_weights(points: DataFrame, spec: dict, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Four rows for each point: the lattice corners (i, j) around it, with their weights w."""
    g = grid_coords(F.col(lat), F.col(lon), **spec)
    p = points.withColumns({f"_{k}": x for k, x in g.items()})
    u, v = F.col("_u"), F.col("_v")
    corner = lambda i, j, w: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), w.alias("w"))
    corners = F.array(corner("_i0", "_j0", (1 - u) * (1 - v)), corner("_i1", "_j0", u * (1 - v)), corner("_i0", "_j1", (1 - u) * v), corner("_i1", "_j1", u * v))
    return p.withColumn("_c", F.explode(corners)).select(*points.columns, "_c.i", "_c.j", "_c.w")


def on_lattice(grid: DataFrame, spec: dict) -> DataFrame:
    """The cells that the lattice has: no more of a grid is joined, or broadcast, however large it is."""
    return grid.where(F.col("i").between(0, spec["nlats"] - 1) & F.col("j").between(0, spec["nlons"] - 1))


def interpolate(points: DataFrame, grid: DataFrame, spec: dict, keys: list[str], value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Bilinear values at points: the mean of the corners that have one, by weight; null where their weights don't reach 1e-6.

    ``grid`` has i, j, ``value`` and the columns ``by`` (such as variable or
    step). One equi-join and one aggregation by point: a shuffle for each, and
    none for the grid where it is small enough to be broadcast by the planner.
    """
    by = by or []
    hit = corner_weights(points, spec).join(on_lattice(grid, spec).select("i", "j", *by, F.col(value).alias("_v")), ["i", "j"])
    some = ~F.isnan("_v") & F.col("_v").isNotNull()
    w = F.sum(F.when(some, F.col("w")))
    out = hit.groupBy(*keys, *by).agg(w.alias("_w"), F.sum(F.when(some, F.col("w") * F.col("_v"))).alias("_s"))
    return out.withColumn(value, F.when(F.col("_w") >= 1e-6, F.col("_s") / F.col("_w"))).drop("_w", "_s")


def interpolate_in_time(points: DataFrame, grid: DataFrame, spec: dict, keys: list[str], hour: str, every: float, last: float, values: list[str]) -> DataFrame:
    """Values between steps: bilinear at the step before and at the one after, then linear in time; hours outside the steps are clamped.

    ``grid``: (i, j, step, values), steps ``every`` hours from 0 to ``last``.
    A point meets its four corners at two steps, each with its weight, in one
    equi-join and one aggregation. Corners that are null or NaN have no
    weight; a value is null where the weights left don't reach 1e-6.
    """
    at = F.least(F.greatest(F.col(hour), F.lit(0.0)), F.lit(last))
    low = F.least(F.floor(at / every) * every, F.lit(max(last - every, 0.0)))
    part = (at - low) / every
    steps = F.explode(F.array(F.struct(low.alias("step"), (1 - part).alias("p")), F.struct((low + every).alias("step"), part.alias("p")))).alias("_t")
    p = corner_weights(points, spec).select(*keys, "i", "j", "w", steps).select(*keys, "i", "j", F.col("_t.step").cast("int").alias("step"), (F.col("w") * F.col("_t.p")).alias("w"))
    hit = p.join(on_lattice(grid, spec).select("i", "j", F.col("step").cast("int").alias("step"), *values), ["i", "j", "step"])
    good = lambda v: F.col(v).isNotNull() & ~F.isnan(v)
    sums = [x for v in values for x in (F.sum(F.when(good(v), F.col("w"))).alias(f"_w_{v}"), F.sum(F.when(good(v), F.col("w") * F.col(v))).alias(f"_s_{v}"))]
    some = hit.groupBy(*keys).agg(*sums).select(*keys, *[F.when(F.col(f"_w_{v}") >= 1e-6, F.col(f"_s_{v}") / F.col(f"_w_{v}")).alias(v) for v in values])
    return points.select(*keys).join(some, keys, "left")


def bracket(left: DataFrame, right: DataFrame, at: Column, axis: str, width: float, cols: list[str]) -> DataFrame:
    """The rows of ``right`` before and after a place on a numeric axis, as prev_<col> and next_<col>, clamped at its ends.

    ``right`` is a short table of axis values, such as a cycle's time steps: it
    is sorted in one task, and its ends come to the driver. The axis
    is cut into buckets of ``width``; an interval of ``right`` is listed under
    each bucket it touches, so that Spark hashes buckets and checks the range
    within them.
    """
    w = Window.orderBy(axis)
    low, high = f"prev_{axis}", f"next_{axis}"
    cols = [axis, *[c for c in cols if c != axis]]
    ends = right.select(*[F.col(x).alias(f"prev_{x}") for x in cols], *[F.lead(x).over(w).alias(f"next_{x}") for x in cols], F.lead(axis, 2).over(w).isNull().alias("_last"))
    ends = ends.where(F.col(high).isNotNull())
    bucket = lambda x: F.floor(x / width).cast("long")
    lo, hi = right.agg(F.min(axis), F.max(axis)).first()  # two numbers
    q = left.withColumn("_at", F.least(F.greatest(at, F.lit(lo)), F.lit(hi)))
    q = q.withColumn("_b", bucket(F.col("_at")))
    ends = ends.withColumn("_b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    inside = (F.col("_at") >= F.col(low)) & ((F.col("_at") < F.col(high)) | (F.col("_last") & (F.col("_at") == F.col(high))))
    return q.join(ends, "_b").where(inside).withColumn("frac", (F.col("_at") - F.col(low)) / (F.col(high) - F.col(low))).drop("_b", "_at", "_last")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the right row of the same keys whose place on a numeric axis is nearest; ties go to the least ``take``, null where there is none.

    Both sides are sorted together by key and place; a left row looks at the
    last right row before it and the first after it. Nothing is paired, and
    repeated left rows stay.
    """
    spots = right.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.min(F.struct(*take)).alias("_right"))
    both = left.select(*keys, F.col(at).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(spots.schema["_right"].dataType).alias("_right"))
    both = both.unionByName(spots.withColumn("_left", F.lit(None).cast(both.schema["_left"].dataType)))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_left").isNotNull())
    here = F.when(F.col("_right").isNotNull(), F.struct("_at", "_right"))
    both = both.withColumns({"_before": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{side}._at")).alias("d"), F.col(f"{side}._right").alias("r")))
    return both.where(F.col("_left").isNotNull()).withColumn("_n", F.least(far("_before"), far("_after"))).select("_left.*", "_n.r.*")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], name: str, axes: list[str], within: float) -> DataFrame:
    """(keys, name): the least ``name`` of ``right`` whose values on all ``axes`` are nearer than ``within`` to a left row's, or null.

    Rows meet by cell of the first two axes, of the size of ``within``; each
    right row is listed under its own cell and the eight about it.
    """
    cell = lambda c: F.floor(F.col(c) / within).cast("long")
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    r = right.select(name, *[F.col(a).alias(f"_r_{a}") for a in axes], *[F.col(a) for a in axes[:2]])
    r = r.withColumn("_i", near(axes[0])).withColumn("_j", near(axes[1])).drop(*axes[:2])
    met = left.withColumns({"_i": cell(axes[0]), "_j": cell(axes[1])}).join(r, ["_i", "_j"])
    for a in axes:
        met = met.where(F.abs(F.col(a) - F.col(f"_r_{a}")) < within)
    return left.select(*keys).join(met.groupBy(*keys).agg(F.min(name).alias(name)), keys, "left")


#: Cells begin off round numbers, so that vertices and points don't lie on their borders.
CELL_SHIFT = 0.0137004137


def _cell(x: Column, cell: float) -> Column:
    return F.floor((x - CELL_SHIFT) / cell).cast("int")


def polygon_index(edges: DataFrame, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(edges by cell, (poly_id, _i, _j) of the cells whose north-east corner a polygon holds) for ``points_in_polygons``.

    An edge is listed under the cells that its bounds touch. Where the edges
    of a polygon meet the parallel of a row of corners, it holds the corners
    between the first and second meeting, the third and fourth, and so on.
    """
    e = edges.select("poly_id", "x1", "y1", "x2", "y2")
    span = lambda a, b: F.sequence(_cell(F.least(a, b), cell), _cell(F.greatest(a, b), cell))
    listed = e.withColumn("_i", F.explode(span("y1", "y2"))).withColumn("_j", F.explode(span("x1", "x2")))
    row = e.withColumn("_i", F.explode(F.sequence(_cell(F.least("y1", "y2"), cell) - 1, _cell(F.greatest("y1", "y2"), cell))))
    top = (F.col("_i") + 1) * F.lit(cell) + CELL_SHIFT
    row = row.where((F.col("y1") > top) != (F.col("y2") > top)).select("poly_id", "_i", ((F.col("x2") - F.col("x1")) * (top - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")).alias("x"))
    w = Window.partitionBy("poly_id", "_i").orderBy("x")
    between = row.withColumns({"n": F.row_number().over(w), "to": F.lead("x").over(w)}).where("n % 2 = 1")
    first, last = F.ceil((F.col("x") - CELL_SHIFT) / cell).cast("int") - 1, F.ceil((F.col("to") - CELL_SHIFT) / cell).cast("int") - 2
    held = between.where(first <= last).select("poly_id", "_i", F.explode(F.sequence(first, last)).alias("_j"))
    return listed, held


def points_in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], cell: float = 1.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, poly_id) for every polygon that holds a point, by the even-odd rule.

    Points, edges and polygons meet by cell. From a point one goes east to the
    cell's border and along it to the north-east corner; each edge on the way
    changes sides, and whether the corner is inside is known. So a point is
    compared with the edges of its own cell only, and one in a cell without
    edges with none. A polygon is one row of a cell, with its edges there: what
    a point and a polygon are to each other is known where they meet, and only
    points and edges are shuffled, never their pairs. A table whose rows an explosion made is larger than the
    planner's estimate from its file, and would be broadcast by it; so all of
    them meet in sorted order.
    """
    listed, held = polygon_index(edges, cell)
    sides = listed.select("_i", "_j", "poly_id", F.struct("x1", "y1", "x2", "y2").alias("_e"))
    index = sides.unionByName(held.withColumn("_e", F.lit(None).cast(sides.schema["_e"].dataType)))
    index = index.groupBy("_i", "_j", "poly_id").agg(F.collect_list("_e").alias("_edges"), F.count_if(F.col("_e").isNull()).cast("int").alias("_held"))
    x, y = F.col(lon), F.col(lat)
    p = points.withColumns({"_i": _cell(y, cell), "_j": _cell(x, cell)}).hint("merge")
    right, top = (F.col("_j") + 1) * F.lit(cell) + CELL_SHIFT, (F.col("_i") + 1) * F.lit(cell) + CELL_SHIFT

    def passed(e: Column) -> Column:
        met = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        east = ((e["y1"] > y) != (e["y2"] > y)) & (x < met) & (met <= F.col("_right"))
        level = (e["y2"] - e["y1"]) * (F.col("_right") - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        north = ((e["x1"] > F.col("_right")) != (e["x2"] > F.col("_right"))) & (y < level) & (level <= F.col("_top"))
        return F.when(east, 1).otherwise(0) + F.when(north, 1).otherwise(0)

    met = p.withColumns({"_right": right, "_top": top}).join(index, ["_i", "_j"])
    odd = F.when(F.size("_edges") == 0, F.col("_held")).otherwise(F.aggregate("_edges", F.col("_held"), lambda n, e: n + passed(e))) % 2 == 1
    return met.where(odd).select(*keys, "poly_id")


def places_in_polygons(points: DataFrame, edges: DataFrame, keys: list[str], cell: float = 1.0, lat: str = "lat", lon: str = "lon", each: int = 1024) -> DataFrame:
    """As ``points_in_polygons``, for points of which many share a place.

    A place is one row with the keys of its points, ``each`` of them at most,
    so that it is compared with a polygon once and not once for each point;
    the keys are dealt out again where a polygon holds the place. Points are
    shuffled by place and then, as places, by cell; pairs are not.
    """
    turn = F.row_number().over(Window.partitionBy(lat, lon).orderBy(lat)) - 1
    p = points.select(F.struct(*keys).alias("_key"), lat, lon).withColumn("_part", F.floor(turn / each))
    p = p.groupBy(lat, lon, "_part").agg(F.collect_list("_key").alias("_keys"))
    return points_in_polygons(p, edges, ["_keys"], cell, lat, lon).select(F.explode("_keys").alias("_key"), "poly_id").select("_key.*", "poly_id")


def nearest_on_sphere(queries: DataFrame, sources: DataFrame, cell: float = 1.0) -> DataFrame:
    """Regridding: for each target (id, lat, lon) the source of the bins around its own with the least chord; source 0 where there is none."""
    xyz = lambda: (F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat")))
    n = int(360 / cell)
    src = sources.select(F.col("id").alias("src"), F.floor(F.col("lat") / cell).cast("int").alias("bi"), F.pmod(F.floor(F.col("lon") / cell).cast("int"), F.lit(n)).alias("bj"), *[x.alias(f"s{k}") for k, x in enumerate(xyz())])
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    q = queries.select("id", F.floor(F.col("lat") / cell).cast("int").alias("_i"), F.floor(F.col("lon") / cell).cast("int").alias("_j"), *[x.alias(f"q{k}") for k, x in enumerate(xyz())], around.alias("_o"))
    q = q.withColumn("bi", F.col("_i") + F.col("_o.a")).withColumn("bj", F.pmod(F.col("_j") + F.col("_o.b"), F.lit(n)))
    chord = sum((F.pow(F.col(f"q{k}") - F.col(f"s{k}"), F.lit(2.0)) for k in range(3)), F.lit(0.0))
    best = q.join(src, ["bi", "bj"]).groupBy("id").agg(F.min_by("src", F.struct(F.round(chord, 12), "src")).alias("src"))
    return queries.select("id").join(best, "id", "left").select("id", F.coalesce("src", F.lit(0)).alias("src"))
