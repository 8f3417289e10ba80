"""Winds that a search can sail in: a closed-form field, or a stored forecast that its nodes meet by tile and time.

A provider has ``over(lat, lon, hour)``, which gives a function of (nodes,
hours) that adds ``wind_tws`` (knots) and ``wind_twd`` (degrees, where it
comes from). ``hours`` are the least and greatest hour asked for, where the
caller knows them, so that a stored forecast reads only the steps between. A
search makes the function once: building a field's expression takes longer
than planning with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from galeframe.functions.units import KNOTS_TO_MS, clamp
from galeframe.operators.common import shared_folder

Wind = Callable[[Column, Column, Column], tuple[Column, Column]]
Blow = Callable[..., DataFrame]
#: The breeze of an empty grid, knots and degrees; the least weight of corners that counts.
EMPTY_TWS, EMPTY_TWD, LEAST_WEIGHT = 12.0, 45.0, 1e-6


@dataclass(frozen=True)
class Field:
    """A wind that is an expression of place and hour."""

    wind: Wind

    def over(self, lat: str, lon: str, hour: Column) -> Blow:
        tws, twd = self.wind(F.col(lat), F.col(lon), hour)
        return lambda nodes, hours=None: nodes.withColumns({"wind_tws": tws, "wind_twd": twd})


@dataclass(frozen=True)
class Staged:
    """A wind that is worked out in stages: the first has the place, each other the two columns of the one before, and all the hour.

    A stage's columns are computed once for a row. In one expression they would
    be written out again wherever they are used, which multiplies from stage to
    stage until planning and compiling take longer than the rows.
    """

    stages: tuple[Wind, ...]

    def over(self, lat: str, lon: str, hour: Column) -> Blow:
        names = [*((f"_a{k}", f"_b{k}") for k in range(len(self.stages) - 1)), ("wind_tws", "wind_twd")]
        pairs = [f(F.col(a), F.col(b), hour) for f, (a, b) in zip(self.stages, [(lat, lon), *names], strict=False)]

        def blow(nodes: DataFrame, hours: tuple[float, float] | None = None) -> DataFrame:
            for name, pair in zip(names, pairs, strict=True):
                nodes = nodes.withColumns(dict(zip(name, pair, strict=True)))
            return nodes.drop(*sum(names[:-1], ()))

        return blow


@dataclass(frozen=True)
class Lattice:
    """Rows i from ``lat`` northwards and columns j from ``lon`` eastwards, and the hours of the steps in order."""

    lat: float
    lat_step: float
    n_lat: int
    lon: float
    lon_step: float
    n_lon: int
    hours: tuple[float, ...]

    @classmethod
    def of(cls, grid: DataFrame, lat: float, lat_step: float, lon: float, lon_step: float) -> Lattice:
        """The lattice of ``grid`` (i, j, hour, ..); its size and its steps, a forecast's few hundred at most, come to the driver."""
        n, m = grid.agg(F.coalesce(F.max("i") + 1, F.lit(0)), F.coalesce(F.max("j") + 1, F.lit(0))).first()
        hours = tuple(float(r[0]) for r in grid.select("hour").where(F.col("hour").isNotNull()).distinct().orderBy("hour").collect())
        return cls(lat, lat_step, int(n), lon, lon_step, int(m), hours)

    def place(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Places on the axes, in steps: latitudes are clamped, longitudes turned by whole circles and then clamped."""
        y = clamp((lat - self.lat) / self.lat_step, 0.0, float(self.n_lat - 1))
        east = F.pmod(lon - F.lit(self.lon), F.lit(360.0)) / self.lon_step
        return y, F.when(east > float(self.n_lon - 1), F.lit(0.0)).otherwise(east)

    def time(self, hour: Column) -> Column:
        """A place on the axis of steps, clamped at its ends: the number of the step before, plus the share of the way to the next."""
        if len(self.hours) == 1:
            return F.lit(0.0)
        steps = F.array(*map(F.lit, self.hours))
        k = clamp(F.size(F.filter(steps, lambda s: s <= hour)) - 1, 0, len(self.hours) - 2)
        return k + clamp((hour - F.get(steps, k)) / (F.get(steps, k + 1) - F.get(steps, k)), 0.0, 1.0)


@dataclass(frozen=True)
class Chosen:
    """Several providers behind one schema: the column ``by`` of a node names its own. A name without a provider has a null wind."""

    providers: dict[str, Field | StoredWinds]
    by: str

    def over(self, lat: str, lon: str, hour: Column) -> Blow:
        blows = {name: p.over(lat, lon, hour) for name, p in self.providers.items()}

        def blow(nodes: DataFrame, hours: tuple[float, float] | None = None) -> DataFrame:
            known = F.coalesce(F.col(self.by).isin(*blows), F.lit(False))
            out = nodes.where(~known).withColumns({c: F.lit(None).cast("double") for c in ("wind_tws", "wind_twd")})
            for name, f in blows.items():
                out = out.unionByName(f(nodes.where(F.col(self.by) == name), hours))
            return out

        return blow


class StoredWinds:
    """A forecast stored by tile and interval of time.

    A tile holds ``size`` by ``size`` cells with one more row and column, at
    the steps before and after; so every node meets exactly one tile, by an
    equi-join on (row of tiles, column of tiles, interval), and no aggregation
    follows. Tiles are Parquet in the shared folder, partitioned by interval.
    A cell given twice counts with its mean; a null or NaN component has no
    weight, and where the weights of a place don't reach 1e-6 its wind is null.
    An empty grid is a breeze of 12 knots from the north-east.
    """

    def __init__(self, grid: DataFrame, lattice: Lattice, size: int = 16) -> None:
        """``grid``: (i, j, hour, u, v), metres a second."""
        self.lattice, self.size = lattice, size
        self.empty = not (lattice.n_lat and lattice.n_lon and lattice.hours)
        if not self.empty:
            spark = grid.sparkSession
            path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
            tiles = self._tiles(grid)
            tiles.write.partitionBy("_k").parquet(path)
            self.tiles = spark.read.schema(tiles.schema).parquet(path)

    def _tiles(self, grid: DataFrame) -> DataFrame:
        spark, n, at = grid.sparkSession, self.lattice, self.size
        steps = len(n.hours)
        step = (F.array_position(F.array(*map(F.lit, n.hours)), F.col("hour").cast("double")) - 1).cast("int")
        own = lambda x: F.floor(F.col(x) / at).cast("int")
        both = lambda x: F.when((F.col(x) % at == 0) & (F.col(x) > 0), F.array(own(x), own(x) - 1)).otherwise(F.array(own(x)))
        slots = F.array(F.struct(F.col("_s").alias("k"), F.lit(0).alias("slot")), F.struct((F.col("_s") - 1).alias("k"), F.lit(1).alias("slot")))
        inside = F.col("i").between(0, n.n_lat - 1) & F.col("j").between(0, n.n_lon - 1)
        cells = grid.where(inside).withColumn("_s", step).where("_s >= 0").select("i", "j", "u", "v", F.explode(slots).alias("t"), both("i").alias("_is"), both("j").alias("_js"))
        last = max(steps - 2, 0)
        cells = cells.select("*", F.explode("_is").alias("_i")).select("*", F.explode("_js").alias("_j")).where(F.col("t.k").between(0, last))
        cells = cells.select("_i", "_j", F.col("t.k").alias("_k"), "t.slot", (F.col("i") - F.col("_i") * at).alias("y"), (F.col("j") - F.col("_j") * at).alias("x"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
        # every tile is there, so that a node always meets one
        every = spark.range((last + 1) * -(-n.n_lat // at) * -(-n.n_lon // at))
        wide, tall = -(-n.n_lon // at), -(-n.n_lat // at)
        whole = lambda e: F.expr(f"cast({e} as int)")
        every = every.select(whole(f"id div {wide} % {tall}").alias("_i"), whole(f"id % {wide}").alias("_j"), whole(f"id div {wide * tall}").alias("_k"))
        cells = cells.unionByName(every, allowMissingColumns=True)
        side, types = at + 1, (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32())

        def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            given = table.filter(pc.is_valid(table.column("slot")))
            place = [given.column(c).to_numpy() for c in ("slot", "y", "x")]
            flat = ((place[0] * side + place[1]) * side + place[2]).astype(int)
            out = []
            for c in ("u", "v"):
                value = given.column(c).to_numpy(zero_copy_only=False).astype(float)
                good = np.isfinite(value)
                total, count = (np.bincount(flat[good], w, 2 * side * side) for w in (value[good], None))
                out.append(np.where(count > 0, total / np.maximum(count, 1), np.nan))
            tile = {"_i": key[0], "_j": key[1], "us": out[0], "vs": out[1], "_k": key[2]}
            return pa.table({n: pa.array([x.as_py() if hasattr(x, "as_py") else x], t) for (n, x), t in zip(tile.items(), types, strict=True)})

        return cells.groupBy("_i", "_j", "_k").applyInArrow(fill, "_i int, _j int, us array<double>, vs array<double>, _k int")

    def over(self, lat: str, lon: str, hour: Column) -> Blow:
        if self.empty:
            return lambda nodes, hours=None: nodes.withColumns({"wind_tws": F.lit(EMPTY_TWS), "wind_twd": F.lit(EMPTY_TWD)})
        y, x = self.lattice.place(F.col(lat), F.col(lon))
        last = max(len(self.lattice.hours) - 2, 0)
        tile = lambda c: F.floor(F.col(c) / self.size).cast("int")
        axes = {"_y": y, "_x": x, "_t": self.lattice.time(hour)}
        keys = {"_i": tile("_y"), "_j": tile("_x"), "_k": F.least(F.floor("_t"), F.lit(last)).cast("int")}

        def blow(nodes: DataFrame, hours: tuple[float, float] | None = None) -> DataFrame:
            tiles = self.tiles
            if hours is not None:
                tiles = tiles.where(F.col("_k").between(*(min(sum(h <= x for h in self.lattice.hours[1:-1]), last) for x in hours)))
            met = nodes.withColumns(axes).withColumns(keys).join(tiles, [*keys])
            schema = StructType([*nodes.schema.fields, *[StructField(c, DoubleType()) for c in ("wind_tws", "wind_twd")]])
            return met.select(*nodes.columns, *axes, *keys, "us", "vs").mapInArrow(_blown(schema, self.size), schema)

        return blow


def _blown(schema: StructType, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def blown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c, b=b: b.column(b.schema.get_field_index(c))
            y, x, t, i, j, k = (col(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_x", "_t", "_i", "_j", "_k"))
            uv = [interpolated(col(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), y - i * size, x - j * size, t - k, size + 1) for c in ("us", "vs")]
            tws, twd = np.hypot(*uv) / KNOTS_TO_MS, np.degrees(np.arctan2(-uv[0], -uv[1])) % 360.0
            new = [pa.array(w, pa.float64(), from_pandas=True) for w in (tws, twd)]
            own = [col(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([a.cast(ty) for a, ty in zip([*own, *new], types, strict=True)], schema.names)

    return blown


def interpolated(tiles: np.ndarray, y: np.ndarray, x: np.ndarray, t: np.ndarray, side: int) -> np.ndarray:
    """Bilinear in place and linear in time, a row of ``tiles`` for each place; values that are missing have no weight, NaN where no weight is left."""
    rows = np.arange(len(tiles))
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    total, weight = np.zeros(len(tiles)), np.zeros(len(tiles))
    for slot in (0, 1):
        for di in (0, 1):
            for dj in (0, 1):
                w = (t if slot else 1 - t) * ((y - i) if di else 1 - (y - i)) * ((x - j) if dj else 1 - (x - j))
                value = tiles[rows, np.minimum((slot * side + np.minimum(i + di, side - 1)) * side + np.minimum(j + dj, side - 1), tiles.shape[1] - 1)]
                good = np.isfinite(value) & (w > 0)
                total += np.where(good, w * np.where(good, value, 0.0), 0.0)
                weight += np.where(good, w, 0.0)
    return np.where(weight >= LEAST_WEIGHT, total / np.where(weight > 0, weight, 1.0), np.nan)
