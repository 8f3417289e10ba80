"""Compact shoreline files as a data source of Spark: a writer in two phases, and a reader that skips by box.

A folder holds part files and ``_committed``, the list of those that count. A
task of the writer writes a part file of its own and reports its name; the
driver writes the list when all tasks have reported, or else deletes the
parts, so that readers see a whole shoreline or the one before. A part file
is, little-endian: GSHH, version (u16), number of polygons (u32), then for
each polygon its id (u32), the length of its name (u8) and the name, its box
(least and greatest latitude and longitude, f32), the number of its vertices
(u32), and their latitudes and longitudes (f32).

Paths are URIs that pyarrow's file systems know (file:, hdfs:, s3: ..), or
plain paths, in storage that all executors share.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

MAGIC, VERSION, LIST = b"GSHH", 1, "_committed"
#: Edges of a chunk, whose box decides whether they are read.
CHUNK = 16
RINGS = "poly_id int, name string, lats array<float>, lons array<float>"
EDGES = "poly_id int, name string, chunk int, min_lat double, max_lat double, min_lon double, max_lon double, seq int, x1 double, y1 double, x2 double, y2 double"
_BOX = ("min_lat", "max_lat", "min_lon", "max_lon")
_RULES = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def polygon_bytes(pid: int, name: str, lats: np.ndarray, lons: np.ndarray) -> bytes:
    label = name.encode()[:255]
    at = np.stack([lats, lons], 1).astype("<f4")
    low, high = (at.min(0), at.max(0)) if len(at) else (np.zeros(2), np.zeros(2))
    return struct.pack("<IB", pid, len(label)) + label + struct.pack("<4fI", low[0], high[0], low[1], high[1], len(at)) + at.tobytes()


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    polygons: int


class ShoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        made = [polygon_bytes(r["poly_id"], r["name"] or "", np.array(r["lats"] or [], float), np.array(r["lons"] or [], float)) for b in iterator for r in b.to_pylist()]
        if not made:
            return Part(None, 0)
        store, folder = files(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(MAGIC + struct.pack("<HI", VERSION, len(made)))
            for m in made:
                out.write(m)
        return Part(name, len(made))

    def commit(self, messages: list[Part | None]) -> None:
        """The list is written beside and moved: readers have the one before until then."""
        store, folder = files(self.path)
        store.create_dir(folder, recursive=True)
        before = committed(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        beside = f"{folder}/{LIST}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(json.dumps(([] if self.overwrite else before) + names).encode())
        store.move(beside, f"{folder}/{LIST}")
        for name in before if self.overwrite else []:
            store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = files(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


def committed(path: str) -> list[str]:
    from pyarrow import fs

    store, folder = files(path)
    at = f"{folder}/{LIST}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


class File(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


class ShoreReader(DataSourceReader):
    """Edges by chunk. Comparisons of a chunk's box with numbers are pushed down: a polygon whose own box can't fit is passed over unread, a chunk whose box doesn't fit gives no edges."""

    def __init__(self, path: str) -> None:
        self.path, self.rules = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _RULES and len(f.attribute) == 1 and f.attribute[0] in _BOX:
                self.rules.append((f.attribute[0], type(f), float(f.value)))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in _BOX):  # a chunk always has a box
                yield f

    def partitions(self) -> list[InputPartition]:
        return [File(n) for n in committed(self.path)]

    def may_fit(self, box: dict[str, float]) -> bool:
        """Whether a chunk within ``box`` can fit: its least values are at most the polygon's greatest, and so on."""
        for col, kind, value in self.rules:
            low, high = box[f"min_{col[4:]}"], box[f"max_{col[4:]}"]
            if kind in (GreaterThan, GreaterThanOrEqual, EqualTo) and not _RULES[GreaterThanOrEqual if kind is EqualTo else kind](high, value):
                return False
            if kind in (LessThan, LessThanOrEqual, EqualTo) and not _RULES[LessThanOrEqual if kind is EqualTo else kind](low, value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, folder = files(self.path)
        with store.open_input_file(f"{folder}/{partition.value}") as f:
            if f.read(4) != MAGIC:
                raise ValueError(f"{partition.value} is no shoreline file")
            _, count = struct.unpack("<HI", f.read(6))
            for _ in range(count):
                pid, size = struct.unpack("<IB", f.read(5))
                name = f.read(size).decode(errors="replace")
                *box, n = struct.unpack("<4fI", f.read(20))
                if not n or not self.may_fit(dict(zip(_BOX, box, strict=True))):
                    f.seek(8 * n, 1)
                    continue
                batch = self.edges(pid, name, np.frombuffer(f.read(8 * n), "<f4").reshape(n, 2).astype(float))
                if batch is not None:
                    yield batch

    def edges(self, pid: int, name: str, at: np.ndarray) -> pa.RecordBatch | None:
        start, end = at, np.roll(at, -1, 0)
        if len(at) > 1 and (at[0] == at[-1]).all():
            start, end = at[:-1], at[1:]
        chunk = np.arange(len(start)) // CHUNK
        first = np.arange(0, len(start), CHUNK)
        low, high = (f.reduceat(g(start, end), first) for f, g in ((np.minimum, np.minimum), (np.maximum, np.maximum)))
        box = {"min_lat": low[:, 0], "max_lat": high[:, 0], "min_lon": low[:, 1], "max_lon": high[:, 1]}
        good = np.ones(len(first), bool)
        for col, kind, value in self.rules:
            good &= _RULES[kind](box[col], value)
        keep = good[chunk]
        if not keep.any():
            return None
        seq = np.flatnonzero(keep)
        cols = [np.full(len(seq), pid, np.int32), None, chunk[seq].astype(np.int32), *[box[c][chunk[seq]] for c in _BOX], seq.astype(np.int32), start[seq, 1], start[seq, 0], end[seq, 1], end[seq, 0]]
        names = [c.split()[0] for c in EDGES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(seq)) if c is None else pa.array(np.ascontiguousarray(c)) for c in cols], names)


class Shoreline(DataSource):
    """``format("shoreline")``: rows of rings are written (``RINGS``, a row for each polygon), rows of edges are read (``EDGES``)."""

    @classmethod
    def name(cls) -> str:
        return "shoreline"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema) -> ShoreReader:
        return ShoreReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShoreWriter:
        return ShoreWriter(self.options["path"], overwrite)


def register(spark) -> None:
    """Makes the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shoreline)


def rings(points: DataFrame) -> DataFrame:
    """A row for each ring of points (poly_id, seq, lon, lat), as the writer takes it."""
    r = points.groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon")))).alias("p"))
    return r.select("poly_id", F.format_string("Land #%d", "poly_id").alias("name"), F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"))


def near(spark, path: str, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Edges of the chunks that touch a box."""
    e = spark.read.format("shoreline").load(path)
    return e.where((F.col("max_lat") >= min_lat) & (F.col("min_lat") <= max_lat) & (F.col("max_lon") >= min_lon) & (F.col("min_lon") <= max_lon))
