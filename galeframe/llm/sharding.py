"""Sharding by histogram sort: splitters of a text-hash order found by counting exact bytes below probes, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import column, durable, partitions, text

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def histogram(sized: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) with key < probe, for each of the sorted probes; each task sends one short row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(probes) + 1), np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(), side="right")
            # bincount sums in doubles; whole bytes of one batch stay far below 2^53
            total[0] += np.bincount(at, weights=b.column(1).to_numpy(), minlength=len(probes) + 1).astype(np.int64)
            total[1] += np.bincount(at, minlength=len(probes) + 1)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])], ["at", "bytes", "rows"])

    got = sized.select("_key", "_size").mapInArrow(count, "at int, bytes long, rows long").groupBy("at").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).collect()
    below = np.zeros((2, len(probes) + 1), np.int64)
    for r in got:
        below[:, r["at"]] = r["b"], r["r"]
    below = np.cumsum(below, axis=1)
    return below[0][:-1], below[1][:-1]


def between(a: int, b: int, parts: int) -> set[int]:
    return {a + (b - a) * i // parts for i in range(1, parts)} - {a}


def splitters(sized: DataFrame, total: int, rows: int, shards: int, tolerance: float, probes_each: int = 64) -> list[int]:
    """shards - 1 keys; the bytes below the k-th are within tolerance * total / shards of k * total / shards, or as near as whole rows allow."""
    goal = [k * total / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    # a splitter's bracket: (key, bytes, rows below) on either side of its goal
    low, high = [(LOW, 0, 0)] * len(goal), [(HIGH, total, rows)] * len(goal)
    done: dict[int, int] = {}
    probes = between(LOW, HIGH, 16 * shards)
    while len(done) < len(goal):
        points = np.array(sorted(probes), np.int64)
        size, count = histogram(sized, points)
        known = list(zip(points.tolist(), size.tolist(), count.tolist(), strict=True))
        probes = set()
        for k in (k for k in range(len(goal)) if k not in done):
            low[k] = max([low[k], *(p for p in known if p[0] < high[k][0] and p[1] <= goal[k])])
            high[k] = min([high[k], *(p for p in known if p[0] > low[k][0] and p[1] > goal[k])])
            near = min((low[k], high[k]), key=lambda p: abs(p[1] - goal[k]))
            if abs(near[1] - goal[k]) <= slack or high[k][2] - low[k][2] <= 1 or high[k][0] - low[k][0] <= 1:
                done[k] = near[0]
            else:
                probes |= between(low[k][0], high[k][0], probes_each)
    return [done[k] for k in range(len(goal))]


def ranges(sized: DataFrame, cuts: list[int], rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted edges, the cuts among them, and the rows below each, so that few ranges hold over 3 / parts of all rows.

    Copies of a text share their upper key bits: such a range is cut again
    until its edges fall among them. Edges after an empty range are left out.
    """
    edges = {*cuts, *between(LOW, HIGH, parts)}
    while True:
        points = np.array(sorted(edges), np.int64)
        _, below = histogram(sized, points)
        count = np.diff(np.concatenate([[0], below, [rows]]))
        heavy = [(a, b) for a, b, n in zip([LOW, *points.tolist()], [*points.tolist(), HIGH], count.tolist(), strict=True) if n > max(64, 3 * rows / parts) and b - a > 1]
        keep = np.isin(points, np.array(cuts, np.int64)) | (count[:-1] > 0)
        if not heavy:
            return points[keep], below[keep]
        edges = set(points[keep].tolist()).union(*(between(a, b, 64) | {a, b} - {LOW, HIGH} for a, b in heavy))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.002) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row, under the law ``bytes``.

    The order is by hash of the text, then hash of the row's number, so that
    equal texts lie side by side and share a shard unless the law needs a cut
    among them; a group of copies of any size can be cut, rows that repeat
    with id and text too, since each has a number of its own, fixed when the
    sizes are written. size: UTF-8 bytes plus ``overhead``; a null text has no
    bytes. slot: the place in the shard, from 0. Null ids are like any other.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    step = 1 << 24
    key = (F.xxhash64(text(text_col)).bitwiseAND(F.lit(-step))).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(step - 1)))
    sized = durable(docs.select(
        column(id_col).alias("_id"), (F.octet_length(text(text_col)).cast("long") + overhead).alias("_size"), F.crc32(text(text_col)).alias("_crc"), key.alias("_key"),
    ))
    whole = sized.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    cuts = splitters(sized, whole["bytes"], whole["rows"], shards, tolerance) if whole["rows"] else [HIGH] * (shards - 1)
    # the exchange's ranges: the shards, cut further, so that a shard needn't be one task
    edges, below = ranges(sized, cuts, whole["rows"], max(4 * partitions(spark), 256))
    rows_before = np.concatenate([[0], below])  # of each range
    shard_of = np.searchsorted(np.array(cuts, np.int64), np.concatenate([[LOW], edges]), side="right")
    first = {}
    for s, b in zip(shard_of.tolist(), rows_before.tolist(), strict=True):
        first.setdefault(s, b)
    base = np.array([b - first[s] for s, b in zip(shard_of.tolist(), rows_before.tolist(), strict=True)], np.int64)
    shared = spark.sparkContext.broadcast((edges, shard_of, base))  # a few entries for each shuffle partition

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, shard_of, base = shared.value
        for b in batches:
            at = np.searchsorted(edges, b.column(3).to_numpy(), side="right")
            more = [pa.array(at, pa.int32()), pa.array(shard_of[at], pa.int32()), pa.array(base[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_range", "shard", "_base"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = sized.mapInArrow(place, f"_id {kind}, _size long, _crc long, _key long, _range int, shard int, _base long")
    order = Window.partitionBy("_range").orderBy("_key", "_id", "_crc")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("_base") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
