"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class _Scratch(threading.local):
    """Tables of the open ``scratch`` blocks of a thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: ``df`` is computed once, written as Parquet to the cluster's shared folder, and read again.

    Inside ``scratch`` the table goes with the others at its end, unless it is
    to ``keep``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH.open and not keep:
        _SCRATCH.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` writes meanwhile are deleted at the end: what is still needed then is in tables that are kept, and no plan that lives on may read others."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder with all in it, on whatever file system Spark has for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session under ``spark.checkpoint.dir``, which driver and executors share.

    A session without that setting gets a temporary folder if its executors
    are threads of the driver; on a cluster it is an error, as executors would
    write where the driver can't read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def one_thread() -> None:
    """A task has one core: numpy's OpenBLAS, where it is that, is told to use no more; its idle threads would spin on the cores of other tasks."""
    if not _TOLD:
        _TOLD.append(True)
        for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if (tell := getattr(ctypes.CDLL(str(path)), name, None)) is not None:
                    tell(ctypes.c_int(1))
                    break


_TOLD: list[bool] = []


def column(name: str) -> Column:
    """The top-level column of this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(col: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(column(col).cast("string"), F.lit(""))


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id reads as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(column(id_col).cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows that Spark sends to Python at once, about, and what it sends by default.
SENT_BYTES, SENT_BY_DEFAULT = 8 << 20, "67108864b"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at about ``SENT_BYTES``, unless it has a limit of its own.

    By default a batch ends at 10,000 rows or 64 MB. Whole texts reach that, and
    then each task holds it several times: in the JVM (outside its heap, in
    buffers that double as they grow), in Python, and on the way back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SENT_BY_DEFAULT:
        spark.conf.set(key, str(SENT_BYTES))


def by_bytes(batches: Iterator[pa.RecordBatch], col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``limit`` bytes of ``col`` (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def salted_prefix(df: DataFrame, keys: list[str], order: list[Column], value: Column, salt: Column, out: str, buckets: int) -> DataFrame:
    """The sum of ``value`` (a long) over a key's earlier rows, without bringing a key's rows into one task.

    ``keys`` hold no nulls. Rows of a key are dealt over ``buckets`` by
    ``salt``; sums run within each (key, bucket) and are shifted by the totals
    of the key's earlier buckets, a table of one row per (key, bucket). With a
    value of 1 it is a gapless rank from 0.
    """
    part = [*keys, "_bucket"]
    df = df.withColumn("_bucket", F.pmod(salt, F.lit(buckets)).cast("int")).withColumn("_value", value.cast("long"))
    totals = df.groupBy(*part).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*part, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return summed.join(shift, part).withColumn(out, F.col("_within") + F.col("_before")).drop("_bucket", "_value", "_within", "_before")


def buckets_for(rows: int, each: int = 20_000) -> int:
    """So many buckets that even a key with all rows has about ``each`` in a bucket."""
    return max(16, -(-rows // each))
