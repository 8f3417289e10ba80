"""What iterative operators share: a table written to the cluster's shared folder in place of a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of the session under ``spark.checkpoint.dir``, which driver and executors share.

    A session without that setting gets a temporary folder where its executors
    are threads of the driver; elsewhere it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once and read again: later jobs start from the files, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder with all in it, on whatever file system Spark has for it; none there is no error."""
    at, files = _path(spark, path)
    files.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none for one that isn't there."""
    at, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small text file, whole or not at all: written beside and renamed; false, and nothing changed, where one of that name is there."""
    beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    at, files = _path(spark, beside)
    to, _ = _path(spark, path)
    out = files.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.exists(to) and files.rename(at, to):
        return True
    files.delete(at, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _path(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()
