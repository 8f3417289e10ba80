"""Stores of forecast cycles: publishing, retention, the newest one, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.functions import text


def write_cycle(cells: DataFrame, path: str) -> None:
    """Appends long-form cells (model, cycle, variable, step, i, j, value), laid out so that a point's series is read from one file."""
    out = cells.withColumns({"_ci": F.floor(F.col("i") / 16), "_cj": F.floor(F.col("j") / 16)})
    out = out.repartitionByRange("model", "cycle", "variable", "_ci", "_cj").sortWithinPartitions("variable", "_ci", "_cj", "i", "j", "step").drop("_ci", "_cj")
    out.write.mode("append").partitionBy("model", "cycle").option("compression", "zstd").parquet(path)


def publish(spark: SparkSession, root: str, model: str, cycle: str) -> None:
    """Makes a cycle the newest: one row, written after its cells; readers that look meanwhile see the one before."""
    spark.createDataFrame([(model, cycle)], "model string, cycle string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_latest")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """(model, cycle): the last one published of each model."""
    return spark.read.parquet(f"{root}/_latest").groupBy("model").agg(F.max_by("cycle", F.struct("at", "cycle")).alias("cycle"))


def expired(cycles: DataFrame, keep: int = 2) -> DataFrame:
    """Cycles (model, cycle) beyond the newest ``keep`` of their model; fewer than one means two."""
    n = keep if keep >= 1 else 2
    return cycles.distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("cycle")))).where(F.col("_rank") > n).drop("_rank")


def newest(cycles: DataFrame) -> DataFrame:
    """(model, reference): the greatest slug of each model that can be read as a time."""
    return cycles.groupBy("model").agg(F.max(text.parse_slug(F.col("cycle"))).alias("reference"))


def sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(folder, files, bytes) below a path, from the listing alone: contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def open_latest(spark: SparkSession, root: str, path: str, model: str) -> DataFrame:
    """The cells of a model's newest published cycle; the scan is of its folder alone. Without one, no cells."""
    cycles = [r["cycle"] for r in latest(spark, root).where(F.col("model") == model).collect()]  # one at most
    return spark.read.parquet(path).where((F.col("model") == model) & F.col("cycle").isin(cycles))
