"""Index files of forecast archives: byte ranges of the messages inside a large file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_ranges(lines: DataFrame, file_col: str, order_col: str, line_col: str) -> DataFrame:
    """(file, order, first, last, name) of colon-parted lines ``number:offset:date:variable:level:...``.

    ``last`` is the byte before the next line's offset, 0 (open) on a file's
    last line. Lines with fewer than three fields or no readable offset are
    skipped.
    """
    f = F.split(F.col(line_col), ":")
    rows = lines.select(F.col(file_col).alias("file"), F.col(order_col).alias("order"), F.get(f, F.lit(1)).try_cast("long").alias("first"), F.array_join(F.slice(f, 4, 64), ":").alias("name"), F.size(f).alias("_n"))
    rows = rows.where("_n >= 3 and first is not null").drop("_n")
    w = Window.partitionBy("file").orderBy("order")
    return rows.withColumn("last", F.coalesce(F.lead("first").over(w) - 1, F.lit(0)))


def first_match(ranges: DataFrame, pattern: Column) -> DataFrame:
    """The first line of each file whose name holds the pattern."""
    hit = ranges.where(F.contains("name", pattern))
    return hit.groupBy("file").agg(F.min_by(F.struct("order", "first", "last", "name"), "order").alias("r")).select("file", "r.*")


JSON_LINE = "param string, number string, _offset long, _length long"


def json_ranges(lines: DataFrame, file_col: str, order_col: str, line_col: str) -> DataFrame:
    """(file, param, member, first, length) of JSON lines; the last of a key stays. Unreadable lines are skipped."""
    j = F.from_json(F.col(line_col), JSON_LINE)
    rows = lines.select(F.col(file_col).alias("file"), F.col(order_col).alias("order"), j.alias("j")).where("j.param is not null and j._offset is not null")
    best = rows.groupBy("file", F.lower("j.param").alias("param"), F.coalesce("j.number", F.lit("0")).alias("member")).agg(F.max_by(F.struct(F.col("j._offset").alias("first"), F.col("j._length").alias("length")), "order").alias("r"))
    return best.select("file", "param", "member", "r.first", "r.length")


def with_fallback(ranges: DataFrame, wanted: list[str]) -> DataFrame:
    """For each file and member the first of the ``wanted`` parameters that is there: one aggregation, whatever their number."""
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("param"))
    hit = ranges.where(F.col("param").isin(wanted))
    return hit.groupBy("file", "member").agg(F.min_by(F.struct("param", "first", "length"), rank).alias("r")).select("file", "member", "r.*")
