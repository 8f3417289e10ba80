"""Ingest as streams: arrivals counted until a step is complete, two components that meet, cycles that only go forward."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galeframe.operators.common import shared_folder


def stream_of(spark: SparkSession, folder: str, pattern: str, per_trigger: int | None = 1) -> DataFrame:
    """Parquet files of a landing folder as a stream, with the schema of those that are there; without ``per_trigger`` a batch has all that are new."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (s.option("maxFilesPerTrigger", per_trigger) if per_trigger else s).parquet(folder)


def landing(spark: SparkSession, deliveries: list[DataFrame], folder: str | None = None) -> str:
    """A landing folder that got one delivery after the other. A delivery has as many files as its tasks write."""
    folder = folder or f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    for d in deliveries:
        d.write.mode("append").parquet(folder)
    return folder


def complete_steps(arrivals: DataFrame, members: int) -> DataFrame:
    """(step, n, mean, low, high), once for each step, as soon as all its members have arrived.

    ``arrivals``: a stream of (step string, member int, value double). The
    state of a step is one value for each member (the least of repeated
    deliveries), thus bounded by ``members``; it is emptied when the step is
    emitted, and a mark of the step alone stays, so that late copies don't
    emit it again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have, done = state.get if state.exists else ("", False)
        if done:
            for _ in batches:
                pass
            return
        got = dict(zip(map(int, x.split(":")[::2]), map(float, x.split(":")[1::2]), strict=True)) if (x := have) else {}
        for pdf in batches:
            for m, v in zip(pdf["member"], pdf["value"], strict=True):
                got[int(m)] = min(float(v), got.get(int(m), float("inf")))
        if len(got) < members:
            state.update((":".join(f"{k}:{v!r}" for k, v in sorted(got.items())), False))
            return
        state.update(("", True))
        v = pd.Series([got[k] for k in sorted(got)])
        yield pd.DataFrame({"step": [key[0]], "n": [len(got)], "mean": [v.mean()], "low": [v.min()], "high": [v.max()]})

    return arrivals.groupBy("step").applyInPandasWithState(run, "step string, n int, mean double, low double, high double", "have string, done boolean", "append", GroupStateTimeout.NoTimeout)


def rendezvous(u: DataFrame, v: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(cell, t, speed) where both components of a cell and time have arrived; state goes when the watermark has passed it."""
    a = u.withWatermark("t", delay).select(F.col("cell"), F.col("t"), F.col("value").alias("u"))
    b = v.withWatermark("t", delay).select(F.col("cell").alias("_cell"), F.col("t").alias("_t"), F.col("value").alias("v"))
    return a.join(b, (F.col("cell") == F.col("_cell")) & (F.col("t") == F.col("_t"))).select("cell", "t", F.hypot("u", "v").alias("speed"))


def windows(events: DataFrame, key: str, length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling windows of event time, late rows dropped beyond the watermark: an extension of the engine."""
    return events.withWatermark("t", delay).groupBy(F.window("t", length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def to_table(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, exactly once, into files of the shared folder, and returns them as a table. One of the same ``base`` goes on where it was."""
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def in_turn(spark: SparkSession, deliveries: list[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table of a stream that runs after each delivery: a delivery is one batch, however many files it has, so that its rows are late by those of earlier ones alone."""
    folder, base = landing(spark, []), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for d in deliveries:
        landing(spark, [d], folder)
        out = to_table(made(stream_of(spark, folder, "*.parquet", None)), base=base)
    return out


def newer_cycles(stream: DataFrame, done: str, write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: of each batch only rows of cycles newer than any published of their model are written.

    ``write`` stores the rows; then the cycles are appended to the table at
    ``done``. A batch whose write fails leaves ``done`` as it was, so that it
    is tried again as a whole.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            last = spark.read.schema("model string, cycle string").parquet(done).groupBy("model").agg(F.max("cycle").alias("_last"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = spark.createDataFrame([], "model string, _last string")
        new = batch.join(last, "model", "left").where(F.col("_last").isNull() | (F.col("cycle") > F.col("_last"))).drop("_last")
        new = new.persist()
        try:
            write(new)
            new.select("model", "cycle").distinct().write.mode("append").parquet(done)
        finally:
            new.unpersist()

    return each


def tracked(root: str, by: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a table of progress at ``root``: how many rows of each ``by`` a batch had. A batch that comes again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("rows"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return each


def polled(stream: DataFrame, each: Callable[[DataFrame, int], None], every: str | None = None, base: str | None = None) -> StreamingQuery:
    """Starts a poll: at once and then ``every`` (such as "10 minutes") a batch of what is new; without it, all that is there and no more. One of the same ``base`` goes on where it was."""
    base = base or f"{shared_folder(stream.sparkSession)}/poll-{uuid.uuid4().hex}"
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", base).trigger(**trigger).start()


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of the batches that a query remembers."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
