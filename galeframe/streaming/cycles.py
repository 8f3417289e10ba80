"""Whole cycles as they come in: a batch is staged, then one file, its manifest, makes it visible or not at all.

    <root>/staged/batch=<batch>   the rows of a batch, by model and cycle
    <root>/manifest/<batch>       written last: which cycles the batch has published

A batch that fails leaves no manifest, so that readers see nothing of it; its
staged files are deleted, and the same batch is tried again by the restarted
stream. A batch that has a manifest is done and does nothing when it comes
again, as it may after a failure between the manifest and the stream's own
commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galeframe.operators.common import delete, exists, listed, put_once, read_text


def manifests(spark: SparkSession, root: str) -> dict[int, dict[str, list[str]]]:
    """Of each committed batch the cycles that it has published, by model. A batch is a cycle or a few, so this is a list as long as the store has cycles."""
    folder = f"{root}/manifest"
    return {int(n): json.loads(read_text(spark, f"{folder}/{n}")) for n in listed(spark, folder) if n.isdigit()}


def high_water(spark: SparkSession, root: str) -> dict[str, str]:
    """The newest cycle published of each model."""
    marks: dict[str, str] = {}
    for published in manifests(spark, root).values():
        for model, cycles in published.items():
            marks[model] = max([*cycles, marks.get(model, "")])
    return marks


def commit_cycles(root: str, ingest: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that ingests cycles newer than the newest published of their model, each batch as a whole or not at all.

    ``ingest`` turns a batch (model, cycle, more columns) into the rows to
    store, model and cycle among them; its first error aborts the batch.
    Batches may be repeated at will.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest, staged = f"{root}/manifest/{number}", f"{root}/staged/batch={number}"
        if exists(spark, manifest):
            return
        marks = high_water(spark, root)
        known = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]) if marks else None
        newest = F.coalesce(F.try_element_at(known, F.col("model")), F.lit("")) if marks else F.lit("")
        try:
            ingest(batch.where(F.col("cycle") > newest)).write.mode("overwrite").partitionBy("model", "cycle").parquet(staged)
        except Exception:
            delete(spark, staged)
            raise
        published: dict[str, list[str]] = {}
        for model in listed(spark, staged):
            if model.startswith("model="):
                published[model.removeprefix("model=")] = [c.removeprefix("cycle=") for c in listed(spark, f"{staged}/{model}") if c.startswith("cycle=")]
        put_once(spark, manifest, json.dumps(published))

    return each


def start(stream: DataFrame, root: str, ingest: Callable[[DataFrame], DataFrame], every: str | None = None) -> StreamingQuery:
    """Ingests a stream of slices into the store at ``root``, at once and then ``every`` (such as "10 minutes"); without it, all that is there and no more. A stopped or failed one goes on where it was."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(commit_cycles(root, ingest)).option("checkpointLocation", f"{root}/progress").trigger(**trigger).start()


def visible(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of committed batches; staged files without a manifest aren't read."""
    batches = [f"{root}/staged/batch={n}" for n, published in manifests(spark, root).items() if published]
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/staged").parquet(*batches).drop("batch")
