"""Tables that are upserted by key, in buckets, with a manifest for each version.

    <root>/data/<write>/_bucket=<b>   rows of one bucket as one write left them
    <root>/versions/<n>               which write holds each bucket in version n

An upsert reads and writes the buckets that its keys fall into, and no
others; its manifest is put as the next number, or, where another writer was
faster, the upsert is done again on that one's version. A reader names a
version or takes the newest, and keeps it whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.operators.common import delete, listed, put_once, read_text


@dataclass(frozen=True)
class Versioned:
    """``schema`` in DDL, ``keys`` among its columns. Of rows of ``upsert`` with the same key the one with the greatest ``order`` counts, ties by all columns."""

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def version(self) -> int:
        """The newest version, 0 where nothing was written."""
        return max((int(n) for n in listed(self.spark, f"{self.root}/versions") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        return json.loads(read_text(self.spark, f"{self.root}/versions/{version}")) if version else {}

    def _read(self, held: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/data/{write}/_bucket={b}" for b, write in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(self.version() if version is None else version))

    def upsert(self, changes: DataFrame, order: str | None = None, deleted: str | None = None) -> int:
        """Rows replace those of their keys, or are added; where the column ``deleted`` is true they go. Returns the new version.

        Null keys are keys. No row is changed by an empty table, which makes a
        version too.
        """
        columns = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).cast("int")
        last = Window.partitionBy(*self.keys).orderBy(*([F.col(order).desc()] if order else []), *[F.col(c).desc() for c in columns])
        new = changes.withColumn("_gone", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).withColumn("_bucket", bucket)
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*columns, "_gone", "_bucket")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # as many as there are buckets at most
        while True:
            at = self.version()
            held = self._manifest(at)
            old = self._read({b: w for b, w in held.items() if int(b) in touched})
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
            stay = old.alias("o").join(new.alias("c"), same, "left_anti").withColumn("_bucket", bucket)
            write = uuid.uuid4().hex
            rows = stay.unionByName(new.where("not _gone").drop("_gone"))
            rows.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{write}")
            written = {n.removeprefix("_bucket=") for n in listed(self.spark, f"{self.root}/data/{write}") if n.startswith("_bucket=")}
            manifest = {b: w for b, w in held.items() if int(b) not in touched} | {b: write for b in written}
            if put_once(self.spark, f"{self.root}/versions/{at + 1}", json.dumps(manifest)):
                return at + 1
            delete(self.spark, f"{self.root}/data/{write}")
