"""Solved points that are kept: a point is solved once for each version of the model, whoever asks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.physics import solver
from galeframe.sources.versions import Versioned

KEYS = ("model", "boat", "tws", "twa")
SCHEMA = "model string, boat string, tws double, twa double, v_boat_kts double, vmg_kts double, heel_deg double, leeway_deg double, sail_set_name string, flat double, reef double, converged boolean"


@dataclass(frozen=True)
class SolvedPoints:
    """A store of solved points at ``root``, a table of versions."""

    spark: SparkSession
    root: str

    @property
    def store(self) -> Versioned:
        return Versioned(self.spark, self.root, SCHEMA, KEYS, 16)

    def solve(self, points: DataFrame) -> DataFrame:
        """Each row of ``points`` (model, boat, tws, twa, the boat's fields, more columns) with its solution, and ``cached``: whether it was there before.

        ``model`` says by which version of the formulas a point is solved;
        points of another version are left as they are and not used. Only
        points that aren't there are solved, each once however many rows ask
        for it; they are added as a new version of the store.
        """
        had = self.store.read().select(*KEYS)
        new = points.dropDuplicates([*KEYS]).join(had, [*KEYS], "left_anti")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        version = self.store.upsert(solver.speed_table(new, ["model", "boat"]).select(*names))
        more = [c for c in points.columns if c not in solver.FIELDS]
        known = self.store.read(version).join(had.withColumn("cached", F.lit(True)), [*KEYS], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
        return points.select(*more).join(known, [*KEYS])
