"""Boats as rows: preset dimensions, derived ratios, and the columns that the formulas read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (
    "loa", "lwl", "b_max", "b_wl", "draft_canoe", "draft_total", "mass", "prismatic", "form_factor", "keel_area", "keel_span", "rudder_area", "effective_draft",
    "main_p", "main_e", "fore_i", "fore_j", "mast", "boom", "mizzen_p", "mizzen_e", "mizzen_boom", "gmt", "crew_mass", "crew_distance", "crew_fraction",
)

# The four preset boats, in the order of FIELDS; a boat without a mizzen has zeros there.
PRESETS = {
    "36ft-ketch": ("36ft Cruising Ketch", (11.0, 9.2, 3.5, 3.10, 0.65, 1.5, 7000.0, 0.55, 0.14, 2.20, 0.95, 0.90, 1.45, 11.5, 4.0, 12.5, 4.3, 14.5, 1.8, 7.8, 2.8, 1.6, 1.05, 280.0, 1.45, 0.0)),
    "36ft-sloop": ("36ft Racing Sloop", (10.90, 9.65, 3.48, 2.95, 0.48, 2.30, 4900.0, 0.57, 0.09, 1.60, 1.85, 0.72, 2.25, 13.9, 4.55, 14.6, 4.25, 17.3, 1.85, 0.0, 0.0, 1.6, 1.15, 550.0, 1.68, 0.85)),
    "40ft-cruiser": ("40ft Cruiser", (12.20, 11.10, 4.05, 3.58, 0.60, 1.98, 8600.0, 0.58, 0.13, 2.35, 1.45, 1.00, 1.92, 14.6, 4.90, 15.4, 4.50, 17.9, 2.10, 0.0, 0.0, 1.6, 1.35, 400.0, 1.80, 0.0)),
    "24ft-sportboat": ("24ft Sportboat", (7.32, 6.86, 2.50, 2.15, 0.30, 1.75, 850.0, 0.58, 0.08, 0.85, 1.45, 0.42, 1.70, 9.0, 3.3, 8.8, 2.7, 10.5, 1.2, 0.0, 0.0, 1.6, 0.95, 320.0, 1.20, 0.95)),
}
DEFAULT = "36ft-ketch"


def presets(spark: SparkSession) -> DataFrame:
    """(boat, name, the fields): one row for each preset."""
    rows = [(k, name, *values) for k, (name, values) in PRESETS.items()]
    return spark.createDataFrame(rows, "boat string, name string, " + ", ".join(f"{f} double" for f in FIELDS))


def resolve(names: DataFrame, col: str) -> DataFrame:
    """Adds the boat of a typed name: trimmed, any case, nothing for the default; null where there is none of that name."""
    key = F.lower(F.trim(F.coalesce(F.col(col), F.lit(""))))
    return names.withColumn("_key", F.when(key == "", F.lit(DEFAULT)).otherwise(key)).join(presets(names.sparkSession).select(F.col("boat").alias("_key"), "boat", "name"), "_key", "left").drop("_key")


def ratios() -> dict[str, Column]:
    """Length to displacement, beam to draft, and sail area to displacement of a boat's row."""
    volume = F.col("mass") / 1025.0
    sails = (F.col("main_p") * F.col("main_e") + F.col("fore_i") * F.col("fore_j")) / 2
    return {
        "length_displacement": F.col("lwl") / F.pow(volume, F.lit(1 / 3)), "beam_draft": F.col("b_wl") / F.greatest(F.col("draft_canoe"), F.lit(0.1)), "sail_displacement": sails / F.pow(volume, F.lit(2 / 3)),
    }
