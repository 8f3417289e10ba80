"""Small rules of the services as column expressions: colours of scores, aliases of models, polars that are out of date, route documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours by least score, the last for all below; text, ground and border of confidences.
SCORE_COLORS = ((80, "#10b981"), (65, "#38bdf8"), (50, "#f59e0b"), (None, "#ef4444"))
TIMELINE_COLORS = ((75, "#10b981"), (50, "#eab308"), (None, "#ef4444"))
CONFIDENCE_STYLES = (
    (75, ("#34d399", "rgba(16, 185, 129, 0.18)", "rgba(52, 211, 153, 0.4)")),
    (50, ("#facc15", "rgba(234, 179, 8, 0.18)", "rgba(250, 204, 21, 0.4)")),
    (None, ("#f87171", "rgba(239, 68, 68, 0.18)", "rgba(248, 113, 113, 0.4)")),
)
# Names that a route request may use for a model; case counts, and no name stands for all.
ROUTING_MODELS = {
    "gfs_0p25": ("gfs", "gfs_seamless", "gfs_0p25"),
    "ifs_0p25": ("ecmwf", "ifs", "ifs_seamless", "ifs_0p25"),
    "icon_global": ("icon", "dwd_icon", "icon_seamless", "icon_global"),
    "gefs_0p50": ("gefs", "gefs_0p50", "noaa_gefs", "gefs050", "gefs_seamless"),
    "ifs_ens_0p25": ("ifs_ens", "ifs_ens_0p25", "ecmwf_ens", "ecmwf_ifs_ens"),
    "icon_eps_global": ("icon_eps", "icon_eps_global", "dwd_icon_eps"),
    "all": ("", "all"),
}


def by_least(score: Column, steps, pick=F.lit) -> Column:
    """The value of the first step whose least score is reached; a null score has the last."""
    out = pick(steps[-1][1])
    for least, value in reversed(steps[:-1]):
        out = F.when(score >= least, pick(value)).otherwise(out)
    return out


def score_color(score: Column) -> Column:
    return by_least(score, SCORE_COLORS)


def timeline_color(score: Column) -> Column:
    """Of a waypoint's confidence, 85 where it has none."""
    return by_least(F.coalesce(score, F.lit(85)), TIMELINE_COLORS)


def confidence_style(score: Column) -> Column:
    """(color, ground, border)."""
    return by_least(score, CONFIDENCE_STYLES, lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("color", "ground", "border"), v, strict=True)]))


def routing_model(name: Column) -> Column:
    """The model of a route request; a name that isn't known stays."""
    out = name
    for model, names in ROUTING_MODELS.items():
        out = F.when(name.isin(*names), F.lit(model)).otherwise(out)
    return out


def polar_stale(version: Column, current: Column, has_geometry: Column, from_file: Column) -> Column:
    """Whether a boat's polar was solved by another version than the current one, or by none. False where the current one isn't known, and for boats that can't be solved again."""
    known = current.isNotNull() & (current != "")
    return known & F.coalesce(has_geometry, F.lit(False)) & ~F.coalesce(from_file, F.lit(False)) & ~version.eqNullSafe(current)


def route_document(name: Column, model: Column, begins: Column, points: Column, creator: str = "galeframe") -> Column:
    """A GPX document of one route; ``points``, in order, have lat, lon, time (text) and speed (knots)."""
    line = lambda p: F.concat(F.lit('<rtept lat="'), p["lat"], F.lit('" lon="'), p["lon"], F.lit('"><time>'), p["time"], F.lit("</time><name>Spd "), F.format_string("%.1f", p["speed"]), F.lit("k</name></rtept>"))
    escaped = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>'), escaped(name), F.lit(" ("), model, F.lit(") Route</name>\n    <time>"), begins,
        F.lit("</time>\n  </metadata>\n  <rte>\n    <name>"), escaped(name), F.lit(" Optimal Weather Route ["), model, F.lit("]</name>\n    "), F.array_join(F.transform(points, line), "\n    "), F.lit("\n  </rte>\n</gpx>"),
    )
