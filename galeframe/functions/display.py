"""Values that a report shows: colours, scales, bounds, durations, names, and whether a result is out of date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.units import round_to

# Fixed values: (knots, red, green, blue) of the wind ramp.
WIND_RAMP = ((0, 29, 78, 216), (10, 16, 185, 129), (20, 250, 204, 21), (30, 249, 115, 22), (40, 239, 68, 68), (50, 168, 85, 247), (70, 139, 92, 246))
# Eleven colours evenly along the sequential ramp.
SEQUENTIAL_RAMP = ((13, 8, 135), (65, 3, 157), (106, 0, 168), (143, 13, 161), (177, 42, 144), (204, 71, 120), (225, 100, 98), (241, 130, 77), (251, 162, 56), (253, 203, 42), (240, 249, 33))
# Names of land masses by number, and by (south and west corner) ranges, tried in this order.
LAND_BY_NUMBER = {
    0: "Eurasia", 1: "Africa", 2: "North America", 3: "South America", 4: "Antarctica", 5: "Antarctica", 6: "Australia", 7: "Greenland", 8: "New Guinea", 9: "Borneo", 10: "Madagascar", 11: "Baffin Island", 12: "Sumatra",
    13: "Honshu (Japan)", 14: "Victoria Island", 15: "Great Britain", 22: "Cuba", 126: "Trinidad", 714: "Grenada",
}
LAND_BY_CORNER = (
    (10.0, 10.9, -62.0, -60.8, "Trinidad"), (11.9, 12.3, -61.9, -61.5, "Grenada"), (11.1, 11.4, -60.9, -60.5, "Tobago"), (32.2, 32.5, -64.9, -64.6, "Bermuda"), (51.3, 55.5, -10.6, -5.5, "Ireland"),
    (18.9, 22.3, -160.3, -154.8, "Hawaii"), (32.6, 32.9, -17.3, -16.6, "Madeira"), (36.9, 39.8, -31.3, -25.0, "Azores"), (27.6, 29.5, -18.2, -13.3, "Canary Islands"), (13.0, 13.4, -59.7, -59.4, "Barbados"),
    (13.7, 14.2, -61.2, -60.8, "St. Lucia"), (14.3, 15.0, -61.3, -60.8, "Martinique"), (15.8, 16.6, -61.9, -61.1, "Guadeloupe"), (17.8, 18.6, -65.1, -64.2, "Virgin Islands"), (17.8, 18.6, -67.4, -65.5, "Puerto Rico"),
    (18.0, 20.1, -74.6, -68.3, "Hispaniola"),
)


def wind_color(tws: Column) -> Column:
    """rgb(...) on the straight line between the ramp's neighbours; the ends beyond."""
    parts = []
    for k in (1, 2, 3):
        x = F.lit(float(WIND_RAMP[-1][k]))
        for a, b in reversed(list(zip(WIND_RAMP, WIND_RAMP[1:], strict=False))):
            x = F.when(tws < b[0], F.lit(float(a[k])) + (tws - a[0]) / float(b[0] - a[0]) * float(b[k] - a[k])).otherwise(x)
        parts.append(F.round(F.when(tws <= 0, float(WIND_RAMP[0][k])).otherwise(x)).cast("int"))
    return F.format_string("rgb(%d, %d, %d)", *parts)


def series_color(index: Column, n: Column) -> Column:
    """Hexadecimal colour of the index-th of n series, from a tenth to nine tenths along the ramp."""
    last = len(SEQUENTIAL_RAMP) - 1
    pos = F.when(n > 1, index / F.nullif(n - 1, F.lit(0)) * 0.8 + 0.1).otherwise(0.5) * last
    at = F.floor(pos).cast("int")
    one = lambda k: F.get(F.array(*[F.lit(float(s[k])) for s in SEQUENTIAL_RAMP]), at)
    two = lambda k: F.get(F.array(*[F.lit(float(s[k])) for s in SEQUENTIAL_RAMP]), F.least(at + 1, F.lit(last)))
    return F.format_string("#%02x%02x%02x", *[F.round(one(k) + (two(k) - one(k)) * (pos - at)).cast("int") for k in range(3)])


def rings(most_percent: Column) -> tuple[Column, Column]:
    """(step, number) of a rose's rings."""
    most = F.greatest(most_percent, F.lit(10.0))
    step = F.when(most > 60, 20).when(most > 35, 15).when(most > 20, 10).otherwise(5)
    return step, F.greatest(F.lit(3), F.ceil(most / step)).cast("int")


def duration(hours: Column) -> Column:
    days = F.floor(hours / 24).cast("int")
    rest = F.format_string("%dh %dm (%.1f hrs)", F.floor(hours % 24).cast("int"), F.round((hours * 60) % 60).cast("int"), round_to(hours, 1))
    return F.when(days > 0, F.concat(F.format_string("%dd ", days), rest)).otherwise(rest)


def score_class(score: Column) -> Column:
    return F.when(score >= 80, F.lit("best")).when(score >= 65, F.lit("good")).when(score >= 50, F.lit("fair")).otherwise(F.lit("poor"))


def padded(low: Column, high: Column, by: float, least: float, most: float) -> tuple[Column, Column]:
    """Bounds widened on both sides, inside [least, most]."""
    return F.greatest(F.least(low, high) - by, F.lit(least)), F.least(F.greatest(low, high) + by, F.lit(most))


def land_name(number: Column, south: Column, west: Column) -> Column:
    out = F.format_string("Land #%d", number)
    for s0, s1, w0, w1, name in reversed(LAND_BY_CORNER):
        out = F.when(south.between(s0, s1) & west.between(w0, w1), F.lit(name)).otherwise(out)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in LAND_BY_NUMBER.items() for x in kv]), number)
    return F.coalesce(named, out)


def outdated(minute: tuple[Column, Column], boat: tuple[Column, Column], penalties: list[tuple[Column, Column]], places: list[tuple[Column, Column]]) -> Column:
    """Whether any parameter of a route differs from what it was solved for: time to the minute, penalties to 0.01, places and step to 0.0001."""
    fmt = lambda t: F.date_format(t, "yyyyMMddHHmm")
    out = ~fmt(minute[0]).eqNullSafe(fmt(minute[1])) | ~boat[0].eqNullSafe(boat[1])
    for pairs, by in ((penalties, 0.01), (places, 0.0001)):
        for a, b in pairs:
            out = out | (F.abs(a - b) > by)
    return out
