"""Manoeuvres, derived sea state, points of sail, polar lookup, categories and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.geo import fold180, norm360, signed
from galeframe.functions.units import clamp, let, round_to

# The test polar, knots of boat speed by true wind speed and angle.
TWS = (6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0)
TWA = (0.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 52.0, 60.0, 70.0, 80.0, 90.0, 110.0, 120.0, 135.0, 150.0, 165.0, 180.0)
SPEEDS = (
    (0.00, 0.00, 0.00, 2.89, 3.32, 3.75, 4.00, 4.22, 4.38, 4.49, 4.54, 4.53, 4.42, 4.36, 4.06, 3.50, 2.99, 2.70),
    (0.00, 0.00, 0.00, 3.83, 4.18, 4.41, 4.58, 4.76, 4.89, 5.00, 5.05, 5.03, 5.04, 5.00, 4.63, 4.38, 3.90, 3.61),
    (0.00, 0.00, 0.00, 4.35, 4.62, 4.83, 4.98, 5.16, 5.30, 5.41, 5.45, 5.46, 5.55, 5.44, 5.11, 4.94, 4.34, 4.30),
    (0.00, 0.00, 0.00, 4.71, 4.96, 5.16, 5.32, 5.49, 5.79, 5.92, 5.96, 6.01, 6.09, 5.98, 5.53, 4.81, 4.70, 4.77),
    (0.00, 0.00, 0.00, 5.00, 5.25, 5.44, 5.74, 5.94, 6.06, 6.15, 6.19, 6.26, 6.32, 6.19, 6.03, 5.17, 5.08, 5.17),
    (0.00, 0.00, 0.00, 5.25, 5.50, 5.85, 6.00, 6.14, 6.25, 6.33, 6.37, 6.46, 6.50, 6.40, 6.27, 5.48, 5.42, 5.52),
    (0.00, 0.00, 0.00, 5.81, 6.04, 6.19, 6.30, 6.42, 6.51, 6.60, 6.68, 6.80, 6.79, 6.75, 6.54, 6.01, 6.08, 6.20),
    (0.00, 0.00, 0.00, 6.10, 6.26, 6.40, 6.49, 6.68, 6.79, 6.88, 7.02, 7.17, 7.18, 7.15, 6.80, 6.43, 6.50, 6.62),
)
CALM_KTS, STALL_DEG, NO_GO_DEG = 3.0, 22.0, 28.0


def polar_rows() -> list[tuple[float, float, float]]:
    return [(s, a, x) for s, row in zip(TWS, SPEEDS, strict=True) for a, x in zip(TWA, row, strict=True)]


def _bracket(axis: tuple[float, ...], x: Column) -> tuple[Column, Column]:
    """(0-based place of the lower neighbour, fraction), clamped at both ends."""
    a = F.array(*[F.lit(v) for v in axis])
    at = clamp(F.size(F.filter(a, lambda v: v <= x)) - 1, 0, len(axis) - 2)
    return at, let(at, lambda k: clamp((x - F.get(a, k)) / (F.get(a, k + 1) - F.get(a, k)), 0.0, 1.0))


def polar_speed(tws: Column, twa: Column) -> Column:
    """Boat speed in knots: none in calm or head to wind, scaled under the lightest column, rolled off near the stall.

    Both arguments are bound once, however often the lookup names them.
    """
    angle = let(F.abs(twa % F.lit(360.0)), fold180)
    return let(F.struct(tws.alias("tws"), angle.alias("angle")), lambda x: _looked_up(x["tws"], x["angle"]))


def _looked_up(tws: Column, angle: Column) -> Column:
    scale = F.when(tws < TWS[0], (tws - CALM_KTS) / (TWS[0] - CALM_KTS)).otherwise(F.lit(1.0))
    flat = F.array(*[F.lit(x) for row in SPEEDS for x in row])
    i, f = _bracket(TWS, F.greatest(tws, F.lit(TWS[0])))
    j, g = _bracket(TWA, angle)

    def between(x: Column) -> Column:
        cell = lambda di, dj: F.get(flat, (x["i"] + di) * len(TWA) + x["j"] + dj)
        low, high = (cell(d, 0) * (1 - x["g"]) + cell(d, 1) * x["g"] for d in (0, 1))
        return (low * (1 - x["f"]) + high * x["f"]) * scale

    s = let(F.struct(i.alias("i"), f.alias("f"), j.alias("j"), g.alias("g")), between)
    stall = F.when(angle < NO_GO_DEG, F.pow((angle - STALL_DEG) / 6.0, F.lit(2.0))).otherwise(F.lit(1.0))
    return F.when((tws <= CALM_KTS) | (angle <= STALL_DEG), F.lit(0.0)).otherwise(let(s * stall, lambda v: F.when(v < 0.05, F.lit(0.0)).otherwise(v)))


def polar_speed_extrapolated(tws: Column, twa: Column) -> Column:
    """Bilinear beyond the table's ends as within, angles from 30 degrees; no rule for calms."""
    angle = F.greatest(F.abs(twa), F.lit(30.0))
    flat = F.array(*[F.lit(x) for row in SPEEDS for x in row])

    def place(axis: tuple[float, ...], x: Column) -> tuple[Column, Column]:
        a = F.array(*[F.lit(v) for v in axis])
        at = clamp(F.size(F.filter(a, lambda v: v <= x)) - 1, 0, len(axis) - 2)
        return at, (x - F.get(a, at)) / (F.get(a, at + 1) - F.get(a, at))

    (i, f), (j, g) = place(TWS, tws), place(TWA, angle)
    cell = lambda di, dj: F.get(flat, (i + di) * len(TWA) + j + dj)
    return (cell(0, 0) * (1 - g) + cell(0, 1) * g) * (1 - f) + (cell(1, 0) * (1 - g) + cell(1, 1) * g) * f


def maneuver(heading: Column, new_heading: Column, twd: Column) -> Column:
    a, b = signed(norm360(heading - twd)), signed(norm360(new_heading - twd))
    same = (a * b >= 0) | (F.abs(a) < 1) | (F.abs(b) < 1)
    return F.when(same, F.lit("none")).when((F.abs(a) + F.abs(b)) / 2 < 90, F.lit("tack")).otherwise(F.lit("gybe"))


def heel(tws: Column, twa: Column) -> Column:
    return (
        F.when(twa < 20, F.lit(3.0)).when(twa <= 50, F.least(tws * 1.3, F.lit(24.0))).when(twa <= 110, F.least(tws * 1.1, F.lit(20.0)))
        .otherwise(F.least(tws * 0.35, F.lit(8.0)))
    )


def gust(tws: Column) -> Column:
    return round_to(tws * 1.25 + 1.5, 1)


def wave_height(tws: Column) -> Column:
    return F.greatest(F.lit(0.3), round_to(F.pow(tws / 10.0, F.lit(1.3)) * 0.5, 1))


def wave_period(tws: Column) -> Column:
    return F.greatest(F.lit(4.0), round_to(F.lit(3.5) + F.sqrt(tws) * 1.2, 1))


def point_of_sail(twa: Column, closed: bool = False) -> Column:
    """Five classes; ``closed`` puts 105 and 150 degrees into the class below, as window scoring does."""
    beam, broad = (twa <= 105, twa <= 150) if closed else (twa < 105, twa < 150)
    return F.when(twa < 60, F.lit("close_hauled")).when(twa < 75, F.lit("close_reach")).when(beam, F.lit("beam_reach")).when(broad, F.lit("broad_reach")).otherwise(F.lit("downwind"))


def confidence_category(score: Column) -> Column:
    return (
        F.when(score >= 85, F.lit("Very High")).when(score >= 70, F.lit("High")).when(score >= 50, F.lit("Moderate")).when(score >= 35, F.lit("Low"))
        .otherwise(F.lit("High Uncertainty"))
    )


def wave_intensity(height: Column, period: Column) -> Column:
    x = height * F.pow(F.lit(7.5) / period, F.lit(0.9))
    return F.when(x < 0.9, F.lit(0)).when(x < 1.7, F.lit(1)).when(x < 2.6, F.lit(2)).when(x < 3.8, F.lit(3)).otherwise(F.lit(4))


def barb(tws: Column) -> tuple[Column, Column, Column]:
    """(pennants of 50, full barbs of 10, half barbs of 5) of the speed rounded to 5 knots."""
    n = (F.round(tws / 5.0) * 5).cast("int")
    return (n / 50).cast("int"), (n % 50 / 10).cast("int"), (n % 10 / 5).cast("int")
