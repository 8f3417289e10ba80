"""Unit conversions, rounding and lattice sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounded factors (metres a second to knots, kilometres and miles an hour) as forecasts are reported, and the exact knot.
KNOTS, KMH, MPH = 1.943844, 3.6, 2.236936
KNOTS_TO_MS = 1852.0 / 3600.0
FEET_TO_M, POUNDS_TO_KG, MM_PER_INCH, HPA = 0.3048, 0.45359237, 25.4, 100.0


def round_to(x: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def let(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def speed(ms: Column, unit: Column) -> Column:
    return F.when(unit == "kn", ms * KNOTS).when(unit == "kmh", ms * KMH).when(unit == "mph", ms * MPH).otherwise(ms)


def temperature(kelvin: Column, unit: Column) -> Column:
    c = kelvin - F.lit(273.15)
    return F.when(unit == "fahrenheit", c * F.lit(1.8) + F.lit(32.0)).when(unit == "celsius", c).otherwise(kelvin)


def pressure(pa: Column, unit: Column) -> Column:
    return F.when(unit == "kPa", pa / F.lit(1000.0)).when(unit == "bar", pa / F.lit(100000.0)).otherwise(pa / F.lit(HPA))


def knots_to_ms(kts: Column) -> Column:
    return kts * F.lit(1852.0) / F.lit(3600.0)


def lattice_size(span: Column, step: Column) -> Column:
    return F.round(span / step).cast("int") + 1
