"""Times, labels, lists and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.units import round_to


def cycle_slug(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd_HH'Z'")


def parse_slug(slug: Column) -> Column:
    """Null where the text isn't a slug."""
    return F.try_to_timestamp(slug, F.lit("yyyyMMdd_HH'Z'")).cast("timestamp_ntz")


def iso_minute(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm")


def valid_time(t: Column, hours: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), hours.cast("int"))


def cycle_floor(t: Column, lag_minutes: int, every: int) -> Column:
    """The latest cycle, every so many hours of a day, that is out after the lag."""
    out = t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lag_minutes))
    return F.date_trunc("day", out).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour(out) / every) * every).cast("int"))


def local_hour(t: Column, lon: Column) -> Column:
    """Solar hour of [0, 24)."""
    return (F.hour(t) + F.minute(t) / 60.0 + lon / 15.0 + 24.0) % F.lit(24.0)


def days_hours(h: Column) -> Column:
    return F.format_string("%dd %dh", F.floor(h / 24).cast("int"), F.floor(h % 24).cast("int"))


def elapsed(h: Column) -> Column:
    return F.when(h < 24, F.format_string("+%.1fh", round_to(h, 1))).otherwise(F.format_string("d%d+%dh", F.floor(h / 24).cast("int"), F.floor(h % 24).cast("int")))


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_")


def alias_of(x: Column, names: dict[str, str]) -> Column:
    out = F.lower(x)
    for k, v in names.items():
        out = F.when(F.lower(x) == k, F.lit(v)).otherwise(out)
    return out


# The texts of warnings.
GALE = "Gale Warning: Peak wind %.0f kts (gusts %.0f kts), seas %.1fm forecast around %s UTC"
CALM = "Low Wind Warning: Extended light airs (<6 kts) for up to %.0f consecutive hours (avg %.1f kts). Motoring likely required."
NIGHT = "Night Arrival Warning: Estimated arrival at %s UTC (~%02d:%02d local time) in darkness. Harbor entry and coastal navigation in the dark."
PEAK = "Peak Wind Event: %.0f kts from %03.0f\u00b0"


def _whole(x: Column) -> Column:
    """For %.0f: half to even, as C prints."""
    return F.bround(x, 0)


def gale_warning(tws: Column, gust: Column, wave: Column, t: Column) -> Column:
    return F.format_string(GALE, _whole(tws), _whole(gust), wave, F.date_format(t, "EEE MMM dd HH:mm"))


def calm_warning(hours: Column, mean: Column) -> Column:
    return F.format_string(CALM, _whole(hours), mean)


def night_warning(arrives: Column, local_hour: Column) -> Column:
    """An hour that is short of a whole minute by rounding alone has that minute; none is shown as :60."""
    minutes = F.floor(F.round(local_hour * 6000.0) / 100.0).cast("int")
    return F.format_string(NIGHT, F.date_format(arrives, "HH:mm"), F.floor(minutes / 60) % 24, minutes % 60)


def peak_event(tws: Column, twd: Column) -> Column:
    return F.format_string(PEAK, _whole(tws), _whole(twd))


def shown_date(t: Column) -> Column:
    return F.date_format(t, "EEE, MMM d")


def shown_time(t: Column) -> Column:
    return F.concat(F.date_format(t, "HH:mm"), F.lit(" UTC"))
