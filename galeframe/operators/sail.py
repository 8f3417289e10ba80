"""One step of sailing on arrays of numpy: a fan of headings from each node. Angles are degrees."""

from __future__ import annotations

import numpy as np

from galeframe.functions import sailing
from galeframe.functions.geo import EARTH_M, NM_M

_AXES = np.array(sailing.TWS), np.array(sailing.TWA)
_SPEEDS = np.array(sailing.SPEEDS)


def bearing(lat1, lon1, lat2, lon2):
    p, q, d = np.radians(lat1), np.radians(lat2), np.radians(lon2) - np.radians(lon1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) % 360.0


def distance_m(lat1, lon1, lat2, lon2):
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def destination(lat, lon, metres, heading):
    p, d, b = np.radians(lat), metres / EARTH_M, np.radians(heading)
    s = np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(b)
    out = np.radians(lon) + np.arctan2(np.sin(b) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * s)
    return np.degrees(np.arcsin(s)), (np.degrees(out) + 180.0) % 360.0 - 180.0


def fold(angle):
    """The size of an angle, at most 180."""
    a = angle % 360.0
    return np.minimum(a, 360.0 - a)


def polar_speed(tws, twa):
    """As ``sailing.polar_speed``."""
    at, part = [], []
    for axis, x in zip(_AXES, (np.maximum(tws, _AXES[0][0]), twa), strict=True):
        k = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, len(axis) - 2)
        at.append(k)
        part.append(np.clip((x - axis[k]) / (axis[k + 1] - axis[k]), 0.0, 1.0))
    (i, j), (f, g) = at, part
    low, high = (_SPEEDS[i + k, j] * (1 - g) + _SPEEDS[i + k, j + 1] * g for k in (0, 1))
    light = np.where(tws < _AXES[0][0], (tws - sailing.CALM_KTS) / (_AXES[0][0] - sailing.CALM_KTS), 1.0)
    stall = np.where(twa < sailing.NO_GO_DEG, ((twa - sailing.STALL_DEG) / (sailing.NO_GO_DEG - sailing.STALL_DEG)) ** 2, 1.0)
    s = (low * (1 - f) + high * f) * light * stall
    return np.where((tws <= sailing.CALM_KTS) | (twa <= sailing.STALL_DEG) | (s < 0.05), 0.0, s)


def turns(heading, new_heading, twd):
    """(tacks, gybes): whether the wind changes sides over the bow or the stern."""
    a, b = ((h - twd + 180.0) % 360.0 - 180.0 for h in (heading, new_heading))
    sides = (a * b < 0) & (np.abs(a) >= 1) & (np.abs(b) >= 1)
    bow = (np.abs(a) + np.abs(b)) / 2 < 90
    return sides & bow, sides & ~bow


def fan(node: dict[str, np.ndarray], offsets: np.ndarray, step_hours: float, tack_minutes: float, gybe_minutes: float, no_go: float, least_kts: float, seq_bits: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(parents' places, columns of the candidates) by node, then heading; those in the no-go zone or too slow are left out."""
    heads = ((bearing(node["lat"], node["lon"], node["dest_lat"], node["dest_lon"]) % 360.0)[:, None] + offsets) % 360.0
    twa = fold(heads - node["wind_twd"][:, None])
    speed = polar_speed(np.broadcast_to(node["wind_tws"][:, None], twa.shape), twa)
    at, k = np.nonzero((twa >= no_go) & (speed > least_kts))
    p = {c: v[at] for c, v in node.items()}
    heading, twa, speed = heads[at, k], twa[at, k], speed[at, k]
    tack, gybe = (t & (p["step"] > 0) for t in turns(p["heading"], heading, p["wind_twd"]))
    metres = speed * (NM_M / 3600.0) * np.maximum(0.1, step_hours * 3600.0 - 60.0 * (tack * tack_minutes + gybe * gybe_minutes))
    lat, lon = destination(p["lat"], p["lon"], metres, heading)
    return at, {
        "step": p["step"] + 1, "lat": lat, "lon": lon, "dist_m": distance_m(lat, lon, p["dest_lat"], p["dest_lon"]), "heading": heading, "tws": p["wind_tws"], "twd": p["wind_twd"], "twa": twa, "speed": speed,
        "traveled_nm": p["traveled_nm"] + metres / NM_M, "maneuver": np.where(tack, "tack", np.where(gybe, "gybe", "none")), "tacks": p["tacks"] + tack, "gybes": p["gybes"] + gybe,
        "seq": (p["idx"].astype(np.int64) << seq_bits) + k, "from_lat": p["lat"], "from_lon": p["lon"],
    }
