"""Pieces of DuckDB SQL for the oracles: the domain views and formulas."""

from __future__ import annotations

from galeframe import tables
from galeframe.functions import sailing

OBS = """obs as (select event_id, ts as t, -60e0 + (event_id % 1200) / 10e0 as lat, -180e0 + (event_id * 7 % 3600) / 10e0 as lon,
 value % 40e0 as tws, cast(event_id * 37 % 360 as double) as twd from events)"""
TRACK = """track as (select user_id as route_id, cast(row_number() over w - 1 as integer) as idx, ts as t, cast(event_id * 13 % 181 as double) as twa, value % 40e0 as tws,
 sum(value % 40e0 / 10e0) over (partition by user_id order by ts, event_id rows unbounded preceding) as distance_nm,
 -60e0 + (event_id % 1200) / 10e0 as lat, -180e0 + (event_id * 7 % 3600) / 10e0 as lon, cast(event_id * 37 % 360 as double) as twd
 from events window w as (partition by user_id order by ts, event_id))"""
ENS = "ens as (select l_partkey as cell, l_linenumber as step, cast(l_orderkey % 31 as integer) as member, l_quantity as u, l_discount * 100e0 as v from lineitem)"
GRID = "grid as (select cast(p_partkey // 50 as integer) as i, cast(p_partkey % 50 as integer) as j, p_retailprice as value from part)"


def values(rows, names: str) -> str:
    lit = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else str(x)
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) {names}"


def polar() -> str:
    return "polar as (select * from " + values(sailing.polar_rows(), "p(tws, twa, speed)") + ")"


def fleet_polars() -> str:
    """CTEs that end in ``fleet``: a table of speeds for each supplier."""
    return polar() + ", fleet as (select s_suppkey, tws, twa, speed * (0.8e0 + (s_acctbal + 1000e0) / 50000e0) as speed from supplier, polar)"


def edges() -> str:
    rows = [(k, n, *p, *q) for k, _, v in tables.POLYGONS for n, (p, q) in enumerate(zip(v, [*v[1:], v[0]], strict=True))]
    return "edges as (select * from " + values(rows, "e(poly_id, seq, x1, y1, x2, y2)") + ")"


def r6(x: str) -> str:
    return f"(round(({x}) * 1e6) / 1e6 + 0e0)"


def r1(x: str) -> str:
    return f"round(({x}) * 10e0) / 10e0"


def norm(x: str) -> str:
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def fold(x: str) -> str:
    return f"(case when {x} > 180 then 360e0 - {x} else {x} end)"


def signed(x: str) -> str:
    return f"(case when {x} > 180 then {x} - 360e0 else {x} end)"


def dist(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(6371000e0 * 2 * atan2(sqrt({h}), sqrt(greatest(1e0 - {h}, 0e0))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return norm(f"degrees(atan2({y}, {x}))")


def dest_lat(lat: str, m: str, h: str) -> str:
    return f"degrees(asin(sin(radians({lat})) * cos(({m}) / 6371000e0) + cos(radians({lat})) * sin(({m}) / 6371000e0) * cos(radians({h}))))"


def dest_lon(lat: str, lon: str, m: str, h: str) -> str:
    d = f"(({m}) / 6371000e0)"
    x = f"degrees(radians({lon}) + atan2(sin(radians({h})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin(radians({dest_lat(lat, m, h)}))))"
    return f"({norm(x + ' + 180e0')} - 180e0)"


def polar_speed(src: str, keys: str, tws: str = "tws", twa: str = "twa") -> str:
    """CTEs that end in ``sped``: src's keys and the boat speed, by a range join with the polar's cells."""
    return f"""{polar()},
px as (select tws as s0, lead(tws) over (order by tws) as s1 from (select distinct tws from polar)),
py as (select twa as a0, lead(twa) over (order by twa) as a1 from (select distinct twa from polar)),
cells as (select s0, s1, a0, a1, c00.speed as c00, c01.speed as c01, c10.speed as c10, c11.speed as c11 from px, py, polar c00, polar c01, polar c10, polar c11
 where s1 is not null and a1 is not null and c00.tws = s0 and c00.twa = a0 and c01.tws = s0 and c01.twa = a1 and c10.tws = s1 and c10.twa = a0 and c11.tws = s1 and c11.twa = a1),
pq as (select {keys}, {tws} as w, {fold(f"abs({twa} % 360e0)")} as a from {src}),
pr as (select *, least(greatest(w, 6e0), 25e0) as cw from pq),
ps as (select {keys}, w, a, ((c00 * (1 - (a - a0) / (a1 - a0)) + c01 * ((a - a0) / (a1 - a0))) * (1 - (cw - s0) / (s1 - s0))
 + (c10 * (1 - (a - a0) / (a1 - a0)) + c11 * ((a - a0) / (a1 - a0))) * ((cw - s0) / (s1 - s0))) * (case when w < 6 then (w - 3e0) / 3e0 else 1e0 end) as raw
 from pr join cells on cw >= s0 and (cw < s1 or (s1 = 25 and cw = 25)) and a >= a0 and (a < a1 or (a1 = 180 and a = 180))),
sped as (select {keys}, case when w <= 3 or a <= 22 then 0e0 when (case when a < 28 then raw * pow((a - 22e0) / 6e0, 2) else raw end) < 0.05 then 0e0
 when a < 28 then raw * pow((a - 22e0) / 6e0, 2) else raw end as speed from ps)"""


def pos(x: str, closed: bool = False) -> str:
    op = "<=" if closed else "<"
    return f"case when {x} < 60 then 'close_hauled' when {x} < 75 then 'close_reach' when {x} {op} 105 then 'beam_reach' when {x} {op} 150 then 'broad_reach' else 'downwind' end"


def maneuver(h: str, n: str, d: str) -> str:
    a, b = signed(norm(f"{h} - {d}")), signed(norm(f"{n} - {d}"))
    return f"case when {a} * {b} >= 0 or abs({a}) < 1 or abs({b}) < 1 then 'none' when (abs({a}) + abs({b})) / 2 < 90 then 'tack' else 'gybe' end"
