"""Queries of the force balance, the polar solver and its targets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import tables
from galeframe.functions.units import round_to
from galeframe.operators import polars
from galeframe.operators.common import shared_folder
from galeframe.physics import boats, cache, forces, solver
from galeframe.plans import duck as d
from galeframe.plans.scalar import r6

c = F.col
QUERIES, SQL = {}, {}
M = forces.Columns


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _boats_sql() -> str:
    rows = [(k, *v) for k, (_, v) in boats.PRESETS.items()]
    return "boats as (select *, mass / 1025e0 as vol, keel_area + rudder_area as foil from " + d.values(rows, f"b(boat, {', '.join(boats.FIELDS)})") + ")"


def _fleet_sql() -> str:
    """As ``_boats_sql``, a boat for each supplier."""
    rows = [(k, n, *v) for n, (k, (_, v)) in enumerate(boats.PRESETS.items())]
    own = {"mass": "mass * (1 + s_suppkey % 7 / 50e0) as mass", "main_p": "main_p * (1 + s_suppkey % 5 / 40e0) as main_p"}
    fields = ", ".join(own.get(f, f) for f in boats.FIELDS)
    return f"presets as (select * from {d.values(rows, f'p(preset, n, {", ".join(boats.FIELDS)})')}), own as (select s_suppkey as boat, preset, {fields} from supplier join presets on n = s_suppkey % 4), boats as (select *, mass / 1025e0 as vol, keel_area + rudder_area as foil from own)"


def _fields() -> dict:
    return {f: c(f) for f in boats.FIELDS}


def _hydro_ctes(src: str) -> str:
    """CTEs from ``src`` (boats' columns, key, v, heel, leeway, side) to ``hyd``."""
    cf = lambda re: f"0.075e0 / pow(greatest(log10(greatest({re}, 1e4)) - 2, 0.5e0), 2)"
    return f"""h0 as (select *, v / sqrt(9.80665e0 * lwl) as fn, lwl / pow(vol, 1e0/3) as lvr, b_wl / greatest(draft_canoe, 0.1e0) as btr, 0.5e0 * 1025 * v * v as q, 2.65e0 * sqrt(vol * lwl) as sh, 2.05e0 * foil as sf,
 greatest(2 * effective_draft * effective_draft / greatest(foil, 0.1e0), 0.5e0) as ar from {src}),
h1 as (select *, 2 * pi() * ar / (sqrt(ar * ar + 4) + 2) as slope, least(greatest((lvr - 5.8e0) / 1.4e0, 0e0), 1e0) as plane from h0),
h2 as (select *, (1 + form_factor) * {cf("v * 0.7e0 * lwl / 1.188e-6")} * q * sh + 1.06e0 * {cf("v * sqrt(keel_area) / 1.188e-6")} * q * sf as r_viscous,
 case when fn <= 0.05 then 0e0 else greatest(case when fn < 0.18 then 0.0003e0 * pow(fn / 0.18e0, 3.5e0) when fn < 0.30 then 0.0003e0 + 0.008e0 * pow((fn - 0.18e0) / 0.12e0, 2.8e0) when fn < 0.40 then 0.0083e0 + 0.075e0 * pow((fn - 0.30e0) / 0.10e0, 2.2e0)
 else (0.0833e0 + 1.25e0 * pow(fn - 0.4e0, 1.3e0) + 12 * pow(fn - 0.4e0, 2.5e0)) * (1 - plane) + (0.0833e0 + 0.09e0 * (fn - 0.4e0)) * plane end * pow(5.8e0 / greatest(lvr, 3.5e0), 2.2e0) * pow(btr / 4e0, 0.35e0)
 * case when fn > 0.35 then 1 - 1.2e0 * (prismatic - 0.56e0) else 1 + 0.8e0 * (prismatic - 0.56e0) end, 0e0) * mass * 9.80665e0 end as r_residuary,
 side * side / greatest(pi() * 1025 * greatest(v, 0.05e0) * greatest(v, 0.05e0) * effective_draft * effective_draft * 0.88e0, 1e-4) as r_induced,
 case when abs(heel) < 1e-4 or v < 0.05 then 0e0 else 6.74e-4 * sin(heel) * sin(heel) * (fn + 0.15e0) * sqrt(btr / 4e0) * sqrt(5.8e0 / greatest(lvr, 3.5e0)) * q * (sh + sf) end as r_heel,
 asin(least(greatest(side / greatest(q * foil, 1e-4) / slope, -0.25e0), 0.25e0)) as wanted,
 q * foil * case when abs(leeway) < radians(12) then slope * sin(leeway) else sign(leeway) * slope * sin(radians(12)) * cos(abs(leeway) - radians(12)) end as foil_force,
 mass * 9.80665e0 * gmt * sin(heel) * (1 + 0.35e0 * sin(heel) * sin(heel)) + crew_mass * crew_fraction * 9.80665e0 * crew_distance * cos(heel) * tanh(heel / radians(12)) as righting from h1)"""


@query(f"""with {_fleet_sql()}, k as (select boats.*, cast(range as integer) as k, 0.3e0 + range * 0.2e0 as v, radians(range % 30) as heel, radians(range % 37 - 18) as leeway, mass * 0.5e0 * (range % 7) as side from boats, range(0, 50)),
{_hydro_ctes("k")} select boat, k, {", ".join(f"{d.r6(x)} as {x}" for x in ("r_viscous", "r_residuary", "r_induced", "r_heel", "wanted", "foil_force", "righting"))} from h2""")
def I28_I33_I39_resistance_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Resistance and righting moment of every supplier's boat at fifty speeds."""
    k = tables.fleet(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49))))
    k = k.withColumns({"v": c("k") * 0.2 + 0.3, "heel": F.radians(c("k") % 30), "leeway": F.radians(c("k") % 37 - 18), "side": c("mass") * 0.5 * (c("k") % 7)})
    h = forces.hydro(M, _fields(), c("v"), c("heel"), c("side"))
    cols = {k: h[k] for k in ("r_viscous", "r_residuary", "r_induced", "r_heel", "righting")} | {"wanted": h["leeway"], "foil_force": forces.side_force(M, _fields(), c("v"), c("leeway"))}
    return k.select("boat", "k", *[r6(x).alias(n) for n, x in cols.items()])


_UP = "case when {a} < 20 then {x} * ({a} / 20e0) when {a} <= 50 then {x} when {a} <= 90 then {x} * cos(radians({a} - 50) * 0.75e0) else {x} * 0.7e0 * sin(radians(180 - {a})) end"
_UPD = "case when {a} < 20 then {d} * 1.5e0 when {a} <= 50 then {d} when {a} <= 90 then {d} + 0.08e0 * ({a} - 50) / 40e0 else {d} + 0.08e0 + 0.65e0 * ({a} - 90) / 90e0 end"
_DN = "case when {a} < 35 then 0e0 when {a} < 80 then {x} * ({a} - 35) / 45e0 when {a} <= 130 then {x} else {x} * greatest((180 - {a}) / 50e0, 0e0) end"
_DND = "case when {a} < 35 then {d} when {a} < 80 then {d} + 0.15e0 * ({a} - 35) / 45e0 when {a} <= 130 then {d} + 0.2e0 + 0.2e0 * ({a} - 80) / 50e0 else 0.4e0 + 0.85e0 * ({a} - 130) / 50e0 end"


@query(f"""with {_boats_sql()}, o as (select event_id, value % 40e0 as tws, cast(event_id * 13 % 181 as double) as twa from events),
k as (select o.event_id, o.tws * 1852e0 / 3600 as wind, radians(o.twa) as twa, 1 + (event_id % 50) * 0.1e0 as v, radians(event_id % 25) as heel, radians(event_id % 8) as leeway, 1 - (event_id % 4) * 0.15e0 as flat, 1 - (event_id % 3) * 0.1e0 as reef, event_id % 2 = 0 as down, boats.*
 from o join boats on boat = case event_id % 4 when 0 then '36ft-ketch' when 1 then '36ft-sloop' when 2 then '40ft-cruiser' else '24ft-sportboat' end),
s as (select *, 0.5e0 * main_p * main_e * 1.08e0 * reef * reef as ma, (boom + main_p * 0.38e0) as mz, 0.5e0 * fore_i * fore_j * (case when down then 1.7e0 else 1.04e0 end) * reef * reef as ha, 1 + fore_i * (case when down then 0.44e0 else 0.36e0 end) as hz,
 0.5e0 * mizzen_p * mizzen_e * 1.05e0 * reef * reef as za, mizzen_boom + mizzen_p * 0.38e0 as zz from k),
t as (select *, ma + ha + za as area, (ma * mz + ha * hz + za * zz) / (ma + ha + za) * (0.3e0 + 0.7e0 * reef) as z from s),
w as (select *, wind * pow(greatest(z, 0.5e0) / 10, 0.142857e0) as vt from t), a as (select *, vt * cos(twa + leeway) + v * cos(leeway) as ax, vt * sin(twa + leeway) - v * sin(leeway) as ay from w),
p as (select *, sqrt(ax * ax + ay * ay) as aws, atan2(ay, ax) as awa from a), e as (select *, aws * sqrt(cos(awa) * cos(awa) + pow(sin(awa) * cos(heel), 2)) as awse, atan2(sin(awa) * cos(heel), cos(awa)) as awe from p),
g as (select *, least(abs(degrees(awe)), 180e0) as g, 0.5e0 * 1.225e0 * awse * awse as q, greatest(pow(1.1e0 * mast, 2) / greatest(area, 1e0), 1e0) as ar from e),
l as (select *, {_UP.format(a="g", x="(1.45e0 * flat)")} as lm, case when down then {_DN.format(a="g", x="(1.6e0 * flat)")} else {_UP.format(a="g", x="(1.35e0 * flat)")} end as lh, {_UP.format(a="g", x="(1.3e0 * flat)")} as lz,
 {_UPD.format(a="g", d="0.018e0")} as dm, case when down then {_DND.format(a="g", d="0.035e0")} else {_UPD.format(a="g", d="0.015e0")} end as dh, {_UPD.format(a="g", d="0.02e0")} as dz from g),
f as (select *, q * (ma * lm + ha * lh + za * lz) as lift, q * (ma * (dm + lm * lm / (pi() * ar * 0.88e0)) + ha * (dh + lh * lh / (pi() * ar * 0.88e0)) + za * (dz + lz * lz / (pi() * ar * 0.88e0))) + 0.5e0 * 1.225e0 * aws * aws * (0.5e0 * b_max * 1.2e0 * 0.6e0 + 0.12e0 * mast) as drag from l),
y as (select *, lift * sin(awe) - drag * cos(awe) as f_x, (lift * cos(awe) + drag * sin(awe)) * cos(heel) as f_y from f)
select event_id, {d.r6("aws")} as aws, {d.r6("awa")} as awa, {d.r6("z")} as z_ce, round(f_x * 1e3) / 1e3 + 0e0 as f_x, round(f_y * 1e3) / 1e3 + 0e0 as f_y, round(f_y * (z * cos(heel) + 0.45e0 * draft_total) * 1e3) / 1e3 + 0e0 as m_x from y""")
def I23_I27_aero_forces(spark: SparkSession, sf: str) -> DataFrame:
    """Sail forces of a preset boat in every observation's wind."""
    o = tables.obs(spark, sf).select("event_id", "tws", (c("event_id") * 13 % 181).cast("double").alias("twa"))
    name = F.element_at(F.array(*map(F.lit, boats.PRESETS)), (c("event_id") % 4 + 1).cast("int"))
    o = o.withColumn("boat", name).join(F.broadcast(boats.presets(spark)), "boat")  # four rows
    e = c("event_id")
    trim = {"heel": F.radians(e % 25), "leeway": F.radians(e % 8), "flat": F.lit(1.0) - (e % 4) * 0.15, "reef": F.lit(1.0) - (e % 3) * 0.1, "down": e % 2 == 0}
    o = o.withColumns(trim).withColumn("z_ce", forces.rig(M, _fields(), c("down"), c("reef"))[1])
    wind = forces.apparent_wind(M, c("tws") * 1852.0 / 3600, F.radians("twa"), F.lit(1.0) + (e % 50) * 0.1, c("heel"), c("leeway"), c("z_ce"))
    o = o.withColumns(dict(zip(("aws", "awa", "aws_eff", "awa_eff"), wind, strict=True)))  # computed once, read by all that follows
    a = forces.sail_forces(M, _fields(), *[c(k) for k in ("aws", "aws_eff", "awa_eff", "z_ce", "heel", "flat", "reef", "down")])
    return o.select("event_id", *[r6(c(k)).alias(k) for k in ("aws", "awa", "z_ce")], *[round_to(a[k], 3).alias(k) for k in ("f_x", "f_y", "m_x")])


@query(f"""with {_fleet_sql()} select boat, {d.r6("lwl / pow(vol, 1e0/3)")} as length_displacement, {d.r6("b_wl / greatest(draft_canoe, 0.1e0)")} as beam_draft, {d.r6("(main_p * main_e + fore_i * fore_j) / 2 / pow(vol, 2e0/3)")} as sail_displacement from boats""")
def I40_I41_boat_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return tables.fleet(spark, sf).select("boat", *[r6(x).alias(k) for k, x in boats.ratios().items()])


@query("""with n as (select o_orderkey, case o_orderkey % 4 when 0 then ' 36FT-Sloop ' when 1 then '' when 2 then null else 'raft' end as typed from orders)
select o_orderkey, case when trim(coalesce(typed, '')) = '' then '36ft-ketch' when lower(trim(typed)) = '36ft-sloop' then '36ft-sloop' end as boat from n""")
def C17_preset_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = c("o_orderkey") % 4
    o = tables.read(spark, sf, "orders").select("o_orderkey", F.when(k == 0, F.lit(" 36FT-Sloop ")).when(k == 1, F.lit("")).when(k == 3, F.lit("raft")).alias("typed"))
    return boats.resolve(o, "typed").select("o_orderkey", "boat")


TWS, TWA = (6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0), (0.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 52.0, 60.0, 70.0, 80.0, 90.0, 110.0, 120.0, 135.0, 150.0, 165.0, 180.0)


@query()
def I37_polar_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The polar of a boat of each market segment, heavier where its customers have more on account: 8 wind speeds by 18 angles, each at its best trim."""
    g = tables.read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("_mean"))
    name = F.element_at(F.array(*map(F.lit, boats.PRESETS)), (F.pmod(F.crc32("c_mktsegment"), F.lit(4)) + 1).cast("int"))
    p = g.select(c("c_mktsegment"), name.alias("boat"), "_mean").join(boats.presets(spark), "boat").withColumn("mass", c("mass") * (F.lit(1.0) + c("_mean") / 100000.0)).drop("boat", "_mean").withColumnRenamed("c_mktsegment", "boat")
    p = p.withColumn("tws", F.explode(F.array(*map(F.lit, TWS)))).withColumn("twa", F.explode(F.array(*map(F.lit, TWA))))
    p = p.repartition(spark.sparkContext.defaultParallelism, "boat", "tws", "twa")
    return solver.speed_table(p.drop("name"), ["boat"])


@query()
def I34_I36_point_solve(spark: SparkSession, sf: str) -> DataFrame:
    """The best trim of a preset boat in the wind of every passage leg's sector: one point for each user and event type."""
    e = tables.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.min("event_id").alias("e"))
    name = F.element_at(F.array(*map(F.lit, boats.PRESETS)), (c("user_id") % 4 + 1).cast("int"))
    p = e.select("user_id", "event_type", name.alias("boat"), (c("v") % 20.0 + 4.0).alias("tws"), (c("e") * 13 % 151 + 30).cast("double").alias("twa")).join(F.broadcast(boats.presets(spark).drop("name")), "boat")  # four rows
    return solver.speed_table(p, ["user_id", "event_type", "boat"])


def _targets_sql(up: tuple, down: tuple, fast: float, fall_up: str, fall_down: str) -> str:
    def one(name: str, low: float, high: float, sign: int) -> str:
        return f"""{name} as (select s_suppkey, tws, arg_max({{'a': twa, 's': speed}}, {{'v': round({sign} * speed * cos(radians(twa)) * 1e9) / 1e9, 'a': -twa}}) as b from fleet where twa between {low} and {high} and speed > {fast} and {sign} * speed * cos(radians(twa)) > 1e-9 group by all)"""

    return f"""with {d.fleet_polars()}, {one("u", *up, 1)}, {one("w", *down, -1)}, t as (select distinct s_suppkey, tws from fleet)
select t.s_suppkey, t.tws, coalesce(u.b.a, {fall_up.split(",")[0]}) as up_twa, {d.r6(f"coalesce(u.b.s, {fall_up.split(',')[1]})")} as up_kts, coalesce(w.b.a, {fall_down.split(",")[0]}) as down_twa, {d.r6(f"coalesce(w.b.s, {fall_down.split(',')[1]})")} as down_kts from t left join u using (s_suppkey, tws) left join w using (s_suppkey, tws)"""


@query(_targets_sql((30.0, 70.0), (120.0, 180.0), 0.0, "45e0,5e0", "150e0,6e0"))
def H31_vmg_targets(spark: SparkSession, sf: str) -> DataFrame:
    t = polars.vmg_targets(tables.fleet_polars(spark, sf), keys=["s_suppkey"])
    return t.select("s_suppkey", "tws", "up_twa", r6(c("up_kts")).alias("up_kts"), "down_twa", r6(c("down_kts")).alias("down_kts"))


@query(_targets_sql((28.0, 75.0), (110.0, 180.0), 0.05, "40e0,0e0", "140e0,0e0"))
def H32_vmg_targets_of_files(spark: SparkSession, sf: str) -> DataFrame:
    t = polars.vmg_targets(tables.fleet_polars(spark, sf), polars.FILE_RULES, ["s_suppkey"])
    return t.select("s_suppkey", "tws", "up_twa", r6(c("up_kts")).alias("up_kts"), "down_twa", r6(c("down_kts")).alias("down_kts"))


@query(f"""with {d.OBS}, {d.polar()}, px as (select tws as s0, lead(tws) over (order by tws) as s1 from (select distinct tws from polar)), py as (select twa as a0, lead(twa) over (order by twa) as a1 from (select distinct twa from polar)),
q as (select event_id, tws as w, greatest(abs(twd % 180), 30e0) as a from obs),
j as (select q.*, s0, s1, a0, a1 from q join px on s1 is not null and (w >= s0 or s0 = 6) and (w < s1 or s1 = 25) join py on a1 is not null and a >= a0 and (a < a1 or a1 = 180)),
v as (select j.*, (w - s0) / (s1 - s0) as f, (a - a0) / (a1 - a0) as g, p00.speed as c00, p01.speed as c01, p10.speed as c10, p11.speed as c11 from j join polar p00 on p00.tws = s0 and p00.twa = a0 join polar p01 on p01.tws = s0 and p01.twa = a1 join polar p10 on p10.tws = s1 and p10.twa = a0 join polar p11 on p11.tws = s1 and p11.twa = a1)
select event_id, {d.r6("(c00 * (1 - g) + c01 * g) * (1 - f) + (c10 * (1 - g) + c11 * g) * f")} as speed from v""")
def H30_polar_extrapolated(spark: SparkSession, sf: str) -> DataFrame:
    from galeframe.functions import sailing

    return tables.obs(spark, sf).select("event_id", r6(sailing.polar_speed_extrapolated(c("tws"), F.abs(c("twd") % 180))).alias("speed"))


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    return tables.fleet_polars(spark, sf).withColumn("converged", (c("tws") + c("twa") + c("s_suppkey")).cast("int") % 5 != 0)


def _filled(src: str, key: str, x: str, done: str) -> str:
    """Unconverged cells of ``src`` between two anchors of a line take the straight line."""
    near = lambda f, rows: f"{f}_value(anchor ignore nulls) over (partition by s_suppkey, {key} order by {x} rows between {rows})"
    fill = f"not converged and a is not null and b is not null and n >= 2 and not {done}"
    return f"""(select s_suppkey, tws, twa, converged, {done} or ({fill}) as done, case when {fill} then a.y + (b.y - a.y) * ({x} - a.x) / (b.x - a.x) else speed end as speed
 from (select *, {near("last", "unbounded preceding and 1 preceding")} as a, {near("first", "1 following and unbounded following")} as b, count(anchor) over (partition by s_suppkey, {key}) as n
 from (select *, case when converged and speed > 0 then {{'x': {x}, 'y': speed}} end as anchor from {src})))"""


@query(f"""with {d.fleet_polars()}, m as (select *, cast(tws + twa + s_suppkey as integer) % 5 <> 0 as converged, false as done from fleet), f as {_filled("m", "tws", "twa", "done")}, g as {_filled("f", "twa", "tws", "done")} select s_suppkey, tws, twa, {d.r6("speed")} as speed, converged from g""")
def E10_repair_polar(spark: SparkSession, sf: str) -> DataFrame:
    """Unconverged cells filled along the angle, then along the wind speed; compared with plain Python in the tests."""
    return polars.repair(_masked(spark, sf), ["s_suppkey"]).select("s_suppkey", "tws", "twa", r6(c("speed")).alias("speed"), "converged")


@query(f"""with {d.fleet_polars()} select s_suppkey, twa, string_agg(case when tws is not null then printf('%.2f', round(speed * 100) / 100) end, chr(9) order by tws) as line from fleet group by s_suppkey, twa""")
def A43_polar_lines(spark: SparkSession, sf: str) -> DataFrame:
    return polars.matrix_lines(tables.fleet_polars(spark, sf), ["s_suppkey"])


@query(f"""with {d.fleet_polars()} select s_suppkey, tws, twa, round(speed * 100) / 100 as speed from fleet""")
def A42_polar_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier's polar written as text, of two decimals, and parsed again."""
    return polars.parse(polars.document(tables.fleet_polars(spark, sf), ["s_suppkey"]), "s_suppkey", "text").select("s_suppkey", "tws", "twa", "speed")


_SHORT = "'tws_kts,twa_deg,v_boat_kts,vmg_kts,heel_deg,leeway_deg,sail_set_name,flat,reef'"


@query(f"""with {d.fleet_polars()} select s_suppkey, tws, twa, {d.r6("speed")} as speed, {d.r6("speed * cos(radians(twa))")} as vmg_kts, {_SHORT} as header,
printf('%.1f', tws) || ',' || printf('%.1f', twa) || ',' || printf('%.3f', round(speed * 1e3) / 1e3) || ',' || printf('%.3f', round(speed * cos(radians(twa)) * 1e3) / 1e3 + 0e0) || ',0.00,0.00,Main+Jib,1.00,1.00' as line from fleet""")
def A44_polar_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table of speeds as lines of the short layout."""
    p = tables.fleet_polars(spark, sf).withColumn("vmg", c("speed") * F.cos(F.radians("twa")))
    line = polars.short_line(c("tws"), c("twa"), round_to(c("speed"), 3), round_to(c("vmg"), 3) + 0.0)
    return p.select("s_suppkey", "tws", "twa", r6(c("speed")).alias("speed"), r6(c("vmg")).alias("vmg_kts"), F.lit(polars.SHORT_HEADER).alias("header"), line.alias("line"))


@query()
def A44_solved_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The solved points of each user and event type as lines of the long layout, with its header."""
    p = I34_I36_point_solve(spark, sf)
    return p.select("user_id", "event_type", F.lit(polars.LONG_HEADER).alias("header"), polars.long_line().alias("line"))


_TARGETS = _targets_sql((30.0, 70.0), (120.0, 180.0), 0.0, "45e0,5e0", "150e0,6e0")


@query(f"""with {d.fleet_polars()}, r as (select s_suppkey, tws, list({{'twa': twa, 'speed': {d.r6("speed")}}} order by twa) as cells from fleet group by all), t as (from ({_TARGETS}))
select s_suppkey, to_json({{'tws_list': list(tws order by tws), 'rows': list(cells order by tws), 'targets': map_from_entries(list({{'k': tws::varchar, 'v': {{'up_twa': up_twa, 'up_kts': up_kts, 'down_twa': down_twa, 'down_kts': down_kts}}}} order by tws))}})::varchar as json from r join t using (s_suppkey, tws) group by s_suppkey""")
def A45_polar_json(spark: SparkSession, sf: str) -> DataFrame:
    return polars.as_json(tables.fleet_polars(spark, sf).withColumn("speed", r6(c("speed"))), keys=["s_suppkey"])


@query(f"""with {_fleet_sql()}, k as (select boats.*, range as k, range * 0.6e0 as v, radians(range * 3) as heel, 0e0 as leeway, mass * 0.3e0 as side from boats, range(1, 9)), {_hydro_ctes("k")},
l as (select boat, boat || '|' || k || '|' || printf('%.3f', round((r_viscous + r_residuary + r_induced + r_heel) * 1e3) / 1e3) || '|' || printf('%.3f', round(righting * 1e3) / 1e3) as line from h2)
select boat, substring(sha256(string_agg(line, '|' order by line)), 1, 12) as version from l group by boat""")
def D25_model_version(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve digits for each supplier's boat that change with the physics, from eight fixed states."""
    return solver_version(tables.fleet(spark, sf))


@query()
def D25_model_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier with the digits of the preset that its boat comes from; compared with a plain loop over the same formulas in the tests."""
    presets = solver_version(boats.presets(spark)).withColumnRenamed("boat", "preset")
    return tables.fleet(spark, sf).select(c("boat").alias("s_suppkey"), "preset").join(presets, "preset")


def solver_version(given: DataFrame) -> DataFrame:
    """(boat, version): a fingerprint of resistances and moments at eight fixed states of each boat."""
    k = given.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    h = forces.hydro(M, _fields(), c("k") * 0.6, F.radians(c("k") * 3), c("mass") * 0.3)
    line = F.format_string("%s|%d|%.3f|%.3f", c("boat").cast("string"), "k", round_to(h["r_total"], 3), round_to(h["righting"], 3))
    return k.select("boat", line.alias("line")).groupBy("boat").agg(F.substring(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list("line"))), 256), 1, 12).alias("version"))


@query(f"""with {_fleet_sql()}, k as (select boats.*, range as k, radians(range * 3) as heel from boats, range(0, 21))
select boat, k, {d.r6("mass * 9.80665e0 * 0.6e0 * sin(2 * heel) + crew_mass * crew_fraction * 9.80665e0 * crew_distance * cos(heel) * tanh(heel / radians(12))")} as righting from k""")
def K03_own_righting_arm(spark: SparkSession, sf: str) -> DataFrame:
    """Righting moments with a user's curve in place of the hull's."""
    k = tables.fleet(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    own = forces.righting_moment(M, _fields(), F.radians(c("k") * 3), lambda m, heel: 0.6 * m.sin(2.0 * heel))
    return k.select("boat", "k", r6(own).alias("righting"))


@query("""with g as (select s_suppkey as id, [6e0, 10e0] as tws_list, [40e0, 90e0, 140e0] as twa_list, s_suppkey % 5 * 0.1e0 as x from supplier),
t as (select id, tws_list[i] as tws, twa_list[j] as twa, 3e0 + i + j * 0.5e0 + x as speed from g, range(1, 3) a(i), range(1, 4) b(j)),
v as (select *, round(speed * cos(radians(twa)) * 1e9) / 1e9 as vmg from t)
select id, tws, max(speed) as fastest, arg_max(twa, vmg) filter (twa between 30 and 70) as up_twa, arg_min(twa, vmg) filter (twa between 120 and 180) as down_twa from v group by id, tws""")
def I38_given_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of speeds as a request gives them, with their targets."""
    s = tables.read(spark, sf, "supplier")
    speed = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda j: F.lit(3.0) + i + j * 0.5 + c("s_suppkey") % 5 * 0.1))
    num = lambda *v: F.array(*map(F.lit, v))
    t = polars.from_matrix(s.select(c("s_suppkey").alias("id"), num(6.0, 10.0).alias("tws_list"), num(40.0, 90.0, 140.0).alias("twa_list"), speed.alias("speeds")), ["id"])
    best = polars.vmg_targets(t, keys=["id"]).select("id", "tws", "up_twa", "down_twa")
    return t.groupBy("id", "tws").agg(F.max("speed").alias("fastest")).join(best, ["id", "tws"])


def asked_points(spark: SparkSession, sf: str) -> DataFrame:
    """A point for each supplier: a preset, a wind speed and an angle, with the version of the model."""
    k = c("s_suppkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    s = tables.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", at(boats.PRESETS, 4).alias("boat"), at(TWS, 8).alias("tws"), at(TWA, 18).alias("twa"))
    return s.join(boats.presets(spark).drop("name"), "boat").join(solver_version(boats.presets(spark)).withColumnRenamed("version", "model"), "boat")


@query()
def I38_cached_presets(spark: SparkSession, sf: str) -> DataFrame:
    """Points of preset polars, asked for by the suppliers of some nations and then by all: the second time only those that nobody asked for are solved."""
    store = cache.SolvedPoints(spark, f"{shared_folder(spark)}/polars-{uuid.uuid4().hex}")
    p = asked_points(spark, sf)
    store.solve(p.where("s_nationkey < 12"))
    return store.solve(p).select("s_suppkey", "boat", "tws", "twa", "v_boat_kts", "heel_deg", "sail_set_name", "converged", "cached")
