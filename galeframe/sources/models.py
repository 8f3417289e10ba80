"""Forecast models as a table, and the fetch tasks of their cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("wind_u_10m", "wind_v_10m", "wind_gust", "pressure_msl", "temp_2m", "precip_accum")

# Fixed values: (model, hours between cycles, minutes until one is out, spans of steps (first, last, every), first and last member, bundled in one file).
MODELS = (
    ("gfs_0p25", 6, 210, ((0, 240, 3),), 0, 0, False),
    ("ifs_0p25", 12, 420, ((0, 144, 3), (150, 240, 6)), 0, 0, False),
    ("icon_global", 12, 270, ((0, 78, 3), (84, 120, 3)), 0, 0, False),
    ("gefs_0p50", 6, 330, ((0, 72, 3), (78, 240, 6)), 0, 30, False),
    ("ifs_ens_0p25", 12, 480, ((0, 144, 3), (150, 240, 6)), 1, 50, False),
    ("icon_eps_global", 12, 330, ((0, 120, 6),), 1, 40, True),
)


def models(spark: SparkSession) -> DataFrame:
    """(model, cycle_hours, lag_minutes, steps, members): members holds -1 alone where one file bundles all."""
    rows = [(m, c, lag, [s for a, b, e in spans for s in range(a, b + 1, e)], [-1] if bundled else list(range(lo, hi + 1))) for m, c, lag, spans, lo, hi, bundled in MODELS]
    return spark.createDataFrame(rows, "model string, cycle_hours int, lag_minutes int, steps array<int>, members array<int>")


def latest_cycles(now: DataFrame, at: str) -> DataFrame:
    """For each row and model the newest cycle that is out at time ``at``."""
    out = F.col(at).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("lag_minutes"))
    floor = F.date_trunc("day", out).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour(out) / F.col("cycle_hours")) * F.col("cycle_hours")).cast("int"))
    return now.join(F.broadcast(models(now.sparkSession))).withColumn("cycle", floor)  # six rows


def uploaded_cycles(now: DataFrame, at: str, listing: DataFrame, last_step: int = 240, every: int = 6, lag_minutes: int = 210, tries: int = 4) -> DataFrame:
    """``now`` with ``cycle``, the newest of the last ``tries`` whose last step is in the ``listing`` (cycle, step), and ``found``; where none is, the one that should be out.

    Each newest cycle, one in ``every`` hours, has ``tries`` candidates, which
    meet the listing by cycle in one equi-join, and rows join it by cycle.
    """
    there = listing.where(F.col("step") == last_step).select(F.col("cycle").cast("timestamp_ntz").alias("_try")).distinct()
    out = F.col(at).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lag_minutes))
    newest = F.date_trunc("day", out).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour(out) / every) * every).cast("int"))
    q = now.withColumn("_newest", newest)
    each = q.select("_newest").distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("_try", F.col("_newest") - F.make_dt_interval(F.lit(0), F.col("_k") * every))
    best = each.join(there, "_try").groupBy("_newest").agg(F.max("_try").alias("_best"))
    q = q.join(best, "_newest", "left")
    return q.withColumns({"cycle": F.coalesce("_best", "_newest"), "found": F.col("_best").isNotNull()}).drop("_newest", "_best")


#: Fixed values of the public code tables: (discipline 0's category, number) of the variables.
CODES = {(2, 2): "wind_u_10m", (2, 3): "wind_v_10m", (2, 22): "wind_gust_10m", (3, 1): "mslp", (3, 0): "mslp", (0, 0): "temp_2m", (1, 8): "precip_accum"}


def variable(category: Column, number: Column) -> Column:
    """The variable of a message by its category and number; null for others."""
    out = F.lit(None).cast("string")
    for (a, b), name in CODES.items():
        out = F.when((category == a) & (number == b), F.lit(name)).otherwise(out)
    return out


def tasks(cycles: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """A row for each step, variable and member of (model, cycle, steps, members, ...).

    ``zero``: accumulated rain at the analysis is zero and isn't fetched. Gusts
    of the icosahedral model at the analysis aren't listed.
    """
    t = cycles.withColumn("step", F.explode("steps")).withColumn("variable", F.explode(F.array(*map(F.lit, variables)))).withColumn("member", F.explode("members"))
    t = t.where(~((F.col("model") == "icon_global") & (F.col("variable") == "wind_gust") & (F.col("step") == 0)))
    return t.withColumn("zero", (F.col("step") == 0) & (F.col("variable") == "precip_accum")).drop("steps", "members")


# How providers call the variables. Index patterns of the GFS family, names of the ECMWF family, folder and file part of ICON and of its ensemble.
NAMES = {
    "wind_u_10m": (":UGRD:10 m above ground:", "10u", "u_10m", "U_10M", "u_10m"),
    "wind_v_10m": (":VGRD:10 m above ground:", "10v", "v_10m", "V_10M", "v_10m"),
    "wind_gust_10m": (":GUST:surface:", "10fg", "vmax_10m", "VMAX_10M", "vmax_10m"),
    "mslp": (":PRMSL:mean sea level:", "msl", "pmsl", "PMSL", "ps"),
    "temp_2m": (":TMP:2 m above ground:", "2t", "t_2m", "T_2M", "t_2m"),
    "precip_accum": (":APCP:surface:", "tp", "tot_prec", "TOT_PREC", "tot_prec"),
    "wave_height_sig": (":HTSGW:surface:", "swh", None, None, None),
}
# Where files lie below a provider's address, and the ending of their index; {day}, {hour}, {step}, {step3}, {member}, {set} and the variable's {folder}, {part}.
FILES = {
    "gfs_0p25": ("gfs.{day}/{hour}/atmos/gfs.t{hour}z.pgrb2.0p25.f{step3}", ".idx", 0),
    "gefs_0p50": ("gefs.{day}/{hour}/atmos/pgrb2{set}p5/{member}.t{hour}z.pgrb2{set}.0p50.f{step3}", ".idx", 0),
    "ifs_0p25": ("{day}/{hour}z/ifs/0p25/oper/{day}{hour}0000-{step}h-oper-fc.grib2", ".index", 1),
    "ifs_ens_0p25": ("{day}/{hour}z/ifs/0p25/enfo/{day}{hour}0000-{step}h-enfo-ef.grib2", ".index", 1),
    "icon_global": ("{hour}/{folder}/icon_global_icosahedral_single-level_{day}{hour}_{step3}_{part}.grib2.bz2", None, 3),
    "icon_eps_global": ("{hour}/{folder}/icon-eps_global_icosahedral_single-level_{day}{hour}_{step3}_{part}.grib2.bz2", None, 4),
}


def named(tasks: DataFrame) -> DataFrame:
    """Adds to tasks (model, cycle, step, variable, member) the file below the provider's address, its index, and what the index calls the variable; null where the provider hasn't it.

    The ensemble's control is gec00, the others gep01 and so on; gusts lie in
    the second file set.
    """
    spark = tasks.sparkSession
    rows = [(m, v, path, end, n[at] if at < 3 else None, n[2 if at == 3 else 4], n[at]) for m, (path, end, at) in FILES.items() for v, n in NAMES.items() if n[at] is not None]
    known = spark.createDataFrame(rows, "model string, variable string, _path string, _end string, index_name string, _folder string, _part string")
    t = tasks.join(F.broadcast(known), ["model", "variable"], "left")  # a row for each model and variable
    member = F.when(F.col("member") == 0, F.lit("gec00")).otherwise(F.format_string("gep%02d", F.col("member")))
    parts = {
        "day": F.date_format("cycle", "yyyyMMdd"), "hour": F.date_format("cycle", "HH"), "step3": F.format_string("%03d", F.col("step")), "step": F.col("step").cast("string"), "member": member,
        "set": F.when(F.col("variable") == "wind_gust_10m", F.lit("b")).otherwise(F.lit("a")), "folder": F.coalesce("_folder", F.lit("")), "part": F.coalesce("_part", F.lit("")),
    }
    path = F.col("_path")
    for k, v in parts.items():
        path = F.replace(path, F.lit("{" + k + "}"), v)
    t = t.withColumn("path", path)
    return t.withColumn("index_path", F.concat("path", "_end")).drop("_path", "_end", "_folder", "_part")


# What is stored of an ensemble's variable, and of its wind.
STATISTICS = ("mean", "std", "p10", "p50", "p90")
EXCEEDANCES = ("prob_wind_ge_25kt", "prob_wind_ge_34kt")


def array_plan(stores: DataFrame) -> DataFrame:
    """(store, array_name, source, members) of stores (store, variables, ensemble, wind, keep_members).

    A deterministic variable is one array; an ensemble's are its statistics,
    and its own name serves the mean, or with ``keep_members`` all members by
    a dimension more. ``wind``: both components are there, so that the
    statistics of speed are stored too.
    """
    each = stores.select("*", F.explode("variables").alias("v"))
    plain = each.where("not ensemble").select("store", F.col("v").alias("array_name"), F.col("v").alias("source"), F.lit(False).alias("members"))
    stat = F.explode(F.array(*map(F.lit, STATISTICS))).alias("s")
    stats = each.where("ensemble").select("store", "v", stat).select("store", F.concat_ws("_", "v", "s").alias("array_name"), F.concat_ws("_", "v", "s").alias("source"), F.lit(False).alias("members"))
    mean = each.where("ensemble").select("store", F.col("v").alias("array_name"), F.concat("v", F.lit("_mean")).alias("source"), F.col("keep_members").alias("members"))
    speeds = F.explode(F.array(*[F.lit(f"wind_speed_{s}") for s in STATISTICS], *map(F.lit, EXCEEDANCES))).alias("array_name")
    speed = stores.where("ensemble and wind").select("store", speeds).select("store", "array_name", F.col("array_name").alias("source"), F.lit(False).alias("members"))
    return plain.unionByName(stats).unionByName(mean).unionByName(speed)
