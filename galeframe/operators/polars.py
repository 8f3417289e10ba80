"""Speed tables: targets, repair of cells without a solution, text and JSON forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.units import round_to


@dataclass(frozen=True)
class TargetRules:
    """Angles searched upwind and downwind, the least speed, and (angle, speed) where nothing is found."""

    up: tuple[float, float] = (30.0, 70.0)
    down: tuple[float, float] = (120.0, 180.0)
    faster_than: float = 0.0
    no_up: tuple[float, float] = (45.0, 5.0)
    no_down: tuple[float, float] = (150.0, 6.0)


SOLVER_RULES = TargetRules()
FILE_RULES = TargetRules((28.0, 75.0), (110.0, 180.0), 0.05, (40.0, 0.0), (140.0, 0.0))


def vmg_targets(polar: DataFrame, rules: TargetRules = SOLVER_RULES, keys: list[str] | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """Best speed made good up and down the wind for each wind speed, as one aggregation, and ``more`` aggregates beside; the smaller angle wins a tie."""
    keys = keys or []
    made = round_to(F.col("speed") * F.cos(F.radians("twa")), 9)

    def best(span: tuple[float, float], sign: int, none: tuple[float, float], name: str) -> list[Column]:
        vmg = made * sign
        found = F.max_by(F.struct("twa", "speed"), F.when(F.col("twa").between(*span) & (F.col("speed") > rules.faster_than) & (vmg > 1e-9), F.struct(vmg.alias("v"), (-F.col("twa")).alias("a"))))
        return [F.coalesce(found["twa"], F.lit(none[0])).alias(f"{name}_twa"), F.coalesce(found["speed"], F.lit(none[1])).alias(f"{name}_kts")]

    return polar.groupBy(*keys, "tws").agg(*best(rules.up, 1, rules.no_up, "up"), *best(rules.down, -1, rules.no_down, "down"), *more)


def _lines(df: DataFrame, keys: list[str], x: str, least: int) -> DataFrame:
    """Unconverged cells between two converged, positive ones of a line take the straight line; lines with fewer than ``least`` anchors don't."""
    good = F.col("converged") & (F.col("speed") > 0)
    w = Window.partitionBy(*keys)
    before, after = w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1), w.orderBy(x).rowsBetween(1, Window.unboundedFollowing)
    at = F.when(good, F.struct(F.col(x).alias("x"), F.col("speed").alias("y")))
    df = df.withColumns({"_a": F.last(at, ignorenulls=True).over(before), "_b": F.first(at, ignorenulls=True).over(after), "_n": F.count_if(good).over(w)})
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    fill = ~F.col("converged") & F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_n") >= least) & ~F.col("_done")
    return df.withColumns({"_new": F.when(fill, line).otherwise(F.col("speed")), "_did": F.col("_done") | fill}).drop("_a", "_b", "_n", "speed", "_done").withColumnsRenamed({"_new": "speed", "_did": "_done"})


def repair(polar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fills unconverged cells (tws, twa, speed, converged) along the angle, then what is left along the wind speed. Edges stay."""
    keys = keys or []
    once = _lines(polar.withColumn("_done", F.lit(False)), [*keys, "tws"], "twa", 2)
    return _lines(once, [*keys, "twa"], "tws", 2).drop("_done")


def matrix_lines(polar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, twa, line): the speeds of an angle at all wind speeds, two decimals, tabs between."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("tws", "speed"))), lambda s: F.format_string("%.2f", round_to(s["speed"], 2)))
    return polar.groupBy(*(keys or []), "twa").agg(F.array_join(cells, "\t").alias("line"))


def document(polar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, text): each table as text, a row for each angle under a head of wind speeds. A table has a few hundred cells."""
    polar, by = (polar, keys) if keys else (polar.withColumn("_one", F.lit(1)), ["_one"])
    head = polar.groupBy(*by).agg(F.concat(F.lit("TWA\\TWS\t"), F.array_join(F.transform(F.sort_array(F.collect_set("tws")), lambda x: F.format_string("%.1f", x)), "\t")).alias("head"))
    lines = F.struct("twa", F.concat(F.format_string("%.1f", "twa"), F.lit("\t"), "line").alias("l"))
    body = matrix_lines(polar, by).groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(lines)), lambda s: s["l"]), "\n").alias("body"))
    return head.join(body, by).select(*(keys or []), F.concat("head", F.lit("\n"), "body").alias("text"))


COMMENTS = r"^\s*(#|!|//|;)"


def parse(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tws, twa, speed) of speed-table texts.

    Comment and blank lines are skipped. Cells are parted by the first of tab,
    semicolon, comma that the head line has, else by blanks. The head's cells
    are wind speeds, after a corner label if its first cell isn't a number or it
    has as many cells as the rows. Empty or unreadable cells are 0; rows
    without a readable angle are left out. Null texts have no rows.
    """
    lines = files.select(id_col, F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("_n", "_line"))
    lines = lines.where((F.trim("_line") != "") & ~F.col("_line").rlike(COMMENTS))
    first = lines.groupBy(id_col).agg(F.min_by("_line", "_n").alias("_head"), F.min("_n").alias("_at"))
    first = first.withColumn("_sep", F.when(F.instr("_head", "\t") > 0, F.lit("\t")).when(F.instr("_head", ";") > 0, F.lit(";")).when(F.instr("_head", ",") > 0, F.lit(",")).otherwise(F.lit(r"\s+")))
    cells = lambda x: F.transform(F.split(F.when(F.col("_sep") == r"\s+", F.trim(x)).otherwise(x), F.col("_sep")), lambda v: F.trim(v))
    number = lambda v: v.try_cast("double")
    rows = lines.join(first, id_col).where(F.col("_n") > F.col("_at")).select(id_col, cells(F.col("_line")).alias("_row"), cells(F.col("_head")).alias("_top"))
    label = number(F.get("_top", F.lit(0))).isNull() | (F.size("_top") == F.size("_row"))
    rows = rows.withColumn("_speeds", F.when(label, F.slice("_top", 2, F.size("_top"))).otherwise(F.col("_top"))).withColumn("twa", number(F.get("_row", F.lit(0)))).where("twa is not null")
    out = rows.select(id_col, "twa", "_row", F.posexplode("_speeds").alias("_k", "_tws")).withColumn("tws", number(F.col("_tws"))).where("tws is not null")
    return out.select(id_col, "tws", "twa", F.coalesce(number(F.get("_row", F.col("_k") + 1)), F.lit(0.0)).alias("speed"))


def as_json(polar: DataFrame, rules: TargetRules = SOLVER_RULES, keys: list[str] | None = None) -> DataFrame:
    """(keys, json): each table and its targets, keyed by wind speed, as JSON."""
    polar, by = (polar, keys) if keys else (polar.withColumn("_one", F.lit(1)), ["_one"])
    cells = F.sort_array(F.collect_list(F.struct("twa", "speed"))).alias("cells")
    row = F.struct("tws", "cells", F.struct("up_twa", "up_kts", "down_twa", "down_kts").alias("targets"))
    each = vmg_targets(polar, rules, by, (cells,)).groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("e"))
    entries = F.transform("e", lambda s: F.struct(s["tws"].cast("string").alias("k"), s["targets"].alias("v")))
    whole = F.struct(F.transform("e", lambda s: s["tws"]).alias("tws_list"), F.transform("e", lambda s: s["cells"]).alias("rows"), F.map_from_entries(entries).alias("targets"))
    return each.select(*(keys or []), F.to_json(whole).alias("json"))


# The columns of the two layouts, and the digits of those of the long one that are numbers.
LONG = (
    ("tws_kts", "tws", 1), ("twa_deg", "twa", 1), ("v_boat_kts", "v_boat_kts", 3), ("vmg_kts", "vmg_kts", 3), ("heel_deg", "heel_deg", 2), ("leeway_deg", "leeway_deg", 2), ("sail_set_name", "sail_set_name", None),
    ("flat", "flat", 2), ("reef", "reef", 2), ("aws_kts", "aws_kts", 2), ("awa_deg", "awa_deg", 2), ("f_x_n", "f_x_n", 1), ("r_total_n", "r_total_n", 1), ("r_viscous_n", "r_viscous_n", 1), ("r_residuary_n", "r_residuary_n", 1),
    ("r_induced_n", "r_induced_n", 1), ("r_heel_n", "r_heel_n", 1), ("heeling_moment_nm", "heeling_moment_nm", 1), ("righting_moment_nm", "righting_moment_nm", 1), ("converged", "converged", None),
)
LONG_HEADER = ",".join(n for n, _, _ in LONG)
SHORT_HEADER = ",".join(n for n, _, _ in LONG[:9])


def long_line() -> Column:
    """A solved point as a line of 20 fields."""
    return F.concat_ws(",", *[F.initcap(F.col(c).cast("string")) if c == "converged" else F.col(c) if digits is None else F.format_string(f"%.{digits}f", c) for _, c, digits in LONG])


def short_line(tws: Column, twa: Column, speed: Column, vmg: Column) -> Column:
    """A cell of a table of speeds as a line of 9 fields; the trim isn't known."""
    return F.concat_ws(",", F.format_string("%.1f", tws), F.format_string("%.1f", twa), F.format_string("%.3f", speed), F.format_string("%.3f", vmg), F.lit("0.00,0.00,Main+Jib,1.00,1.00"))


def from_matrix(given: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tws, twa, speed) of tables given as tws_list, twa_list and rows of speeds; what such a table has isn't solved."""
    rows = given.select(*keys, "tws_list", "twa_list", F.posexplode("speeds").alias("_i", "_row")).select(*keys, F.get("tws_list", F.col("_i")).alias("tws"), "twa_list", F.posexplode("_row").alias("_j", "speed"))
    return rows.select(*keys, "tws", F.get("twa_list", F.col("_j")).alias("twa"), "speed")
