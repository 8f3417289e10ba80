"""Equilibrium of speed, heel and leeway: rows of trims are solved in Arrow batches; Spark expands, deals and picks them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.common import durable
from galeframe.physics.boats import FIELDS
from galeframe.physics.forces import Arrays, G, aero, hydro

KTS = 1852.0 / 3600.0
NO_GO, SPINNAKER_FROM, MOST_HEEL = 28.0, 45.0, np.deg2rad(28.0)
LOW, HIGH = np.array([0.05, 0.0, np.deg2rad(-5.0)]), np.array([20.0, np.deg2rad(60.0), np.deg2rad(20.0)])
FLATS, REEFS = (1.0, 0.85, 0.70, 0.55, 0.40), (1.0, 0.90, 0.80, 0.70, 0.60)
HELD = 1 << 15
OUT = ("v", "heel", "leeway", "aws", "awa", "f_x", "r_total", "r_viscous", "r_residuary", "r_induced", "r_heel", "m_x", "righting")


def state(b: dict, row: dict, x: np.ndarray) -> dict:
    v, heel, leeway = np.maximum(x[:, 0], 0.05), x[:, 1], x[:, 2]
    a = aero(Arrays, b, row["tws"] * KTS, np.deg2rad(row["twa"]), v, heel, leeway, row["flat"], row["reef"], row["down"])
    h = hydro(Arrays, b, v, heel, a["f_y"])
    return a | h | {"v": x[:, 0], "heel": heel, "leeway": leeway, "wanted": h["leeway"]}


def residuals(b: dict, row: dict, x: np.ndarray) -> np.ndarray:
    """Surge, sway and roll. The units they are accepted in, 2 % of the weight (at least 100 N), 2 degrees, and that force at half the beam (at least 1 m)."""
    s = state(b, row, x)
    force = np.maximum(0.02 * G * b["mass"], 100.0)
    moment = force * np.maximum(0.5 * b["b_max"], 1.0)
    return np.stack([(s["f_x"] - s["r_total"]) / force, (x[:, 2] - s["wanted"]) / np.deg2rad(2.0), (s["m_x"] - s["righting"]) / moment], 1)


def start(row: dict) -> np.ndarray:
    """Half the wind's speed, upright, without leeway; a root doesn't depend on it."""
    v = row["tws"] * KTS / 2
    return np.stack([v, np.zeros_like(v), np.zeros_like(v)], 1)


def solve(b: dict, row: dict, steps: int = 200, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(states, norms of what is left) by bounded Levenberg-Marquardt, up to ``width`` rows at once.

    A row's damping rises where a step doesn't help and falls where it does;
    rows whose steps or gains become tiny are left alone, and others take
    their place, so that work arrays are no longer than ``width``.
    """
    x = np.clip(start(row), LOW, HIGH)
    r, damp, taken = np.empty_like(x), np.full(len(x), 1e-2), np.zeros(len(x), int)
    pick = lambda d, i: {k: v[i] for k, v in d.items()}
    busy, after = np.arange(0), 0
    while True:
        if after < len(x) and len(busy) <= width // 2:
            more = np.arange(after, min(len(x), after + width - len(busy)))
            r[more] = residuals(pick(b, more), pick(row, more), x[more])
            busy, after = np.concatenate([busy, more]), after + len(more)
        if not len(busy):
            break
        bb, rr, xx, fx = pick(b, busy), pick(row, busy), x[busy], r[busy]
        jac = np.empty((len(busy), 3, 3))
        for k, h in enumerate((1e-5, 1e-6, 1e-6)):
            to = xx.copy()
            h = np.where(to[:, k] + h > HIGH[k], -h, h)
            to[:, k] += h
            jac[:, :, k] = (residuals(bb, rr, to) - fx) / h[:, None]
        a, g = np.einsum("nik,nil->nkl", jac, jac), np.einsum("nik,ni->nk", jac, fx)
        # a coordinate held at its bound with the gradient pushing outwards stays there
        held = ((xx <= LOW) & (g > 0)) | ((xx >= HIGH) & (g < 0))
        free = ~held
        a = a * free[:, :, None] * free[:, None, :]
        diag = np.einsum("nkk->nk", a)
        a = a + (damp[busy][:, None] * np.maximum(diag, 1e-12))[:, :, None] * np.eye(3) + held[:, :, None] * np.eye(3)
        move = np.linalg.solve(a, -(g * free)[:, :, None])[:, :, 0]
        to = np.clip(xx + move, LOW, HIGH)
        new = residuals(bb, rr, to)
        was, now = (fx * fx).sum(1), (new * new).sum(1)
        better = now < was
        x[busy[better]], r[busy[better]] = to[better], new[better]
        damp[busy] = np.clip(np.where(better, damp[busy] * 0.3, damp[busy] * 4.0), 1e-12, 1e12)
        small = np.abs(to - xx).max(1) < 1e-8
        done = (better & ((was - now < 1e-12 * was) | (now < 1e-20))) | small | (damp[busy] >= 1e12)
        taken[busy] += 1
        busy = busy[~done & (taken[busy] < steps)]
    return x, np.sqrt((r * r).sum(1))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, none of them empty: a search ends with few rows at work, however many began."""
    parts, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            parts.append(batch.slice(at, rows))
            n += parts[-1].num_rows
            if n >= rows:
                yield pa.concat_batches(parts)
                parts, n = [], 0
    if parts:
        yield pa.concat_batches(parts)


def solved(trims: DataFrame) -> DataFrame:
    """Solves every row: a boat's fields, tws (knots), twa (degrees), flat, reef, down; adds OUT and converged.

    A root doesn't depend on where the search starts, so rows are solved apart
    and no row waits for its neighbour's answer. Angles are in radians,
    speeds in metres a second. A task takes up to HELD rows at a time.
    """
    names = trims.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            col = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
            b, row = {f: col(f) for f in FIELDS}, {c: col(c) for c in ("tws", "twa", "flat", "reef", "down")}
            x, left = solve(b, row)
            s = state(b, row, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s[k]) for k in OUT], pa.array(left < 0.25)], [*names, *OUT, "converged"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trims.schema)
    return trims.mapInArrow(run, f"{fields}, {', '.join(f'{k} double' for k in OUT)}, converged boolean")


def score() -> Column:
    over = F.greatest(F.col("heel") - float(MOST_HEEL), F.lit(0.0))
    return F.col("v") - over * 30.0 - over * over * 200.0


def speed_table(points: DataFrame, keys: list[str]) -> DataFrame:
    """Best trim of each point (``keys``, the boat's fields, tws, twa): the point's solution columns and converged.

    Full sail is kept where it converges upright enough; the other points try
    a lattice of flatness and reef, and the best score stands. Off the wind
    the spinnaker is tried as well. Points in the no-go zone have speed 0.
    Full sails are solved and written once, so that a task has one Python
    worker at a time; points are dealt by number, since few files may hold many.
    """
    deal = 2 * points.sparkSession.sparkContext.defaultParallelism
    # written once: numbers given after a shuffle may differ where a plan is computed twice
    points = durable(points.withColumn("_point", F.monotonically_increasing_id()))
    sets = F.explode(F.when(F.col("twa") >= SPINNAKER_FROM, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    wide = points.where(F.col("twa") >= NO_GO).repartition(deal, "_point").withColumns({"down": sets, "flat": F.lit(1.0), "reef": F.lit(1.0)})
    full = durable(solved(wide))
    good = F.col("converged") & (F.col("heel") <= float(MOST_HEEL))
    lattice = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for r in REEFS for f in FLATS]))
    tried = solved(full.where(~good).drop(*OUT, "converged").withColumn("_t", lattice).withColumns({"flat": F.col("_t.f"), "reef": F.col("_t.r")}).drop("_t"))
    keep = ["flat", "reef", "down", "converged", *OUT]
    # a full sail that is good stands; then any converged trim by score; then full sail as it is
    rank = F.when(good & (F.col("flat") == 1.0) & (F.col("reef") == 1.0), F.lit(2)).when(F.col("converged"), F.lit(1)).otherwise(F.lit(0))
    every = full.unionByName(tried)
    best = every.groupBy("_point", "down").agg(F.max_by(F.struct(*keep), F.struct(rank.alias("rank"), F.when(F.col("converged"), score()).otherwise(0.0).alias("score"), "reef", "flat")).alias("s"))
    best = best.select("_point", "s.*").groupBy("_point").agg(F.max_by(F.struct(*keep), F.struct("converged", "v", ~F.col("down"))).alias("s"))
    out = points.select("_point", *keys, "tws", "twa").join(best, "_point", "left")
    deg = lambda x: F.coalesce(F.degrees(F.col(f"s.{x}")), F.lit(0.0))
    num = lambda x, k=1.0: F.coalesce(F.col(f"s.{x}") / k, F.lit(0.0))
    name = F.when(F.col("s").isNull(), F.lit("In Irons (No-Go)")).when(F.col("s.down"), F.lit("Downwind (Main+Spin)")).otherwise(F.lit("Upwind (Main+Jib)"))
    return out.select(
        *keys, "tws", "twa", num("v", KTS).alias("v_boat_kts"), num("v").alias("v_boat_ms"), (num("v", KTS) * F.cos(F.radians("twa"))).alias("vmg_kts"), deg("heel").alias("heel_deg"), deg("leeway").alias("leeway_deg"),
        name.alias("sail_set_name"), F.coalesce("s.flat", F.lit(1.0)).alias("flat"), F.coalesce("s.reef", F.lit(1.0)).alias("reef"), F.coalesce(F.col("s.aws") / KTS, F.col("tws")).alias("aws_kts"),
        F.coalesce(F.degrees(F.col("s.awa")), F.col("twa")).alias("awa_deg"), num("f_x").alias("f_x_n"), *[num(k).alias(f"{k}_n") for k in ("r_total", "r_viscous", "r_residuary", "r_induced", "r_heel")],
        num("m_x").alias("heeling_moment_nm"), num("righting").alias("righting_moment_nm"), F.coalesce("s.converged", F.lit(True)).alias("converged"),
    )
