"""The solver's answers, the polar's shape, and polar files."""

import hashlib
import math
import uuid

import numpy as np
import pytest
from galeframe.operators import polars
from galeframe.operators.common import shared_folder
from galeframe.physics import boats, cache, forces, solver
from galeframe.plans import physics, registry
from pyspark.sql import functions as F


def test_polar_points_balance(spark):
    p = boats.presets(spark).drop("name").withColumn("tws", F.explode(F.array(F.lit(8.0), F.lit(16.0)))).withColumn("twa", F.explode(F.array(*[F.lit(float(a)) for a in (20, 40, 90, 150)])))
    got = solver.speed_table(p, ["boat"]).collect()
    assert len(got) == 32
    for r in got:
        if r["twa"] < 28:
            assert (r["v_boat_kts"], r["sail_set_name"], r["converged"]) == (0.0, "In Irons (No-Go)", True)
            continue
        assert r["converged"] and 1.0 < r["v_boat_kts"] < 25.0 and 0 <= r["heel_deg"] <= 35
        boat = dict(zip(boats.FIELDS, boats.PRESETS[r["boat"]][1], strict=True))
        force = max(boat["mass"] * 9.80665 * 0.02, 100.0)
        assert abs(r["f_x_n"] - r["r_total_n"]) < 0.25 * force and abs(r["heeling_moment_nm"] - r["righting_moment_nm"]) < 0.25 * force * max(boat["b_max"] / 2, 1.0)
        assert math.isclose(r["vmg_kts"], r["v_boat_kts"] * math.cos(math.radians(r["twa"])), rel_tol=1e-9, abs_tol=1e-9)
    by = {(r["boat"], r["tws"], r["twa"]): r["v_boat_kts"] for r in got}
    assert all(by[(b, 16.0, a)] > by[(b, 8.0, a)] for b in boats.PRESETS for a in (40.0, 90.0, 150.0))


def test_model_version_is_stable(spark):
    a, b = ({r["boat"]: r["version"] for r in physics.solver_version(boats.presets(spark)).collect()} for _ in range(2))
    assert a == b and len(a) == 4 and all(len(v) == 12 for v in a.values())


def test_model_fingerprint_is_that_of_plain_python(spark, sf):
    """The digits from a plain loop over the formulas with numbers; the formulas are compared with SQL in I28_I33_I39."""
    want = {}
    for name, (_, values) in boats.PRESETS.items():
        lines = []
        b = dict(zip(boats.FIELDS, map(float, values), strict=True))
        for k in range(1, 9):
            h = forces.hydro(forces.Arrays, b, np.float64(k * 0.6), np.radians(k * 3.0), np.float64(b["mass"] * 0.3))
            r, m = (math.floor(float(h[x]) * 1e3 + 0.5) / 1e3 for x in ("r_total", "righting"))
            lines.append(f"{name}|{k}|{r:.3f}|{m:.3f}")
        want[name] = hashlib.sha256("|".join(sorted(lines)).encode()).hexdigest()[:12]
    got = physics.QUERIES["D25_model_fingerprint"](spark, sf).collect()
    assert got and all(r["version"] == want[r["preset"]] for r in got)


def test_polar_texts(spark):
    texts = {
        1: "! note\nTWA\\TWS\t6\t8\n45\t4.5\t5.0\n90\t5.5\t\n",
        2: "# c\n6;8\n45;4.5;5.0\n90;5.5;0\n",
        3: "twa 6 8\r\n45 4.5 5.0\r\n90 5.5 x\r\n",
        4: "TWA,6,8\n45,4.5,5.0\n\nbad,1,2\n90,5.5,0",
        5: None,
        6: "",
    }
    got = polars.parse(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text").collect()
    want = {(6.0, 45.0, 4.5), (8.0, 45.0, 5.0), (6.0, 90.0, 5.5), (8.0, 90.0, 0.0)}
    for i in (1, 2, 3, 4):
        assert {(r["tws"], r["twa"], r["speed"]) for r in got if r["id"] == i} == want, i
    assert not [r for r in got if r["id"] > 4]


def plain_repair(cells):
    """cells: {(tws, twa): (speed, converged)}."""
    out = {k: s for k, (s, _) in cells.items()}
    done = set()
    for axis in (1, 0):
        before = dict(out)
        for k, (_, good) in cells.items():
            if good or k in done:
                continue
            line = sorted((x[axis], before[x]) for x in cells if x[1 - axis] == k[1 - axis] and cells[x][1] and before[x] > 0)
            low, high = [p for p in line if p[0] < k[axis]], [p for p in line if p[0] > k[axis]]
            if low and high:
                (a, y), (b, z) = low[-1], high[0]
                out[k] = y + (z - y) * (k[axis] - a) / (b - a)
                done.add(k)
    return out


def test_repair_of_cells_without_a_solution(spark, sf):
    m = physics._masked(spark, sf).where("s_suppkey = 1").drop("s_suppkey")
    want = plain_repair({(r["tws"], r["twa"]): (r["speed"], r["converged"]) for r in m.collect()})
    got = {(r["tws"], r["twa"]): r["speed"] for r in polars.repair(m).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_json_has_targets_by_wind_speed(spark, sf):
    import json

    row = json.loads(physics.A45_polar_json(spark, sf).first()["json"])
    assert row["tws_list"] == sorted(row["tws_list"]) and set(row["targets"]) == {str(x) for x in row["tws_list"]}


def test_points_are_solved_once_for_each_model(spark, sf):
    """The cached answers are those of the solver; what is solved the second time is what nobody had asked for."""
    p = physics.asked_points(spark, sf)
    got = {r["s_suppkey"]: r for r in physics.I38_cached_presets(spark, sf).collect()}
    asked = {(r["boat"], r["tws"], r["twa"]) for r in p.where("s_nationkey < 12").collect()}
    want = {(r["boat"], r["tws"], r["twa"]): r["v_boat_kts"] for r in solver.speed_table(p.dropDuplicates(["boat", "tws", "twa"]), ["boat"]).collect()}
    rows = p.select("s_suppkey", "boat", "tws", "twa").collect()
    assert len(got) == len(rows)
    for r in rows:
        k = (r["boat"], r["tws"], r["twa"])
        assert got[r["s_suppkey"]]["cached"] == (k in asked) and math.isclose(got[r["s_suppkey"]]["v_boat_kts"], want[k], abs_tol=1e-6)
    store = cache.SolvedPoints(spark, f"{shared_folder(spark)}/solved-{uuid.uuid4().hex}")
    one = p.limit(1)
    first, again, other = (store.solve(x).collect() for x in (one, one.unionByName(one), one.withColumn("model", F.lit("next"))))
    assert [r["cached"] for r in first + again + other] == [False, True, True, False] and store.store.read().count() == 2


@pytest.mark.parametrize("name", ["H31_vmg_targets", "H32_vmg_targets_of_files", "A45_polar_json"])
def test_tables_of_speeds_are_dealt_by_supplier_before_they_have_cells(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x and "tws" not in x for x in exchanges)


def test_full_sails_are_solved_once_on_short_arrays(spark, monkeypatch):
    """One Python step in the plan of a table of points; work arrays have a bounded length, whatever a batch has, and rows the answers they have alone."""
    p = boats.presets(spark).drop("name").withColumn("tws", F.lit(16.0)).withColumn("twa", F.lit(90.0))
    assert solver.speed_table(p, ["boat"])._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    n, rng = 300, np.random.default_rng(3)
    values = np.array([v for _, v in boats.PRESETS.values()])[rng.integers(0, 4, n)]
    b = {f: values[:, k].copy() for k, f in enumerate(boats.FIELDS)}
    row = {"tws": rng.uniform(4, 24, n), "twa": rng.uniform(30, 180, n), "flat": np.ones(n), "reef": np.ones(n), "down": rng.random(n) < 0.5}
    whole, sizes, plain = solver.solve(b, row), [], solver.residuals
    monkeypatch.setattr(solver, "residuals", lambda b, row, x: (sizes.append(len(x)), plain(b, row, x))[1])
    parts = solver.solve(b, row, width=64)
    assert max(sizes) <= 64 and np.array_equal(parts[0], whole[0]) and np.array_equal(parts[1], whole[1])
    import pyarrow as pa

    given = [pa.record_batch({"k": list(range(at, at + size))}) for at, size in ((0, 0), (0, 3), (3, 20), (23, 1))]
    got = list(solver.gathered(iter(given), 8))
    assert [k for x in got for k in x.column(0).to_pylist()] == list(range(24)) and all(0 < x.num_rows < 16 for x in got)
