"""Alignment operators against plain numpy."""

import re
import math
import random

import numpy as np

from pyspark.sql import functions as F

from lapwing.operators import alignment, lags, corners


def drive(late=0.0, spike=None):
    """A lap on a circle of 200 m at changing speed, 20 Hz, with fixes at 5 Hz that trail by ``late`` seconds."""
    t = np.arange(0, 60, 0.05)
    v = 40 + 8 * np.sin(t / 3) + 4 * np.sin(t * 1.1)
    d = np.r_[0, np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(t))]
    held = np.floor(t / 0.2 + 1e-9) * 0.2
    at = np.interp(held - late, t, d) / 200
    x, y = 200 * np.cos(at), 200 * np.sin(at)
    g = -(v**2) / 200 / 9.80665
    fix = np.r_[True, np.diff(held) > 1e-6]
    if spike is not None:
        x = np.where(np.abs(held - spike) < 1e-6, x + 15, x)
    return [("a", float(a), i, float(b), float(c), float(e), float(h), bool(f)) for i, (a, b, c, e, h, f) in enumerate(zip(t, v, g, x, y, fix, strict=True))]


SCHEMA = "k string, t double, i int, v double, g double, x double, y double, fix boolean"


def test_path_lag_finds_a_planted_delay(spark):
    for late in (0.3, 0.6):
        df = spark.createDataFrame(drive(late), SCHEMA)
        fixes = df.withColumns({c: F.when(F.col("fix"), F.col(c)) for c in "xy"})
        got = lags.path_lag(fixes, ["k"], "t", "i", "x", "y", "v").first().lag
        assert abs(got + lags.HOLD_LEAD - late) <= 0.03
    still = spark.createDataFrame(drive(), SCHEMA).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    assert lags.path_lag(still, ["k"], "t", "i", "x", "y", "v").first().lag is None


def brute_residuals(rows):
    t, v, g, x, y, fix = (np.array([r[c] for r in rows]) for c in (1, 3, 4, 5, 6, 7))
    px, py, h, path = 0.0, 0.0, 0.0, []
    for j in range(len(t)):
        path.append((px, py))
        if j + 1 < len(t):
            dt = t[j + 1] - t[j]
            px, py, h = px + v[j] * math.cos(h) * dt, py + v[j] * math.sin(h) * dt, h - g[j] * 9.80665 / max(v[j], 5) * dt
    path, at, out = np.array(path), np.flatnonzero(fix), {}
    for i in at:
        near = [j for j in at if j != i and abs(round(t[j] * 1e6) - round(t[i] * 1e6)) <= 1_500_000]
        a, b, w = path[near], np.column_stack([x[near], y[near]]), np.ones(len(near))
        if len(near) < 6:
            continue
        for _ in range(3):
            ma, mb = np.average(a, axis=0, weights=w), np.average(b, axis=0, weights=w)
            u, _, vt = np.linalg.svd(((a - ma) * w[:, None]).T @ (b - mb))
            turn = vt.T @ np.diag([1, np.linalg.det(vt.T @ u.T)]) @ u.T
            r = np.linalg.norm((a - ma) @ turn.T + mb - b, axis=1)
            w = np.minimum(1, 3 / np.maximum(r, 1e-9))
        out[i] = float(np.linalg.norm(turn @ (path[i] - ma) + mb - [x[i], y[i]]))
    return out


def test_jump_residuals_are_brute_force_and_flag_the_spike(spark):
    rows = drive(spike=20.0)
    got = alignment.jump_residuals(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "i", "v", "g", "x", "y", "fix").collect()
    want = brute_residuals(rows)
    assert {r.i for r in got if r.residual is not None} == set(want)
    assert all(abs(r.residual - want[r.i]) < 1e-6 for r in got if r.residual is not None)
    assert [r.i for r in got if r.jump] == [400]


def test_jump_residuals_are_made_a_lap_at_a_time(spark, monkeypatch):
    """No row gathers its neighbours, laps go to their fits from the windows' one shuffle, and few neighbours at a time give the same."""
    laps = [(k, *r[1:]) for k in "ab" for r in drive(spike=20.0)]
    laps += [("c", 0.1 * i, i % 9, 30.0, 0.1, float(i), float(i % 3), True) for i in range(40)] + [("c", None, 50 + i, 30.0, 0.1, 1.0, None if i else 2.0, True) for i in range(9)]
    df = spark.createDataFrame(laps, SCHEMA)
    ask = lambda: alignment.jump_residuals(df, ["k"], "t", "i", "v", "g", "x", "y", "fix")
    whole = {(r.k, r.i): (r.residual, r.jump) for r in ask().where("k <> 'c'").collect()}
    want = brute_residuals(drive(spike=20.0))
    assert all((whole[k, i][0] is None) == (i not in want) and (i not in want or abs(whole[k, i][0] - want[i]) < 1e-6) for k, i in whole)
    monkeypatch.setattr(alignment, "HELD", 50)
    assert {(r.k, r.i): (r.residual, r.jump) for r in ask().where("k <> 'c'").collect()} == whole
    odd = ask().where("k = 'c'").collect()
    assert len(odd) == 49 and all((r.residual is None) == (r.i >= 50) for r in odd)
    plan = ask()._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_jump_residuals_need_whole_sensors(spark):
    df = spark.createDataFrame(drive(), SCHEMA)
    flat = alignment.jump_residuals(df.withColumn("g", F.lit(0.0)), ["k"], "t", "i", "v", "g", "x", "y", "fix")
    assert flat.where("residual is not null").count() == 0
    holed = alignment.jump_residuals(df.withColumn("g", F.when(F.col("i") != 600, F.col("g"))), ["k"], "t", "i", "v", "g", "x", "y", "fix")
    blank = [r.i for r in holed.where("residual is null").collect()]
    assert blank and all(abs(i - 600) <= 30 for i in blank if 40 < i < 1160)


def test_span_integrals_are_brute_force(spark):
    rng = random.Random(4)
    rows = [("a", round(i * 0.5, 3), i, None if rng.random() < 0.05 else rng.uniform(-2, 2)) for i in range(200)]
    spans = [("a", n, *sorted((rng.uniform(-3, 103), rng.uniform(-3, 103)))) for n in range(40)]
    got = alignment.span_integrals(spark.createDataFrame(rows, "k string, t double, i int, g double"), spark.createDataFrame(spans, "k string, n int, lo double, hi double"), ["k"], "t", "i", "g")
    t, g = np.array([r[1] for r in rows]), np.array([np.nan if r[3] is None else r[3] for r in rows])
    ok = np.isfinite(g)
    for r in got.collect():
        inside = (t >= r.lo) & (t <= r.hi)
        if inside.sum() < 2 or (inside & ok).sum() < 0.9 * inside.sum():
            assert r.integral is None
            continue
        grid = np.unique(np.r_[r.lo, t[ok & (t > r.lo) & (t < r.hi)], r.hi])
        assert abs(r.integral - np.trapezoid(np.interp(grid, t[ok], g[ok]), grid)) < 1e-9


def test_retime_by_zero_is_identity(spark):
    df = spark.createDataFrame(drive(), SCHEMA).withColumns({"lag": F.lit(0.0), "late": F.lit(0.05)})
    assert alignment.retime(df, ["k"], "t", "i", [(["x", "y"], "lag")]).exceptAll(df).count() == 0
    moved = {r.i: r.x for r in alignment.retime(df.withColumn("late", F.lit(0.0501)), ["k"], "t", "i", [(["x"], "late")]).collect()}
    rows = drive()
    assert all(moved[i] == rows[min(i + 1, len(rows) - 1)][5] for i in moved)


def test_clusters_at_planted_places(spark):
    rng = random.Random(6)
    rows = [("L", rng.gauss(m, 6)) for m in (400, 1500) for _ in range(60)] + [("R", rng.gauss(900, 6)) for _ in range(60)] + [("R", rng.uniform(0, 3000)) for _ in range(10)]
    got = corners.density_clusters(spark.createDataFrame(rows, "side string, at double"), "side", "at", 3500.0, 3.0).orderBy("apex").collect()
    assert [(r.side, round(r.apex / 10)) for r in got] == [("L", 40), ("R", 90), ("L", 150)]


def test_lags_are_fitted_where_the_samples_lie(spark):
    """Neither grids nor their shifts are dealt out anew: only laps' samples are."""
    rows = [(k, i, i * 0.125, 20.0 + i % 7, i * 2.5, float(i % 5), 0.1) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, t double, v double, px double, y double, long_g double")
    for got in (lags.path_lag(df, ["k"], "t", "i", "px", "y", "v"), lags.speed_lags(df, ["k"], ["t", "i"], "t", "v", "px", "long_g")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k#" in plan and not re.search(r"hashpartitioning\([^)]*\b[gf]#", plan)


def test_ticks_are_linear_between_rows_and_flat_outside(spark):
    df = spark.createDataFrame([(1, 0.3, 3.0), (1, 1.0, 10.0), (1, 1.05, 20.0), (2, 0.5, 7.0)], "k int, x double, y double")
    got = lags.ticked(df, ["k"], "x", ["y"], F.lit(0.0), F.lit(-1), F.lit(12), 0.1, "f").orderBy("k", "f").collect()
    at = np.arange(-1, 13) * 0.1
    assert [(r.k, r.f) for r in got] == [(k, f) for k in (1, 2) for f in range(-1, 13)]
    assert np.allclose([r.y for r in got], [*np.interp(at, [0.3, 1.0, 1.05], [3.0, 10.0, 20.0]), *[7.0] * 14])
