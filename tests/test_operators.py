"""Operators that SQL does not cover, against plain Python, and rules at the edges."""

import random

from pyspark.sql import functions as F

from lapwing.operators import joins, robust, sequence as seq


def test_rate_limit_is_the_loop(spark):
    rng = random.Random(3)
    values = [rng.uniform(-10, 10) for _ in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, o int, v double")
    got = [r.z for r in seq.fold_limited(df, ["k"], "o", "v", F.lit(1.5), "z").orderBy("o").collect()]

    def one_way(v):
        out = [v[0]]
        for x in v[1:]:
            out.append(min(max(x, out[-1] - 1.5), out[-1] + 1.5))
        return out

    want = [(a + b) / 2 for a, b in zip(one_way(values), one_way(values[::-1])[::-1], strict=True)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_spacing_keeps_the_higher_peak(spark):
    heights = [0, 5, 0, 7, 0, 6, 0, 3, 0]
    df = spark.createDataFrame([("a", float(i), float(h)) for i, h in enumerate(heights)], "k string, o double, v double")
    assert sorted(r.o for r in seq.peaks(df, ["k"], "o", "v", 2.0, 3.0).collect()) == [3.0, 7.0]


def test_asof_takes_the_last_of_equal_times_and_tau_zero_is_identity(spark):
    s = spark.createDataFrame([("a", 1.0, 1, 10), ("a", 1.0, 2, 20), ("a", 3.0, 3, 30)], "k string, t double, i int, v int")
    q = spark.createDataFrame([("a", 0.5, 1), ("a", 1.0, 2), ("a", 2.9, 3), ("a", 9.0, 4)], "k string, t double, n int")
    assert [r.v for r in joins.asof_hold(q, s, ["k"], "t", "i", ["v"]).orderBy("n").collect()] == [10, 20, 20, 30]


def test_nearest_is_brute_force(spark):
    rng = random.Random(5)
    ruler = [(i, rng.random(), rng.random()) for i in range(60)]
    pts = [(i, rng.uniform(-0.5, 1.5), rng.uniform(-0.5, 1.5)) for i in range(200)]
    got = {r.id: r.r for r in joins.nearest(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(ruler, "r int, x double, y double"), 0.1, "id", "r").collect()}
    assert got == {i: min(ruler, key=lambda q: ((q[1] - x) ** 2 + (q[2] - y) ** 2, q[0]))[0] for i, x, y in pts}


def test_interpolation_outside(spark):
    c = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0)], "k string, x double, y double")
    q = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", 3.0)], "k string, x double")
    assert [r.z for r in joins.interpolate(q, c, ["k"], "x", "y", "z").orderBy("x").collect()] == [None, 2.0, None]
    assert [r.z for r in joins.interpolate(q, c, ["k"], "x", "y", "z", clamp=True).orderBy("x").collect()] == [0.0, 2.0, 4.0]


def test_null_verdicts_and_flat_groups(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", True)], "k string, f boolean")
    got = {r.k: r.all for r in robust.all_of(df, ["k"], F.col("f"), "all").collect()}
    assert got == {"a": None, "b": False, "c": True}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, x double")
    assert [r.z for r in robust.robust_z(flat, ["k"], "x", F.lit(True), "z").collect()] == [None, None]


def test_lap_clock_rounds_what_is_stored(spark):
    from lapwing.functions.expressions import lap_clock

    values = [0.0, 0.125, 0.375, 9.994999, 19.845, 59.995, 59.9951, 60.0, 83.155, 227.845, 250.125, 403.675, None]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "x double").select(lap_clock(F.col("x")).alias("c")).collect()]
    assert got == [None if v is None else f"{int(v // 60)}:{v - 60 * (v // 60):05.2f}" for v in values]


def test_nearest_takes_any_density_copies_and_what_is_not_finite(spark, monkeypatch):
    """Tiles are cut where the ruler is dense, its copies are one place, a far point has its hit, and what is not finite keeps its row, as in the SQL."""
    import numpy as np

    from lapwing.operators import tiles

    rng, inf = np.random.default_rng(8), float("inf")
    dense = np.r_[rng.normal(0, 1e-4, (3000, 2)), rng.normal(5, 1, (60, 2)), np.round(rng.uniform(-3, 3, (300, 2)))]
    pts = np.r_[rng.normal(0, 1e-4, (400, 2)), rng.uniform(-9, 9, (300, 2)), np.round(rng.uniform(-3, 3, (100, 2))) + 0.5, [[1e13, 0.0]]]
    far = ((pts[:, None, :] - dense) ** 2).sum(axis=2)
    d2, at = tiles.closest(pts, dense)
    assert np.array_equal(at, far.argmin(axis=1)) and np.array_equal(d2, far.min(axis=1))
    monkeypatch.setattr(joins, "TILE", 100)
    monkeypatch.setattr(joins, "TAKEN", 50)
    ruler = [(i, float(x), float(y)) for i, (x, y) in enumerate(dense)] + [(90000 + i, 0.0, 0.0) for i in range(500)] + [(-1, inf, 0.0), (-2, float("nan"), 0.0), (-3, None, 0.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(-1, inf, 0.0), (-2, float("nan"), 1.0), (-3, None, 1.0)]
    ask = lambda r: {x.id: (x.r, x.distance) for x in joins.nearest(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(r, "r int, x double, y double"), 0.1, "id", "r").collect()}
    got = ask(ruler)
    want = {i: (int(k), float(np.sqrt(far[i, k]))) for i, k in enumerate(far.argmin(axis=1))}
    assert {k: v for k, v in got.items() if k >= 0} == want
    assert got.keys() == want.keys() | {-1, -2} and got[-1] == (0, inf) and got[-2][0] == -2 and np.isnan(got[-2][1])
    assert ask([(7, inf, 0.0)])[5] == (7, inf) and ask([]) == {}
