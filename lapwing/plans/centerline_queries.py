"""Queries on the middle line and the corridor of the driven laps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import centerline as cl
from lapwing.plans.tables import DRIVE, drive

QUERIES: dict = {}
ORACLES: dict = {}
TRACK, LAP = ["track"], ["track", "k"]
BOXES = [(0, 300.0, 500.0), (0, 450.0, 700.0), (1, 900.0, 1300.0)]
LENGTH = 1800


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = DRIVE + sql
        return f

    return add


BINS = f", bx AS (SELECT * FROM (VALUES {', '.join(f'({t}, {a}::DOUBLE, {b}::DOUBLE)' for t, a, b in BOXES)}) v(track, start_m, end_m)), m0 AS (SELECT track, unnest(generate_series(CAST(ceil(td - 2) AS BIGINT), CAST(floor(td + 2) AS BIGINT))) AS bin, td, e FROM d), m1 AS (SELECT track, CAST(bin AS INTEGER) AS bin, CASE WHEN count(*) >= 5 THEN median(td) END AS x, CASE WHEN count(*) >= 5 THEN median(e) END AS y, sqrt(stddev_pop(td) ** 2 + stddev_pop(e) ** 2) AS spread, count(*) AS n FROM m0 WHERE bin >= 0 GROUP BY ALL), m2 AS (SELECT *, EXISTS (SELECT 1 FROM bx WHERE bx.track = m1.track AND bin >= start_m AND bin <= end_m) AS protected, median(n) OVER (PARTITION BY track) AS usual FROM m1), m3 AS (SELECT track, bin, x AS x0, y AS y0, spread, n, protected, NOT protected AND (spread > 6 OR n > 1.5 * usual) AS rejected FROM m2)"


def line(spark, d):
    """(boxes, lengths) of the tracks."""
    boxes = spark.createDataFrame(BOXES, "track int, start_m double, end_m double")
    return boxes, spark.createDataFrame([(0, LENGTH), (1, LENGTH)], "track int, length int")


@query(BINS + " SELECT track, bin, round(CASE WHEN NOT rejected THEN x0 END, 4) AS x, round(CASE WHEN NOT rejected THEN y0 END, 4) AS y, round(spread, 4) AS spread, n, protected, rejected FROM m3")
def centerline_bins(spark, d):
    rows = cl.rejected(cl.bins(drive(spark, d), TRACK, "td", "td", "e"), line(spark, d)[0], TRACK)
    return rows.select("track", "bin", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("spread", 4).alias("spread"), "n", "protected", "rejected")


_EDGE = "{f}_value(CASE WHEN {c} IS NOT NULL THEN {v} END IGNORE NULLS) OVER {w}"
RING = BINS + f""", sp AS (SELECT CAST(t.t AS INTEGER) AS track, CAST(b.b AS INTEGER) AS bin FROM range(2) t(t), range({LENGTH}) b(b)),
f0 AS (SELECT sp.*, CASE WHEN NOT rejected THEN x0 END AS x, CASE WHEN NOT rejected THEN y0 END AS y, coalesce(protected, false) AS protected, coalesce(rejected, false) AS rejected FROM sp LEFT JOIN m3 USING (track, bin)),
f1 AS (SELECT f0.*, bin + u.u * {LENGTH} AS p, u.u AS turn FROM f0, (VALUES (-1), (0), (1)) u(u)),
f2 AS (SELECT *, {_EDGE.format(f='last', c='x', v='p', w='a')} AS xp0, {_EDGE.format(f='last', c='x', v='x', w='a')} AS xv0, {_EDGE.format(f='first', c='x', v='p', w='b')} AS xp1, {_EDGE.format(f='first', c='x', v='x', w='b')} AS xv1, {_EDGE.format(f='last', c='y', v='y', w='a')} AS yv0, {_EDGE.format(f='first', c='y', v='y', w='b')} AS yv1, last_value(CASE WHEN protected THEN p END IGNORE NULLS) OVER a AS pp0, first_value(CASE WHEN protected THEN p END IGNORE NULLS) OVER b AS pp1 FROM f1 WINDOW a AS (PARTITION BY track ORDER BY p ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY track ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f3 AS (SELECT track, bin, rejected, CASE WHEN xp0 = xp1 THEN xv0 ELSE xv0 + (xv1 - xv0) * (p - xp0) / (xp1 - xp0) END AS x, CASE WHEN xp0 = xp1 THEN yv0 ELSE yv0 + (yv1 - yv0) * (p - xp0) / (xp1 - xp0) END AS y, least(p - pp0, pp1 - p) AS away FROM f2 WHERE turn = 0),
g1 AS (SELECT track, (bin + o.o + {LENGTH}) % {LENGTH} AS bin, sum(x * exp(-o.o * o.o / 8.0)) / sum(exp(-o.o * o.o / 8.0)) AS fx, sum(y * exp(-o.o * o.o / 8.0)) / sum(exp(-o.o * o.o / 8.0)) AS fy FROM f3, generate_series(-8, 8) AS o(o) GROUP BY ALL),
g2 AS (SELECT track, (bin + o.o + {LENGTH}) % {LENGTH} AS bin, sum(x * exp(-o.o * o.o / 200.0)) / sum(exp(-o.o * o.o / 200.0)) AS wx, sum(y * exp(-o.o * o.o / 200.0)) / sum(exp(-o.o * o.o / 200.0)) AS wy FROM f3, generate_series(-40, 40) AS o(o) GROUP BY ALL),
ln AS (SELECT f3.track, f3.bin, f3.rejected, fx * (1 - least(coalesce(away / 25.0, 1), 1)) + wx * least(coalesce(away / 25.0, 1), 1) AS x, fy * (1 - least(coalesce(away / 25.0, 1), 1)) + wy * least(coalesce(away / 25.0, 1), 1) AS y FROM f3 JOIN g1 USING (track, bin) JOIN g2 USING (track, bin))"""


def built(spark, d):
    boxes, lengths = line(spark, d)
    return cl.centerline(drive(spark, d), boxes, lengths, TRACK, "td", "td", "e")


@query(RING + " SELECT track, bin, round(x, 4) AS x, round(y, 4) AS y, rejected FROM ln")
def centerline(spark, d):
    return built(spark, d).select("track", "bin", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "rejected")


FIELD = RING + ", q0 AS (SELECT track, k.k AS bin, bin - k.k * 10 AS s, exp(-((bin - k.k * 10) / 10.0) ** 2 / 2) AS w0, x, y FROM ln, generate_series(0, 182) k(k) WHERE abs(bin - k.k * 10) <= 20), q1 AS (SELECT track, CAST(bin AS INTEGER) AS bin, exp(-s * s / 200.0) AS w, s, x, y FROM q0), q2 AS (SELECT track, bin, sum(w) AS sw, sum(w * s) AS ws, sum(w * s * s) AS wss, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * s * x) AS wsx, sum(w * s * y) AS wsy FROM q1 GROUP BY ALL), q3 AS (SELECT *, (sw * wsx - ws * wx) / (sw * wss - ws * ws) AS tx, (sw * wsy - ws * wy) / (sw * wss - ws * ws) AS ty FROM q2 WHERE sw * wss - ws * ws > 1e-9)"


@query(FIELD + " SELECT track, bin, round(wx / sw, 4) AS gx, round(wy / sw, 4) AS gy, round(tx / sqrt(tx ** 2 + ty ** 2), 4) AS tx, round(ty / sqrt(tx ** 2 + ty ** 2), 4) AS ty FROM q3")
def line_field(spark, d):
    return cl.field(built(spark, d), TRACK).where("tx is not null").select("track", "bin", *[F.round(c, 4).alias(c) for c in ("gx", "gy", "tx", "ty")])


_FIT = "{n}v AS (SELECT track, k, bin, median(e) AS v FROM {s} GROUP BY ALL), {n} AS (SELECT track, bin, CASE WHEN count(v) >= 30 THEN greatest(quantile_cont(v, 0.02) - 2, -20) ELSE -15 END AS lo, CASE WHEN count(v) >= 30 THEN least(quantile_cont(v, 0.98) + 2, 20) ELSE 15 END AS hi, count(v) AS laps FROM {n}v GROUP BY ALL)"
BAND = ", s0 AS (SELECT *, CAST(greatest(least(round_even(td / 10, 0), 399), 0) AS INTEGER) AS bin FROM d), " + _FIT.format(n="a", s="s0") + ", s1 AS (SELECT s0.* FROM s0 JOIN a USING (track, bin) WHERE e >= lo AND e <= hi), " + _FIT.format(n="b", s="s1") + ", kv AS (SELECT track, k, bin, median(lat_g * 9.81 / greatest(v, 8) ** 2) AS kp FROM s0 GROUP BY ALL), kk AS (SELECT track, bin, CASE WHEN count(kp) >= 20 THEN median(kp) ELSE 0 END AS kappa FROM kv GROUP BY ALL)"


def binned(spark, d):
    from lapwing.operators.trajectory import bin_index

    return drive(spark, d).withColumn("bin", bin_index(F.col("td"), 400))


@query(BAND + " SELECT kk.track, kk.bin, round(coalesce(lo, -15), 4) AS e_lo, round(coalesce(hi, 15), 4) AS e_hi, coalesce(laps, 0) AS laps, round(kappa, 6) AS kappa FROM kk LEFT JOIN b USING (track, bin)")
def corridor_band(spark, d):
    s = binned(spark, d)
    met = cl.curvature(s, LAP, TRACK, "v", "lat_g").join(cl.envelope(s, LAP, TRACK, "e"), ["track", "bin"], "left")
    return met.select("track", "bin", F.round(F.coalesce("e_lo", F.lit(-15.0)), 4).alias("e_lo"), F.round(F.coalesce("e_hi", F.lit(15.0)), 4).alias("e_hi"), F.coalesce("laps", F.lit(0)).alias("laps"), F.round("kappa", 6).alias("kappa"))


@query()
def corridor_build(spark, d):
    """The corridor of all bins, stamped, and read back as one that is not stale."""
    made = built(spark, d)
    rows = cl.stamped(cl.corridor(binned(spark, d), made, LAP, TRACK, "e", "v", "lat_g"), made, TRACK)
    return cl.unless_stale(rows, made, TRACK).select("track", "bin", *[F.round(c, 4).alias(c) for c in ("gx", "gy", "tx", "ty", "e_lo", "e_hi")], F.round("kappa", 6).alias("kappa"), "laps", "version")


@query(RING + " SELECT track, 'centerline' AS session_id, 1 AS lap, CAST(bin AS DOUBLE) AS dist_lap_m, round(x, 4) AS x, round(y, 4) AS y, CAST(0 AS DOUBLE) AS gps_accuracy_m FROM ln WHERE x IS NOT NULL")
def reference_ruler(spark, d):
    return cl.as_ruler(built(spark, d), TRACK).select("track", "session_id", "lap", "dist_lap_m", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "gps_accuracy_m")
