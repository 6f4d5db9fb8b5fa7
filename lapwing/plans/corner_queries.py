"""Queries on corners, passages and gears of the driven laps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions.lineage import grown
from lapwing.operators import gears, transits as tra
from lapwing.plans import trajectory_queries
from lapwing.plans.tables import DRIVE, drive, read

SECTION_SQL = trajectory_queries.ORACLES["trajectory_sections"]

QUERIES: dict = {}
ORACLES: dict = {}
LAP, ORDER, TRACK = ["track", "k"], ["t", "i"], ["track"]

CORNERS = [(0, "T1", 100.0, 400.0, 250.0, None), (0, "T2", 350.0, 900.0, 600.0, 700.0), (0, "T3", 1200.0, 1600.0, 1300.0, None), (1, "T1", 50.0, 700.0, 300.0, 500.0), (1, "T4", 1000.0, 1900.0, 1100.0, None)]
CORNERS_SQL = "z AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{c}', {a}::DOUBLE, {b}::DOUBLE, {x}::DOUBLE, {'NULL' if y is None else y}::DOUBLE)" for t, c, a, b, x, y in CORNERS) + ") v(track, corner_id, start_m, end_m, apex_m, second_m))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = DRIVE + sql
        return f

    return add


def corners(spark):
    return spark.createDataFrame(CORNERS, "track int, corner_id string, start_m double, end_m double, apex_m double, second_m double")


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


def q4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


@query(f", {CORNERS_SQL}, n AS (SELECT *, lead(start_m) OVER (PARTITION BY track ORDER BY start_m) AS nx FROM z), s AS (SELECT track, start_m AS lo, corner_id AS label FROM n UNION ALL SELECT track, end_m, 'S_post_' || corner_id FROM n WHERE nx IS NULL OR end_m < nx), l AS (SELECT track, arg_max(label, lo) AS last FROM s GROUP BY track) SELECT d.k, d.i, coalesce(s.label, l.last) AS corner FROM d ASOF LEFT JOIN s ON d.track = s.track AND d.dl >= s.lo JOIN l ON l.track = d.track")
def corner_labels(spark, d):
    return tra.labels(drive(spark, d), corners(spark), TRACK, "dl").select("k", "i", "corner")


ZONES = f", {CORNERS_SQL}, b AS (SELECT *, coalesce(lag(dl) OVER (PARTITION BY k ORDER BY t, i), dl) AS before, CASE WHEN n % 9 < 3 THEN 1 ELSE 0 END AS brake, 0.5 + 0.5 * sin(n / 4.0::DOUBLE) AS throttle, CASE WHEN obd THEN v END AS speed, abs(td - dl) AS off FROM d), m AS (SELECT b.*, z.corner_id, start_m, end_m, apex_m, second_m, CASE WHEN dl >= start_m AND dl <= end_m THEN 'in' WHEN dl < start_m AND dl >= start_m - 150 THEN 'lookback' WHEN dl > end_m AND before <= end_m THEN 'after' END AS zone FROM b JOIN z USING (track)), y AS (SELECT * FROM m WHERE zone IS NOT NULL)"


def channels(spark, d):
    """The driven laps with brake, throttle, and speed where the lap has an engine bus."""
    e = drive(spark, d)
    return e.withColumns({"brake": (F.col("n") % 9 < 3).cast("int"), "throttle": 0.5 + 0.5 * F.sin(F.col("n") / 4.0), "speed": F.when(F.col("obd"), F.col("v")), "gps_speed": F.col("gps"), "offset": F.abs(F.col("td") - F.col("dl")), "sigma": F.abs("e")})


@query(ZONES + " SELECT k, i, corner_id, zone FROM y")
def corner_zones(spark, d):
    return tra.zones(drive(spark, d), corners(spark), LAP, TRACK, ORDER, "dl").select("k", "i", "corner_id", "zone")


_V = "CASE WHEN bool_or(obd) OVER (PARTITION BY k) THEN speed ELSE gps END"
TRANSITS = ZONES + f""", p AS (SELECT *, {_V} AS sp FROM y),
a AS (SELECT k, corner_id, any_value(start_m) AS start_m, any_value(end_m) AS end_m, any_value(apex_m) AS apex_m, any_value(second_m) AS second_m, bool_or(obd) AS obd_present, count(*) FILTER (WHERE zone = 'in') AS n, arg_min(dl, (t, i)) FILTER (WHERE zone = 'in') AS entry_m, arg_max(dl, (t, i)) FILTER (WHERE zone = 'in') AS exit_m, max(t) FILTER (WHERE zone = 'in') - min(t) FILTER (WHERE zone = 'in') AS time_in, arg_min(dl, (sp, t, i)) FILTER (WHERE zone = 'in') AS min_speed_m, min(sp) FILTER (WHERE zone = 'in') AS min_speed, max(sp) FILTER (WHERE zone = 'in') AS max_speed, arg_min(lat_g, (-abs(lat_g), t, i)) FILTER (WHERE zone = 'in') AS lat_g_peak, arg_min(dl, (-abs(lat_g), t, i)) FILTER (WHERE zone = 'in') AS lat_g_peak_m, max(long_g) FILTER (WHERE zone = 'in') AS max_accel, min(long_g) FILTER (WHERE zone = 'in') AS max_decel, avg(throttle) FILTER (WHERE zone = 'in') AS mean_throttle, avg(CASE WHEN throttle >= 0.95 THEN 1.0 ELSE 0 END) FILTER (WHERE zone = 'in') AS share_open, avg(CAST(brake AS DOUBLE)) FILTER (WHERE zone = 'in') AS share_braking, arg_min(dl, (t, i)) FILTER (WHERE brake = 1) - any_value(start_m) AS brake_on, arg_max(dl, (t, i)) FILTER (WHERE brake = 1) - any_value(start_m) AS brake_off, arg_min(dl, (t, i)) FILTER (WHERE throttle < 0.8) - any_value(start_m) AS lift, arg_min(dl, (t, i)) FILTER (WHERE zone = 'in' AND dl >= apex_m AND throttle >= 0.95) - any_value(start_m) AS wide_open, median(off) FILTER (WHERE zone = 'in') AS offset_mid, max(off) FILTER (WHERE zone = 'in') AS offset_max,
 max((dl, t, i, sp)) FILTER (WHERE dl <= start_m) AS e0, min((dl, t, i, sp)) FILTER (WHERE dl >= start_m) AS e1, max((dl, t, i, sp)) FILTER (WHERE dl <= end_m) AS x0, min((dl, t, i, sp)) FILTER (WHERE dl >= end_m) AS x1, max((dl, t, i, sp)) FILTER (WHERE zone = 'in' AND dl <= apex_m) AS a0, min((dl, t, i, sp)) FILTER (WHERE zone = 'in' AND dl >= apex_m) AS a1 FROM p GROUP BY k, corner_id HAVING count(*) FILTER (WHERE zone = 'in') >= 3),
b2 AS (SELECT *, CASE WHEN e0[1] = e1[1] THEN e0[4] ELSE e0[4] + (e1[4] - e0[4]) * (start_m - e0[1]) / (e1[1] - e0[1]) END AS entry_speed, CASE WHEN x0[1] = x1[1] THEN x0[4] ELSE x0[4] + (x1[4] - x0[4]) * (end_m - x0[1]) / (x1[1] - x0[1]) END AS exit_speed, CASE WHEN a0[1] = a1[1] THEN a0[4] ELSE a0[4] + (a1[4] - a0[4]) * (apex_m - a0[1]) / (a1[1] - a0[1]) END AS apex_speed FROM a),
g0 AS (SELECT p.k, p.corner_id, p.t, p.i, p.dl, p.throttle > 0.8 AS h FROM p JOIN b2 USING (k, corner_id) WHERE zone = 'in' AND dl >= min_speed_m),
g1 AS (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER (PARTITION BY k, corner_id ORDER BY t, i) THEN 1 ELSE 0 END AS nw FROM g0), g2 AS (SELECT *, sum(nw) OVER (PARTITION BY k, corner_id ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS g FROM g1),
g3 AS (SELECT k, corner_id, g, min(t) AS t0, max(t) AS t1, min(dl) AS dl FROM g2 WHERE h GROUP BY ALL HAVING max(t) - min(t) >= 0.3), g4 AS (SELECT k, corner_id, arg_min(dl, t0) AS ret FROM g3 GROUP BY ALL),
tt AS (SELECT b2.*, ret - start_m AS throttle_return, min_speed_m - apex_m AS apex_offset FROM b2 LEFT JOIN g4 USING (k, corner_id))"""
NUMBERS = ("entry_m", "exit_m", "time_in", "min_speed", "min_speed_m", "max_speed", "lat_g_peak", "lat_g_peak_m", "max_accel", "max_decel", "mean_throttle", "share_open", "share_braking", "brake_on", "brake_off", "lift", "wide_open", "throttle_return", "offset_mid", "offset_max", "entry_speed", "exit_speed", "apex_speed", "apex_offset")


@query(TRANSITS + f" SELECT k, corner_id, n, obd_present, {q4(*NUMBERS)} FROM tt")
def corner_transits(spark, d):
    return tra.transits(channels(spark, d), corners(spark), LAP, TRACK, ORDER, "dl").select("k", "corner_id", "n", "obd_present", *r4(*NUMBERS))


@query(TRANSITS + ", f AS (SELECT k, count(*) FILTER (WHERE n % 29 = 10) AS jumps, avg(e) AS drift_x, avg(td - dl) AS drift_y FROM d GROUP BY k), s AS (SELECT k, corner_id, offset_max, f.jumps, sqrt(drift_x ** 2 + drift_y ** 2) AS drift FROM tt JOIN f USING (k)), r AS (SELECT *, coalesce(drift <= 20, false) AND coalesce(offset_max <= 40, false) AND coalesce(offset_max <= 40, false) AS ok FROM s) SELECT k, corner_id, jumps, round(drift, 4) AS drift, ok AS transit_reliable, bool_and(ok) OVER (PARTITION BY k) AS lap_reliable FROM r")
def corners_scored(spark, d):
    """Passages of laps with their flagged fixes and drift, and how far their places can be relied on."""
    e = channels(spark, d)
    passages = tra.transits(e, corners(spark), LAP, TRACK, ORDER, "dl")
    jumps = e.groupBy(*LAP).agg(F.count(F.when(F.col("n") % 29 == 10, 1)).alias("jumps"))
    drift = e.groupBy(*LAP).agg(F.hypot(F.avg("e"), F.avg(F.col("td") - F.col("dl"))).alias("drift"))
    rows = tra.session_corners(passages, passages.select(*LAP, "corner_id", F.lit("ok").alias("status")), jumps, drift, LAP)
    return tra.spatial_reliability(rows, LAP, "drift", "offset_max", "offset_max").select("k", "corner_id", "jumps", *r4("drift"), "transit_reliable", "lap_reliable")


def sigma_tier(spark, d):
    """Passages of laps with the verdict on the section of their corner, and the laps' roll-up; unknown where the corner has no section."""
    from lapwing.plans.trajectory_queries import trajectory_sections

    passages = tra.transits(channels(spark, d), corners(spark), LAP, TRACK, ORDER, "dl")
    verdicts = trajectory_sections(spark, d).select(F.col("k").alias("__k"), F.col("section").alias("__c"), "status", "rank_eligible")
    rows = passages.join(grown(verdicts), (F.col("k") == F.col("__k")) & (F.col("corner_id") == F.col("__c")), "left")
    return tra.sigma_reliability(rows, LAP).select("k", "corner_id", "status", "transit_reliable_traj", "lap_reliable_traj")


QUERIES["sigma_tier"] = sigma_tier
ORACLES["sigma_tier"] = ORACLES["corner_transits"].split(" SELECT k, corner_id, n, obd_present")[0] + f", sv AS ({SECTION_SQL}), sj AS (SELECT tt.k, tt.corner_id, sv.status, sv.rank_eligible AS r FROM tt LEFT JOIN sv ON sv.k = tt.k AND sv.section = tt.corner_id) SELECT k, corner_id, status, r AS transit_reliable_traj, CASE WHEN bool_or(NOT r) OVER (PARTITION BY k) THEN false WHEN bool_or(r) OVER (PARTITION BY k) THEN true END AS lap_reliable_traj FROM sj"


def lap_pockets(spark, d):
    """Each lap in a row, from its scored passages."""
    from lapwing.operators import scorecards as sc

    e = channels(spark, d)
    rows = tra.transits(e, corners(spark), LAP, TRACK, ORDER, "dl").withColumn("drift", F.col("k") % 25)
    rows = tra.spatial_reliability(rows, LAP, "drift", "offset_max", "offset_max").withColumn("pace_decile", (F.col("k") % 10).cast("int"))
    return sc.lap_pocket(rows, LAP).select("k", "pace_decile", "lap_reliable", "n_transits", "n_reliable_transits", *r4("max_speed"))


QUERIES["lap_pockets"] = lap_pockets
ORACLES["lap_pockets"] = ORACLES["corner_transits"].split(" SELECT k, corner_id, n, obd_present")[0] + ", pk AS (SELECT k, max_speed, k % 25 <= 20 AND coalesce(offset_max <= 40, false) AS ok FROM tt) SELECT k, CAST(k % 10 AS INTEGER) AS pace_decile, bool_and(ok) AS lap_reliable, count(*) AS n_transits, count(*) FILTER (WHERE ok) AS n_reliable_transits, round(max(max_speed), 4) AS max_speed FROM pk GROUP BY k"


LINE_SQL = ", ls AS (SELECT track, k, CAST(floor(n / 25) AS INTEGER) AS lap, 'C' || CAST((n // 10) % 7 AS VARCHAR) AS corner, k % 30 AS dis, e, x, CAST(n AS DOUBLE) AS n FROM d), lp AS (SELECT k, lap, corner, max(abs(e)) * 10 AS off FROM ls GROUP BY ALL), lk AS (SELECT ls.* FROM ls WHERE k % 17 <> 3 AND k % 13 <> 5 AND lap % 4 <> 0 AND dis <= 20 AND NOT EXISTS (SELECT 1 FROM lp WHERE lp.k = ls.k AND lp.lap = ls.lap AND lp.corner = ls.corner AND off > 40)) SELECT track, k, count(*) AS n, round(avg(45 + n * 1e-5::DOUBLE - (k % 5) / 111132.0::DOUBLE), 9) AS lat FROM lk GROUP BY ALL"


def line_input(spark, d):
    """Samples that a line may be made from: without excluded and unreliable sessions, unclean laps, drifting laps and glitched corners."""
    from lapwing.operators import centerline as cl

    e = drive(spark, d).withColumns({"session_id": F.col("k"), "lap": F.floor(F.col("n") / 25).cast("int"), "corner": F.concat(F.lit("C"), (F.floor(F.col("n") / 10) % 7).cast("string"))})
    e = e.withColumns({"gps_drift_disagreement_m": (F.col("k") % 30).cast("double"), "lat": 45 + F.col("n") * 1e-5, "long": F.lit(-122.0), "gps_drift_lat_m": (F.col("k") % 5).cast("double"), "gps_drift_lon_m": F.lit(0.0)})
    laps = e.select("session_id", "lap").distinct().withColumn("is_clean", F.col("lap") % 4 != 0)
    passages = e.groupBy("session_id", "lap", F.col("corner").alias("corner_id")).agg((F.max(F.abs("e")) * 10).alias("offset_max"))
    notes = e.select("session_id").distinct().select("session_id", (F.col("session_id") % 17 == 3).alias("exclude"), F.when(F.col("session_id") % 13 == 5, "gps_unreliable").alias("flag"))
    return cl.line_samples(e, laps, passages, notes, F.lit(45.0)).groupBy("track", "k").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 9).alias("lat"))


QUERIES["line_input"] = line_input
ORACLES["line_input"] = DRIVE + LINE_SQL


CAND = """, r0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY t, i) AS DOUBLE) AS row, count(*) OVER (PARTITION BY k) AS cnt, 0.5 + 0.5 * sin(n / 4.0::DOUBLE) AS throttle FROM d),
r1 AS (SELECT *, CASE WHEN bool_or(obd) OVER (PARTITION BY k) THEN v ELSE gps END AS sp, avg(lat_g) OVER (PARTITION BY k ORDER BY t, i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM r0 WHERE cnt >= 50),
r2 AS (SELECT *, abs(smooth) AS size FROM r1),
r3 AS (SELECT *, coalesce(last_value(CASE WHEN size < 0.2 THEN row END IGNORE NULLS) OVER (PARTITION BY k ORDER BY row ROWS UNBOUNDED PRECEDING), min(row) OVER (PARTITION BY k)) AS er, coalesce(first_value(CASE WHEN size < 0.2 THEN row END IGNORE NULLS) OVER (PARTITION BY k ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(row) OVER (PARTITION BY k)) AS xr, lag(size) OVER (PARTITION BY k ORDER BY row) AS pb, lead(size) OVER (PARTITION BY k ORDER BY row) AS pa FROM r2),
c0 AS (SELECT k, row AS pr, dl AS peak_m, smooth AS peak_g, er, xr, size FROM r3 WHERE size > pb AND size > pa AND size >= 0.4),
c1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr) AS candidate FROM c0 a WHERE NOT EXISTS (SELECT 1 FROM c0 b WHERE a.k = b.k AND a.pr <> b.pr AND abs(a.pr - b.pr) < 4 AND (b.size > a.size))),
c2 AS (SELECT c1.*, arg_min(dl, row) AS entry_m, arg_max(dl, row) AS exit_m, arg_max(t, row) - arg_min(t, row) AS duration, min(sp) AS min_speed, arg_min(dl, (sp, row)) AS min_speed_m, arg_min(row, (sp, row)) AS srow FROM c1 JOIN r3 ON c1.k = r3.k AND row >= c1.er AND row <= c1.xr GROUP BY ALL),
c3 AS (SELECT c2.k, candidate, arg_min(dl, row) FILTER (WHERE dl >= entry_m - 150 AND dl <= exit_m AND long_g < -0.12) AS b, arg_min(dl, row) FILTER (WHERE dl >= entry_m - 150 AND dl <= exit_m AND throttle < 0.8) AS l, arg_min(dl, row) FILTER (WHERE row >= c2.er AND row <= c2.xr AND row >= srow AND throttle > 0.8) AS r FROM c2 JOIN r3 ON c2.k = r3.k GROUP BY ALL)"""


@query(CAND + " SELECT k, candidate, round(peak_m, 4) AS peak_m, round(peak_g, 4) AS peak_g, CASE WHEN peak_g > 0 THEN 'right' ELSE 'left' END AS direction, round(entry_m, 4) AS entry_m, round(exit_m, 4) AS exit_m, round(duration, 4) AS duration, round(min_speed, 4) AS min_speed, round(min_speed_m, 4) AS min_speed_m, round(l - entry_m, 4) AS lift, round(r - entry_m, 4) AS throttle_return FROM c2 JOIN c3 USING (k, candidate)")
def corner_candidates(spark, d):
    e = channels(spark, d).withColumns({"lat": F.col("x"), "long": F.col("e")})
    got = tra.corner_candidates(e, LAP, ORDER, "dl", 4 / 3)
    return got.select("k", "candidate", "direction", *r4("peak_m", "peak_g", "entry_m", "exit_m", "duration", "min_speed", "min_speed_m", "lift", "throttle_return"))


ORACLES["gear_bands"] = """WITH RECURSIVE l AS (SELECT l_extendedprice / l_quantity / 10 AS r FROM lineitem WHERE l_quantity > 0 AND l_extendedprice / l_quantity / 10 BETWEEN 30 AND 260), b AS (SELECT min(r) AS lo, (max(r) - min(r)) / 230 AS w FROM l), h AS (SELECT least(CAST(floor((r - lo) / w) AS BIGINT), 229) AS bin, count(*) AS n FROM l, b GROUP BY 1), f AS (SELECT s.s AS bin, coalesce(n, 0) AS n FROM range(230) s(s) LEFT JOIN h ON h.bin = s.s), p AS (SELECT *, lag(n) OVER (ORDER BY bin) AS b, lead(n) OVER (ORDER BY bin) AS a, max(n) OVER () AS top FROM f), q AS (SELECT lo + (bin + 0.5::DOUBLE) * w AS c FROM p, b WHERE bin BETWEEN 1 AND 228 AND n >= p.b AND n > a AND n >= 0.005 * top),
m AS (SELECT min(c) AS c FROM q UNION ALL SELECT (SELECT min(q.c) FROM q WHERE q.c - m.c >= 8) FROM m WHERE m.c IS NOT NULL)
SELECT round(avg(r), 6) AS band FROM m JOIN l ON abs(l.r - m.c) < 4 WHERE m.c IS NOT NULL GROUP BY m.c"""


def gear_bands(spark, d):
    """Bands of the ratio of two channels, one row each."""
    ratio = F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity") / 10)
    found = gears.gear_bands(read(spark, d, "lineitem"), ratio)
    return spark.createDataFrame([(round(x, 6),) for x in found], "band double")


QUERIES["gear_bands"] = gear_bands

BANDS = [60.0, 90.0, 140.0]
GEARS = ", g0 AS (SELECT *, v / 0.44704 AS mph, CASE WHEN k % 13 = 5 THEN 0 ELSE v / 0.44704 * CASE WHEN n % 17 = 3 THEN 138 ELSE CASE (n // 12) % 3 WHEN 0 THEN 141 WHEN 1 THEN 92 ELSE 58 END END END AS rpm FROM d), g1 AS (SELECT *, CASE WHEN rpm > 1200 AND mph > 8 THEN 2 - CASE WHEN abs(rpm / mph - 60) <= least(abs(rpm / mph - 90), abs(rpm / mph - 140)) THEN 0 WHEN abs(rpm / mph - 90) <= abs(rpm / mph - 140) THEN 1 ELSE 2 END END AS raw FROM g0), g2 AS (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) OVER (PARTITION BY k ORDER BY t, i) OR row_number() OVER (PARTITION BY k ORDER BY t, i) = 1 THEN 1 ELSE 0 END AS nw FROM g1), g3 AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS g FROM g2), g4 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k, g) >= 2 THEN raw END AS sure FROM g3), g5 AS (SELECT *, CASE WHEN rpm <> 0 THEN last_value(sure IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) END AS gear FROM g4)"


def geared(spark, d):
    """The driven laps at a third of their times, so that the dwell is two samples, with engine speed and gear."""
    mph = F.col("v") / 0.44704
    ratio = F.when(F.col("n") % 17 == 3, 138.0).otherwise(F.element_at(F.array(F.lit(141.0), F.lit(92.0), F.lit(58.0)), (F.floor(F.col("n") / 12) % 3 + 1).cast("int")))
    e = drive(spark, d).withColumns({"mph": mph, "rpm": F.when(F.col("k") % 13 == 5, 0.0).otherwise(mph * ratio), "t": F.col("t") / 5})
    return gears.derive_gear(e, LAP, ORDER, "t", "rpm", "mph", BANDS)


@query(GEARS + " SELECT k, i, CAST(gear AS INTEGER) AS gear FROM g5")
def gear_runs(spark, d):
    return geared(spark, d).select("k", "i", "gear")


@query(GEARS + ", w AS (SELECT * FROM g5 WHERE dl >= 450 AND dl <= 1100), kn AS (SELECT *, lag(gear) OVER (PARTITION BY k ORDER BY t, i) AS pg FROM w WHERE gear IS NOT NULL), s AS (SELECT k, count(*) AS gn, count(*) FILTER (WHERE gear < pg) AS dn, min(dl) FILTER (WHERE gear < pg) AS ats, arg_max(gear, (t, i)) FILTER (WHERE dl <= 800) AS ag FROM kn GROUP BY k), l AS (SELECT k, count(*) AS n, max(rpm) AS mr FROM w GROUP BY k), x AS (SELECT l.*, coalesce(gn, 0) AS gn, dn, ats, ag, CASE WHEN n < 10 THEN 'ambiguous' WHEN mr = 0 THEN 'no-obd' WHEN coalesce(gn, 0) < 2 THEN 'ambiguous' WHEN dn = 0 THEN NULL WHEN dn > 1 THEN 'ambiguous' WHEN ats > 800 THEN 'traffic' END AS reason FROM l LEFT JOIN s USING (k)) SELECT k, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN dn = 0 THEN 'no-downshift' ELSE 'downshift' END AS label, reason, round(CASE WHEN n >= 10 AND mr <> 0 AND gn >= 2 AND dn = 1 THEN ats END, 4) AS shift_m, CAST(CASE WHEN n >= 10 AND mr <> 0 THEN ag END AS INTEGER) AS apex_gear FROM x")
def shift_classify(spark, d):
    return gears.shift_classes(geared(spark, d), LAP, ORDER, "dl", "rpm", "gear", 500.0, 800.0, 1100.0).select("k", "label", "reason", *r4("shift_m"), "apex_gear")
