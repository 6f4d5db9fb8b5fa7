"""Queries on whole laps: evidence, knots, trajectories, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import crossings as cross, trajectory as tr
from lapwing.plans.tables import BINS, CORRIDOR, DRIVE, SECTIONS_SQL, corridor, drive, section_table

QUERIES: dict = {}
ORACLES: dict = {}
LAP, ORDER, TRACK = ["track", "k"], ["t", "i"], ["track"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = DRIVE + sql
        return f

    return add


def six(*names: str):
    return [F.round(n, 5).alias(n) for n in names]


def r5(*names: str) -> str:
    return ", ".join(f"round({n}, 5) AS {n}" for n in names)


EVIDENCE = """, v1 AS (SELECT *, td - dl AS delta, median(td - dl) OVER (PARTITION BY k) AS lapm, CASE WHEN row_number() OVER w = 1 THEN true ELSE coalesce(abs(td - lag(td) OVER w) > 0.01, false) END AS fresh FROM d WINDOW w AS (PARTITION BY k ORDER BY t, i)),
v2 AS (SELECT *, fresh AND coalesce(abs(delta - lapm) < 200, false) AS seen, CASE WHEN fresh AND abs(delta - lapm) < 200 THEN delta END AS dd FROM v1),
v3 AS (SELECT *, CASE WHEN count(dd) OVER w >= 5 THEN median(dd) OVER w END AS m FROM v2 WINDOW w AS (PARTITION BY k ORDER BY t, i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
v4 AS (SELECT *, abs(dd - m) AS away FROM v3),
v5 AS (SELECT *, CASE WHEN count(away) OVER w >= 5 THEN median(away) OVER w END AS mad FROM v4 WINDOW w AS (PARTITION BY k ORDER BY t, i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
v6 AS (SELECT *, seen AND coalesce(away <= greatest(15, 5 * coalesce(1.4826 * mad, 3)), false) AS ok FROM v5),
v7 AS (SELECT *, median(CASE WHEN ok THEN delta END) OVER (PARTITION BY k) AS cm, coalesce(abs(lapm) > 150, true) AS rescale_invalid FROM v6),
v8 AS (SELECT *, ok AND coalesce(abs(delta - cm) < 60, false) AND NOT rescale_invalid AS ev0 FROM v7),
v9 AS (SELECT *, coalesce(last_value(CASE WHEN fresh THEN n % 31 = 4 END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING), false) AS held FROM v8),
v AS (SELECT * REPLACE (ev0 AND NOT held AS ev0) FROM v9)"""


def marked(spark, d):
    """Samples with evidence, of which some fixes were flagged."""
    e = tr.evidence(drive(spark, d), LAP, ORDER, "dl", "td").withColumn("flag", F.col("n") % 31 == 4)
    return tr.without_flagged(e, LAP, ORDER, "flag")


@query(EVIDENCE + " SELECT k, i, round(delta, 5) AS delta, fresh, ev0 AS evidence, rescale_invalid, held AS held_by_flag FROM v")
def lap_evidence(spark, d):
    return marked(spark, d).select("k", "i", *six("delta"), "fresh", "evidence", "rescale_invalid", "held_by_flag")


@query(" SELECT k, round(CASE WHEN count(*) FILTER (WHERE gps > 15 AND v > 15) >= 50 THEN median(gps / v) FILTER (WHERE gps > 15 AND v > 15) ELSE 1 END, 5) AS scale FROM d GROUP BY k")
def speed_scale(spark, d):
    return tr.speed_scale(drive(spark, d), ["k"], "gps", "v").select("k", *six("scale"))


WEIGHTS = EVIDENCE + f", {CORRIDOR}, w AS (SELECT v.*, exp(-power(greatest(0, e_lo - e, e - e_hi) / 5, 2)) AS w FROM v JOIN c ON v.track = c.track AND c.bin = greatest(least(round_even(v.td / 10, 0), {BINS - 1}), 0))"


@query(WEIGHTS + " SELECT k, i, round(w, 5) AS w FROM w")
def envelope_weights(spark, d):
    return tr.envelope_weight(drive(spark, d), corridor(spark), BINS, "td", "e", track=TRACK).select("k", "i", *six("w"))


SPINE = WEIGHTS + ", e0 AS (SELECT track, k, min(dl) AS lo, max(dl) AS hi FROM d GROUP BY ALL), s AS (SELECT track, k, CAST(unnest(range(greatest(CAST(ceil((hi - lo) / 10) AS BIGINT), 1))) AS INTEGER) AS j, lo FROM e0), k0 AS (SELECT track, k, j, lo + 10.0::DOUBLE * j AS knot FROM s)"
_PASS = """, a{n} AS (SELECT k, j, sum(w) AS tot, sum(w * x) / sum(w) AS xm, sum(w * z) / sum(w) AS zm FROM p{n} GROUP BY ALL HAVING sum(w) >= 1e-9),
b{n} AS (SELECT p.k, p.j, any_value(xm) AS xm, any_value(zm) AS zm, sum(w * (x - xm) ** 2) AS sxx, sum(w * (x - xm) * (z - zm)) AS sxz FROM p{n} p JOIN a{n} USING (k, j) GROUP BY ALL),
r{n} AS (SELECT p.k, p.j, p.x, p.z, p.w0, p.w, zm, z - zm - CASE WHEN sxx > 1e-9 THEN sxz / sxx ELSE 0 END * (x - xm) AS r FROM p{n} p JOIN b{n} USING (k, j)),
m{n} AS (SELECT k, j, median(r) AS rm FROM r{n} GROUP BY ALL), q{n} AS (SELECT r.k, r.j, 1.4826 * median(abs(r - rm)) AS mad FROM r{n} r JOIN m{n} USING (k, j) GROUP BY ALL),
p{m} AS (SELECT k, j, x, z, w0, w0 * CASE WHEN abs(r) > 3 * (mad + 0.5) THEN 3 * (mad + 0.5) / abs(r) ELSE 1 END AS w, zm AS fit, mad FROM r{n} JOIN q{n} USING (k, j))"""
FIT = SPINE + ", p0 AS (SELECT k0.k, k0.j, w.dl - knot AS x, w.delta AS z, w.w * (1 - abs((w.dl - knot) / 60) ** 3) ** 3 AS w0 FROM w JOIN k0 ON w.k = k0.k AND abs(w.dl - knot) < 60 WHERE ev0), p1 AS (SELECT *, w0 AS w FROM p0 WHERE (k, j) IN (SELECT (k, j) FROM p0 GROUP BY k, j HAVING count(*) >= 3))" + _PASS.format(n=1, m=2) + _PASS.format(n=2, m=3) + ", f AS (SELECT k, j, any_value(fit) AS fit, greatest(any_value(mad), 3) / sqrt(greatest(sum(w) ** 2 / sum(w * w), 1e-9)) AS se, sum(w) ** 2 / sum(w * w) AS n_eff FROM p3 GROUP BY ALL HAVING sum(w) >= 1e-6)"


@query(FIT + f" SELECT k, j, {r5('fit', 'se', 'n_eff')} FROM f")
def knot_fit(spark, d):
    seen = tr.envelope_weight(marked(spark, d), corridor(spark), BINS, "td", "e", track=TRACK)
    return tr.knot_fit(seen.where("evidence"), tr.knot_spine(seen, LAP, "dl"), LAP, "dl", "delta", "w").select("k", "j", *six("fit", "se", "n_eff"))


BOUND = ", kb AS (SELECT k0.k, k0.j, median(abs(d.lat_g) * 9.81 / greatest(d.v, 8) ** 2) AS kappa FROM k0 JOIN d ON d.k = k0.k AND abs(d.dl - k0.knot) < 30 GROUP BY ALL), bd AS (SELECT k0.k, k0.j, k0.knot, least(coalesce(kappa, 0) * 20 + 0.1, 0.8) AS bound FROM k0 LEFT JOIN kb USING (k, j))"


@query(SPINE + BOUND + " SELECT k, j, round(bound, 5) AS bound FROM bd")
def slope_bounds(spark, d):
    e = drive(spark, d)
    return tr.slope_bound(e, tr.knot_spine(e, LAP, "dl"), LAP, "dl", "v", "lat_g").select("k", "j", *six("bound"))


KNOTS = FIT + BOUND + """, g1 AS (SELECT bd.*, fit, se, min(knot) OVER l AS klo, max(knot) OVER l AS khi, count(*) OVER l AS size, count(fit) OVER l AS nf FROM bd LEFT JOIN f USING (k, j) WINDOW l AS (PARTITION BY k)),
g2 AS (SELECT *, last_value(CASE WHEN fit IS NOT NULL THEN knot END IGNORE NULLS) OVER p AS xa, last_value(fit IGNORE NULLS) OVER p AS ya, first_value(CASE WHEN fit IS NOT NULL THEN knot END IGNORE NULLS) OVER q AS xb, first_value(fit IGNORE NULLS) OVER q AS yb FROM g1 WINDOW p AS (PARTITION BY k ORDER BY j ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY k ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g3 AS (SELECT *, CASE WHEN nf < 2 THEN 0 WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = xb THEN ya ELSE ya + (yb - ya) * (knot - xa) / (xb - xa) END AS z FROM g2),
fw AS (WITH RECURSIVE fw AS (SELECT k, j, z AS y FROM g3 WHERE j = 0 UNION ALL SELECT g3.k, g3.j, greatest(least(g3.z, fw.y + g3.bound * 10), fw.y - g3.bound * 10) FROM fw JOIN g3 ON g3.k = fw.k AND g3.j = fw.j + 1) SELECT * FROM fw),
bw AS (WITH RECURSIVE bw AS (SELECT k, j, z AS y FROM g3 WHERE j = size - 1 UNION ALL SELECT g3.k, g3.j, greatest(least(g3.z, bw.y + g3.bound * 10), bw.y - g3.bound * 10) FROM bw JOIN g3 ON g3.k = bw.k AND g3.j = bw.j - 1) SELECT * FROM bw),
g4 AS (SELECT g3.*, (fw.y + bw.y) / 2 AS y FROM g3 JOIN fw USING (k, j) JOIN bw USING (k, j)),
ge AS (SELECT g4.k, g4.j, min(abs(v.dl - g4.knot)) AS gap FROM g4 JOIN v ON v.k = g4.k AND v.ev0 GROUP BY ALL),
gb AS (SELECT k, bool_or(rescale_invalid) OR NOT bool_or(ev0) AS bare FROM v GROUP BY k),
g5 AS (SELECT g4.*, bare OR size < 2 AS bare, sqrt(least(coalesce(se, 15), 15) ** 2 + (bound * coalesce(gap, 1e4)) ** 2 + (z - y) ** 2) AS own, CASE WHEN khi > klo THEN least(greatest(2 + 4.5 * least(knot - klo, khi - knot) / 200, 2), 6.5) ELSE 6.5 END AS prior FROM g4 LEFT JOIN ge USING (k, j) JOIN gb USING (k)),
g6 AS (SELECT *, 1 / greatest(own, 0.5) ** 2 AS pe, 1 / prior ** 2 AS pp FROM g5),
kn AS (SELECT k, j, knot, klo, size, own, prior, CASE WHEN bare THEN 0 ELSE y * pe / (pe + pp) END AS delta, greatest(CASE WHEN bare THEN prior ELSE sqrt(1 / (pe + pp)) END, 1) AS sigma FROM g6)"""


def estimated(spark, d):
    """(samples, knots) of all laps."""
    e = drive(spark, d).withColumn("flag", F.col("n") % 31 == 4)
    return tr.estimate(e, LAP, ORDER, "dl", "td", "v", "lat_g", "e", F.col("obd"), corridor(spark), BINS, "flag", TRACK)


@query(KNOTS + f" SELECT k, j, {r5('knot', 'delta', 'sigma')} FROM kn")
def knot_sigma_blend(spark, d):
    return estimated(spark, d)[1].select("k", "j", *six("knot", "delta", "sigma"))


SAMPLES = KNOTS + """, ss AS (SELECT v.*, greatest(0, least(CAST(floor((dl - klo) / 10) AS INTEGER), size - 1)) AS j0, size FROM v JOIN (SELECT DISTINCT k, klo, size FROM kn) USING (k)),
st AS (SELECT ss.track, ss.k, ss.i, ss.t, ss.v, ss.dl, ss.e, ss.long_g, ss.lat_g, ss.obd, ss.rescale_invalid, a.delta + (b.delta - a.delta) * CASE WHEN b.knot > a.knot THEN greatest(0, least(1, (ss.dl - a.knot) / (b.knot - a.knot))) ELSE 0 END AS delta_hat, a.sigma + (b.sigma - a.sigma) * CASE WHEN b.knot > a.knot THEN greatest(0, least(1, (ss.dl - a.knot) / (b.knot - a.knot))) ELSE 0 END AS sigma_m FROM ss JOIN kn a ON a.k = ss.k AND a.j = ss.j0 JOIN kn b ON b.k = ss.k AND b.j = least(ss.j0 + 1, ss.size - 1)),
sm AS (SELECT *, max(dl + delta_hat) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS s_hat, CASE WHEN rescale_invalid THEN 'rescale_invalid' WHEN bool_or(obd) OVER (PARTITION BY k) THEN 'ok' ELSE 'gps_backbone' END AS status FROM st)"""


@query(SAMPLES + f" SELECT k, i, {r5('delta_hat', 'sigma_m', 's_hat')}, status FROM sm")
def trajectory_samples(spark, d):
    return estimated(spark, d)[0].select("k", "i", *six("delta_hat", "sigma_m", "s_hat"), "status")


CROSS = SAMPLES + f""", {SECTIONS_SQL},
x0 AS (SELECT l.track, l.k, l.status, section, a, b, a >= lo AND b <= hi AND b > a AS covered FROM (SELECT track, k, any_value(status) AS status, min(s_hat) AS lo, max(s_hat) AS hi FROM sm GROUP BY ALL) l JOIN z USING (track)),
x1 AS (SELECT k, section, 'a' AS fin, a AS x FROM x0 WHERE covered UNION ALL SELECT k, section, 'b', b FROM x0 WHERE covered),
sl AS (SELECT k, s_hat, max(t) AS t, arg_max(v, t) AS v, arg_max(dl, t) AS dl, arg_max(delta_hat, t) AS delta_hat FROM sm GROUP BY ALL),
sr AS (SELECT k, s_hat, min(t) AS t, arg_min(v, t) AS v, arg_min(dl, t) AS dl, arg_min(delta_hat, t) AS delta_hat FROM sm GROUP BY ALL),
x2 AS (SELECT x1.*, l.s_hat AS ls, l.t AS lt, l.v AS lv, l.dl AS ldl, l.delta_hat AS lde FROM x1 ASOF JOIN sl l ON l.k = x1.k AND x1.x >= l.s_hat),
x3 AS (SELECT x2.*, r.s_hat AS rs, r.t AS rt, r.v AS rv, r.dl AS rdl, r.delta_hat AS rde FROM x2 ASOF LEFT JOIN sr r ON r.k = x2.k AND x2.x < r.s_hat),
x4 AS (SELECT k, section, fin, x, CASE WHEN rs IS NULL THEN 0 ELSE (x - ls) / (rs - ls) END AS p, * EXCLUDE (k, section, fin, x) FROM x3),
x5 AS (SELECT k, section, fin, x, CASE WHEN rs IS NULL THEN lt ELSE lt + (rt - lt) * p END AS t, CASE WHEN rs IS NULL THEN lv ELSE lv + (rv - lv) * p END AS v, CASE WHEN rs IS NULL THEN ldl ELSE ldl + (rdl - ldl) * p END AS dl, CASE WHEN rs IS NULL THEN lde ELSE lde + (rde - lde) * p END AS delta FROM x4),
x6 AS (SELECT x5.*, greatest(0, least(CAST(floor((dl - klo) / 10) AS INTEGER), size - 1)) AS j0, size FROM x5 JOIN (SELECT DISTINCT k, klo, size FROM kn) USING (k)),
x7 AS (SELECT x6.*, a.sigma + (b.sigma - a.sigma) * CASE WHEN b.knot > a.knot THEN greatest(0, least(1, (x6.dl - a.knot) / (b.knot - a.knot))) ELSE 0 END AS sig FROM x6 JOIN kn a ON a.k = x6.k AND a.j = x6.j0 JOIN kn b ON b.k = x6.k AND b.j = least(x6.j0 + 1, x6.size - 1)),
od AS (SELECT k, dl, max(t) AS t FROM sm GROUP BY ALL),
o1 AS (SELECT x1.*, o.dl AS ls, o.t AS lt FROM x1 ASOF LEFT JOIN od o ON o.k = x1.k AND x1.x >= o.dl), o2 AS (SELECT o1.*, o.dl AS rs, o.t AS rt FROM o1 ASOF LEFT JOIN od o ON o.k = o1.k AND o1.x < o.dl),
o3 AS (SELECT k, section, fin, CASE WHEN ls IS NULL THEN rt WHEN rs IS NULL THEN lt ELSE lt + (rt - lt) * (x - ls) / (rs - ls) END AS odo FROM o2),
x8 AS (SELECT x7.*, odo FROM x7 JOIN o3 USING (k, section, fin)),
cr AS (SELECT x0.*, a.t AS t_a, b.t AS t_b, b.t - a.t AS seconds, a.v AS v_a, b.v AS v_b, a.sig AS sig_a, b.sig AS sig_b, a.delta AS delta_a, b.delta AS delta_b, b.dl - a.dl AS driven, b.odo - a.odo AS odometer_s FROM x0 LEFT JOIN x8 a ON a.k = x0.k AND a.section = x0.section AND a.fin = 'a' LEFT JOIN x8 b ON b.k = x0.k AND b.section = x0.section AND b.fin = 'b')"""


@query(CROSS + f" SELECT k, section, covered, {r5('seconds', 'driven', 'odometer_s', 'v_a', 'v_b', 'sig_a', 'sig_b')}, abs(seconds - odometer_s) <= (abs(delta_a) + abs(delta_b)) / ((greatest(v_a, 8) + greatest(v_b, 8)) / 2) + 0.2 AS speed_consistent FROM cr")
def section_crossings(spark, d):
    s, k = estimated(spark, d)
    rows = cross.tripwire(cross.crossings(s, k, section_table(spark), LAP, TRACK))
    return rows.select("k", "section", "covered", *six("seconds", "driven", "odometer_s", "v_a", "v_b", "sig_a", "sig_b"), "speed_consistent")


RESID = CROSS + f""", l1 AS (SELECT cr.k, cr.section, CAST(greatest(least(round_even(s_hat / 10, 0), {BINS - 1}), 0) AS INTEGER) AS bin, median(sm.e) AS e, count(*) AS n FROM cr JOIN sm ON sm.k = cr.k AND s_hat >= a AND s_hat <= b WHERE covered AND sm.e IS NOT NULL GROUP BY ALL),
l2 AS (SELECT k, section FROM l1 GROUP BY ALL HAVING sum(n) >= 5),
l3 AS (SELECT cr.track, cr.k, cr.section, CAST(unnest(generate_series(CAST(floor(a / 10) AS BIGINT), CAST(floor(b / 10) AS BIGINT))) AS INTEGER) AS bin FROM cr JOIN l2 USING (k, section)),
l4 AS (SELECT l3.*, e FROM l3 LEFT JOIN l1 USING (k, section, bin)),
l5 AS (SELECT *, last_value(CASE WHEN e IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS xa, last_value(e IGNORE NULLS) OVER p AS ya, first_value(CASE WHEN e IS NOT NULL THEN bin END IGNORE NULLS) OVER q AS xb, first_value(e IGNORE NULLS) OVER q AS yb FROM l4 WINDOW p AS (PARTITION BY k, section ORDER BY bin ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY k, section ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l6 AS (SELECT track, k, section, bin, CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = xb THEN ya ELSE ya + (yb - ya) * (bin - xa) / (xb - xa) END AS e FROM l5),
l7 AS (SELECT k, section, sum(kappa * e) * 10 AS swept FROM l6 JOIN c USING (track, bin) GROUP BY ALL),
h0 AS (SELECT z.track, z.section, coalesce(sum(abs(kappa)), 0) * 10 AS heading FROM z LEFT JOIN c ON c.track = z.track AND c.bin * 10 >= z.a AND c.bin * 10 <= z.b GROUP BY ALL),
rs AS (SELECT cr.*, heading, driven - (b - a + swept) AS resid FROM cr LEFT JOIN l7 USING (k, section) JOIN h0 ON h0.track = cr.track AND h0.section = cr.section)"""


@query(RESID + f" SELECT k, section, {r5('resid', 'heading')} FROM rs")
def line_residuals(spark, d):
    s, k = estimated(spark, d)
    rows = cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)
    return rows.select("k", "section", *six("resid", "heading"))


VERDICT = RESID + """, vd AS (SELECT *, coalesce(status = 'gps_backbone', false) AS gps, (greatest(v_a, 8) + greatest(v_b, 8)) / 2 AS vm, heading * 3.2 + 10.3 AS band, driven - (b - a) AS off FROM rs),
ve AS (SELECT *, CASE WHEN covered THEN sqrt(greatest(0, (sig_a ** 2 + sig_b ** 2 - 2 * 0.66 * sig_a * sig_b) / (greatest(v_a, 8) * greatest(v_b, 8))) + (greatest(0, abs(off) - band) / vm) ** 2 + coalesce((greatest(0, abs(resid) - 10.2) / vm) ** 2, 0)) END AS sigma_t FROM vd),
vf AS (SELECT *, CASE WHEN NOT covered THEN 'C' WHEN gps AND sigma_t <= 0.1 THEN 'B' WHEN sigma_t <= 0.1 THEN 'A' WHEN sigma_t <= 0.3 THEN 'B' ELSE 'C' END AS tier, CASE WHEN NOT covered THEN 'no_coverage' WHEN status = 'rescale_invalid' THEN 'rescale_invalid' ELSE 'ok' END AS outcome FROM ve)"""


@query(VERDICT + " SELECT k, section, round(seconds, 5) AS seconds, round(sigma_t, 5) AS sigma_t, tier, outcome AS status, tier = 'A' AND outcome = 'ok' AS rank_eligible FROM vf")
def trajectory_sections(spark, d):
    """Section times of every lap on its trajectory; without references, laps on GPS alone stay below tier A."""
    s, k = estimated(spark, d)
    rows = cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)
    return rows.select("k", "section", *six("seconds", "sigma_t"), "tier", "status", "rank_eligible")


_MIDDLE = "sum((b2 - a2) * (({c} + ({c}1 - {c}) * (a2 - t) / (t1 - t)) + ({c} + ({c}1 - {c}) * (b2 - t) / (t1 - t))) / 2)"
ACCEL = CROSS + f""", ap AS (SELECT k, t, long_g AS g, lat_g AS s, lead(t) OVER w AS t1, lead(long_g) OVER w AS g1, lead(lat_g) OVER w AS s1 FROM sm WINDOW w AS (PARTITION BY k ORDER BY t, i)),
aq AS (SELECT cr.k, cr.section, ap.*, greatest(ap.t, t_a) AS a2, least(t1, t_b) AS b2 FROM cr JOIN ap ON ap.k = cr.k WHERE covered AND t1 IS NOT NULL AND greatest(ap.t, t_a) < least(t1, t_b)),
ai AS (SELECT k, section, {_MIDDLE.format(c="g")} AS il, {_MIDDLE.format(c="s")} AS ia FROM aq GROUP BY ALL), an AS (SELECT cr.k, cr.section, count(*) AS n FROM cr JOIN sm ON sm.k = cr.k AND sm.t >= t_a AND sm.t <= t_b WHERE covered GROUP BY ALL HAVING count(*) >= 2),
af AS (SELECT cr.*, CASE WHEN an.n IS NOT NULL THEN v_b - v_a - 9.80665 * il END AS raw, CASE WHEN an.n IS NOT NULL THEN ia END AS ia FROM cr LEFT JOIN ai USING (k, section) LEFT JOIN an USING (k, section)),
am AS (SELECT track, section, median(raw) AS m FROM af WHERE status = 'ok' AND raw IS NOT NULL GROUP BY ALL), ar AS (SELECT track, section, round(any_value(m), 2) AS off, ceil(quantile_cont(abs(raw - m), 0.99) * 10 - 1e-9) / 10 AS tol FROM af JOIN am USING (track, section) WHERE status = 'ok' AND raw IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
ac AS (SELECT af.k, af.section, raw, off, tol, CASE WHEN af.k % 7 <> 6 THEN -9.80665 * ((af.k % 5 - 2) / 1000.0::DOUBLE * seconds + (af.k % 3 - 1) / 100.0::DOUBLE * ia) END AS corr FROM af LEFT JOIN ar USING (track, section))"""


@query(ACCEL + " SELECT k, section, round(raw, 5) AS accel_raw, round(corr, 5) + 0.0 AS correction, round(raw - corr - off, 5) AS accel_value, tol AS accel_tol FROM ac")
def accel_checks(spark, d):
    """Sections of laps against their corner's reference, derived from laps with a good ruler, and their session's calibration, which some lack."""
    from lapwing.operators import fits

    s, k = estimated(spark, d)
    rows = cross.accel_features(cross.crossings(s, k, section_table(spark), LAP, TRACK), s, LAP, "i")
    refs = fits.residual_references(rows.where("lap_status = 'ok'"), ["track", "section"], "accel_raw", 3)
    own = F.col("k")
    sessions = s.select("k").distinct().where("k % 7 <> 6").select("k", ((own % 5 - 2) / 1000.0).alias("b_g"), ((own % 3 - 1) / 100.0).alias("psi"))
    return cross.accel_check(rows, refs, sessions, ["k"], TRACK).select("k", "section", *six("accel_raw", "accel_value"), (F.round("correction", 5) + 0.0).alias("correction"), "accel_tol")


@query(EVIDENCE + f", {SECTIONS_SQL}, ge AS (SELECT v.k, section, median(delta) FILTER (WHERE abs(td - a) < 60) AS da, median(delta) FILTER (WHERE abs(td - b) < 60) AS db FROM v JOIN z ON v.track = z.track WHERE ev0 AND (abs(td - a) < 60 OR abs(td - b) < 60) GROUP BY ALL) SELECT k, section, round(da, 5) AS delta_a, round(db, 5) AS delta_b FROM ge WHERE da IS NOT NULL AND db IS NOT NULL")
def gate_offsets(spark, d):
    from lapwing.operators import scorecards as sc

    return sc.gate_offsets(marked(spark, d), section_table(spark), LAP, TRACK, "td", "delta", "evidence", 60.0).select("k", "section", *six("delta_a", "delta_b"))


@query(SAMPLES + ", lt AS (SELECT k, max(t) - min(t) AS x FROM sm GROUP BY k), le AS (SELECT quantile_cont(x, 0.1) AS e FROM lt), lq AS (SELECT k FROM lt, le WHERE x <= e) SELECT CAST(track AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS lap_key, i, round(s_hat, 5) AS s_hat FROM sm JOIN lq USING (k)")
def decile_traces(spark, d):
    """Samples of the fastest tenth of the laps, with their places on the ruler."""
    from lapwing.operators import robust, scorecards as sc

    s = estimated(spark, d)[0]
    laps = s.groupBy(*LAP).agg((F.max("t") - F.min("t")).alias("x"))
    laps = robust.quantile_bucket(laps, [], "x", 10, F.lit(True), "pace_decile")
    return sc.decile_traces(s, laps, LAP).select("lap_key", "i", *six("s_hat"))


def timed(spark, d):
    s, k = estimated(spark, d)
    return cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)


@query(VERDICT + """, au AS (SELECT k, section, a, tier = 'A' AND outcome = 'ok' AS r, section || ': tier ' || tier || CASE WHEN sigma_t IS NOT NULL THEN printf(', sigma %.2f s', sigma_t) ELSE '' END || coalesce('; ' || nullif(array_to_string(list_filter([CASE WHEN covered AND gps THEN 'accelerometer and speed disagree' END, CASE WHEN covered AND abs(off) > band THEN 'driven distance out of band' END, CASE WHEN covered AND coalesce(abs(resid) > 10.2, false) THEN 'line does not explain the distance' END, CASE WHEN NOT covered THEN 'not covered' END], lambda x: x IS NOT NULL), ', '), ''), '') || CASE WHEN outcome = 'ok' THEN '' ELSE '; ' || outcome END AS why FROM vf)
SELECT k, count(*) AS sections, count(*) FILTER (WHERE r) AS ranked, coalesce(string_agg(why, chr(10) ORDER BY a, section) FILTER (WHERE NOT r), '') AS audit FROM au GROUP BY k""")
def lap_audits(spark, d):
    """Each lap with a line on every section that it may not rank in."""
    from lapwing.operators import scorecards as sc

    return sc.lap_audits(timed(spark, d), LAP).select("k", "sections", "ranked", "audit")


@query(VERDICT + ", ca AS (SELECT k % 2 AS track, k, CAST(k AS VARCHAR) AS name, 'T1' AS section, 5.0 + k % 10 AS lo, 15.0 + k % 10 AS hi, ['A', 'not_A', 'C_wide', 'any'][1 + k % 4] AS want FROM (SELECT DISTINCT k FROM vf) UNION ALL SELECT k % 2, k, k || ' lost', 'T8', 0.0, 1.0, 'any' FROM (SELECT DISTINCT k FROM vf) WHERE k % 5 = 0), cb AS (SELECT ca.name, vf.seconds, vf.tier, vf.k IS NULL AS lost, coalesce(vf.seconds BETWEEN lo AND hi, false) AS v, CASE want WHEN 'any' THEN true WHEN 'A' THEN tier = 'A' WHEN 'not_A' THEN tier <> 'A' ELSE tier = 'C' AND coalesce(sigma_t >= 0.25, false) END AS w FROM ca LEFT JOIN vf ON vf.k = ca.k AND vf.section = ca.section) SELECT name AS \"case\", round(seconds, 5) AS seconds, tier, CASE WHEN lost THEN 'missing' WHEN v AND w THEN 'ok' WHEN v THEN 'tier' WHEN w THEN 'value' ELSE 'value, tier' END AS outcome FROM cb")
def canonical_cases(spark, d):
    """Expected values and tiers of each lap's first section, told by a rule on its number, against what came out."""
    from lapwing.operators import scorecards as sc

    times = timed(spark, d)
    k = F.col("k")
    want = F.element_at(F.array(*[F.lit(x) for x in ("A", "not_A", "C_wide", "any")]), (k % 4 + 1).cast("int"))
    laps = times.select(*LAP).distinct()
    cases = laps.select("track", "k", k.cast("string").alias("case"), F.lit("T1").alias("section"), (5.0 + k % 10).alias("lo"), (15.0 + k % 10).alias("hi"), want.alias("want"))
    lost = laps.where("k % 5 = 0").select("track", "k", F.concat(k.cast("string"), F.lit(" lost")).alias("case"), F.lit("T8").alias("section"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit("any").alias("want"))
    return sc.canonical_cases(times, cases.unionByName(lost), LAP).select("case", *six("seconds"), "tier", "outcome")


@query(VERDICT + ", ms AS (SELECT vf.k, vf.section, avg(sm.v) AS m FROM vf JOIN sm ON sm.k = vf.k AND s_hat >= vf.a AND s_hat <= vf.b GROUP BY ALL) SELECT vf.k, vf.section, round(m, 5) AS mean_speed, round(off, 5) AS dev, round(band, 5) AS band, round(sigma_t, 5) AS sigma_t, tier FROM vf LEFT JOIN ms USING (k, section)")
def battery_table(spark, d):
    """Sections of laps with their mean speed, deviation, band and sigma."""
    from lapwing.operators import scorecards as sc

    s, k = estimated(spark, d)
    times = cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)
    return sc.battery(s, times, LAP, "s_hat", "v", "gps").select("k", "section", *six("mean_speed", "dev", "band", "sigma_t"), "tier")


#: Corners of both tracks, and the window from the first to the second of each.
RANGE = [(0, "T1", 100.0, 400.0), (0, "T2", 450.0, 900.0), (0, "T3", 1200.0, 1600.0), (1, "T1", 50.0, 300.0), (1, "T2", 320.0, 700.0)]
RANGE_SQL = "zc AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{c}', {a}::DOUBLE, {b}::DOUBLE)" for t, c, a, b in RANGE) + ") v(track, corner, s, e)), zn AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY track ORDER BY s), 3900.0::DOUBLE) AS nx FROM zc), z AS (SELECT track, 'T1..T2' AS section, greatest(0, min(s) - 50) AS a, max(least(nx, e + 250)) FILTER (WHERE corner = 'T2') AS b FROM zn WHERE corner IN ('T1', 'T2') GROUP BY track)"
VERDICT_COLUMNS = " SELECT k, section, round(seconds, 5) AS seconds, round(sigma_t, 5) AS sigma_t, tier, outcome AS status, tier = 'A' AND outcome = 'ok' AS rank_eligible FROM vf"


@query(VERDICT.replace(SECTIONS_SQL, RANGE_SQL) + VERDICT_COLUMNS)
def range_sections(spark, d):
    """Times across two corners of every lap."""
    s, k = estimated(spark, d)
    corners = spark.createDataFrame(RANGE, "track int, corner_id string, start_m double, end_m double")
    rows = cross.range_times(s.withColumnRenamed("e", "e_lat"), k, corners, F.lit(3900.0), corridor(spark), LAP, TRACK, "T1", "T2", "i", BINS)
    return rows.select("k", "section", *six("seconds", "sigma_t"), "tier", "status", "rank_eligible")


SPAN_SQL = "z AS (SELECT track, 'span' AS section, 200.0::DOUBLE AS a, 1200.0::DOUBLE AS b FROM (VALUES (0), (1)) v(track))"
COLD_SQL = f"c AS (SELECT CAST(t.t AS INTEGER) AS track, CAST(b.b AS INTEGER) AS bin, -15.0::DOUBLE AS e_lo, 15.0::DOUBLE AS e_hi, 0.0::DOUBLE AS kappa FROM range(2) t(t), range({BINS}) b(b))"


@query(VERDICT.replace(SECTIONS_SQL, SPAN_SQL).replace(CORRIDOR, COLD_SQL).replace("n % 31 = 4", "false") + VERDICT_COLUMNS)
def span_sections(spark, d):
    """Times between two places of every lap, on the plain band around one line."""
    line = spark.range(BINS * 10).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("track"), F.col("id").cast("int").alias("bin"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    names = {"dl": "dl", "td": "td", "v": "v", "lat_g": "lat_g", "e": "e"}
    rows = cross.span_times(drive(spark, d), line, LAP, TRACK, ORDER, 200.0, 1200.0, names, F.col("obd"), BINS)
    return rows.select("k", "section", *six("seconds", "sigma_t"), "tier", "status", "rank_eligible")


@query(f", {SECTIONS_SQL}, l AS (SELECT track, k, min(dl) AS lo, max(dl) AS hi FROM d GROUP BY ALL), x AS (SELECT l.k, section, a, b FROM l JOIN z USING (track) WHERE a >= lo AND b <= hi), y AS (SELECT k, section, 'a' AS fin, a AS x FROM x UNION ALL SELECT k, section, 'b', b FROM x), o1 AS (SELECT y.*, o.dl AS ls, o.t AS lt FROM y ASOF JOIN d o ON o.k = y.k AND y.x >= o.dl), o2 AS (SELECT o1.*, o.dl AS rs, o.t AS rt FROM o1 ASOF LEFT JOIN d o ON o.k = o1.k AND o1.x < o.dl), q AS (SELECT k, section, fin, CASE WHEN rs IS NULL THEN lt ELSE lt + (rt - lt) * (x - ls) / (rs - ls) END AS t FROM o2) SELECT a.k, a.section, round(b.t - a.t, 5) AS seconds FROM q a JOIN q b ON a.k = b.k AND a.section = b.section AND a.fin = 'a' AND b.fin = 'b'")
def odometer_sections(spark, d):
    return cross.odometer_time(drive(spark, d), section_table(spark), LAP, TRACK).select("k", "section", *six("seconds"))


@query(", a AS (SELECT *, coalesce(0.5 * (gps + lag(gps) OVER w) * (t - lag(t) OVER w), 0) AS st FROM d WINDOW w AS (PARTITION BY k ORDER BY t, i)), b AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS g FROM a), m AS (SELECT k, max(g) AS mg, max(dl) AS ml FROM b GROUP BY k) SELECT k, i, CAST(NULL AS DOUBLE) AS v, round(CASE WHEN mg > 0 THEN g * ml / mg ELSE g END, 5) AS dl FROM b JOIN m USING (k)")
def gps_emulation(spark, d):
    e = drive(spark, d).withColumn("gps", F.col("gps") / 0.44704)
    return cross.gps_only_emulation(e, LAP, ORDER, "t", "gps", "dl", ["v"]).select("k", "i", "v", *six("dl"))


@query()
def emulated_pairs(spark, d):
    """Sections of laps with an engine bus, against the same laps without it."""
    e = drive(spark, d).where("obd").withColumns({"flag": F.lit(False), "mph": F.col("gps") / 0.44704})
    bare = cross.gps_only_emulation(e, LAP, ORDER, "t", "mph", "dl", ["v"]).withColumns({"v": F.col("gps"), "obd": F.lit(False)})

    def times(rows):
        s, k = tr.estimate(rows, LAP, ORDER, "dl", "td", "v", "lat_g", "e", F.col("obd"), corridor(spark), BINS, "flag", TRACK)
        return cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)

    return cross.paired(times(e), times(bare), LAP).select("k", "section", *six("seconds_a", "seconds_b", "diff", "sigma_b"), "tier_b")


@query(RESID + ", cl AS (SELECT section, heading, driven - (b - a) AS dev, resid, delta_a, delta_b FROM rs WHERE covered AND status = 'ok'), cm AS (SELECT section, median(dev) AS m FROM cl GROUP BY section), cs AS (SELECT section, any_value(abs(m)) + 3 * 1.4826 * median(abs(dev - m)) AS bound, avg(heading) AS heading FROM cl JOIN cm USING (section) GROUP BY section), rm AS (SELECT median(resid) AS m FROM cl), fr AS (SELECT covar_pop(delta_a, delta_b) / nullif(stddev_pop(delta_a) * stddev_pop(delta_b), 0) AS r, count(*) AS n FROM cl GROUP BY section HAVING count(*) >= 4), md AS (SELECT delta FROM (SELECT *, max(knot) OVER (PARTITION BY k) AS khi2 FROM kn) WHERE knot - klo >= 200 AND khi2 - knot >= 200), mm AS (SELECT median(delta) AS m FROM md) SELECT round(regr_slope(bound, heading), 4) AS band_per_rad, round(regr_intercept(bound, heading), 4) AS band_base, count(*) AS sections, (SELECT round(tanh(sum(atanh(r) * (n - 3)) / sum(n - 3)), 4) FROM fr WHERE abs(r) < 0.999999) AS rho, (SELECT round(1.4826 * median(abs(resid - m)), 4) FROM cl, rm) AS consistency_std, (SELECT round(1.4826 * median(abs(delta - m)), 4) FROM md, mm) AS prior_mid FROM cs")
def trust_constants(spark, d):
    """Constants of the verdict, from the sections of laps with an engine bus and a good ruler."""
    from pyspark.sql import Window

    from lapwing.operators import scorecards as sc

    s, k = estimated(spark, d)
    rows = cross.section_times(s.withColumnRenamed("e", "e_lat"), k, section_table(spark), corridor(spark), LAP, TRACK, "i", BINS)
    clean = rows.where("covered and lap_status = 'ok'").withColumn("dev", F.col("driven") - (F.col("b") - F.col("a")))
    lap = Window.partitionBy(*LAP)
    ends = k.withColumns({"lo": F.min("knot").over(lap), "hi": F.max("knot").over(lap)})
    names = ("band_per_rad", "band_base", "rho", "consistency_std", "prior_mid")
    return sc.trust_constants(clean, ends).select("sections", *[F.round(n, 4).alias(n) for n in names])
