"""Queries on laps, corners and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.operators import joins, robust, sections
from lapwing.plans.tables import LAPS, laps, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH o AS ({LAPS})" + sql
        return f

    return add


#: Price bands as segments, and boxes that overlap.
BANDS = [("S_post_T3", 0.0), ("T1", 50000.0), ("S_post_T1", 90000.0), ("T2", 140000.0), ("S_post_T2", 220000.0), ("T3", 300000.0)]
BOXES = [("T1", 40000.0, 120000.0), ("T2", 100000.0, 180000.0), ("T3", 250000.0, 400000.0)]
BANDS_SQL = ", b AS (SELECT label, lo, coalesce(lead(lo) OVER (ORDER BY lo), 'infinity'::DOUBLE) AS hi FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in BANDS) + ") AS v(label, lo))"
BOXES_SQL = ", b AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in BOXES) + ") AS v(corner_id, lo, hi))"


@query(BANDS_SQL + " SELECT lap, label FROM o JOIN b ON x >= lo AND x < hi")
def segment_label(spark, d):
    starts = spark.createDataFrame(BANDS, "label string, start double")
    return joins.in_ranges(laps(spark, d), joins.segments(starts, "start", "label"), "x").select("lap", "label")


@query(BOXES_SQL + " SELECT k, corner_id, count(*) AS n, arg_min(lap, (x, lap)) AS slowest_at, arg_max(lap, (x, lap)) AS fastest_at, round(median(x), 3) AS mid, count(*) FILTER (WHERE status = 'F') AS braking, arg_min(lap, (t, lap)) AS entry, arg_max(lap, (t, lap)) AS exit FROM o JOIN b ON x >= lo AND x <= hi GROUP BY ALL HAVING count(*) >= 3")
def box_transits(spark, d):
    boxes = spark.createDataFrame(BOXES, "corner_id string, lo double, hi double")
    m = joins.in_ranges(laps(spark, d), boxes, "x", closed=True)
    return m.groupBy("k", "corner_id").agg(F.count("*").alias("n"), F.min_by("lap", F.struct("x", "lap")).alias("slowest_at"), F.max_by("lap", F.struct("x", "lap")).alias("fastest_at"), F.round(F.median("x"), 3).alias("mid"), F.count(F.when(F.col("status") == "F", 1)).alias("braking"), F.min_by("lap", F.struct("t", "lap")).alias("entry"), F.max_by("lap", F.struct("t", "lap")).alias("exit")).where("n >= 3")


@query(", a AS (SELECT k, CAST(substr(corner, 1, 1) AS INTEGER) - 1 AS place, max(x) AS z FROM o GROUP BY ALL) SELECT a.k, a.place, round(a.z, 2) AS z, round(greatest(a.z, b.z, c.z), 2) AS around FROM a LEFT JOIN a b ON a.k = b.k AND b.place = (a.place + 4) % 5 LEFT JOIN a c ON a.k = c.k AND c.place = (a.place + 1) % 5")
def neighbour_max(spark, d):
    a = laps(spark, d).groupBy("k", (F.substring("corner", 1, 1).cast("int") - 1).alias("place")).agg(F.max("x").alias("z"))
    return joins.neighbour_max(a, ["k"], "place", 5, "z", "around").select("k", "place", F.round("z", 2).alias("z"), F.round("around", 2).alias("around"))


EDGES = ", q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM o WHERE status = 'F')"


@query(EDGES + " SELECT lap, CASE WHEN x >= e[1] AND x <= e[len(e)] THEN CAST(len(list_filter(e[2:len(e)-1], lambda y: y < x)) AS INTEGER) END AS decile FROM o, q")
def pace_decile(spark, d):
    return robust.quantile_bucket(laps(spark, d), [], "x", 10, F.col("status") == "F", "decile").select("lap", "decile")


Z = ", m AS (SELECT corner, median(x) FILTER (WHERE status = 'F') AS m FROM o GROUP BY corner), s AS (SELECT corner, 1.4826 * median(abs(x - m)) FILTER (WHERE status = 'F') AS s FROM o JOIN m USING (corner) GROUP BY corner), z AS (SELECT o.*, round(CASE WHEN s > 0.1 THEN (x - m) / s END, 2) + 0.0 AS z FROM o JOIN m USING (corner) JOIN s USING (corner))"


@query(Z + " SELECT lap, z FROM z")
def robust_z(spark, d):
    return robust.robust_z(laps(spark, d), ["corner"], "x", F.col("status") == "F", "z").select("lap", "z")


@query(Z + " SELECT lap, abs(z) <= 2 AS reliable, bool_and(abs(z) <= 2) OVER (PARTITION BY k) AS driver_reliable, CASE WHEN bool_or(status = 'O') OVER (PARTITION BY k) THEN false WHEN bool_or(status = 'P') OVER (PARTITION BY k) THEN NULL ELSE true END AS final FROM z")
def reliability_flags(spark, d):
    z = robust.robust_z(laps(spark, d), ["corner"], "x", F.col("status") == "F", "z").withColumn("reliable", F.abs("z") <= 2)
    z = robust.all_of(z, ["k"], F.col("reliable"), "driver_reliable")
    verdict = F.when(F.col("status") == "O", False).when(F.col("status") == "F", True)
    return robust.all_of(z, ["k"], verdict, "final").select("lap", "reliable", "driver_reliable", "final")


@query(", w AS (SELECT k FROM o WHERE x > 20000 GROUP BY k HAVING count(DISTINCT corner) = 5) SELECT k FROM w INTERSECT SELECT k FROM o WHERE status = 'F'")
def relational_division(spark, d):
    o = laps(spark, d)
    return joins.keys_with_all(o, ["k"], "corner", F.col("x") > 20000, 5).join(o.where("status = 'F'"), "k", "left_semi")


VOTES = ", i AS (SELECT k, CAST(floor(x / 20000) AS BIGINT) AS bin, x - floor(x / 20000) * 20000 AS off, x FROM o), v1 AS (SELECT k, bin, median(off) AS v FROM i GROUP BY ALL), e1 AS (SELECT bin, CASE WHEN count(*) >= 30 THEN quantile_cont(v, 0.02) - 200 ELSE -15000 END AS lo, CASE WHEN count(*) >= 30 THEN quantile_cont(v, 0.98) + 200 ELSE 15000 END AS hi FROM v1 GROUP BY bin), j AS (SELECT i.* FROM i JOIN e1 USING (bin) WHERE off BETWEEN lo AND hi), v2 AS (SELECT k, bin, median(off) AS v FROM j GROUP BY ALL)"


@query(VOTES + " SELECT bin, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN quantile_cont(v, 0.02) - 200 ELSE -15000 END, 2) AS lo, round(CASE WHEN count(*) >= 30 THEN quantile_cont(v, 0.98) + 200 ELSE 15000 END, 2) AS hi FROM v2 GROUP BY bin")
def envelope_two_pass(spark, d):
    bin_ = F.floor(F.col("x") / 20000)
    i = laps(spark, d).select("k", bin_.alias("bin"), (F.col("x") - bin_ * 20000).alias("off"))
    fit = lambda rows: robust.two_level_envelope(rows, ["k"], ["bin"], "off", 0.02, 0.98, 200.0, 30, 15000.0)
    kept = i.join(fit(i).drop("n"), "bin").where(F.col("off").between(F.col("lo"), F.col("hi"))).select("k", "bin", "off")
    return fit(kept).select("bin", "n", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@query(" SELECT corner, lap, k, round(x, 2) AS x, place FROM (SELECT *, row_number() OVER (PARTITION BY corner ORDER BY x, k, lap) AS place FROM o WHERE status = 'F') WHERE place <= 5")
def leaderboard(spark, d):
    place = F.row_number().over(Window.partitionBy("corner").orderBy("x", "k", "lap"))
    return laps(spark, d).where("status = 'F'").withColumn("place", place).where("place <= 5").select("corner", "lap", "k", F.round("x", 2).alias("x"), "place")


@query(", b AS (SELECT corner, arg_min(lap, (x, k, lap)) AS lap, min(x) AS x FROM o WHERE status = 'F' GROUP BY corner) SELECT corner, b.lap, round(b.x, 2) AS x, round(b.x - (SELECT min(x) FROM b), 2) AS delta FROM b")
def best_lap(spark, d):
    b = laps(spark, d).where("status = 'F'").groupBy("corner").agg(F.min(F.struct("x", "k", "lap")).alias("b")).select("corner", "b.lap", "b.x")
    best = b.agg(F.min("x").alias("best"))
    return b.join(F.broadcast(best)).select("corner", "lap", F.round("x", 2).alias("x"), F.round(F.col("x") - F.col("best"), 2).alias("delta"))


@query(", r AS (SELECT min(t) AS lo, max(t) AS hi FROM o), b AS (SELECT corner, x, greatest(0, least(39, CAST(ceil((t - lo) / ((hi - lo) / 40)) AS BIGINT) - 1)) AS bin FROM o, r) SELECT corner, bin, count(*) AS n, round(quantile_cont(x, 0.1) + 1e-6, 2) AS p10, round(quantile_cont(x, 0.5) + 1e-6, 2) AS p50, round(quantile_cont(x, 0.9) + 1e-6, 2) AS p90 FROM b GROUP BY ALL")
def channel_envelope(spark, d):
    o = laps(spark, d)
    span = o.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    b = o.join(F.broadcast(span)).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(39), F.ceil((F.col("t") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)) - 1)).cast("long"))
    return b.groupBy("corner", "bin").agg(F.count("*").alias("n"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).select("corner", "bin", "n", *[F.round(F.col("p")[i] + 1e-6, 2).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


@query(" SELECT corner, count(*) FILTER (WHERE status = 'F') AS f, count(*) FILTER (WHERE status = 'O') AS o, count(*) FILTER (WHERE status = 'P') AS p, round(median(x), 2) AS mid FROM o GROUP BY corner")
def pivot_counts(spark, d):
    o = laps(spark, d)
    wide = o.groupBy("corner").pivot("status", ["F", "O", "P"]).count().fillna(0)
    mid = o.groupBy("corner").agg(F.round(F.median("x"), 2).alias("mid"))
    return wide.join(mid, "corner").select("corner", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), "mid")


@query(" SELECT corner, status, count(*) AS n, round(avg(CASE WHEN x > 150000 THEN 1.0 ELSE 0 END), 6) AS eligible FROM o GROUP BY GROUPING SETS ((), (status), (corner, status))")
def coverage_sets(spark, d):
    corner, status = F.col("corner"), F.col("status")
    sets = laps(spark, d).groupingSets([[], [status], [corner, status]], corner, status)
    return sets.agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") > 150000).cast("double")), 6).alias("eligible"))


@query(", s AS (SELECT k % 10 AS g, corner, stddev_samp(x) AS sd FROM o GROUP BY ALL HAVING count(*) >= 10) SELECT g, round(median(sd), 3) AS scatter, count(*) AS corners FROM s GROUP BY g")
def scatter_median(spark, d):
    s = laps(spark, d).groupBy((F.col("k") % 10).alias("g"), "corner").agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n")).where("n >= 10")
    return s.groupBy("g").agg(F.round(F.median("sd"), 3).alias("scatter"), F.count("*").alias("corners"))


@query(", r AS (SELECT k, corr(x, t) AS r, count(*) AS n FROM o GROUP BY k HAVING count(*) >= 4) SELECT round(tanh(sum(atanh(r) * (n - 3)) / sum(n - 3)), 6) AS r, count(*) AS drivers, (SELECT round(regr_slope(x, t) * 1e6, 4) FROM o) AS slope, (SELECT round(regr_intercept(x, t), 2) FROM o) AS intercept FROM r WHERE abs(r) < 0.999999")
def fisher_z(spark, d):
    o = laps(spark, d)
    line = o.agg(F.round(F.regr_slope("x", "t") * 1e6, 4).alias("slope"), F.round(F.regr_intercept("x", "t"), 2).alias("intercept"))
    return robust.fisher_mean(o, ["k"], "x", "t").select(F.round("r", 6).alias("r"), F.col("groups").alias("drivers")).join(line)


@query(", m AS (SELECT corner, median(x) AS m FROM o GROUP BY corner) SELECT corner, round(any_value(m), 3) AS reference, ceil(quantile_cont(abs(x - m), 0.99) * 10 - 1e-9) / 10 AS tolerance, round(quantile_cont(abs(x - m), 0.999), 3) AS threshold, count(*) AS n FROM o JOIN m USING (corner) GROUP BY corner HAVING count(*) >= 20")
def percentile_refs(spark, d):
    o = laps(spark, d)
    center = robust.exact_quantiles(o, ["corner"], "x", [0.5], "m").withColumn("m", F.col("m")[0])
    away = robust.with_group(o, center, ["corner"]).withColumn("away", F.abs(F.col("x") - F.col("m")))
    tails = robust.exact_quantiles(away, ["corner"], "away", [0.99, 0.999], "p")
    g = robust.with_group(o.groupBy("corner").agg(F.count("*").alias("n")).where("n >= 20"), center, ["corner"])
    g = robust.with_group(g, tails, ["corner"])
    return g.select("corner", F.round("m", 3).alias("reference"), (F.ceil(F.col("p")[0] * 10 - 1e-9) / 10.0).cast("double").alias("tolerance"), F.round(F.col("p")[1], 3).alias("threshold"), "n")


@query(", f AS (SELECT unnest([1000.0, 5000.0, 20000.0, 50000.0, 80000.0, 120000.0]) AS floor), m AS (SELECT corner, median(x) AS m FROM o GROUP BY corner), c AS (SELECT corner, floor, avg(CASE WHEN abs(x - m) < 2 * floor THEN 1.0 ELSE 0 END) AS share FROM o JOIN m USING (corner), f GROUP BY ALL) SELECT corner, CAST(min(floor) AS DOUBLE) AS floor FROM c WHERE share >= 0.9 GROUP BY corner")
def smallest_floor(spark, d):
    o = laps(spark, d)
    grid = F.array(*[F.lit(x) for x in (1000.0, 5000.0, 20000.0, 50000.0, 80000.0, 120000.0)])
    away = o.join(o.groupBy("corner").agg(F.median("x").alias("m")), "corner").select("corner", F.abs(F.col("x") - F.col("m")).alias("r"), F.explode(grid).alias("floor"))
    share = away.groupBy("corner", "floor").agg(F.avg((F.col("r") < 2 * F.col("floor")).cast("double")).alias("share"))
    return share.where("share >= 0.9").groupBy("corner").agg(F.min("floor").alias("floor"))


@query(", r AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS n FROM o), s AS (SELECT k, stddev_pop(x) AS sd FROM r WHERE r > CASE WHEN n >= 5 THEN floor(n * 0.1) ELSE 0 END AND r <= n - CASE WHEN n >= 5 THEN floor(n * 0.1) ELSE 0 END GROUP BY k) SELECT round(median(sd), 3) AS mid, count(*) AS drivers FROM s")
def trimmed_std(spark, d):
    return robust.trimmed_std(laps(spark, d), ["k"], "x").agg(F.round(F.median("std"), 3).alias("mid"), F.count("*").alias("drivers"))


ORACLES["stratified_split"] = "SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1(CAST(c_custkey AS VARCHAR)), c_custkey) <= round_even(count(*) OVER (PARTITION BY c_mktsegment) * 0.6, 0) THEN 'calibration' ELSE 'held_out' END AS fold FROM customer"


def stratified_split(spark, d):
    return robust.split_by_hash(read(spark, d, "customer"), ["c_mktsegment"], "c_custkey").select("c_custkey", "fold")


QUERIES["stratified_split"] = stratified_split


@query(" SELECT a.corner, count(*) AS pairs, count(*) FILTER (WHERE a.t > b.t) AS odd FROM o a JOIN o b ON a.k = b.k AND a.corner = b.corner AND b.x - a.x >= 50000 GROUP BY a.corner")
def paradox_pairs(spark, d):
    """Pairs of a driver's laps in a corner, one faster by a margin, and how many have the other order in time.

    A lap's faster partners are counted by a running count in x; those that came later by the driver's laps of the corner
    on cells of x, exact at the cell that holds the margin.
    """
    o = laps(spark, d).select("k", "corner", "x", "t")
    return joins.margin_pairs(o, ["k", "corner"], "x", "t", 50000.0).groupBy("corner").agg(F.sum("pairs").alias("pairs"), F.sum("odd").alias("odd")).where("pairs > 0")


@query(", m AS (SELECT corner, count(*) FILTER (WHERE status = 'F') AS good, count(*) AS n, count(*) FILTER (WHERE t < (SELECT median(t) FROM o)) AS early FROM o GROUP BY corner) SELECT corner, CASE WHEN early = 0 THEN 'N/A' WHEN good * 1.0 / n >= 0.48 THEN 'PASS' ELSE 'FAIL' END AS gate FROM m")
def acceptance_gates(spark, d):
    o = laps(spark, d)
    mid = robust.exact_quantiles(o, [], "t", [0.5], "mid").withColumn("mid", F.col("mid")[0])
    m = robust.with_group(o, mid, []).groupBy("corner").agg(F.count(F.when(F.col("status") == "F", 1)).alias("good"), F.count("*").alias("n"), F.count(F.when(F.col("t") < F.col("mid"), 1)).alias("early"))
    return m.select("corner", F.when(F.col("early") == 0, "N/A").when(F.col("good") / F.col("n") >= 0.48, "PASS").otherwise("FAIL").alias("gate"))


@query()
def reference_fit(spark, d):
    """Corners' references and calibrations of groups of drivers, fitted on what the other leaves: the tests repeat the fit in plain numpy."""
    from lapwing.operators.fits import joint_references

    rows = laps(spark, d).withColumns({"track": F.col("k") % 2, "team": F.floor(F.col("k") / 8), "y": F.col("x") / 1e5, "a": (F.col("lap") % 13 + 4).cast("double"), "b": (F.col("lap") % 12 - 6).cast("double")})
    refs, fit, rounds = joint_references(rows, ["track"], ["team"], ["corner"], "y", "a", "b", F.col("status") != "P", F.col("status") == "F")
    sessions = fit.groupBy("track").agg(F.count("*").alias("sessions"))
    return refs.join(sessions, "track").select("track", "corner", "offset", "tol", "n", "sessions", F.lit(rounds).alias("rounds"))


CROSSINGS = ", r AS (SELECT k, lap, 100.0 AS a, 100.0 + (lap % 5) * 60 AS b, CASE WHEN lap % 13 <> 0 THEN x / 1e4 END AS seconds, 5.0 + k % 40 AS v_a, 6.0 + lap % 40 AS v_b, 1.0 + (k % 9) / 4.0 AS sig_a, 1.0 + (lap % 9) / 4.0 AS sig_b, (lap % 5) * 60 + (k % 31) - 15.0 AS driven, (lap % 7) / 5.0 AS heading, CASE WHEN k % 5 <> 0 THEN (lap % 27) - 13.0 END AS resid, CASE WHEN lap % 3 <> 0 THEN (k % 9) - 4.0 END AS accel, status = 'F' AS gps, status = 'P' AS rescaled FROM o), g AS (SELECT *, greatest(v_a, 8) AS va, greatest(v_b, 8) AS vb, heading * 3.2 + 10.3 AS band, driven - (b - a) AS off, seconds IS NOT NULL AND b > a AS cov FROM r), s AS (SELECT *, sqrt(greatest(0, (sig_a ** 2 + sig_b ** 2 - 2 * 0.66 * sig_a * sig_b) / (va * vb)) + (greatest(0, abs(off) - band) / ((va + vb) / 2)) ** 2 + coalesce((greatest(0, abs(resid) - 10.2) / ((va + vb) / 2)) ** 2, 0)) AS sigma, coalesce(abs(accel) <= 2.5, NOT gps) AS aok, abs(off) <= band AS bok, coalesce(abs(resid) <= 10.2, true) AS rok FROM g), t AS (SELECT *, CASE WHEN NOT cov THEN 'C' WHEN gps AND sigma <= 0.1 AND NOT (aok AND bok AND rok) THEN 'B' WHEN sigma <= 0.1 THEN 'A' WHEN sigma <= 0.3 THEN 'B' ELSE 'C' END AS tier FROM s)"


@query(CROSSINGS + " SELECT k, lap, CASE WHEN cov THEN round(sigma, 4) END AS sigma_t, tier, CASE WHEN NOT cov THEN 'no_coverage' WHEN rescaled THEN 'rescale_invalid' ELSE 'ok' END AS status, tier = 'A' AND cov AND NOT rescaled AS rank_eligible FROM t")
def section_verdicts(spark, d):
    """Verdicts on crossings whose features are taken from the laps' numbers."""
    c, n = F.col, lambda x: x.cast("double")
    rows = laps(spark, d).select(
        "k", "lap", F.lit(100.0).alias("a"), (100.0 + n(c("lap") % 5) * 60).alias("b"), F.when(c("lap") % 13 != 0, c("x") / 1e4).alias("seconds"),
        (5.0 + n(c("k") % 40)).alias("v_a"), (6.0 + n(c("lap") % 40)).alias("v_b"), (1.0 + n(c("k") % 9) / 4.0).alias("sig_a"), (1.0 + n(c("lap") % 9) / 4.0).alias("sig_b"),
        (n(c("lap") % 5) * 60 + n(c("k") % 31) - 15.0).alias("driven"), (n(c("lap") % 7) / 5.0).alias("heading"), F.when(c("k") % 5 != 0, n(c("lap") % 27) - 13.0).alias("resid"),
        F.when(c("lap") % 3 != 0, n(c("k") % 9) - 4.0).alias("accel_value"), F.lit(2.5).alias("accel_tol"), (c("status") == "F").alias("gps_only"), (c("status") == "P").alias("rescaled"),
    )
    return sections.verdict(rows).select("k", "lap", F.round("sigma_t", 4).alias("sigma_t"), "tier", "status", "rank_eligible")


@query(", c AS (SELECT DISTINCT corner AS corner_id, CAST(substr(corner, 1, 1) AS DOUBLE) * 400 AS start_m, CAST(substr(corner, 1, 1) AS DOUBLE) * 400 + CASE WHEN corner LIKE '2%' THEN 450 ELSE 120 END AS end_m FROM o), w AS (SELECT corner_id, greatest(0, start_m - 50) AS a, least(coalesce(lead(start_m) OVER (ORDER BY start_m), 2100), end_m + 250) AS b FROM c) SELECT corner_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM w")
def section_windows(spark, d):
    number = F.substring("corner", 1, 1).cast("double") * 400
    long = F.when(F.col("corner").startswith("2"), 450.0).otherwise(120.0)
    corners = laps(spark, d).select(F.col("corner").alias("corner_id"), number.alias("start_m"), (number + long).alias("end_m"), F.lit("t").alias("track")).distinct()
    return sections.windows(corners, F.lit(2100.0), ["track"]).select("corner_id", "a", "b")
