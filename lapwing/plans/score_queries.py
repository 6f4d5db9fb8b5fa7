"""Queries on populations and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import scorecards as sc
from lapwing.plans.tables import DRIVE, LAPS, SECTIONS_SQL, drive, laps, section_table

QUERIES: dict = {}
ORACLES: dict = {}
LAP, ORDER, TRACK = ["track", "k"], ["t", "i"], ["track"]


def query(sql: str | None = None, base: str = f"WITH o AS ({LAPS})"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return add


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


def q4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


TRIALS = ", x AS (SELECT *, CASE lap % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'slow_drift' ELSE 'spike' END AS kind, CASE WHEN k % 2 = 0 THEN 'gate' ELSE 'mid' END AS place, lap % 7 <> 0 AS planted, x / 1e6 - 0.2 AS err, status = 'F' AS rank, CASE WHEN k % 5 <> 0 THEN status <> 'P' END AS caught, 'b' || lap % 2 AS batch FROM o)"


def trials(spark, d):
    c = F.col
    return laps(spark, d).withColumns({"kind": F.when(c("lap") % 3 == 0, "burst").when(c("lap") % 3 == 1, "slow_drift").otherwise("spike"), "place": F.when(c("k") % 2 == 0, "gate").otherwise("mid"), "planted": c("lap") % 7 != 0, "err": c("x") / 1e6 - 0.2, "rank": c("status") == "F", "caught": F.when(c("k") % 5 != 0, c("status") != "P"), "batch": F.concat(F.lit("b"), (c("lap") % 2).cast("string"))})


@query(TRIALS + " SELECT kind, place, count(*) AS n, round(avg(CASE WHEN caught THEN 1.0 WHEN NOT caught THEN 0 END), 4) AS caught, round(quantile_cont(abs(err), 0.9), 4) AS err_p90, round(avg(CASE WHEN abs(err) > 0.1 AND rank THEN 1.0 ELSE 0 END), 4) AS bad_rankable FROM x WHERE planted GROUP BY ALL")
def fault_scores(spark, d):
    return sc.fault_scores(trials(spark, d), 0.1).select("kind", "place", "n", *r4("caught", "err_p90", "bad_rankable"))


@query(TRIALS + " SELECT batch, count(*) AS attempted, count(*) FILTER (WHERE NOT planted) AS skipped FROM x GROUP BY batch")
def batch_counts(spark, d):
    return sc.batch_counts(trials(spark, d))


PAIRS = ", x AS (SELECT status <> 'P' AS rank_a, x / 1e4 AS seconds_a, CASE WHEN lap % 9 <> 0 THEN x / 1e4 + (k % 21 - 10) / 40.0 END AS seconds_b, (lap % 5 + 1) / 20.0 AS sigma_b, lap % 4 <> 0 AS rank_b FROM o), y AS (SELECT *, abs(seconds_b - seconds_a) AS d FROM x WHERE rank_a AND seconds_b IS NOT NULL)"


def pairs(spark, d):
    c = F.col
    return laps(spark, d).select("k", "lap", (c("status") != "P").alias("rank_a"), (c("x") / 1e4).alias("seconds_a"), F.when(c("lap") % 9 != 0, c("x") / 1e4 + (c("k") % 21 - 10) / 40.0).alias("seconds_b"), ((c("lap") % 5 + 1) / 20.0).alias("sigma_b"), (c("lap") % 4 != 0).alias("rank_b"))


@query(PAIRS + " SELECT count(*) AS n, round(avg(CASE WHEN d <= 0.11 THEN 1.0 ELSE 0 END), 4) AS within, round(avg(CASE WHEN d <= 2 * sigma_b + 0.003 THEN 1.0 ELSE 0 END), 4) AS within_2sigma, round(avg(CASE WHEN rank_b THEN 1.0 ELSE 0 END), 4) AS tier_a, round(avg(CASE WHEN d <= 0.11 THEN 1.0 ELSE 0 END) FILTER (WHERE rank_b), 4) AS tier_a_within, round(median(d), 4) AS median_abs, round(quantile_cont(d, 0.9), 4) AS p90_abs FROM y")
def pair_scores(spark, d):
    p = pairs(spark, d).withColumn("sigma_b", F.col("sigma_b") + 0.0015)
    return sc.pair_scores(p, 0.11).select("n", *r4("within", "within_2sigma", "tier_a", "tier_a_within", "median_abs", "p90_abs"))


@query(PAIRS + " SELECT count(*) AS n, count(*) FILTER (WHERE d > 0.21) AS over_first, count(*) FILTER (WHERE d > 0.24) AS over_second, round(count(*) FILTER (WHERE d > 0.24) * 1.0 / count(*), 4) AS rate FROM y")
def odometer_scores(spark, d):
    p = pairs(spark, d).select(F.col("rank_a").alias("rank"), F.col("seconds_a").alias("seconds"), F.col("seconds_b").alias("odometer_s"))
    return sc.odometer_scores(p, 0.21, 0.24).select("n", "over_first", "over_second", *r4("rate"))


@query(", c AS (SELECT corner AS metric, avg(x) AS value FROM o WHERE status = 'F' GROUP BY corner), b AS (SELECT corner AS metric, avg(x) AS base FROM o WHERE status <> 'F' AND corner NOT LIKE '3%' GROUP BY corner), r AS (SELECT DISTINCT corner AS metric FROM o UNION ALL SELECT 'none') SELECT r.metric, round(value, 3) AS value, round(base, 3) AS base, CASE WHEN value IS NULL OR base IS NULL THEN 'N/A' WHEN value - base <= 100 THEN 'PASS' ELSE 'FAIL' END AS gate FROM r LEFT JOIN c USING (metric) LEFT JOIN b USING (metric)")
def baseline_gates(spark, d):
    o = laps(spark, d)
    mean = lambda rows: rows.groupBy(F.col("corner").alias("metric")).agg(F.avg("x").alias("value"))
    rules = o.select(F.col("corner").alias("metric")).distinct().unionByName(spark.createDataFrame([("none",)], "metric string")).withColumns({"better": F.lit("lower"), "slack": F.lit(100.0)})
    same = sc.same_population(o.where("status = 'F'"), o.where("status = 'F'").select("corner", "k"), ["corner"])
    got = sc.gates(mean(o.where("status = 'F'")), mean(o.where("status <> 'F' and not corner like '3%'")), rules, same)
    return got.select("metric", F.round("value", 3).alias("value"), F.round("base", 3).alias("base"), "gate")


@query(TRIALS + ", y AS (SELECT *, (lap % 5 + 1) / 20.0 AS sigma FROM x) SELECT kind, count(*) AS n, round(avg(CASE WHEN abs(err) < 2 * sigma THEN 1.0 ELSE 0 END), 4) AS within, round(avg(err), 4) AS mean_err, round(median(sigma), 4) AS sigma FROM y GROUP BY kind")
def sigma_coverage(spark, d):
    t = trials(spark, d).withColumn("sigma", (F.col("lap") % 5 + 1) / 20.0)
    return sc.sigma_coverage(t, "kind", "err", "sigma").select("kind", "n", *r4("within", "mean_err", "sigma"))


@query(", m AS (SELECT corner, median(x) AS center FROM o GROUP BY corner), s AS (SELECT corner, any_value(center) AS center, 1.4826 * median(abs(x - center)) AS std FROM o JOIN m USING (corner) GROUP BY corner) SELECT corner, round(center, 3) AS center, round(std, 3) AS std, round(abs(center) + 3 * std, 3) AS bound FROM s")
def robust_bounds(spark, d):
    from lapwing.operators.robust import robust_spread

    return robust_spread(laps(spark, d), ["corner"], "x").select("corner", *[F.round(c, 3).alias(c) for c in ("center", "std", "bound")])


@query(", p AS (SELECT corner, quantile_cont(abs(x - 150000), 0.999) + 1.0 AS p FROM o WHERE status = 'F' GROUP BY corner) SELECT corner, round(p, 3) AS threshold FROM p")
def rule_thresholds(spark, d):
    """The rule of a threshold: the 99.9th percentile of clean residuals, and 1 more."""
    from lapwing.operators.robust import exact_quantiles

    clean = laps(spark, d).where("status = 'F'").withColumn("r", F.abs(F.col("x") - 150000))
    return exact_quantiles(clean, ["corner"], "r", [0.999]).select("corner", F.round(F.col("q")[0] + 1.0, 3).alias("threshold"))


@query(", l AS (SELECT track, k, max(dl) AS m FROM d GROUP BY ALL) SELECT track, count(m) AS n, round(min(m), 4) AS least, round(max(m), 4) AS most, round(stddev_pop(m), 4) AS std, round(quantile_cont(m, 0.05), 4) AS p5, round(median(m), 4) AS p50, round(quantile_cont(m, 0.95), 4) AS p95 FROM l GROUP BY track", DRIVE)
def odometer_spread(spark, d):
    l = drive(spark, d).groupBy(*LAP).agg(F.max("dl").alias("m"))  # noqa: E741
    return sc.odometer_spread(l, TRACK, "m").select("track", "n", *r4("least", "most", "std", "p5", "p50", "p95"))


@query(", s AS (SELECT k, td - lag(td) OVER (PARTITION BY k ORDER BY t, i) AS s FROM d) SELECT k, round(coalesce(-sum(least(s, 0)), 0) + 0.0, 4) AS back FROM s GROUP BY k", DRIVE)
def backward_walk(spark, d):
    return sc.backward_walk(drive(spark, d), ["k"], ORDER, "td").select("k", *r4("back"))


@query(f", {SECTIONS_SQL}, s AS (SELECT *, abs(lat_g) * 9.80665 / greatest(v, 8) * (lead(t) OVER (PARTITION BY k ORDER BY t, i) - t) AS r FROM d), h AS (SELECT z.track, k, section, sum(r) AS h FROM s JOIN z ON z.track = s.track AND dl >= a AND dl <= b GROUP BY ALL) SELECT track, section, count(h) AS laps, round(median(h), 4) AS heading FROM h GROUP BY ALL", DRIVE)
def turned_headings(spark, d):
    return sc.turned(drive(spark, d), section_table(spark), LAP, TRACK, ORDER, "t", "dl", "v", "lat_g").select("track", "section", "laps", *r4("heading"))


@query(", x AS (SELECT corner, CASE WHEN status = 'F' THEN 'old' ELSE 'new' END AS method, x FROM o), q AS (SELECT corner, method, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b FROM x GROUP BY ALL) SELECT corner, round(max(a) FILTER (WHERE method = 'old'), 3) AS old_p2, round(max(b) FILTER (WHERE method = 'old'), 3) AS old_p98, round(max(a) FILTER (WHERE method = 'new'), 3) AS new_p2, round(max(b) FILTER (WHERE method = 'new'), 3) AS new_p98 FROM q GROUP BY corner")
def driven_tails(spark, d):
    o = laps(spark, d).withColumn("method", F.when(F.col("status") == "F", "old").otherwise("new"))
    return sc.tails(o, "corner", "method", "x").select("corner", *[F.round(f"{m}_{p}", 3).alias(f"{m}_{p}") for m in ("old", "new") for p in ("p2", "p98")])


@query(f", {SECTIONS_SQL}, x AS (SELECT d.k, section, avg(v) AS m FROM d JOIN z ON z.track = d.track AND dl >= a AND dl <= b GROUP BY ALL) SELECT k, section, round(m, 4) AS mean_speed FROM x", DRIVE)
def battery_transits(spark, d):
    """Odometer section times with the mean speed in each."""
    e = drive(spark, d)
    t = e.select(*LAP).distinct().join(section_table(spark), TRACK)
    return sc.section_speeds(e, t, LAP, "dl", "v", "gps").where("mean_speed is not null").select("k", "section", *r4("mean_speed"))


@query(", b AS (SELECT corner, arg_min(x, (x, lap)) AS bx, arg_min(t, (x, lap)) AS bt FROM o WHERE status = 'F' GROUP BY corner) SELECT lap, round(x - bx, 3) AS x_delta, round(t - bt, 1) AS t_delta FROM o LEFT JOIN b USING (corner)")
def metric_deltas(spark, d):
    o = laps(spark, d)
    best = o.where("status = 'F'").groupBy("corner").agg(F.min(F.struct("x", "lap", "t")).alias("b")).select("corner", "b.x", "b.t")
    return sc.metric_deltas(o, best, ["corner"], ["x", "t"]).select("lap", F.round("x_delta", 3).alias("x_delta"), F.round("t_delta", 1).alias("t_delta"))


@query(" SELECT k FROM d GROUP BY k HAVING count(*) >= 50 AND abs(median(td - dl)) <= 100 AND max(abs(e)) <= 4.0", DRIVE)
def quality_laps(spark, d):
    e = drive(spark, d).withColumn("delta", F.col("td") - F.col("dl"))
    return sc.quality_laps(e, ["k"], "delta", "e", 50, 100.0, 4.0)


@query(", f AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE n % 3 = 1) / (max(t) - min(t)) AS rate, bool_or(obd) AS obd FROM d GROUP BY k), g AS (SELECT k FROM f WHERE obd AND n >= 50 AND rate >= 0.44 AND k % 4 <> 0) SELECT k, sha1(k::VARCHAR) AS h FROM g ORDER BY h, k LIMIT 5", DRIVE)
def validation_laps(spark, d):
    """A stable sample of laps that validation may use: the limit is the feature."""
    e = drive(spark, d).withColumn("fresh", F.col("n") % 3 == 1)
    reliable = e.where("k % 4 <> 0").select("k")
    found = sc.validation_laps(e, reliable, ["k"], "t", "fresh", "obd", 50, 0.44)
    return sc.hash_capped(found, ["k"], 5).select("k", F.sha1(F.col("k").cast("string").cast("binary")).alias("h"))


@query(", w AS (SELECT DISTINCT k + 3 AS k FROM o WHERE status = 'P') SELECT count(*) AS wanted, count(*) FILTER (WHERE k IN (SELECT k FROM o)) AS found, count(*) FILTER (WHERE k NOT IN (SELECT k FROM o)) AS missing FROM w")
def population_counts(spark, d):
    o = laps(spark, d)
    return sc.exact_population(o, o.where("status = 'P'").select((F.col("k") + 3).alias("k")), ["k"])[1]


@query(" SELECT lap FROM o WHERE coalesce(status = 'F', false) AND coalesce(CASE WHEN x > 50000 THEN CAST(floor(x / 40000) AS INTEGER) END, 99) < 4 AND x BETWEEN 150000 * 0.8 AND 150000 * 1.2")
def browsed_laps(spark, d):
    o = laps(spark, d).withColumns({"clean": F.col("status") == "F", "decile": F.when(F.col("x") > 50000, F.floor(F.col("x") / 40000).cast("int"))})
    return sc.plausible_laps(sc.browsed(o, "clean", "clean", "decile", top=4), "x", F.lit(150000.0)).select("lap")


@query(", c AS (SELECT DISTINCT corner AS corner_id, CAST(substr(corner, 1, 1) AS DOUBLE) * 400 AS start_m, CAST(substr(corner, 1, 1) AS DOUBLE) * 400 + CASE WHEN corner LIKE '2%' THEN 450 WHEN corner LIKE '4%' THEN -10 ELSE 120 END AS end_m, CAST(substr(corner, 1, 1) AS DOUBLE) * 430 AS apex_m FROM o), w AS (SELECT *, lag(end_m) OVER (ORDER BY start_m) AS before FROM c) SELECT corner_id, 'order' AS fault FROM w WHERE end_m <= start_m UNION ALL SELECT corner_id, 'apex' FROM w WHERE NOT (apex_m >= start_m AND apex_m <= end_m) UNION ALL SELECT corner_id, 'overlap' FROM w WHERE start_m < before UNION ALL SELECT corner_id, 'length' FROM w WHERE end_m > 2100")
def corner_faults(spark, d):
    number = F.substring("corner", 1, 1).cast("double")
    size = F.when(F.col("corner").startswith("2"), 450.0).when(F.col("corner").startswith("4"), -10.0).otherwise(120.0)
    c = laps(spark, d).select(F.col("corner").alias("corner_id"), (number * 400).alias("start_m"), (number * 400 + size).alias("end_m"), (number * 430).alias("apex_m"), F.lit("t").alias("track")).distinct()
    return sc.corner_faults(c, TRACK, F.lit(2100.0)).select("corner_id", "fault")


@query(", l AS (SELECT k, round(x / 1e5, 3) AS lag, CASE status WHEN 'F' THEN 'lap' WHEN 'O' THEN 'session' ELSE 'default' END AS origin FROM o) SELECT k, round(median(lag), 4) AS median_s, count(*) FILTER (WHERE origin = 'lap') AS n_lap, count(*) FILTER (WHERE origin = 'session') AS n_session, count(*) FILTER (WHERE origin = 'default') AS n_default FROM l GROUP BY k")
def lag_blocks(spark, d):
    l = laps(spark, d).select("k", F.round(F.col("x") / 1e5, 3).alias("lag"), F.when(F.col("status") == "F", "lap").when(F.col("status") == "O", "session").otherwise("default").alias("origin"))  # noqa: E741
    return sc.lag_blocks(l, ["k"]).select("k", F.round("lags.median_s", 4).alias("median_s"), "lags.n_lap", "lags.n_session", "lags.n_default")


@query(", x AS (SELECT lap, (k % 13 - 6) / 50.0 AS b, CASE WHEN lap % 5 <> 0 THEN (k % 7 - 3) / 50.0 END AS a FROM o) SELECT count(*) AS laps, round(avg(CASE WHEN abs(b) <= 0.05 THEN 1.0 ELSE 0 END), 4) AS before, round(avg(CASE WHEN abs(a) <= 0.05 THEN 1.0 ELSE 0 END) FILTER (WHERE a IS NOT NULL), 4) AS after, round(median(b), 4) AS median_before, round(median(a), 4) AS median_after FROM x")
def lag_acceptance(spark, d):
    o = laps(spark, d)
    a = o.where("lap % 5 <> 0").select("lap", ((F.col("k") % 7 - 3) / 50.0).alias("lag"))
    return sc.lag_acceptance(o.select("lap", ((F.col("k") % 13 - 6) / 50.0).alias("lag")), a, ["lap"]).select("laps", *r4("before", "after", "median_before", "median_after"))


@query(", s AS (SELECT lap, CASE WHEN x > 200000 THEN 'A' WHEN x > 100000 THEN 'B' ELSE 'C' END AS tier, CASE WHEN lap % 3 <> 0 THEN (k % 40) / 100.0 END AS sigma, k % 2 = 1 AS band, k % 3 = 1 AS line FROM o) SELECT lap, 'tier ' || tier || CASE WHEN sigma IS NOT NULL THEN printf(', sigma %.2f s', sigma) ELSE '' END || CASE WHEN band OR line THEN '; ' ELSE '' END || CASE WHEN band THEN 'driven distance out of band' ELSE '' END || CASE WHEN band AND line THEN ', ' ELSE '' END || CASE WHEN line THEN 'line does not explain the distance' ELSE '' END AS told FROM s")
def explained_verdicts(spark, d):
    failed = F.array_compact(F.array(F.when(F.col("k") % 2 == 1, "driven_band_dev_m"), F.when(F.col("k") % 3 == 1, "consistency_resid_m")))
    tier = F.when(F.col("x") > 200000, "A").when(F.col("x") > 100000, "B").otherwise("C")
    return laps(spark, d).select("lap", sc.explained(tier, F.when(F.col("lap") % 3 != 0, (F.col("k") % 40) / 100.0), failed).alias("told"))


@query(" SELECT DISTINCT strftime(make_timestamp(CAST(t * 1e6 AS BIGINT)), '%Y-%m-%d') AS date, dense_rank() OVER (ORDER BY strftime(make_timestamp(CAST(t * 1e6 AS BIGINT)), '%Y-%m-%d') DESC) AS place FROM o")
def newest_dates(spark, d):
    """Distinct dates, the newest first."""
    from pyspark.sql import Window

    day = F.date_format(F.timestamp_micros((F.col("t") * 1e6).cast("long")), "yyyy-MM-dd")
    days = laps(spark, d).select(day.alias("date")).distinct()
    return days.withColumn("place", F.row_number().over(Window.orderBy(F.desc("date"))).cast("long"))


@query(" SELECT k, lap, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN status = 'F' THEN x END NULLS LAST, lap) AS place, printf('%d:%05.2f', CAST(floor(x / 1000 / 60) AS INTEGER), x / 1000 - 60 * floor(x / 1000 / 60)) AS clock FROM o")
def lap_index(spark, d):
    """Laps of a driver, those without a time last, with their times as a clock shows them."""
    from pyspark.sql import Window

    from lapwing.functions.expressions import lap_clock

    place = F.row_number().over(Window.partitionBy("k").orderBy(F.when(F.col("status") == "F", F.col("x")).asc_nulls_last(), "lap"))
    return laps(spark, d).select("k", "lap", place.alias("place"), lap_clock(F.col("x") / 1000).alias("clock"))
