"""Queries on laps as curves, on lags of laps and on a catalogue of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import curves as cv, lags
from lapwing.plans.tables import DRIVE, drive
from lapwing.sources import store

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


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


GRID = ", ge AS (SELECT track, k, unnest(generate_series(CAST(ceil(min(dl) / 20) AS BIGINT), CAST(floor(max(dl) / 20) AS BIGINT))) AS g FROM d GROUP BY track, k), ga AS (SELECT ge.*, g * 20.0::DOUBLE AS x, a.dl AS d0, a.t AS t0, a.v AS v0 FROM ge ASOF JOIN d a ON a.k = ge.k AND g * 20.0::DOUBLE >= a.dl), gb AS (SELECT ga.*, b.dl AS d1, b.t AS t1, b.v AS v1 FROM ga ASOF LEFT JOIN d b ON b.k = ga.k AND ga.x < b.dl), gg AS (SELECT track, k, g, CASE WHEN d1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * (x - d0) / (d1 - d0) END AS t, CASE WHEN d1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - d0) / (d1 - d0) END AS v FROM gb), el AS (SELECT track, k, g, v, t - first_value(t) OVER (PARTITION BY k ORDER BY g) AS elapsed FROM gg)"


@query(GRID + " SELECT k, g, round(elapsed, 4) AS elapsed FROM el")
def elapsed_curves(spark, d):
    return cv.elapsed(drive(spark, d), LAP, "dl", "t", 20.0).select("k", "g", *r4("elapsed"))


@query(GRID + ", two AS (SELECT k FROM d GROUP BY k ORDER BY count(*) DESC, k LIMIT 2), o AS (SELECT min(k) AS a, max(k) AS b FROM two), z AS (SELECT x.g, x.elapsed - y.elapsed AS dd FROM el x JOIN el y USING (g), o WHERE x.k = a AND y.k = b) SELECT g, round(dd - (SELECT arg_min(dd, g) FROM z), 4) + 0.0 AS delta FROM z")
def delta_curve(spark, d):
    e = drive(spark, d)
    two = [r.k for r in e.groupBy("k").count().orderBy(F.desc("count"), "k").limit(2).collect()]  # the two laps that are compared
    lap = lambda k: cv.elapsed(e.where(F.col("k") == k), LAP, "dl", "t", 20.0)
    return cv.delta_curve(lap(min(two)), lap(max(two))).select("g", (F.round("delta", 4) + 0.0).alias("delta"))


@query(GRID + ", m AS (SELECT k % 3 AS grp, g, median(elapsed) AS elapsed, count(*) AS laps FROM el GROUP BY ALL) SELECT a.g, round(a.elapsed - b.elapsed, 4) + 0.0 AS delta FROM m a JOIN m b USING (g) WHERE a.grp = 0 AND b.grp = 1 AND a.laps >= 2 AND b.laps >= 2")
def group_median_curve(spark, d):
    c = cv.median_curve(cv.elapsed(drive(spark, d), LAP, "dl", "t", 20.0).withColumn("grp", F.col("k") % 3), ["grp"], 2)
    return cv.curve_difference(c.where("grp = 0"), c.where("grp = 1")).select("g", (F.round("delta", 4) + 0.0).alias("delta"))


@query(GRID + ", hp AS (SELECT k, g, g // 25 AS win, v - avg(v) OVER (PARTITION BY k ORDER BY g RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS high FROM el), ot AS (SELECT a.k, a.win, a.g, a.high, median(b.high) AS m FROM hp a JOIN hp b ON a.g = b.g AND a.k % 2 = b.k % 2 AND a.k <> b.k GROUP BY ALL), sh AS (SELECT a.k, a.win, s.s AS shift, a.high, b.m FROM ot a, generate_series(-3, 3) s(s), ot b WHERE b.k = a.k AND b.win = a.win AND b.g = a.g + s.s), r AS (SELECT k, win, shift, covar_pop(high, m) / nullif(stddev_pop(high) * stddev_pop(m), 0) AS r, count(*) AS n FROM sh GROUP BY ALL) SELECT k, win AS \"window\", CAST(arg_max(shift, (round(r, 9), -abs(shift), shift)) AS INTEGER) AS shift, round(max(r), 5) AS r FROM r WHERE n >= 6 AND r IS NOT NULL GROUP BY ALL")
def profile_registration(spark, d):
    p = cv.high_pass(cv.on_grid(drive(spark, d), LAP, "dl", "t", {"v": "v"}, 20.0), LAP, "v", 5)
    got = cv.registration(p, TRACK, ["k"], F.floor(F.col("g") / 25), 3, 6)
    return got.select("k", "window", "shift", F.round("r", 5).alias("r"))


@query(GRID.replace("el AS (SELECT track, k, g, v, t", "el AS (SELECT track, k, g, v, t AS tt, t") + ", b AS (SELECT track, arg_min(k, (-n, k)) AS best FROM (SELECT track, k, count(*) AS n FROM el GROUP BY ALL) GROUP BY track), p AS (SELECT a.k, a.g, a.tt - first_value(a.tt) OVER w AS ta, c.tt - first_value(c.tt) OVER w AS tb, a.g * 20.0::DOUBLE - first_value(a.g * 20.0::DOUBLE) OVER w AS db, (a.g * 20.0::DOUBLE - first_value(a.g * 20.0::DOUBLE) OVER w) * (1 + (a.k % 7 - 3) / 50.0::DOUBLE) AS da FROM el a JOIN b ON a.track = b.track JOIN el c ON c.k = b.best AND c.g = a.g WHERE a.k <> b.best WINDOW w AS (PARTITION BY a.k ORDER BY a.g)), l AS (SELECT p.*, q.db AS x0, q.tb AS y0 FROM p ASOF JOIN p q ON p.k = q.k AND p.da >= q.db), u AS (SELECT l.*, q.db AS x1, q.tb AS y1 FROM l ASOF LEFT JOIN p q ON l.k = q.k AND l.da < q.db) SELECT k, g, round(ta - tb, 4) + 0.0 AS delta, round(ta - CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (da - x0) / (x1 - x0) END, 4) + 0.0 AS speed FROM u")
def driven_delta(spark, d):
    """Each lap against its track's longest: laps whose numbers differ drive a longer or shorter line over the same places."""
    from pyspark.sql import Window

    grid = cv.on_grid(drive(spark, d), LAP, "dl", "t", {"t": "t"}, 20.0).withColumn("d", F.col("g") * 20.0)
    sizes = grid.groupBy(*LAP).agg(F.count("*").alias("n"))
    best = sizes.groupBy("track").agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("best"))
    far = F.col("g") * 20.0 - F.first(F.col("g") * 20.0).over(Window.partitionBy("k").orderBy("g"))
    pairs = grid.join(best, "track").where("k <> best").withColumn("d", far * (1 + (F.col("k") % 7 - 3) / 50.0))
    own = grid.join(best, "track").where("k = best").drop("k", "best")
    ends = pairs.select("track", "k").distinct().join(own, "track").select("k", "g", "t", "d")
    got = cv.driven_delta(pairs.select("k", "g", "t", "d"), ends, ["k"])
    return got.select("k", "g", *[(F.round(c, 4) + 0.0).alias(c) for c in ("delta", "speed")])


GATES = [(0, "G1", 310.0, -9.0, 290.0, 9.0, 300.0), (0, "G2", 700.0, -20.0, 700.0, 1.0, 690.0), (1, "G3", 505.0, 20.0, 495.0, -20.0, 500.0)]
GATES_SQL = ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{g}', {', '.join(f'{v}::DOUBLE' for v in vs)})" for t, g, *vs in GATES) + ") v(track, gate, x0, y0, x1, y1, seed))"


@query(GATES_SQL + ", p AS (SELECT track, k, t, dl, x, e AS y, lead(t) OVER w AS t2, lead(dl) OVER w AS dl2, lead(x) OVER w AS x2, lead(e) OVER w AS y2 FROM d WINDOW w AS (PARTITION BY k ORDER BY t, i)), m AS (SELECT p.*, gate, seed, (x2 - x) * (y1 - y0) - (y2 - y) * (x1 - x0) AS det, (x0 - x) * (y1 - y0) - (y0 - y) * (x1 - x0) AS un, (x0 - x) * (y2 - y) - (y0 - y) * (x2 - x) AS wn FROM p JOIN q ON p.track = q.track AND abs(dl - seed) <= 120 WHERE t2 IS NOT NULL), h AS (SELECT *, un / nullif(det, 0) AS u, wn / nullif(det, 0) AS w FROM m), c AS (SELECT k, gate, t + u * (t2 - t) AS time, dl + u * (dl2 - dl) AS place, seed FROM h WHERE u BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1) SELECT k, gate, round(arg_min(time, (abs(place - seed), time)), 4) AS time, round(arg_min(place, (abs(place - seed), time)), 4) AS place FROM c GROUP BY ALL")
def gate_times(spark, d):
    gates = spark.createDataFrame(GATES, "track int, gate string, x0 double, y0 double, x1 double, y1 double, seed double")
    e = drive(spark, d).withColumn("y", F.col("e"))
    return cv.gate_times(e, gates, LAP, TRACK, ORDER, "t", "x", "y", "dl").select("k", "gate", *r4("time", "place"))


@query(" SELECT k, bool_or(obd) AS has_obd, count(*) FILTER (WHERE f) AS fixes, round(count(*) FILTER (WHERE f) / (max(t) - min(t)), 4) AS rate FROM (SELECT *, row_number() OVER w = 1 OR coalesce(abs(td - lag(td) OVER w) > 0.01, false) AS f FROM d WINDOW w AS (PARTITION BY k ORDER BY t, i)) GROUP BY k")
def session_catalogue(spark, d):
    e = drive(spark, d).withColumn("speed", F.when(F.col("obd"), F.col("v")))
    return store.session_catalogue(e, ["k"], ORDER, "t", "td", "speed").select("k", "has_obd", "fixes", *r4("rate"))


@query()
def speed_lags(spark, d):
    """Lags of laps by their speeds, against a channel that trails by a quarter of a second: tested at planted delays."""
    from pyspark.sql import Window

    late = Window.partitionBy("k").orderBy("n")
    e = drive(spark, d).withColumns({"obd_mph": F.when(F.col("obd"), F.col("v") / 0.44704), "gps_mph": (F.col("v") - (F.col("v") - F.lag("v", 1, 30.0).over(late)) / 3) / 0.44704})
    return lags.speed_lags(e, LAP, ORDER, "t", "obd_mph", "gps_mph", "long_g").select("k", *r4("lag", "r"), "origin")


@query(", a AS (SELECT track, k, max(dl) AS len, count(*) AS n FROM d GROUP BY ALL), b AS (SELECT k, len FROM a WHERE n >= 60) SELECT k, round(len, 4) AS len FROM b ORDER BY len, k LIMIT 1")
def best_full_lap(spark, d):
    a = drive(spark, d).groupBy("k").agg(F.max("dl").alias("len"), F.count("*").alias("n"))
    return cv.best_lap(a, a.where("n >= 60"), ["k"], "len").select("k", *r4("len"))


SPLITS = ", a AS (SELECT k, CAST(floor(dl / 400) AS INTEGER) AS place, max(t) - min(t) AS s, count(*) >= 9 AS ok FROM d GROUP BY ALL)"


@query(SPLITS + ", f AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY s) AS p FROM a WHERE ok), i AS (SELECT place, count(*) FILTER (WHERE s < 9) AS impossible FROM f WHERE p <= 5 GROUP BY place) SELECT place, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 4) AS share, coalesce(any_value(impossible), 0) AS impossible FROM a LEFT JOIN i USING (place) GROUP BY place")
def coverage_floor(spark, d):
    return cv.coverage_floor(splits(spark, d), "place", "ok", "s", F.lit(9.0)).select("place", "n", *r4("share"), "impossible")


def splits(spark, d):
    e = drive(spark, d).groupBy("k", F.floor(F.col("dl") / 400).cast("int").alias("place"))
    return e.agg((F.max("t") - F.min("t")).alias("s"), (F.count("*") >= 9).alias("ok"))


@query(SPLITS + " SELECT a.place, b.place AS next, round(covar_pop(a.s, b.s) / nullif(stddev_pop(a.s) * stddev_pop(b.s), 0), 5) AS r, count(*) AS laps FROM a JOIN a b ON a.k = b.k AND b.place = a.place + 1 GROUP BY ALL")
def adjacent_sections(spark, d):
    got = cv.adjacent_correlation(splits(spark, d).withColumn("order", F.col("place")), ["k"], "place", "order", "s")
    return got.select("place", "next", F.round("r", 5).alias("r"), "laps")
