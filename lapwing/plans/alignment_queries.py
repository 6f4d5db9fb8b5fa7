"""Queries on the alignment of sensors, spans of series, and places of corners."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import alignment, lags, corners

from lapwing.plans.tables import SERIES, read, series

QUERIES: dict = {}
ORACLES: dict = {}

K, LAP = ["k"], ["k", "lap"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH e AS ({SERIES}), p AS (SELECT k, (min(t) + max(t)) / 2 AS mid, (count(*) % 7) / 10.0 AS lag FROM e GROUP BY k, lap), a AS (SELECT e.k, e.i, e.t, p.mid AS m0, p.lag AS l0 FROM e ASOF LEFT JOIN p ON e.k = p.k AND e.t >= p.mid), b AS (SELECT a.*, p.mid AS m1, p.lag AS l1 FROM a ASOF LEFT JOIN p ON a.k = p.k AND a.t <= p.mid) SELECT k, i, round(CASE WHEN m0 IS NULL THEN l1 WHEN m1 IS NULL OR m0 = m1 THEN l0 ELSE l0 + (l1 - l0) * (t - m0) / (m1 - m0) END + 1e-7, 4) AS lag FROM b")
def blended_lag(spark, d):
    e = series(spark, d)
    knots = e.groupBy(*LAP).agg(((F.min("t") + F.max("t")) / 2).alias("mid"), ((F.count("*") % 7) / 10).alias("lag")).drop("lap")
    return alignment.blended_lag(e, knots, K, "t").select("k", "i", F.round(F.col("lag") + 1e-7, 4).alias("lag"))


@query(f"WITH e AS ({SERIES}), p AS (SELECT k, i, t + 3600 AS ta, t + 86400 AS tb FROM e), x AS (SELECT p.*, e.v FROM p ASOF JOIN e ON p.k = e.k AND p.ta >= e.t) SELECT x.k, x.i, x.v, e.c FROM x ASOF JOIN e ON x.k = e.k AND x.tb >= e.t")
def retime(spark, d):
    e = series(spark, d).withColumns({"lag_v": F.lit(3600.0), "lag_c": F.lit(86400.0)})
    return alignment.retime(e, K, "t", "i", [(["v"], "lag_v"), (["c"], "lag_c")]).select("k", "i", "v", "c")


SPANS = f"WITH e AS ({SERIES}), n AS (SELECT k, t, i, CASE WHEN c <> 'click' THEN v / 1e6 END AS g FROM e), f AS (SELECT k, t, g, lead(t) OVER w AS t1, lead(g) OVER w AS g1, lag(t) OVER w AS t0 FROM n WHERE g IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY t, i)), s AS (SELECT k, lap, min(t) + 1800 AS lo, max(t) - 1800 AS hi FROM e GROUP BY k, lap), h AS (SELECT s.k, s.lap, count(*) AS n, count(g) AS m FROM s JOIN n ON s.k = n.k AND n.t BETWEEN lo AND hi GROUP BY ALL), c AS (SELECT s.*, f.*, greatest(t, lo) AS a, least(t1, hi) AS b FROM s JOIN f ON s.k = f.k), p AS (SELECT k, lap, sum(CASE WHEN t1 IS NOT NULL AND a < b THEN (b - a) * ((g + (g1 - g) * (a - t) / (t1 - t)) + (g + (g1 - g) * (b - t) / (t1 - t))) / 2 ELSE 0 END + CASE WHEN t0 IS NULL THEN greatest(0, least(hi, t) - lo) * g ELSE 0 END + CASE WHEN t1 IS NULL THEN greatest(0, hi - greatest(lo, t)) * g ELSE 0 END) AS z FROM c GROUP BY ALL), r AS (SELECT s.k, s.lap, lo, hi, CASE WHEN hi > lo AND n >= 2 AND m >= {{least}} * n THEN z END AS z FROM s LEFT JOIN h USING (k, lap) LEFT JOIN p USING (k, lap))"


def spans(spark, d):
    """The series with a channel that is missing in places, and the stretch inside each lap."""
    e = series(spark, d).withColumn("g", F.when(F.col("c") != "click", F.col("v") / 1e6))
    return e, e.groupBy(*LAP).agg((F.min("t") + 1800).alias("lo"), (F.max("t") - 1800).alias("hi"))


@query(SPANS.format(least=0.5) + " SELECT k, lap, round(z, 4) AS integral FROM r")
def span_integrals(spark, d):
    e, s = spans(spark, d)
    return alignment.span_integrals(e, s, K, "t", "i", "g", 0.5).select("k", "lap", F.round("integral", 4).alias("integral"))


ENDS = "".join(f", a_{x} AS (SELECT r.k, r.lap, r.{x} AS q, e.t AS t0, e.v AS v0 FROM r ASOF JOIN e ON r.k = e.k AND r.{x} >= e.t), b_{x} AS (SELECT a.k, a.lap, CASE WHEN e.t = t0 THEN v0 ELSE v0 + (e.v - v0) * (q - t0) / (e.t - t0) END AS v FROM a_{x} a ASOF JOIN e ON a.k = e.k AND a.q <= e.t)" for x in ("lo", "hi"))


@query(SPANS.format(least=0.9) + ENDS + " SELECT r.k, r.lap, round(b_hi.v - b_lo.v - 9.80665 * z, 4) AS residual FROM r LEFT JOIN b_lo USING (k, lap) LEFT JOIN b_hi USING (k, lap)")
def accel_residual(spark, d):
    e, s = spans(spark, d)
    return alignment.accel_residual(e, s, K, "t", "i", "v", "g").select("k", "lap", F.round("residual", 4).alias("residual"))


def stints(spark, d):
    """The series cut into laps of 400 samples, 8 a second."""
    e = series(spark, d).withColumns({"lap": F.floor(F.col("i") / 400).cast("long"), "n": F.col("i") % 400})
    return e.select("lap", "i", (F.col("n") * 0.125).alias("t"), (20 + F.col("v") / 10).alias("v"), ((F.col("v") - 50) / 100).alias("g"), F.col("v").alias("x"), (F.col("v") / 2).alias("y"))


@query()
def path_lag(spark, d):
    """Least-squares search: tested against planted delays."""
    e = stints(spark, d).withColumns({"x": F.col("x") / 20, "y": F.col("y") / 20})
    return lags.path_lag(e, ["lap"], "t", "i", "x", "y", "v")


@query()
def jump_residuals(spark, d):
    """Three weighted rigid fits: tested against brute force."""
    out = alignment.jump_residuals(stints(spark, d).withColumn("fix", F.lit(True)), ["lap"], "t", "i", "v", "g", "x", "y", "fix")
    return out.select("lap", "i", F.round("residual", 3).alias("residual"), "jump")


@query()
def corner_clusters(spark, d):
    """Peaks with spacing and prominence: tested at planted places."""
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("side"), (F.col("o_totalprice") / 100).alias("at"))
    return corners.density_clusters(o, "side", "at", 3500.0, 0.5).select("side", "centre", F.round("apex", 3).alias("apex"), "n")


POINTS = "WITH x AS (SELECT label, vec_id, 45 + CAST(embedding[1] AS DOUBLE) / 1000 AS lat, -122 + CAST(embedding[2] AS DOUBLE) / 1000 AS lon FROM embeddings WHERE label IS NOT NULL AND embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL), q AS (SELECT label AS pin, arg_min(lat, vec_id) AS pin_lat, arg_min(lon, vec_id) AS pin_lon FROM x GROUP BY label), m AS (SELECT x.*, x.vec_id // 64 AS lap, pin, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(pin_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(pin_lat)) * pow(sin(radians(pin_lon - lon) / 2), 2)))) AS metres FROM x, q), b AS (SELECT lap, pin, metres, vec_id FROM m QUALIFY row_number() OVER (PARTITION BY lap, pin ORDER BY metres, vec_id) = 1), g AS (SELECT * FROM b WHERE metres < 50)"


def matches(spark, d):
    """Vectors as places of laps of 64, and one pin for each label: its first vector."""
    e = read(spark, d, "embeddings")
    x = e.select("label", "vec_id", (45 + F.get("embedding", F.lit(0)).cast("double") / 1000).alias("lat"), (-122 + F.get("embedding", F.lit(1)).cast("double") / 1000).alias("lon"), F.floor(F.col("vec_id") / 64).cast("long").alias("lap")).where("label is not null and lat is not null and lon is not null")
    pins = x.groupBy(F.col("label").alias("pin")).agg(F.min_by("lat", "vec_id").alias("pin_lat"), F.min_by("lon", "vec_id").alias("pin_lon"))
    return corners.pin_matches(x, pins, ["lap"], ["vec_id"], ["vec_id"])


@query(POINTS + " SELECT pin, round(median(vec_id % 64), 3) AS place, round(stddev_pop(vec_id % 64), 3) AS spread, count(*) AS laps FROM g GROUP BY pin")
def pin_places(spark, d):
    m = matches(spark, d).withColumn("at", F.col("vec_id") % 64)
    return corners.pin_places(m, "at").select("pin", F.round("place", 3).alias("place"), F.round("spread", 3).alias("spread"), "laps")


@query(POINTS + ", f AS (SELECT pin, lap, row_number() OVER (PARTITION BY pin ORDER BY metres DESC, lap) AS r FROM g), w AS (SELECT pin, string_agg(CAST(lap AS VARCHAR), ',' ORDER BY r) AS worst FROM f WHERE r <= 4 GROUP BY pin) SELECT pin, round(median(metres), 3) AS median, round(stddev_samp(metres), 3) AS deviation, any_value(worst) AS worst FROM g JOIN w USING (pin) GROUP BY pin")
def apex_spread(spark, d):
    return corners.apex_spread(matches(spark, d), "lap").select("pin", F.round("median", 3).alias("median"), F.round("deviation", 3).alias("deviation"), "worst")
