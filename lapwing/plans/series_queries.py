"""Queries on the sample series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.operators import joins, sequence as seq

from lapwing.plans.tables import SERIES, read, series

QUERIES: dict = {}
ORACLES: dict = {}

K, ORDER, LAP = ["k"], ["t", "i"], ["k", "lap"]
W = "(PARTITION BY k ORDER BY t, i)"
DIST = f"d AS (SELECT *, coalesce(0.5 * (v + lag(v) OVER w) * (t - lag(t) OVER w), 0) / 3600 AS step FROM e WINDOW w AS {W}), s AS (SELECT *, sum(step) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS dist FROM d)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH e AS ({SERIES})" + sql
        return f

    return add


def distance(spark, d):
    """The series with ``dist``, its running integral over hours."""
    return seq.trapezoid(series(spark, d), K, ORDER, "t", F.col("v") / 3600, "dist")


@query(f", n AS (SELECT k, i, t, CASE WHEN c = 'view' THEN v END AS g FROM e) SELECT k, i, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING), first_value(g IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM n")
def ffill_bfill(spark, d):
    e = series(spark, d).select("k", "i", "t", F.when(F.col("c") == "view", F.col("v")).alias("g"))
    return seq.fill(e, K, ORDER, ["g"]).select("k", "i", "g")


@query(f", {DIST} SELECT k, i, round(dist, 4) AS dist, round(dist - first_value(dist) OVER (PARTITION BY k, lap ORDER BY t, i), 4) AS dist_lap FROM s")
def trapezoid_distance(spark, d):
    e = seq.relative(distance(spark, d), LAP, ORDER, "dist", "dist_lap")
    return e.select("k", "i", F.round("dist", 4).alias("dist"), F.round("dist_lap", 4).alias("dist_lap"))


@query(", a AS (SELECT k, lap, min(t) AS start, max(t) AS stop FROM e GROUP BY ALL) SELECT k, lap, start, round(coalesce(lead(start) OVER (PARTITION BY k ORDER BY lap), stop) - start, 3) AS lap_time FROM a")
def lap_times(spark, d):
    return seq.lap_times(series(spark, d), K, "lap", "t", "i")


@query(", a AS (SELECT k, lap, count(*) AS n, round(max(v), 4) AS most, round(avg(v) + 1e-7, 4) AS mean, round(min(v), 4) AS least, round(avg(CASE WHEN v >= 50 THEN 1.0 ELSE 0 END), 4) AS wide_open, round(avg(CASE WHEN c = 'click' THEN 1.0 ELSE 0 END), 4) AS braking FROM e GROUP BY ALL) SELECT *, lap <> min(lap) OVER (PARTITION BY k) AND lap <> max(lap) OVER (PARTITION BY k) AS clean, CASE WHEN lap = min(lap) OVER (PARTITION BY k) THEN 'warmup' WHEN lap = max(lap) OVER (PARTITION BY k) THEN 'cooldown' ELSE '' END AS reason FROM a")
def lap_summary(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    a = series(spark, d).groupBy(*LAP).agg(F.count("*").alias("n"), F.round(F.max("v"), 4).alias("most"), F.round(F.avg("v") + 1e-7, 4).alias("mean"), F.round(F.min("v"), 4).alias("least"), share(F.col("v") >= 50).alias("wide_open"), share(F.col("c") == "click").alias("braking"))
    w = Window.partitionBy("k")
    reason = F.when(F.col("lap") == F.min("lap").over(w), "warmup").when(F.col("lap") == F.max("lap").over(w), "cooldown").otherwise("")
    return a.withColumn("reason", reason).withColumn("clean", F.col("reason") == "")


@query(" SELECT k, i, max(v) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS high FROM e")
def running_ruler(spark, d):
    return seq.running_max(series(spark, d), K, ORDER, "v", "high").select("k", "i", "high")


@query(", m AS (SELECT *, CASE WHEN count(v) OVER w >= 5 THEN median(v) OVER w END AS median FROM e WINDOW w AS (PARTITION BY k ORDER BY t, i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)), r AS (SELECT *, abs(v - median) AS away FROM m), s AS (SELECT *, CASE WHEN count(away) OVER w >= 5 THEN median(away) OVER w END AS mad FROM r WINDOW w AS (PARTITION BY k ORDER BY t, i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) SELECT k, i, round(median, 4) AS median, round(mad, 4) AS mad, coalesce(away <= greatest(15, 5 * mad), false) AS usual FROM s")
def rolling_mad_filter(spark, d):
    return seq.hampel(series(spark, d), K, ORDER, "v").select("k", "i", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "usual")


@query(" SELECT k, i, round(avg(v) OVER (PARTITION BY k ORDER BY t, i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 1e-7, 4) AS mean7, round(avg(v) OVER (PARTITION BY k ORDER BY t, i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) + 1e-7, 4) AS mean4 FROM e")
def rolling_mean(spark, d):
    e = seq.rolling_mean(seq.rolling_mean(series(spark, d), K, ORDER, "v", 7, "mean7"), K, ORDER, "v", 4, "mean4")
    return e.select("k", "i", F.round(F.col("mean7") + 1e-7, 4).alias("mean7"), F.round(F.col("mean4") + 1e-7, 4).alias("mean4"))


ISLANDS = ", f AS (SELECT *, {hit} AS h FROM e), c AS (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER (PARTITION BY k ORDER BY t, i) OR row_number() OVER (PARTITION BY k ORDER BY t, i) = 1 THEN 1 ELSE 0 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS island FROM c)"


@query(ISLANDS.format(hit="v > 20") + ", r AS (SELECT k, island, min(t) AS first, max(t) AS past FROM g WHERE h GROUP BY ALL) SELECT k, min(first) AS first FROM r WHERE past - first >= 7200 GROUP BY k")
def sustained_first(spark, d):
    return seq.first_sustained(series(spark, d), K, ORDER, "t", F.col("v") > 20, 7200)


@query(ISLANDS.format(hit="c") + " SELECT k, i, CASE WHEN count(*) OVER (PARTITION BY k, island) >= 2 THEN c END AS confirmed FROM g")
def run_suppress(spark, d):
    return seq.suppress_runs(series(spark, d), K, ORDER, "c", 2, "confirmed").select("k", "i", "confirmed")


@query(ISLANDS.format(hit="v > 20") + ", r AS (SELECT k, island, count(*) FILTER (WHERE h) AS n FROM g GROUP BY ALL) SELECT k, max(n) AS longest FROM r GROUP BY k")
def longest_run(spark, d):
    return seq.longest_run(series(spark, d), K, ORDER, F.col("v") > 20)


@query(ISLANDS.format(hit="v > 10") + ", r AS (SELECT k, island, min(t) AS lo, max(t) AS hi FROM g WHERE h GROUP BY ALL), m AS (SELECT *, CASE WHEN lo - lag(hi) OVER (PARTITION BY k ORDER BY lo, island) <= 86400 THEN 0 ELSE 1 END AS new FROM r), s AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, island ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT k, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY k, grp HAVING max(hi) - min(lo) >= 172800")
def wide_spans(spark, d):
    return seq.wide_spans(series(spark, d), K, ORDER, "t", F.col("v") > 10, 86400, 172800)


@query(", b AS (SELECT k, t, lag(t) OVER (PARTITION BY k ORDER BY t, i) AS before FROM e) SELECT k, t, false AS is_gap FROM b UNION ALL SELECT k, (t + before) / 2 AS t, true AS is_gap FROM b WHERE abs(t - before) > 259200")
def gap_rows(spark, d):
    return seq.gap_rows(series(spark, d), K, ORDER, "t", 259200)


@query(", q AS (SELECT k, i, t + 3600 AS t FROM e), h AS (SELECT q.k, q.i, e.v, e.i AS from_i FROM q ASOF LEFT JOIN e ON q.k = e.k AND q.t >= e.t) SELECT k, i, v AS held, from_i FROM h")
def asof_hold(spark, d):
    e = series(spark, d)
    source = e.select("k", "t", "i", F.col("v").alias("held"), F.col("i").alias("from_i"))
    return joins.asof_hold(e.select("k", "i", (F.col("t") + 3600).alias("t")), source, K, "t", "i", ["held", "from_i"]).select("k", "i", "held", "from_i")


GRID = ", u AS (SELECT k, t, avg(v) AS v FROM e GROUP BY ALL), r AS (SELECT k, unnest(generate_series(CAST(ceil(min(t) / 21600) AS BIGINT), CAST(floor(max(t) / 21600) AS BIGINT))) * CAST(21600 AS DOUBLE) AS t FROM e GROUP BY k), a AS (SELECT r.k, r.t, u.t AS t0, u.v AS v0 FROM r ASOF JOIN u ON r.k = u.k AND r.t >= u.t), b AS (SELECT a.*, u.t AS t1, u.v AS v1 FROM a ASOF JOIN u ON a.k = u.k AND a.t <= u.t), g AS (SELECT k, t, CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM b)"


def gridded(spark, d, step=21600.0):
    """Each session's channel at whole multiples of ``step`` seconds, linear between samples."""
    e = series(spark, d)
    ends = e.groupBy("k").agg(F.ceil(F.min("t") / step).alias("a"), F.floor(F.max("t") / step).alias("b")).where("a <= b")
    grid = ends.select("k", F.explode(F.sequence("a", "b")).alias("n")).select("k", (F.col("n") * step).alias("t"))
    return joins.interpolate(grid, e.groupBy("k", "t").agg(F.avg("v").alias("v")), K, "t", "v", "v")


@query(GRID + " SELECT k, t, round(v, 4) AS v FROM g")
def interpolate_grid(spark, d):
    return gridded(spark, d).select("k", "t", F.round("v", 4).alias("v"))


HOURS = ", h AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS n, c, sum(v) AS v FROM e WHERE c IN ('view', 'click') GROUP BY ALL), s AS (SELECT min(n) AS a, max(n) AS b FROM h), r AS (SELECT unnest(generate_series(a, b)) AS n FROM s), x AS (SELECT r.n, coalesce(p.v, 0) AS p, coalesce(q.v, 0) AS q FROM r LEFT JOIN (SELECT * FROM h WHERE c = 'view') p USING (n) LEFT JOIN (SELECT * FROM h WHERE c = 'click') q USING (n)), l AS (SELECT k.k AS lag, corr(a.p, b.q) AS r, count(*) AS n FROM x a, generate_series(-6, 30) AS k(k), x b WHERE b.n = a.n + k.k GROUP BY 1)"


def lag_correlations(spark, d):
    """(lag, r, n): correlation of hourly sums of two event types at each lag; the lags are exploded on one side of an equi-join."""
    e = series(spark, d).where(F.col("c").isin("view", "click"))
    h = e.groupBy(F.floor(F.col("t") / 3600).alias("n")).agg(F.sum(F.when(F.col("c") == "view", F.col("v"))).alias("p"), F.sum(F.when(F.col("c") == "click", F.col("v"))).alias("q"))
    spine = h.agg(F.min("n").alias("a"), F.max("n").alias("b")).select(F.explode(F.sequence("a", "b")).alias("n"))
    x = spine.join(h, "n", "left").fillna(0.0)
    left = x.select(F.col("p"), "n", F.explode(F.sequence(F.lit(-6), F.lit(30))).alias("lag")).select("p", "lag", (F.col("n") + F.col("lag")).alias("n"))
    return left.join(x.select("n", "q"), "n").groupBy("lag").agg(F.corr("p", "q").alias("r"), F.count("*").alias("n"))


@query(HOURS + " SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r, n FROM l")
def xcorr_lag(spark, d):
    return lag_correlations(spark, d).select("lag", F.round("r", 6).alias("r"), "n")


@query(HOURS + ", p AS (SELECT *, lag(r) OVER (ORDER BY lag) AS y0, lead(r) OVER (ORDER BY lag) AS y2 FROM l), b AS (SELECT * FROM p ORDER BY r DESC, lag LIMIT 1) SELECT CAST(lag AS INTEGER) AS lag, round(CASE WHEN y0 - 2 * r + y2 < 0 THEN lag + 0.5 * (y0 - y2) / (y0 - 2 * r + y2) ELSE lag END, 4) AS refined, CASE WHEN r >= 0.97 THEN 'own' ELSE 'default' END AS origin FROM b")
def lag_peak(spark, d):
    w = Window.orderBy("lag")
    p = lag_correlations(spark, d).withColumns({"y0": F.lag("r").over(w), "y2": F.lead("r").over(w)})
    bend = F.col("y0") - 2 * F.col("r") + F.col("y2")
    best = p.orderBy(F.desc("r"), "lag").limit(1)
    refined = F.when(bend < 0, F.col("lag") + 0.5 * (F.col("y0") - F.col("y2")) / bend).otherwise(F.col("lag"))
    return best.select("lag", F.round(refined, 4).alias("refined"), F.when(F.col("r") >= 0.97, "own").otherwise("default").alias("origin"))


@query(", a AS (SELECT k, lap, CASE WHEN count(*) >= 2 THEN median(v) END AS own FROM e GROUP BY ALL), s AS (SELECT *, median(own) OVER (PARTITION BY k) AS ses FROM a) SELECT k, lap, round(coalesce(own, ses, 0.45), 4) AS lag, CASE WHEN own IS NOT NULL THEN 'lap' WHEN ses IS NOT NULL THEN 'session' ELSE 'default' END AS origin FROM s")
def session_lag_ladder(spark, d):
    own = series(spark, d).groupBy(*LAP).agg(F.when(F.count("*") >= 2, F.median("v")).alias("own"))
    ses = own.groupBy("k").agg(F.median("own").alias("ses"))
    origin = F.when(F.col("own").isNotNull(), "lap").when(F.col("ses").isNotNull(), "session").otherwise("default")
    return own.join(ses, "k").select("k", "lap", F.round(F.coalesce("own", "ses", F.lit(0.45)), 4).alias("lag"), origin.alias("origin"))


@query(" SELECT a.k, a.i, count(*) AS n, round(avg(b.v) + 1e-7, 4) AS mean FROM e a JOIN e b ON a.k = b.k AND abs(a.t - b.t) <= 86400 AND a.i <> b.i GROUP BY ALL")
def time_neighbours(spark, d):
    e = series(spark, d)
    other = e.select("k", F.col("t").alias("t2"), F.col("i").alias("i2"), F.col("v").alias("v2"))
    near = joins.band_join(e.select("k", "t", "i"), other, K, "t", "t2", 86400.0).where("i <> i2")
    return near.groupBy("k", "i").agg(F.count("*").alias("n"), F.round(F.avg("v2") + 1e-7, 4).alias("mean"))


@query(", x AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS bin, v FROM e), m AS (SELECT bin + o.o AS bin, v FROM x, generate_series(-2, 2) AS o(o)), a AS (SELECT bin, median(v) AS mid, stddev_pop(v) AS spread, count(*) AS n FROM m GROUP BY bin) SELECT bin, CASE WHEN n >= 5 THEN round(mid, 4) END AS mid, round(spread, 4) AS spread, n, n > 1.5 * (SELECT median(n) FROM a) AS crowded FROM a")
def bin_median_grid(spark, d):
    x = series(spark, d).select(F.floor(F.col("t") / 86400).alias("bin"), "v")
    a = x.select("bin", "v", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("o")).select((F.col("bin") + F.col("o")).alias("bin"), "v").groupBy("bin").agg(F.median("v").alias("mid"), F.stddev_pop("v").alias("spread"), F.count("*").alias("n"))
    usual = a.agg(F.median("n").alias("usual"))
    return a.join(F.broadcast(usual)).select("bin", F.when(F.col("n") >= 5, F.round("mid", 4)).alias("mid"), F.round("spread", 4).alias("spread"), "n", (F.col("n") > 1.5 * F.col("usual")).alias("crowded"))


@query(", h AS (SELECT CAST(floor(t / 3600) AS BIGINT) % 24 AS bin, avg(v) AS v FROM e GROUP BY 1) SELECT (h.bin + o.o + 24) % 24 AS bin, round(sum(h.v * exp(-o.o * o.o / 8.0)) / sum(exp(-o.o * o.o / 8.0)), 4) AS smooth FROM h, generate_series(-8, 8) AS o(o) GROUP BY 1")
def circular_smooth(spark, d):
    h = series(spark, d).groupBy((F.floor(F.col("t") / 3600) % 24).alias("bin")).agg(F.avg("v").alias("v"))
    moved = h.select("bin", "v", F.explode(F.sequence(F.lit(-8), F.lit(8))).alias("o")).select(F.pmod(F.col("bin") + F.col("o"), F.lit(24)).alias("bin"), "v", F.exp(-F.col("o") * F.col("o") / 8.0).alias("w"))
    return moved.groupBy("bin").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 4).alias("smooth"))


DAYS = ", y AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS day, avg(v) AS v FROM e GROUP BY 1)"


def days(spark, d):
    return series(spark, d).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.avg("v").alias("v"))


@query(DAYS + ", p AS (SELECT a.day, (b.day - a.day) AS x, b.v AS y, exp(-0.5 * ((b.day - a.day) / 5.0) ** 2) AS w FROM y a JOIN y b ON abs(a.day - b.day) <= 10), m AS (SELECT day, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM p GROUP BY day) SELECT day, round(sy / sw, 4) AS mean, CASE WHEN sw * sxx - sx * sx > 1e-9 THEN round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 4) END AS slope FROM m")
def gaussian_tangent(spark, d):
    y = days(spark, d)
    p = joins.band_join(y.select("day"), y.select(F.col("day").alias("d2"), F.col("v").alias("y")), [], "day", "d2", 10.0)
    x = F.col("d2") - F.col("day")
    p = p.select("day", x.alias("x"), "y", F.exp(-0.5 * F.pow(x / 5.0, 2)).alias("w"))
    w, xx, yy = F.col("w"), F.col("x"), F.col("y")
    m = p.groupBy("day").agg(F.sum(w).alias("sw"), F.sum(w * xx).alias("sx"), F.sum(w * yy).alias("sy"), F.sum(w * xx * xx).alias("sxx"), F.sum(w * xx * yy).alias("sxy"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    return m.select("day", F.round(F.col("sy") / F.col("sw"), 4).alias("mean"), F.when(det > 1e-9, F.round((F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det, 4)).alias("slope"))


@query(", p AS (SELECT *, sqrt(((t - lag(t) OVER w) / 86400) ** 2 + (v - lag(v) OVER w) ** 2) AS step FROM e WINDOW w AS (PARTITION BY k ORDER BY t, i)) SELECT k, count(*) AS n, round(coalesce(sum(step), 0), 3) AS path, round(coalesce(max(step), 0), 3) AS jump FROM p GROUP BY k")
def path_length(spark, d):
    w = seq.over(K, ORDER)
    step = F.hypot((F.col("t") - F.lag("t").over(w)) / 86400, F.col("v") - F.lag("v").over(w))
    return series(spark, d).withColumn("step", step).groupBy("k").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 3).alias("path"), F.round(F.coalesce(F.max("step"), F.lit(0.0)), 3).alias("jump"))


@query(", y AS (SELECT c, CAST(floor(t / 86400) AS BIGINT) AS day, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY day) AS r, count(*) OVER (PARTITION BY c) AS m FROM y), f AS (WITH RECURSIVE f AS (SELECT c, day, r, m, v, v AS z FROM n WHERE r = 1 UNION ALL SELECT n.c, n.day, n.r, n.m, n.v, greatest(least(n.v, f.z + 2), f.z - 2) FROM f JOIN n ON n.c = f.c AND n.r = f.r + 1) SELECT * FROM f), b AS (WITH RECURSIVE b AS (SELECT c, day, r, m, v, v AS z FROM n WHERE r = m UNION ALL SELECT n.c, n.day, n.r, n.m, n.v, greatest(least(n.v, b.z + 2), b.z - 2) FROM b JOIN n ON n.c = b.c AND n.r = b.r - 1) SELECT * FROM b) SELECT c, day, round((f.z + b.z) / 2, 4) AS limited FROM f JOIN b USING (c, day)")
def rate_limit(spark, d):
    y = series(spark, d).groupBy("c", F.floor(F.col("t") / 86400).alias("day")).agg(F.avg("v").alias("v"))
    return seq.fold_limited(y, ["c"], "day", "v", F.lit(2.0), "limited").select("c", "day", F.round("limited", 4).alias("limited"))


@query(", y AS (SELECT c, CAST(floor(t / 86400) AS BIGINT) AS day, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM y WINDOW w AS (PARTITION BY c ORDER BY day)) SELECT c, CAST(day AS DOUBLE) AS day, round(v, 4) AS v FROM n WHERE v > a AND v > b AND v >= 10")
def peaks(spark, d):
    y = series(spark, d).groupBy("c", F.floor(F.col("t") / 86400).cast("double").alias("day")).agg(F.avg("v").alias("v"))
    return seq.peaks(y, ["c"], "day", "v", 10.0).select("c", "day", F.round("v", 4).alias("v"))


@query()
def spaced_peaks(spark, d):
    y = series(spark, d).groupBy("c", F.floor(F.col("t") / 86400).cast("double").alias("day")).agg(F.avg("v").alias("v"))
    return seq.peaks(y, ["c"], "day", "v", 10.0, 3.0).select("c", "day", F.round("v", 4).alias("v"))


# a lap of the ruler: sections of each session's own running distance
SECTIONS = f", {DIST}, m AS (SELECT k, max(dist) AS total FROM s GROUP BY k HAVING max(dist) > 0), x AS (SELECT m.k, b.b AS section, least(total * b.b / 5, total) AS pos FROM m, generate_series(0, 5) AS b(b)), u AS (SELECT k, dist, min(t) AS t FROM s GROUP BY ALL), lo AS (SELECT x.*, u.dist AS d0, u.t AS t0 FROM x ASOF JOIN u ON x.k = u.k AND x.pos >= u.dist), hi AS (SELECT lo.*, u.dist AS d1, u.t AS t1 FROM lo ASOF LEFT JOIN u ON lo.k = u.k AND lo.pos <= u.dist), z AS (SELECT k, section, CASE WHEN d0 = d1 THEN t0 ELSE t0 + (t1 - t0) * (pos - d0) / (d1 - d0) END AS t FROM hi), p AS (SELECT k, section, t - lag(t) OVER (PARTITION BY k ORDER BY section) AS seconds FROM z)"


def section_rows(spark, d):
    """(k, section, seconds): time between the crossings of five equal stretches of a session's distance."""
    s = distance(spark, d)
    total = s.groupBy("k").agg(F.max("dist").alias("total")).where("total > 0")
    marks = total.select("k", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("section"), "total").select("k", "section", F.least(F.col("total") * F.col("section") / 5, F.col("total")).alias("dist"))
    t = joins.interpolate(marks, s.groupBy("k", "dist").agg(F.min("t").alias("t")), K, "dist", "t", "t")
    return t.select("k", "section", (F.col("t") - F.lag("t").over(Window.partitionBy("k").orderBy("section"))).alias("seconds")).where("section > 0")


@query(SECTIONS + " SELECT k, CAST(section AS INTEGER) AS section, round(seconds, 2) AS seconds, seconds IS NOT NULL AS covered FROM p WHERE section > 0")
def section_times(spark, d):
    return section_rows(spark, d).select("k", "section", F.round("seconds", 2).alias("seconds"), F.col("seconds").isNotNull().alias("covered"))


@query(SECTIONS + " SELECT CAST(section AS INTEGER) AS section, arg_min(k, (seconds, k)) AS k, round(min(seconds), 2) AS seconds FROM p WHERE seconds > 0 GROUP BY section")
def fastest_sections(spark, d):
    best = F.min(F.struct("seconds", "k")).alias("b")
    return section_rows(spark, d).where("seconds > 0").groupBy("section").agg(best).select("section", "b.k", F.round("b.seconds", 2).alias("seconds"))


@query(f", {DIST}, n AS (SELECT *, lead(v) OVER w AS v1, lead(t) OVER w AS t1 FROM s WINDOW w AS {W}) SELECT k, lap, round(sum(0.5 * (v + v1) * (t1 - t)) / 3600, 3) AS integral, round(count(v) * 1.0 / count(*), 4) AS coverage FROM n WHERE t1 IS NOT NULL AND floor(t1 / 604800) = lap GROUP BY ALL")
def window_integral(spark, d):
    w = seq.over(K, ORDER)
    n = series(spark, d).withColumns({"v1": F.lead("v").over(w), "t1": F.lead("t").over(w)}).where(F.floor(F.col("t1") / 604800) == F.col("lap"))
    return n.groupBy("k", "lap").agg(F.round(F.sum(0.5 * (F.col("v") + F.col("v1")) * (F.col("t1") - F.col("t"))) / 3600, 3).alias("integral"), F.round(F.count("v") / F.count("*"), 4).alias("coverage"))


_SOLVE = "m{n} AS (SELECT k, (bb * ay - ab * cy) / (aa * bb - ab * ab) AS p, (aa * cy - ab * ay) / (aa * bb - ab * ab) AS q FROM (SELECT k, sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * y) AS ay, sum(w * b * y) AS cy FROM f{n} GROUP BY k))"
_REWEIGH = "r{n} AS MATERIALIZED (SELECT f{n}.k, y, a, b, y - p * a - q * b AS r FROM f{n} JOIN m{n} USING (k)), d{n} AS (SELECT k, median(r) AS m FROM r{n} GROUP BY k), h{n} AS (SELECT r{n}.k, 1.4826 * median(abs(r - m)) AS s FROM r{n} JOIN d{n} USING (k) GROUP BY r{n}.k), f{m} AS MATERIALIZED (SELECT r{n}.k, y, a, b, CASE WHEN abs(r) > 1.345 * s AND s > 0 THEN 1.345 * s / abs(r) ELSE 1.0 END AS w FROM r{n} JOIN h{n} USING (k))"
_ROUNDS = 20


@query(", f1 AS (SELECT k, v AS y, 1.0 AS a, (t - min(t) OVER (PARTITION BY k)) / 604800 AS b, 1.0 AS w FROM e WHERE k IN (SELECT k FROM e GROUP BY k HAVING count(*) >= 12)), " + ", ".join(_SOLVE.format(n=n) + (", " + _REWEIGH.format(n=n, m=n + 1) if n < _ROUNDS else "") for n in range(1, _ROUNDS + 1)) + f" SELECT k, round(p, 4) AS level, round(q, 4) AS drift FROM m{_ROUNDS}")
def session_calibration(spark, d):
    from lapwing.operators.fits import huber_fits

    b = (F.col("t") - F.min("t").over(Window.partitionBy("k"))) / 604800
    rows = series(spark, d).select("k", F.col("v").alias("y"), F.lit(1.0).alias("a"), b.alias("b"))
    return huber_fits(rows, ["k"], "y", "a", "b").select("k", F.round("p", 4).alias("level"), F.round("q", 4).alias("drift"))


@query(", p AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY k ORDER BY t, i)), x AS (SELECT k, i, gate.gate, t + (gate.gate - v) / (v1 - v) * (t1 - t) AS t FROM p, (VALUES (25.0), (50.0)) AS gate(gate) WHERE (v < gate.gate AND v1 >= gate.gate)) SELECT k, CAST(gate AS DOUBLE) AS gate, round(min(t), 2) AS first, count(*) AS n FROM x GROUP BY ALL")
def gate_crossing(spark, d):
    w = seq.over(K, ORDER)
    p = series(spark, d).withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w)})
    x = p.withColumn("gate", F.explode(F.array(F.lit(25.0), F.lit(50.0)))).where((F.col("v") < F.col("gate")) & (F.col("v1") >= F.col("gate")))
    at = F.col("t") + (F.col("gate") - F.col("v")) / (F.col("v1") - F.col("v")) * (F.col("t1") - F.col("t"))
    return x.groupBy("k", "gate").agg(F.round(F.min(at), 2).alias("first"), F.count("*").alias("n"))


ORACLES["header_parse"] = "SELECT json_extract_string(props, '$.' || key) AS value, key, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL"


def header_parse(spark, d):
    """Key and value pairs of headers kept as JSON objects."""
    pairs = read(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key", "value").agg(F.count("*").alias("n"))


QUERIES["header_parse"] = header_parse
