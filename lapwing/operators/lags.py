"""How far slow sensors trail fast ones: lags of laps and sessions, as grouped moments over exploded lags.

All laps are worked through at once: channels are put on a grid, each lag is so many rows of it ahead or behind, and a
lag's fit is a handful of sums. No lap is a task of its own. What is dealt out is samples; grids and lags are made
of them where they lie and summed there, so that neither is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import G, MPH, correlation, to_xy
from lapwing.functions.lineage import cut, grown
from lapwing.operators import sequence as seq
from lapwing.operators.sequence import over

Names = Sequence[str]

#: Fixed values of speed lags: grid, reach, least speed (mph), span and correlations, lead of a held speed, smoothing, default, offset to positions.
GRID, FROM, TO, FAST, SPAN, LIKE, LIKE_ACCEL, HOLD_LEAD, SMOOTH, DEFAULT, OFFSET = 0.05, -6, 30, 20.0, 30.0, 0.97, 0.6, 0.075, 0.5, 0.45, 0.12
#: Fixed values of position lags: step and reach, rows off each end, fixes of the mean, largest jump, least rows and laps, most slow rows.
STEP, LEAST, MOST, TRIM, SMOOTHED, JUMP, ROWS, LAPS, SLOW = 0.01, -30, 150, 50, 7, 30.0, 1500, 2, 0.05


def dealt(df: DataFrame, keys: Names) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as a shuffle has, or left where a join has dealt it out so: it becomes many times as much where it lies."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ticked(rows: DataFrame, keys: Names, x: str, columns: Names, origin: Column, first: Column, last: Column, step: float, out: str) -> DataFrame:
    """(keys, out, __at, columns): columns at origin + step times each number from ``first`` to ``last``, linear between a key's rows, flat outside them.

    x is distinct in a key and not null. Each row tells the places from itself up to the next row; the first also those before.
    """
    w = over(keys, [x])
    ahead = {f"__n_{c}": F.lead(c).over(w) for c in (x, *columns)}
    rows = rows.withColumns({**ahead, "__first": F.row_number().over(w) == 1})
    here, following = F.col(x), F.col(f"__n_{x}")
    number = lambda f, c: f((c - origin) / step).cast("int")
    lo = F.when(F.col("__first"), first).otherwise(F.greatest(first, number(F.floor, here) - 1)).cast("int")
    hi = F.when(following.isNull(), last).otherwise(F.least(last, number(F.ceil, following) + 1)).cast("int")
    at = origin + F.col(out) * step
    told = rows.withColumn(out, F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn("__at", at)
    told = told.where((F.col("__first") | (F.col("__at") >= here)) & (following.isNull() | (F.col("__at") < following)))
    share = F.when(following.isNotNull() & (F.col("__at") > here), (F.col("__at") - here) / (following - here))
    value = lambda c: F.when(share.isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"__n_{c}") - F.col(c)) * share).alias(c)
    return told.select(*keys, out, "__at", *[value(c) for c in columns])


def gridded(df: DataFrame, keys: Names, t: str, columns: Names, step: float) -> DataFrame:
    """(keys, g, columns): channels, without nulls, at each ``step`` seconds from a lap's first row on, linear between its rows. Rows of one time are averaged."""
    rows = dealt(df.where(F.col(t).isNotNull()), keys).groupBy(*keys, F.col(t).cast("double").alias("__t")).agg(*[F.avg(c).alias(c) for c in columns])
    lap = Window.partitionBy(*keys)
    rows = rows.withColumns({"__lo": F.min("__t").over(lap), "__hi": F.max("__t").over(lap)})
    rows = rows.withColumn("__end", F.greatest(F.ceil((F.col("__hi") - F.col("__lo")) / step - 1e-9).cast("int") - 1, F.lit(0)))
    return ticked(rows, keys, "__t", columns, F.col("__lo"), F.lit(0), F.col("__end"), step, "g").select(*keys, "g", *columns)


def correlation_lags(df: DataFrame, keys: Names, t: str, ref: str, sig: str, mask: str) -> DataFrame:
    """(keys, shift, r, n): correlation of ref with sig so many grid steps later, where both are masked in."""
    rows = df.where(F.col(ref).isNotNull() & F.col(sig).isNotNull()).withColumn("__m", F.col(mask).cast("double"))
    grid = gridded(rows, keys, t, [ref, sig, "__m"], GRID)
    w = over(keys, ["g"])  # a lap's grid has no gaps
    ahead = F.array(*[F.lead("__s", s).over(w) for s in range(FROM, TO + 1)])
    left = grid.withColumn("__s", F.when(F.col("__m") > 0.5, F.col(sig))).withColumn("__ahead", ahead).where("__m > 0.5")
    met = left.select(*keys, F.col(ref).alias("__a"), F.posexplode("__ahead").alias("shift", "__b")).where("__b is not null").withColumn("shift", F.col("shift") + FROM)
    return met.groupBy(*keys, "shift").agg(correlation(F.col("__a"), F.col("__b")).alias("r"), F.count("*").alias("n")).where("n >= 3 and r is not null")


def best_lag(corrs: DataFrame, keys: Names) -> DataFrame:
    """(keys, lag, r): the shift of the highest correlation in seconds, refined by a parabola through its neighbours."""
    w = Window.partitionBy(*keys).orderBy("shift")
    side = lambda f, d: F.when(f("shift").over(w) == F.col("shift") + d, f("r").over(w))
    rows = corrs.withColumns({"__y0": side(F.lag, -1), "__y2": side(F.lead, 1)})
    best = rows.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("shift")).alias("s"), "__y0", "__y2")).alias("b"))
    bend = F.col("b.__y0") - 2 * F.col("b.r") + F.col("b.__y2")
    return best.select(*keys, ((-F.col("b.s") + F.when(bend < 0, 0.5 * (F.col("b.__y0") - F.col("b.__y2")) / bend).otherwise(0.0)) * GRID).alias("lag"), F.col("b.r").alias("r"))


def slope(df: DataFrame, keys: Names, order: Names, t: str, v: Column, out: str) -> DataFrame:
    """Adds the derivative of v: second order between unequal neighbours, one-sided at the ends."""
    w = over(keys, order)
    df = df.withColumn("__v", v)
    h0, h1 = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    d0, d1 = F.col("__v") - F.lag("__v").over(w), F.lead("__v").over(w) - F.col("__v")
    both = (h0 / h1 * d1 + h1 / h0 * d0) / (h0 + h1)
    ok = lambda h: h.isNotNull() & (h > 0)
    return df.withColumn(out, F.when(ok(h0) & ok(h1), both).when(h0.isNull() & ok(h1), d1 / h1).when(h1.isNull() & ok(h0), d0 / h0)).drop("__v")


def speed_lags(df: DataFrame, keys: Names, order: Names, t: str, obd_mph: str, gps_mph: str, long_g: str) -> DataFrame:
    """(keys, lag, r, origin): "lap" by the two speeds, "accel" by acceleration on laps without an engine bus, null where neither is good enough."""
    w = over(keys, order)
    lap = Window.partitionBy(*keys)
    df = df.withColumns({"__dt": F.col(t) - F.lag(t).over(w), "__obd": F.count(obd_mph).over(lap) > 0})
    laps = df.groupBy(*keys).agg(F.first("__obd").alias("__obd"), (F.count(F.when(F.col(obd_mph) > FAST, 1)) * F.coalesce(F.median("__dt"), F.lit(0.0))).alias("__span"))
    long_enough = laps.where(F.col("__obd") & (F.col("__span") >= SPAN)).select(*keys)
    own = df.where("__obd").join(grown(long_enough), list(keys), "left_semi").withColumn("__fast", F.coalesce(F.col(obd_mph) > FAST, F.lit(False)))
    a = best_lag(correlation_lags(own, keys, t, obd_mph, gps_mph, "__fast"), keys)
    bare = slope(df.where("not __obd"), keys, order, t, F.coalesce(gps_mph, F.lit(0.0)) * MPH / G, "__dv")
    around = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-round(SMOOTH * 5e5), round(SMOOTH * 5e5))
    bare = bare.withColumn("__us", F.round(F.col(t) * 1e6).cast("long")).withColumns({"__lg": F.avg(long_g).over(around), "__sv": F.avg("__dv").over(around), "__fast": F.coalesce(F.col(gps_mph) > FAST, F.lit(False))})
    b = best_lag(correlation_lags(bare, keys, t, "__lg", "__sv", "__fast"), keys)
    met = laps.join(grown(a.select(*keys, F.col("lag").alias("__la"), F.col("r").alias("__ra"))), list(keys), "left").join(grown(b.select(*keys, F.col("lag").alias("__lb"), F.col("r").alias("__rb"))), list(keys), "left")
    by_speed = F.col("__obd") & (F.col("__span") >= SPAN) & (F.col("__ra") >= LIKE)
    by_accel = ~F.col("__obd") & (F.col("__rb") >= LIKE_ACCEL)
    return met.select(*keys, F.when(by_speed, F.col("__la") - HOLD_LEAD).when(by_accel, F.col("__lb")).alias("lag"), F.when(by_speed, F.col("__ra")).when(by_accel, F.col("__rb")).alias("r"), F.when(by_speed, "lap").when(by_accel, "accel").otherwise("none").alias("origin"))


def path_lag(df: DataFrame, keys: Names, t: str, tie: str, x: str, y: str, v: str) -> DataFrame:
    """(keys, lag): seconds by which positions trail the odometer; v in m/s, x and y in metres.

    The length of the path of the fixes is explained, at grid times inside a lap, by a line in time and the odometer's distance so many
    seconds before; the lag that leaves least is the lap's. The fit of a lag is a partial correlation, made from sums. Null with a
    jump, few fixes, a flat search or a least at its edge.
    """
    order = [t, tie]
    w = over(keys, order)
    rows = df.select(*keys, F.col(t).cast("double").alias(t), tie, F.col(x).alias("__x"), F.col(y).alias("__y"), F.coalesce(v, F.lit(0.0)).alias("__v"))
    seen = rows.where("not isnan(__x) and not isnan(__y)")
    fixes = seen.where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    moved = ~(F.col("__x").eqNullSafe(F.lag("__x").over(w)) & F.col("__y").eqNullSafe(F.lag("__y").over(w))) | (F.row_number().over(w) == 1)
    fixes = fixes.withColumn("__new", moved).where("__new")
    for c in ("__x", "__y"):
        fixes = seq.rolling_mean(fixes, keys, order, c, SMOOTHED, f"{c}s")
    step = F.coalesce(F.hypot(F.col("__xs") - F.lag("__xs").over(w), F.col("__ys") - F.lag("__ys").over(w)), F.lit(0.0))
    path = fixes.withColumn("__step", step).withColumn("path", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    good = path.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__step").alias("jump")).where((F.col("n") >= 10) & (F.col("jump") <= JUMP)).select(*keys)
    ranked = rows.withColumns({"__r": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*keys))})
    ends = ranked.where(F.col("__n") - 2 * TRIM >= 50).groupBy(*keys).agg(F.max(F.when(F.col("__r") == TRIM + 1, F.col(t))).alias("lo"), F.max(F.when(F.col("__r") == F.col("__n") - TRIM, F.col(t))).alias("hi")).join(grown(good), list(keys)).where("hi > lo")
    fine = round(GRID / STEP)
    lap = Window.partitionBy(*keys)
    curve = lambda df, c: dealt(df.groupBy(*keys, t).agg(F.max(c).alias(c)).join(grown(ends), list(keys)), keys)
    lo, hi, none = F.col("lo"), F.col("hi"), F.lit(0.0)
    grid = ticked(curve(path, "path"), keys, t, ["path"], none, F.ceil(lo / GRID), F.floor(hi / GRID), GRID, "g").select(*keys, "g", F.col("__at").alias("__t"), F.col("path").alias("__p"))
    odometer = curve(seq.trapezoid(rows, keys, order, t, F.col("__v"), "odo"), "odo")
    ticks = ticked(odometer, keys, t, ["odo"], none, F.floor(lo / STEP) - MOST - fine, F.ceil(hi / STEP) - LEAST + fine, STEP, "f")
    # a row per grid number with its own fine ticks; a shift is then a tick of one of the rows around
    own = ticks.groupBy(*keys, F.floor(F.col("f") / fine).cast("int").alias("g")).agg(*[F.max(F.when(F.pmod(F.col("f"), F.lit(fine)) == k, F.col("odo"))).alias(f"__o{k}") for k in range(fine)])
    both = dealt(grid.unionByName(own, allowMissingColumns=True), keys).groupBy(*keys, "g").agg(*[F.max(c).alias(c) for c in ("__t", "__p", *[f"__o{k}" for k in range(fine)])])
    w = over(keys, ["g"])
    tick = lambda shift: F.lag(f"__o{-shift % fine}", -(-shift // fine)).over(w)
    left = both.withColumns({"__odo": F.array(*[tick(s) for s in range(LEAST, MOST + 1)]), "__mt": F.avg("__t").over(lap), "__mp": F.avg("__p").over(lap)}).where("__t is not null")
    met = left.select(*keys, (F.col("__t") - F.col("__mt")).alias("__t"), (F.col("__p") - F.col("__mp")).alias("__p"), F.posexplode("__odo").alias("shift", "odo")).where("odo is not null").withColumn("shift", F.col("shift") + LEAST)
    s = lambda a, b: F.covar_pop(a, b)
    sums = met.groupBy(*keys, "shift").agg(s("__t", "__t").alias("tt"), s("__t", "__p").alias("tp"), s("__p", "__p").alias("pp"), s("__t", "odo").alias("td"), s("odo", "odo").alias("dd"), s("__p", "odo").alias("pd"))
    free = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("tt")
    dd, pd, pp = free("td", "td", "dd"), free("tp", "td", "pd"), free("tp", "tp", "pp")
    left_over = F.sqrt(F.greatest(F.lit(0.0), pp - F.when(dd > 1e-9, pd * pd / dd).otherwise(0.0)))
    fits = sums.where("tt > 0").select(*keys, "shift", left_over.alias("rms"))
    best = fits.groupBy(*keys).agg(F.min_by("shift", F.struct("rms", "shift")).alias("shift"), F.min("rms").alias("lo"), F.max("rms").alias("hi"), F.avg("rms").alias("mean"))
    clear = (F.col("shift") > LEAST) & (F.col("shift") < MOST) & (F.col("hi") - F.col("lo") > F.greatest(F.lit(1e-9), 1e-6 * F.col("mean")))
    return df.select(*keys).distinct().join(grown(best), list(keys), "left").select(*keys, F.when(clear, F.col("shift") * STEP - HOLD_LEAD).alias("lag"))


def session_position_lag(laps: DataFrame, session: Names, lap: str) -> DataFrame:
    """(session, lag, origin, laps) from laps (rows, slow share, path_lag, speed_lag, speed_origin).

    The median of path lags of eligible laps that are not at the session's ends, where two laps or more have one; else that of
    speed lags less their offset; else the default.
    """
    w = Window.partitionBy(*session)
    marked = laps.withColumns({"__n": F.count("*").over(w), "__lo": F.min(lap).over(w), "__hi": F.max(lap).over(w)})
    inner = (F.col("__n") < 3) | ((F.col(lap) > F.col("__lo")) & (F.col(lap) < F.col("__hi")))
    path = F.when(inner & (F.col("rows") >= ROWS) & (F.col("slow") <= SLOW), F.col("path_lag"))
    got = marked.groupBy(*session).agg(F.count(path).alias("__np"), F.median(path).alias("__path"), F.count("speed_lag").alias("__ns"), F.count(F.when(F.col("speed_lag").isNotNull() & (F.col("speed_origin") != "default"), 1)).alias("__own"), F.median(F.col("speed_lag") - OFFSET).alias("__speed"))
    by_path, by_speed = F.col("__np") >= LAPS, F.col("__own") > 0
    return got.select(*session, F.when(by_path, F.col("__path")).when(by_speed, F.col("__speed")).otherwise(DEFAULT - OFFSET).alias("lag"), F.when(by_path, "path").when(by_speed, "offset").otherwise("offset-default").alias("origin"), F.when(by_path, F.col("__np")).when(by_speed, F.col("__ns")).otherwise(0).alias("laps"))


def ladder(laps: DataFrame, session: Names, lap: str) -> DataFrame:
    """(session, lap, lag, r, origin): every lap with the lag that is applied to it, from laps (lag, r, origin of ``speed_lags``).

    Accepted laps keep their own; the first and last of three or more set none. All others get the median of those of their session
    ("session"), and where there is none the default ("default").
    """
    w = Window.partitionBy(*session)
    edge = (F.count("*").over(w) >= 3) & ((F.col(lap) == F.min(lap).over(w)) | (F.col(lap) == F.max(lap).over(w)))
    marked = laps.withColumn("__own", F.coalesce(F.col("origin").isin("lap", "accel") & ~edge, F.lit(False)))
    middle = marked.where("__own").groupBy(*session).agg(F.median("lag").alias("__mid"))
    met = marked.join(grown(middle), list(session), "left")
    own, mid = F.col("__own"), F.col("__mid")
    return met.select(*session, lap, F.when(own, F.col("lag")).otherwise(F.coalesce(mid, F.lit(DEFAULT))).alias("lag"), F.when(own, F.col("r")).alias("r"), F.when(own, F.col("origin")).when(mid.isNotNull(), "session").otherwise("default").alias("origin"))


def session_lags(samples: DataFrame, session: Names, lap: str, t: str, tie: str, obd_mph: str, gps_mph: str, long_g: str, lat: str, lon: str, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(laps, sessions): laps (session, lap, mid, lag, r, origin) with the lag of speeds and the middle of their time, and sessions
    (session, lag, origin, laps) with the one lag of positions. Where not ``enabled``, both are 0 and "disabled".

    Path lengths are fitted on eligible laps only: inside the session, long, and seldom slow.
    """
    keys = [*session, lap]
    w = Window.partitionBy(*session)
    n = F.count("*")
    slow = F.avg(F.when(F.col(obd_mph) < FAST, 1.0).otherwise(0.0))
    spans = samples.groupBy(*keys).agg(((F.min_by(t, F.struct(t, tie)) + F.max_by(t, F.struct(t, tie))) / 2).alias("mid"), n.alias("rows"), slow.alias("slow"), F.count(obd_mph).alias("__obd"))
    if not enabled:
        none = [F.lit(0.0).alias("lag"), F.lit(None).cast("double").alias("r"), F.lit("disabled").alias("origin")]
        return spans.select(*keys, "mid", *none), spans.select(*session).distinct().select(*session, none[0], none[2], F.lit(0).cast("long").alias("laps"))
    spans = cut(spans)
    own = cut(ladder(speed_lags(samples, keys, [t, tie], t, obd_mph, gps_mph, long_g), session, lap))
    inner = (F.count("*").over(w) < 3) | ((F.col(lap) > F.min(lap).over(w)) & (F.col(lap) < F.max(lap).over(w)))
    fit = spans.withColumn("__in", inner).where(F.col("__in") & (F.col("__obd") > 0) & (F.col("rows") >= ROWS) & (F.col("slow") <= SLOW)).select(*keys)
    rows = samples.join(grown(fit), keys, "left_semi")
    whole = Window.partitionBy(*keys)
    x, y = to_xy(F.col(lat), F.col(lon), F.avg(lat).over(whole), F.avg(lon).over(whole))
    paths = path_lag(rows.select(*keys, t, tie, x.alias("__px"), y.alias("__py"), (F.col(obd_mph) * MPH).alias("__pv")), keys, t, tie, "__px", "__py", "__pv")
    met = spans.join(grown(own.select(*keys, F.col("lag").alias("speed_lag"), F.col("origin").alias("speed_origin"))), keys).join(grown(paths.select(*keys, F.col("lag").alias("path_lag"))), keys, "left")
    return spans.select(*keys, "mid").join(grown(own), keys), session_position_lag(met, session, lap)
