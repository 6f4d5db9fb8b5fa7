"""Where a lap's car was on the ruler: odometer distance plus a smooth offset fitted to the fixes.

``df`` has a row per sample; ``keys`` name a lap. Points of a knot, and knots of a lap, are bounded by the
length of a lap, so they are gathered into arrays and fitted by array expressions after one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import MAD_SCALE, huber, tricube
from lapwing.functions.lineage import cut, grown
from lapwing.operators import sequence as seq
from lapwing.operators.sequence import FIRST, HERE, over, turned_round

Names = Sequence[str]

#: A fresh fix, masks of wrong segments, of a lap's ruler, of teleports and of the rest, half window and least of its values.
FRESH, SNAP, RESCALE, TELEPORT, BACKSTOP, HALF, LEAST = 0.01, 200.0, 150.0, 15.0, 60.0, 15, 5
#: Hampel's factor, noise of a fix, knots' spacing and band, Huber's factor and offset, caps and floors of sigma.
SIGMAS, NOISE, SPACING, BAND, OUTLIER, OUTLIER_BASE, FIT_CAP, FLOOR = 5.0, 3.0, 10.0, 60.0, 3.0, 0.5, 15.0, 1.0
#: Bound of the offset's slope (reach, gravity, least speed, factor, floor, cap), the prior (ends, middle, taper).
SLOPE_REACH, SLOPE_G, SLOWEST, SLOPE_FACTOR, SLOPE_FLOOR, SLOPE_CAP = 30.0, 9.81, 8.0, 20.0, 0.10, 0.80
PRIOR_END, PRIOR_MID, TAPER = 2.0, 6.5, 200.0
#: Soft scale of the corridor's edge, width of its bins, speeds that scale the two channels and how many they must be.
SOFT, BIN, SCALE_ABOVE, SCALE_LEAST = 5.0, 10.0, 15.0, 50


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, computed once: a generator keeps later expressions from copying theirs."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fresh(df: DataFrame, keys: Names, order: Names, at: str, out: str = "fresh") -> DataFrame:
    """Marks rows whose ruler differs from the row before by more than a fresh fix does; a key's first row is one."""
    w = over(keys, order)
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, True).otherwise(F.coalesce(F.abs(F.col(at) - F.lag(at).over(w)) > FRESH, F.lit(False))))


def evidence(df: DataFrame, keys: Names, order: Names, dl: str, td: str) -> DataFrame:
    """Adds delta (ruler less odometer), rescale_invalid (of the lap) and evidence: fresh fixes on the right
    segment, near the rolling median of their like, and near the median of what is left."""
    lap = Window.partitionBy(*keys)
    df = fresh(df.withColumn("delta", F.col(td) - F.col(dl)), keys, order, td)
    df = df.withColumn("__lap", F.median("delta").over(lap))
    seen = F.col("fresh") & (F.abs(F.col("delta") - F.col("__lap")) < SNAP)
    df = df.withColumn("__seen", F.coalesce(seen, F.lit(False))).withColumn("__d", F.when(F.col("__seen"), F.col("delta")))
    df = seq.rolling_median(df, keys, order, "__d", HALF, LEAST, "__m").withColumn("__away", F.abs(F.col("__d") - F.col("__m")))
    df = seq.rolling_median(df, keys, order, "__away", HALF, LEAST, "__mad")
    near = F.col("__away") <= F.greatest(F.lit(TELEPORT), SIGMAS * F.coalesce(F.col("__mad") * MAD_SCALE, F.lit(NOISE)))
    df = df.withColumn("__ok", F.col("__seen") & F.coalesce(near, F.lit(False)))
    df = df.withColumn("__c", F.median(F.when(F.col("__ok"), F.col("delta"))).over(lap))
    own = F.col("__ok") & F.coalesce(F.abs(F.col("delta") - F.col("__c")) < BACKSTOP, F.lit(False))
    invalid = F.coalesce(F.abs("__lap") > RESCALE, F.lit(True))
    return df.withColumns({"evidence": own & ~invalid, "rescale_invalid": invalid}).drop("__lap", "__seen", "__d", "__m", "__away", "__mad", "__ok", "__c")


def without_flagged(df: DataFrame, keys: Names, order: Names, flag: str) -> DataFrame:
    """Takes flagged fixes, and the rows that hold their values until the next fix, out of the evidence; adds held_by_flag."""
    held = F.last(F.when(F.col("fresh"), F.coalesce(F.col(flag), F.lit(False))), True).over(over(keys, order).rowsBetween(FIRST, HERE))
    df = df.withColumn("held_by_flag", F.coalesce(held, F.lit(False)))
    return df.withColumn("evidence", F.col("evidence") & ~F.col("held_by_flag"))


def speed_scale(df: DataFrame, keys: Names, gps: str, obd: str) -> DataFrame:
    """(keys, scale): median ratio of the speed channels where both are fast (m/s); 1 with few such rows."""
    fast = (F.col(gps) > SCALE_ABOVE) & (F.col(obd) > SCALE_ABOVE)
    ratio = F.when(fast, F.col(gps) / F.col(obd))
    return df.groupBy(*keys).agg(F.when(F.count(ratio) >= SCALE_LEAST, F.median(ratio)).otherwise(1.0).alias("scale"))


def bin_index(at: Column, bins: int) -> Column:
    """The corridor bin of a place: rounded half to even, clipped, 0 where there is none."""
    return F.when(at.isNull() | F.isnan(at.cast("double")), 0).otherwise(F.greatest(F.least(F.bround(at / BIN), F.lit(bins - 1)), F.lit(0))).cast("int")


def lateral_offset(df: DataFrame, corridor: DataFrame, bins: int, x: str, y: str, at: str, out: str = "e_lat", track: Names = ()) -> DataFrame:
    """Adds the signed distance of a point from the corridor's middle, positive to the left of travel.

    ``corridor`` has a row per track and bin: bin, gx, gy (middle), tx, ty (unit tangent).
    """
    c = corridor.select(*track, "bin", "gx", "gy", "tx", "ty")
    met = df.withColumn("bin", bin_index(F.col(at), bins)).join(c, [*track, "bin"], "left")
    return met.withColumn(out, -F.col("ty") * (F.col(x) - F.col("gx")) + F.col("tx") * (F.col(y) - F.col("gy"))).drop("bin", "gx", "gy", "tx", "ty")


def envelope_weight(df: DataFrame, corridor: DataFrame, bins: int, at: str, e: str, out: str = "w", track: Names = ()) -> DataFrame:
    """Adds how much a sample counts: 1 inside its bin's envelope (e_lo, e_hi), falling softly outside; null offsets count 0."""
    met = df.withColumn("bin", bin_index(F.col(at), bins)).join(corridor.select(*track, "bin", "e_lo", "e_hi"), [*track, "bin"], "left")
    outside = F.greatest(F.lit(0.0), F.col("e_lo") - F.col(e), F.col(e) - F.col("e_hi"))
    return met.withColumn(out, F.when(F.col(e).isNull(), 0.0).otherwise(F.exp(-F.pow(outside / SOFT, 2)))).drop("bin", "e_lo", "e_hi")


def knot_spine(df: DataFrame, keys: Names, dl: str) -> DataFrame:
    """(keys, j, knot): every ``SPACING`` metres of a lap's odometer, from its least on and below its largest."""
    ends = df.groupBy(*keys).agg(F.min(dl).alias("lo"), F.max(dl).alias("hi"))
    n = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / SPACING).cast("int"), F.lit(1))
    return ends.where("lo is not null").select(*keys, "lo", F.explode(F.sequence(F.lit(0), n - 1)).alias("j")).select(*keys, "j", (F.col("lo") + SPACING * F.col("j")).alias("knot"))


def to_knots(df: DataFrame, spine: DataFrame, keys: Names, dl: str, reach: float) -> DataFrame:
    """Rows of ``df`` with each knot (j, knot) less than ``reach`` away: exploded to the few knots around, which follow from the spine's ends."""
    ends = spine.groupBy(*keys).agg(F.min("knot").alias("__lo"), F.max("j").alias("__last"))
    off = F.col(dl) - F.col("__lo")
    first, last = F.greatest(F.ceil((off - reach) / SPACING).cast("int"), F.lit(0)), F.least(F.floor((off + reach) / SPACING).cast("int"), F.col("__last"))
    around = df.join(grown(ends), list(keys)).withColumn("j", F.explode(F.when(first <= last, F.sequence(first, last))))
    return around.withColumn("knot", F.col("__lo") + SPACING * F.col("j")).where(F.abs(F.col(dl) - F.col("knot")) < reach).drop("__lo", "__last")


def knot_fit(points: DataFrame, spine: DataFrame, keys: Names, d: str, z: str, w: str) -> DataFrame:
    """(keys, j, fit, se, n_eff): tricube local lines through the points, two Huber passes; no row with fewer than three points."""
    near = to_knots(points, spine, keys, d, BAND).withColumn("__x", F.col(d) - F.col("knot"))
    point = F.struct(F.col("__x").alias("x"), F.col(z).cast("double").alias("z"), (F.col(w) * tricube(F.col("__x") / BAND)).alias("w"))
    df = near.groupBy(*keys, "j").agg(F.array_sort(F.collect_list(point)).alias("p")).where(F.size("p") >= 3)
    df = df.withColumn("w", F.transform("p", lambda p: p["w"]))
    weighed = lambda f: total(F.zip_with("p", "w", lambda p, w: w * f(p)))
    for _ in range(2):
        df = settled(df, {"all": total(F.col("w"))}).where("all >= 1e-9")
        df = settled(df, {"xm": weighed(lambda p: p["x"]) / F.col("all"), "zm": weighed(lambda p: p["z"]) / F.col("all")})
        df = settled(df, {"sxx": weighed(lambda p: F.pow(p["x"] - F.col("xm"), 2)), "sxz": weighed(lambda p: (p["x"] - F.col("xm")) * (p["z"] - F.col("zm")))})
        df = settled(df, {"slope": F.when(F.col("sxx") > 1e-9, F.col("sxz") / F.col("sxx")).otherwise(0.0)})
        df = settled(df, {"r": F.transform("p", lambda p: p["z"] - F.col("zm") - F.col("slope") * (p["x"] - F.col("xm")))})
        df = settled(df, {"rm": middle(F.col("r"))})
        df = settled(df, {"mad": MAD_SCALE * middle(F.transform("r", lambda r: F.abs(r - F.col("rm"))))})
        df = settled(df, {"w": F.zip_with("p", "r", lambda p, r: p["w"] * huber(r, OUTLIER * (F.col("mad") + OUTLIER_BASE)))})
    df = settled(df, {"all": total(F.col("w")), "sq": total(F.transform("w", lambda w: w * w))}).where("all >= 1e-6")
    n_eff = F.pow("all", 2) / F.col("sq")
    return df.select(*keys, "j", F.col("zm").alias("fit"), (F.greatest("mad", F.lit(NOISE)) / F.sqrt(F.greatest(n_eff, F.lit(1e-9)))).alias("se"), n_eff.alias("n_eff"))


def slope_bound(df: DataFrame, spine: DataFrame, keys: Names, dl: str, v: str, lat_g: str) -> DataFrame:
    """(keys, j, bound): how much the offset may change for each metre, by the median curvature around a knot."""
    bend = F.abs(lat_g) * SLOPE_G / F.pow(F.greatest(F.coalesce(F.col(v), F.lit(SLOWEST)), F.lit(SLOWEST)), 2)
    kappa = to_knots(df, spine, keys, dl, SLOPE_REACH).groupBy(*keys, "j").agg(F.median(bend).alias("kappa"))
    return spine.select(*keys, "j").join(grown(kappa), [*keys, "j"], "left").select(*keys, "j", F.least(F.coalesce("kappa", F.lit(0.0)) * SLOPE_FACTOR + SLOPE_FLOOR, F.lit(SLOPE_CAP)).alias("bound"))


def linear_fill(df: DataFrame, keys: Names, x: str, y: str, out: str) -> DataFrame:
    """Nulls of y between its neighbours in x, linearly; the nearest value before the first and after the last."""
    w = Window.partitionBy(*keys).orderBy(x)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))
    df = df.withColumns({"__a": F.last(known, True).over(w.rowsBetween(FIRST, HERE)), "__b": F.last(known, True).over(turned_round(keys, [x]))})
    a, b = F.col("__a"), F.col("__b")
    between = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    return df.withColumn(out, F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(between)).drop("__a", "__b")


def gap_to(spine: DataFrame, points: DataFrame, keys: Names, d: str, out: str = "gap") -> DataFrame:
    """``spine`` with the distance from each knot to the nearest point of its key, 1e4 without any: both are sorted once, no pairs are formed."""
    both = spine.select(*keys, "j", F.col("knot").alias("__x"), F.lit(None).cast("double").alias("__p")).unionByName(points.select(*keys, F.lit(None).cast("int").alias("j"), F.col(d).cast("double").alias("__x"), F.col(d).cast("double").alias("__p")))
    w = Window.partitionBy(*keys).orderBy("__x")
    before, after = F.last("__p", True).over(w.rangeBetween(FIRST, HERE)), F.last("__p", True).over(turned_round(keys, ["__x"]).rangeBetween(FIRST, HERE))
    near = both.withColumns({"__b": before, "__a": after}).where("j is not null")
    gap = F.coalesce(F.least(F.col("__x") - F.col("__b"), F.col("__a") - F.col("__x")), F.lit(1e4))
    return near.select(*keys, "j", F.col("__x").alias("knot"), gap.alias(out))


def prior_sigma(knot: Column, lo: Column, hi: Column) -> Column:
    """Sigma of an offset of 0: small at a lap's ends, which the ruler pins."""
    share = F.least(knot - lo, hi - knot) / TAPER
    return F.when(hi > lo, F.least(F.greatest(PRIOR_END + (PRIOR_MID - PRIOR_END) * share, F.lit(PRIOR_END)), F.lit(PRIOR_MID))).otherwise(PRIOR_MID)


def knots(df: DataFrame, keys: Names, dl: str, v: str, lat_g: str, w: str, prior_only: str = "rescale_invalid") -> DataFrame:
    """(keys, j, knot, delta, sigma): the blended offset and its sigma, from rows with delta and evidence.

    Laps without evidence, with fewer than two knots, or flagged by ``prior_only``, have offset 0 and the prior's sigma.
    """
    spine = knot_spine(df, keys, dl)
    seen = df.where("evidence")
    fit = knot_fit(seen, spine, keys, dl, "delta", w)
    lap = Window.partitionBy(*keys)
    rows = gap_to(spine, seen, keys, dl).join(grown(fit.select(*keys, "j", "fit", "se")), [*keys, "j"], "left").join(grown(slope_bound(df, spine, keys, dl, v, lat_g)), [*keys, "j"])
    rows = linear_fill(rows.withColumn("__n", F.count("fit").over(lap)), keys, "knot", "fit", "__fit")
    rows = rows.withColumn("__fit", F.when(F.col("__n") >= 2, F.col("__fit")).otherwise(0.0))
    limited = seq.fold_limited(rows, keys, "j", "__fit", F.col("bound") * SPACING, "__delta").drop("__fit").withColumn("j", F.col("j").cast("int"))
    rows = rows.join(grown(limited), [*keys, "j"])
    clip = F.col("__delta_moved")
    own = F.sqrt(F.pow(F.least(F.coalesce("se", F.lit(FIT_CAP)), F.lit(FIT_CAP)), 2) + F.pow(F.col("bound") * F.col("gap"), 2) + F.pow(clip, 2))
    rows = rows.withColumns({"__own": own, "__prior": prior_sigma(F.col("knot"), F.min("knot").over(lap), F.max("knot").over(lap)), "__size": F.count("*").over(lap)})
    e, p = 1 / F.pow(F.greatest("__own", F.lit(0.5)), 2), 1 / F.pow("__prior", 2)
    bare = df.groupBy(*keys).agg((F.max(F.col(prior_only).cast("int")) + F.when(F.max(F.col("evidence").cast("int")) == 1, 0).otherwise(1) > 0).alias("__bare"))
    rows = rows.join(grown(bare), list(keys)).withColumn("__bare", F.col("__bare") | (F.col("__size") < 2))
    delta = F.when(F.col("__bare"), 0.0).otherwise(F.col("__delta") * e / (e + p))
    sigma = F.greatest(F.when(F.col("__bare"), F.col("__prior")).otherwise(F.sqrt(1 / (e + p))), F.lit(FLOOR))
    return rows.select(*keys, "j", "knot", delta.alias("delta"), sigma.alias("sigma"))


def at_knots(df: DataFrame, knot_rows: DataFrame, keys: Names, at: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with knot columns (name: new name), linear between knots and flat outside; a lap's knots come as one array."""
    rows = knot_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "knot", *columns))).alias("__k"))
    met = df.join(grown(rows), list(keys), "left")
    n, first = F.size("__k"), F.element_at("__k", 1)["knot"]
    j = F.least(F.greatest(F.floor((F.col(at) - first) / SPACING), F.lit(0)), n - 1).cast("int")
    met = met.withColumn("__a", F.element_at("__k", j + 1)).withColumn("__b", F.element_at("__k", F.least(j + 2, n)))
    share = F.when(F.col("__b.knot") > F.col("__a.knot"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("__a.knot")) / (F.col("__b.knot") - F.col("__a.knot"))))).otherwise(0.0)
    return met.withColumns({new: F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * share for c, new in columns.items()}).drop("__k", "__a", "__b")


def trajectory(df: DataFrame, knot_rows: DataFrame, keys: Names, order: Names, dl: str, has_obd: Column) -> DataFrame:
    """Samples with delta_hat, sigma_m, s_hat (never falling) and status, from the lap's knots."""
    df = at_knots(df, knot_rows, keys, dl, {"delta": "delta_hat", "sigma": "sigma_m"})
    s = F.max(F.col(dl) + F.col("delta_hat")).over(over(keys, order).rowsBetween(FIRST, HERE))
    lap_obd = F.max(has_obd.cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumns({"s_hat": s, "status": F.when(F.col("rescale_invalid"), "rescale_invalid").when(lap_obd, "ok").otherwise("gps_backbone")})


def estimate(df: DataFrame, keys: Names, order: Names, dl: str, td: str, v: str, lat_g: str, e: str, has_obd: Column, corridor: DataFrame, bins: int, flag: str | None = None, track: Names = ()) -> tuple[DataFrame, DataFrame]:
    """(samples, knots) of laps: evidence, flagged fixes out, corridor weights, knots, trajectory.

    Both are cut by checkpoints: sections read them several times, and each lap is estimated once.
    """
    seen = evidence(df, keys, order, dl, td)
    if flag:
        seen = without_flagged(seen, keys, order, flag)
    seen = cut(envelope_weight(seen, corridor, bins, td, e, track=track))
    rows = cut(knots(seen, keys, dl, v, lat_g, "w"))
    return cut(trajectory(seen, rows, keys, order, dl, has_obd)), rows
