"""Section windows and the verdict on a section's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import BAND_BASE, BAND_PER_RAD, RESIDUAL_BAND, RHO, TIER_A, TIER_B, V_FLOOR

#: Metres before a corner's start that belong to its section, and the most after its end.
PRE, POST = 50.0, 250.0


def windows(corners: DataFrame, lap_length: Column, keys: list[str], pre: float = PRE, post: float = POST) -> DataFrame:
    """(keys, corner_id, a, b): from before a corner to the next corner's start, or ``post`` past its own end if that is nearer."""
    following = F.coalesce(F.lead("start_m").over(Window.partitionBy(*keys).orderBy("start_m")), lap_length)
    return corners.select(*keys, "corner_id", F.greatest(F.lit(0.0), F.col("start_m") - pre).alias("a"), F.least(following, F.col("end_m") + post).alias("b"))


def range_window(corners: DataFrame, lap_length: Column, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, a, b): one window over the corners from ``first`` to ``last``; no row where they come in the other order."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b"))
    w = windows(corners, lap_length, keys).withColumn("at", order)
    ends = w.groupBy(*keys).agg(F.max(F.when(F.col("corner_id") == first, F.struct("at", "a"))).alias("f"), F.max(F.when(F.col("corner_id") == last, F.struct("at", "b"))).alias("l"))
    return ends.where("f.at <= l.at").select(*keys, F.col("f.a").alias("a"), F.col("l.b").alias("b"))


def heading(corridor: DataFrame, sections: DataFrame, keys: list[str], width: float = 10.0) -> DataFrame:
    """(keys, corner_id, heading): the sum of curvature times bin width over a section's bins; bins are exploded from the section and met by equality."""
    lo, hi = F.ceil(F.col("a") / width), F.floor(F.col("b") / width)
    bins = sections.select(*keys, "corner_id", F.explode_outer(F.when(lo <= hi, F.sequence(lo, hi))).alias("bin"))
    return bins.join(corridor.select(*keys, "bin", "kappa"), [*keys, "bin"], "left").groupBy(*keys, "corner_id").agg((F.coalesce(F.sum(F.abs("kappa")), F.lit(0.0)) * width).alias("heading"))


def tier(sigma: Column) -> Column:
    return F.when(sigma <= TIER_A, "A").when(sigma <= TIER_B, "B").otherwise("C")


def verdict(rows: DataFrame) -> DataFrame:
    """Adds sigma_t, tier, rank_eligible and checks to rows of crossings.

    Rows have a, b, seconds (null: not covered), v_a, v_b, sig_a, sig_b, driven, heading, resid
    (null: not evaluable, passes), accel_value and accel_tol (null: fails on GPS-only laps only),
    gps_only and rescaled (the lap's ruler is invalid: the time stays, the rank goes). A row stays a row.
    """
    v_a, v_b = F.greatest("v_a", F.lit(V_FLOOR)), F.greatest("v_b", F.lit(V_FLOOR))
    mean = (v_a + v_b) / 2
    base = F.greatest(F.lit(0.0), (F.pow("sig_a", 2) + F.pow("sig_b", 2) - 2 * RHO * F.col("sig_a") * F.col("sig_b")) / (v_a * v_b))
    band = F.col("heading") * BAND_PER_RAD + BAND_BASE
    off = F.col("driven") - (F.col("b") - F.col("a"))
    over = lambda x, most: F.greatest(F.lit(0.0), F.abs(x) - most) / mean
    sigma = F.sqrt(base + F.pow(over(off, band), 2) + F.pow(F.coalesce(over(F.col("resid"), F.lit(RESIDUAL_BAND)), F.lit(0.0)), 2))
    band_ok, resid_ok = F.abs(off) <= band, F.coalesce(F.abs("resid") <= RESIDUAL_BAND, F.lit(True))
    accel_ok = F.coalesce(F.abs("accel_value") <= F.col("accel_tol"), ~F.col("gps_only"))
    covered = F.col("seconds").isNotNull() & (F.col("b") > F.col("a"))
    check = lambda name, value, most, ok: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), most.cast("double").alias("threshold"), ok.alias("pass"))
    checks = F.array(check("coverage", covered.cast("int"), F.lit(1.0), covered), check("driven_band_dev_m", off, band, band_ok), check("consistency_resid_m", F.col("resid"), F.lit(RESIDUAL_BAND), resid_ok), check("accel_speed_resid_mps", F.col("accel_value"), F.col("accel_tol"), accel_ok))
    out = rows.withColumns({"sigma_t": F.when(covered, sigma), "checks": F.when(covered, checks).otherwise(F.slice(checks, 1, 1))})
    own = F.when(~covered, "C").when(F.col("gps_only") & (F.col("sigma_t") <= TIER_A) & ~(accel_ok & band_ok & resid_ok), "B").otherwise(tier(F.col("sigma_t")))
    out = out.withColumn("tier", own).withColumn("status", F.when(~covered, "no_coverage").when(F.col("rescaled"), "rescale_invalid").otherwise("ok"))
    return out.withColumn("rank_eligible", (F.col("tier") == "A") & (F.col("status") == "ok"))


def failed_checks(gps_only: Column, checks: Column) -> Column:
    """Names of failed checks that bear on the verdict: the accelerometer's on GPS-only laps alone."""
    bad = F.filter(checks, lambda c: ~c["pass"] & (gps_only | (c["name"] != "accel_speed_resid_mps")))
    return F.array_sort(F.transform(bad, lambda c: c["name"]))
