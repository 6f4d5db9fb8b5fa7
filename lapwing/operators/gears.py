"""Gears from the ratio of engine speed to road speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators import sequence as seq
from lapwing.operators.sequence import FIRST, HERE, over

Names = Sequence[str]

#: Range and bins of the histogram, least share of the top bin, least distance of bands, dwell of a gear, least engine and road speed.
LO, HI, BINS, SHARE, APART, DWELL, RPM, MPH = 30.0, 260.0, 230, 0.005, 8.0, 0.3, 1200, 8.0
#: Fixed values of shift classes: metres before the zone, least rows.
BEFORE, LEAST_ROWS = 50.0, 10


def gear_bands(df: DataFrame, ratio: Column) -> list[float]:
    """Centres of the bands, ascending: local maxima of the histogram, of maxima too close the first, each the mean of what is near it.

    At most ``BINS`` rows of the histogram come to the driver.
    """
    r = df.select(ratio.cast("double").alias("r")).where(F.col("r").between(LO, HI))
    lo, hi = r.agg(F.min("r"), F.max("r")).first()
    if lo is None:
        return []
    width = (hi - lo) / BINS or 1.0
    h = {x["bin"]: x["n"] for x in r.groupBy(F.least(F.floor((F.col("r") - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n")).collect()}
    n = [h.get(i, 0) for i in range(BINS)]
    kept: list[float] = []
    for i in range(1, BINS - 1):
        if n[i] >= n[i - 1] and n[i] > n[i + 1] and n[i] >= SHARE * max(n) and (not kept or lo + (i + 0.5) * width - kept[-1] >= APART):
            kept.append(lo + (i + 0.5) * width)
    near = [F.avg(F.when(F.abs(F.col("r") - c) < APART / 2, F.col("r"))) for c in kept]
    means = r.agg(*near).first() if kept else []
    return sorted(c if m is None else m for c, m in zip(kept, means, strict=True))


def nearest_band(ratio: Column, bands: Sequence[float]) -> Column:
    """The gear of a ratio: 0 for the largest band, the shortest gear."""
    if not bands:
        return F.lit(None).cast("int")
    best = F.array_min(F.array(*[F.struct(F.abs(ratio - b).alias("away"), F.lit(i).alias("i")) for i, b in enumerate(bands)]))
    return F.when(ratio.isNotNull(), len(bands) - 1 - best["i"])


def derive_gear(df: DataFrame, keys: Names, order: Names, t: str, rpm: str, mph: str, bands: Sequence[float], out: str = "gear") -> DataFrame:
    """Adds the gear: nearest band, without runs shorter than the dwell, held over gaps; null without engine speed."""
    w = over(keys, order)
    raw = F.when((F.col(rpm) > RPM) & (F.col(mph) > MPH), nearest_band(F.col(rpm) / F.col(mph), bands))
    df = df.withColumns({"__raw": raw, "__dt": F.col(t) - F.lag(t).over(w)})
    df = df.withColumn("__least", F.greatest(F.lit(1), F.bround(DWELL / F.coalesce(F.median("__dt").over(Window.partitionBy(*keys)), F.lit(0.046)))))
    df = seq.suppress_runs(df, keys, order, "__raw", F.col("__least"), "__sure")
    held = F.last("__sure", True).over(w.rowsBetween(FIRST, HERE))
    return df.withColumn(out, F.when(F.coalesce(F.col(rpm) != 0, F.lit(True)), held)).drop("__raw", "__dt", "__least", "__sure")


def shift_classes(df: DataFrame, keys: Names, order: Names, at: str, rpm: str, gear: str, start: float, apex: float, end: float) -> DataFrame:
    """(keys, label, reason, shift_m, apex_gear): whether a lap shifts down once on the way into a corner.

    Rows from 50 m before the zone to ``end`` count. Shifts past the apex are traffic; few rows, few gears and several shifts are ambiguous.
    """
    rows = df.where((F.col(at) >= start - BEFORE) & (F.col(at) <= end))
    known = rows.where(F.col(gear).isNotNull()).withColumn("__before", F.lag(gear).over(over(keys, order)))
    down = F.col(gear) < F.col("__before")
    shifts = known.groupBy(*keys).agg(F.count("*").alias("__gears"), F.count(F.when(down, 1)).alias("__down"), F.min(F.when(down, F.col(at))).alias("__at"), F.max_by(gear, F.when(F.col(at) <= apex, F.struct(*order))).alias("apex_gear"))
    laps = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(F.coalesce(rpm, F.lit(1))).alias("__rpm"))
    met = laps.join(shifts, list(keys), "left")
    reason = F.when(F.col("__n") < LEAST_ROWS, "ambiguous").when(F.col("__rpm") == 0, "no-obd").when(F.coalesce("__gears", F.lit(0)) < 2, "ambiguous").when(F.col("__down") == 0, F.lit(None)).when(F.col("__down") > 1, "ambiguous").when(F.col("__at") > apex, "traffic")
    met = met.withColumn("reason", reason)
    label = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("__down") == 0, "no-downshift").otherwise("downshift")
    one = (F.col("__n") >= LEAST_ROWS) & (F.col("__rpm") != 0) & (F.col("__gears") >= 2) & (F.col("__down") == 1)
    seen = (F.col("__n") >= LEAST_ROWS) & (F.col("__rpm") != 0)
    return met.select(*keys, label.alias("label"), "reason", F.when(one, F.col("__at")).alias("shift_m"), F.when(seen, F.col("apex_gear")).alias("apex_gear"))


def group_traces(df: DataFrame, laps: DataFrame, keys: Names, at: str, lo: float, hi: float) -> DataFrame:
    """Samples of chosen laps inside a stretch."""
    return df.join(laps.select(*keys).distinct(), list(keys), "left_semi").where(F.col(at).between(lo, hi))
