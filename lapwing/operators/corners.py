"""Where corners lie: clusters of candidates along a lap, and pins projected on to laps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import M_PER_DEG, haversine
from lapwing.operators import sequence as seq

Names = Sequence[str]


def density_clusters(candidates: DataFrame, side: str, at: str, length: float, prominence: float, width: float = 5.0, smooth: int = 6, apart: int = 10, reach: float = 30.0, least: int = 5) -> DataFrame:
    """(side, apex, n): prominent peaks of the smoothed density of candidates, at the median of those within ``reach``.

    Candidates are counted into bins first; what follows is over the bins of a lap, some hundred of them.
    """
    bins = int(length // width)
    counts = candidates.where((F.col(at) >= 0) & (F.col(at) < bins * width)).groupBy(side, F.floor(F.col(at) / width).cast("double").alias("bin")).agg(F.count("*").alias("n"))
    spine = candidates.select(side).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("double"))
    # places outside the lap count as empty
    around = Window.partitionBy(side).orderBy("bin").rowsBetween(-(smooth // 2), (smooth - 1) // 2)
    level = spine.join(counts, [side, "bin"], "left").select(side, "bin", (F.sum(F.coalesce("n", F.lit(0))).over(around) / F.lit(float(smooth))).alias("v"))
    tops = seq.peaks(level, [side], "bin", "v", 0.0, float(apart)).select(side, F.floor("bin").cast("double").alias("top"), F.col("v").alias("height"))
    met = tops.join(level, side)
    higher = F.col("v") > F.col("height")
    walls = met.groupBy(side, "top", "height").agg(F.max(F.when(higher & (F.col("bin") < F.col("top")), F.col("bin"))).alias("l"), F.min(F.when(higher & (F.col("bin") > F.col("top")), F.col("bin"))).alias("r"))
    low = walls.join(level, side).groupBy(side, "top", "height").agg(
        F.min(F.when((F.col("bin") <= F.col("top")) & (F.col("bin") > F.coalesce("l", F.lit(-1.0))), F.col("v"))).alias("left"),
        F.min(F.when((F.col("bin") >= F.col("top")) & (F.col("bin") < F.coalesce("r", F.lit(float(bins)))), F.col("v"))).alias("right"),
    )
    kept = low.where(F.col("height") - F.greatest("left", "right") >= prominence).select(side, ((F.col("top") + 0.5) * width).alias("centre"))
    near = candidates.join(kept, side).where(F.abs(F.col(at) - F.col("centre")) <= reach)
    return near.groupBy(side, "centre").agg(F.median(at).alias("apex"), F.count("*").alias("n")).where(F.col("n") >= least).select(side, "centre", "apex", "n")


def pin_matches(points: DataFrame, pins: DataFrame, keys: Names, order: Names, carry: Names, most: float = 50.0) -> DataFrame:
    """(keys, pin, metres, carry): each lap's sample nearest to each pin (pin, pin_lat, pin_lon), if nearer than ``most``.

    A pin lists the cells of latitude and longitude within its reach, and samples meet it there by equality.
    """
    high = most / M_PER_DEG
    wide = F.lit(high) / F.greatest(F.cos(F.radians(F.abs("pin_lat") + high)), F.lit(0.01))
    cells = lambda c, reach: F.sequence(F.floor((F.col(c) - reach) / high), F.floor((F.col(c) + reach) / high))
    near = pins.withColumn("__ca", F.explode(cells("pin_lat", F.lit(high * 1.01)))).withColumn("__co", F.explode(cells("pin_lon", wide * 1.01)))
    rows = points.withColumns({"__ca": F.floor(F.col("lat") / high), "__co": F.floor(F.col("lon") / high)})
    met = rows.join(near, ["__ca", "__co"]).withColumn("__d", haversine(F.col("lat"), F.col("lon"), F.col("pin_lat"), F.col("pin_lon")))
    best = met.groupBy(*keys, "pin").agg(F.min(F.struct("__d", *order, *[c for c in carry if c not in order])).alias("b"))
    return best.where(F.col("b.__d") < most).select(*keys, "pin", F.col("b.__d").alias("metres"), *[F.col(f"b.{c}").alias(c) for c in carry])


def seeded_boxes(clusters: DataFrame, pins: DataFrame, within: float = 80.0, half: float = 80.0) -> DataFrame:
    """(pin, side, centre, start_m, end_m, apex_m, second_m, confidence): corner boxes from pins (pin, side, place, laps, optional second pin's place) and clusters (side, centre).

    A pin takes the nearest cluster of its side within ``within`` metres, met on cells of that width; without one it stands for itself.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / within) + d).cast("long")
    c = clusters.select("side", F.col("centre").alias("__centre"), F.explode(F.array(*[cell("centre", d) for d in (-1, 0, 1)])).alias("__c"))
    met = pins.withColumn("__c", cell("place")).join(c, ["side", "__c"], "left").withColumn("__gap", F.abs(F.col("place") - F.col("__centre")))
    best = met.groupBy(*pins.columns).agg(F.min(F.when(F.col("__gap") <= within, F.struct("__gap", "__centre"))).alias("__b"))
    centre = F.coalesce(F.col("__b.__centre"), F.col("place"))
    second = F.col("second") if "second" in pins.columns else F.lit(None).cast("double")
    lo, hi = F.least(centre, F.coalesce(second, centre)), F.greatest(centre, F.coalesce(second, centre))
    return best.select("pin", "side", centre.alias("centre"), F.greatest(F.lit(0.0), lo - half).alias("start_m"), (hi + half).alias("end_m"), centre.alias("apex_m"), second.alias("second_m"), F.when(F.col("__b").isNull(), "low").otherwise("high").alias("confidence"))


def pin_places(matches: DataFrame, at: str) -> DataFrame:
    """(pin, place, spread, laps): median and deviation over laps of where a pin lies."""
    return matches.groupBy("pin").agg(F.median(at).alias("place"), F.stddev_pop(at).alias("spread"), F.count("*").alias("laps"))


def apex_spread(matches: DataFrame, lap: str, worst: int = 4) -> DataFrame:
    """(pin, median, deviation, worst): how far laps pass from a pin, and the laps that pass farthest."""
    rank = F.row_number().over(Window.partitionBy("pin").orderBy(F.desc("metres"), lap))
    far = matches.withColumn("__r", rank).where(F.col("__r") <= worst).groupBy("pin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(lap).cast("string").alias("lap")))), lambda s: s["lap"]), ",").alias("worst"))
    return matches.groupBy("pin").agg(F.median("metres").alias("median"), F.stddev_samp("metres").alias("deviation")).join(far, "pin")
