"""The middle line of a track and the corridor around it, from many laps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import drift_corrected
from lapwing.functions.lineage import cut
from lapwing.operators.sequence import FIRST, HERE, turned_round

Names = Sequence[str]

#: Fixed values in metres: reach of a bin, spread and crowding that reject it, smoothing in corners and on straights, blend between them.
REACH, SPREAD, CROWDED, SMOOTH, STRAIGHT, BLEND, LEAST = 2.0, 6.0, 1.5, 2.0, 10.0, 25.0, 5
#: Fixed values of the corridor: bin, pad, cap, least laps and band without them, least laps of a curvature, quantiles; smoothing of its line.
BIN, PAD, CAP, LAPS, COLD, BEND_LAPS, LO, HI, FIELD, FIELD_REACH = 10.0, 2.0, 20.0, 30, 15.0, 20, 0.02, 0.98, 10.0, 20.0
#: Version of the corridor's rule.
VERSION = "corridor-1"


#: Fixed values of what a line is made from, in metres: disagreement of a lap's drift, offset of a passage.
DRIFT_LIMIT, OFFSET_LIMIT = 20.0, 40.0
UNRELIABLE = "gps_unreliable"


def line_samples(samples: DataFrame, laps: DataFrame, passages: DataFrame, notes: DataFrame, lat0: Column) -> DataFrame:
    """Samples that a line may be made from, with lat and long moved back by their lap's drift.

    Out are sessions whose notes (session_id, exclude, flag) exclude them or call their GPS unreliable, laps that are not clean, laps whose
    drift disagrees by more than its limit (unknown disagreement passes), and, of each lap, the stretches of corners (session_id, lap, corner_id) that
    it passed too far off. Laps, passages and notes meet samples by equality; samples between corners stay.
    """
    out = notes.where(F.coalesce("exclude", F.lit(False)) | F.coalesce(F.col("flag") == UNRELIABLE, F.lit(False))).select("session_id")
    clean = laps.where("is_clean").select("session_id", "lap")
    glitched = passages.where(F.col("offset_max") > OFFSET_LIMIT).select("session_id", "lap", F.col("corner_id").alias("corner"))
    kept = samples.join(out, "session_id", "left_anti").join(clean, ["session_id", "lap"], "left_semi")
    kept = kept.where(F.coalesce(F.col("gps_drift_disagreement_m") <= DRIFT_LIMIT, F.lit(True))).join(glitched, ["session_id", "lap", "corner"], "left_anti")
    lat, lon = drift_corrected(F.col("lat"), F.col("long"), F.col("gps_drift_lat_m"), F.col("gps_drift_lon_m"), lat0)
    return kept.withColumns({"lat": lat, "long": lon})


def bins(samples: DataFrame, track: Names, at: str, x: str, y: str) -> DataFrame:
    """(track, bin, x, y, spread, n): medians of the samples within ``REACH`` of each metre; null with fewer than five."""
    around = F.sequence(F.ceil(F.col(at) - REACH).cast("int"), F.floor(F.col(at) + REACH).cast("int"))
    met = samples.where(F.col(at).isNotNull()).select(*track, F.explode(around).alias("bin"), F.col(x).alias("__x"), F.col(y).alias("__y")).where("bin >= 0")
    enough = lambda c: F.when(F.count("*") >= LEAST, c)
    return met.groupBy(*track, "bin").agg(enough(F.median("__x")).alias("x"), enough(F.median("__y")).alias("y"), F.hypot(F.stddev_pop("__x"), F.stddev_pop("__y")).alias("spread"), F.count("*").alias("n"))


def rejected(rows: DataFrame, boxes: DataFrame, track: Names) -> DataFrame:
    """Nulls x and y of bins outside the protected boxes (start_m, end_m) that spread too far or are folded on themselves; adds protected and rejected."""
    inside = boxes.select(*track, F.explode(F.sequence(F.ceil("start_m").cast("int"), F.floor("end_m").cast("int"))).alias("bin")).distinct().withColumn("protected", F.lit(True))
    usual = rows.groupBy(*track).agg(F.median("n").alias("__usual"))
    met = rows.join(inside, [*track, "bin"], "left").join(usual, list(track)).withColumn("protected", F.coalesce("protected", F.lit(False)))
    bad = ~F.col("protected") & ((F.coalesce("spread", F.lit(0.0)) > SPREAD) | (F.col("n") > CROWDED * F.col("__usual")))
    met = met.withColumn("rejected", bad)
    return met.withColumns({c: F.when(~F.col("rejected"), F.col(c)) for c in ("x", "y")}).drop("__usual")


def _ring(rows: DataFrame, track: Names, length: str) -> DataFrame:
    """The ring of bins three times over, as ``__p``, with the middle turn marked."""
    return rows.select("*", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("__turn")).withColumn("__p", F.col("bin") + F.col("__turn") * F.col(length))


def ring_fill(rows: DataFrame, track: Names, length: str, columns: Names) -> DataFrame:
    """Nulls filled linearly between the neighbours on the ring of ``length`` bins; every bin needs a row."""
    w = Window.partitionBy(*track).orderBy("__p")
    ring = _ring(rows, track, length)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(c).alias("v")))
        ring = ring.withColumns({f"__a_{c}": F.last(known, True).over(w.rowsBetween(FIRST, HERE)), f"__b_{c}": F.last(known, True).over(turned_round(track, ["__p"]))})
    ring = ring.where("__turn = 0")
    for c in columns:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        ring = ring.withColumn(c, F.when(a.isNull() | b.isNull() | (a["p"] == b["p"]), F.coalesce(a["v"], b["v"])).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("__p") - a["p"]) / (b["p"] - a["p"])))
    return ring.select(*rows.columns)


def ring_distance(rows: DataFrame, track: Names, length: str, marked: str, out: str = "away") -> DataFrame:
    """Adds the distance on the ring to the nearest marked bin; null where none is marked."""
    w = Window.partitionBy(*track).orderBy("__p")
    own = F.when(F.col(marked), F.col("__p"))
    ring = _ring(rows, track, length).withColumns({"__a": F.last(own, True).over(w.rowsBetween(FIRST, HERE)), "__b": F.last(own, True).over(turned_round(track, ["__p"]))}).where("__turn = 0")
    return ring.withColumn(out, F.least(F.col("__p") - F.col("__a"), F.col("__b") - F.col("__p"))).select(*rows.columns, out)


def ring_smooth(rows: DataFrame, track: Names, length: str, columns: Names, sigma: float) -> DataFrame:
    """(track, bin, columns): Gaussian means around the ring, out to four sigma."""
    reach = round(4 * sigma)
    moved = rows.select(*track, length, "bin", *columns, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("__o"))
    weight = F.exp(-F.pow(F.col("__o") / sigma, 2) / 2)
    moved = moved.withColumn("bin", F.pmod(F.col("bin") + F.col("__o"), F.col(length)).cast("int"))
    return moved.groupBy(*track, "bin").agg(*[(F.sum(F.col(c) * weight) / F.sum(F.when(F.col(c).isNotNull(), weight))).alias(c) for c in columns])


def centerline(samples: DataFrame, boxes: DataFrame, lengths: DataFrame, track: Names, at: str, x: str, y: str) -> DataFrame:
    """(track, bin, x, y, n, spread, rejected): the line over every metre of a track's ``length`` (a column of ``lengths``).

    Bins are rejected, filled around the ring, and smoothed: finely near protected corners, widely away from them.
    """
    spine = lengths.select(*track, "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("bin"))
    rows = spine.join(rejected(bins(samples, track, at, x, y), boxes, track), [*track, "bin"], "left").fillna(False, ["protected", "rejected"]).fillna(0, ["n"])
    rows = cut(ring_distance(ring_fill(rows, track, "length", ["x", "y"]), track, "length", "protected"))  # read by the join and both smoothings
    fine = ring_smooth(rows, track, "length", ["x", "y"], SMOOTH).withColumnsRenamed({"x": "__fx", "y": "__fy"})
    wide = ring_smooth(rows, track, "length", ["x", "y"], STRAIGHT).withColumnsRenamed({"x": "__wx", "y": "__wy"})
    share = F.least(F.coalesce(F.col("away") / BLEND, F.lit(1.0)), F.lit(1.0))
    out = rows.join(fine, [*track, "bin"]).join(wide, [*track, "bin"])
    return out.select(*track, "bin", *[(F.col(f"__f{c}") * (1 - share) + F.col(f"__w{c}") * share).alias(c) for c in "xy"], "n", "spread", "rejected")


def field(line: DataFrame, track: Names, sigma: float = FIELD, reach: float = FIELD_REACH, step: float = BIN) -> DataFrame:
    """(track, bin, gx, gy, tx, ty): at every ``step`` metres the weighted mean place and the unit tangent of a local line through the bins around."""
    k = F.explode(F.sequence(F.ceil((F.col("bin") - reach) / step).cast("int"), F.floor((F.col("bin") + reach) / step).cast("int"))).alias("__k")
    met = line.where("x is not null").select(*track, F.col("bin").alias("__b"), "x", "y", k).where("__k >= 0")
    s = F.col("__b") - F.col("__k") * step
    w = F.exp(-F.pow(s / sigma, 2) / 2)
    sums = met.groupBy(*track, F.col("__k").alias("bin")).agg(F.sum(w).alias("w"), F.sum(w * s).alias("ws"), F.sum(w * s * s).alias("wss"), *[F.sum(w * F.col(c)).alias(f"w{c}") for c in "xy"], *[F.sum(w * s * F.col(c)).alias(f"ws{c}") for c in "xy"])
    det = F.col("w") * F.col("wss") - F.pow("ws", 2)
    sums = sums.withColumns({f"t{c}": F.when(det > 1e-9, (F.col("w") * F.col(f"ws{c}") - F.col("ws") * F.col(f"w{c}")) / det) for c in "xy"})
    size = F.hypot("tx", "ty")
    return sums.select(*track, "bin", (F.col("wx") / F.col("w")).alias("gx"), (F.col("wy") / F.col("w")).alias("gy"), (F.col("tx") / size).alias("tx"), (F.col("ty") / size).alias("ty"))


def envelope(samples: DataFrame, lap: Names, track: Names, e: str) -> DataFrame:
    """(track, bin, e_lo, e_hi, laps): quantiles of one vote (a median) per lap and bin, padded, capped; a plain band with few laps. Fitted twice, the second time inside the first."""

    def fit(rows: DataFrame) -> DataFrame:
        vote = rows.groupBy(*dict.fromkeys([*track, *lap]), "bin").agg(F.median(e).alias("v"))
        q = vote.groupBy(*track, "bin").agg(F.percentile("v", F.array(F.lit(LO), F.lit(HI))).alias("q"), F.count("v").alias("laps"))
        enough = F.col("laps") >= LAPS
        return q.select(*track, "bin", F.when(enough, F.greatest(F.col("q")[0] - PAD, F.lit(-CAP))).otherwise(-COLD).alias("e_lo"), F.when(enough, F.least(F.col("q")[1] + PAD, F.lit(CAP))).otherwise(COLD).alias("e_hi"), "laps")

    first = fit(samples)
    inside = samples.join(first.drop("laps"), [*track, "bin"]).where(F.col(e).between(F.col("e_lo"), F.col("e_hi"))).drop("e_lo", "e_hi")
    return fit(inside)


def curvature(samples: DataFrame, lap: Names, track: Names, v: str, lat_g: str) -> DataFrame:
    """(track, bin, kappa): median over laps of each lap's median curvature, 0 with few laps."""
    bend = F.col(lat_g) * 9.81 / F.pow(F.greatest(F.col(v), F.lit(8.0)), 2)
    vote = samples.groupBy(*dict.fromkeys([*track, *lap]), "bin").agg(F.median(bend).alias("__v"))
    return vote.groupBy(*track, "bin").agg(F.when(F.count("__v") >= BEND_LAPS, F.median("__v")).otherwise(0.0).alias("kappa"))


def cold_corridor(lines: DataFrame, track: Names) -> DataFrame:
    """A corridor without laps: the field's bins with a plain band and no curvature."""
    return lines.select(*track, "bin", "gx", "gy", "tx", "ty", F.lit(-COLD).alias("e_lo"), F.lit(COLD).alias("e_hi"), F.lit(0.0).alias("kappa"), F.lit(0).cast("long").alias("laps"))


def corridor(samples: DataFrame, line: DataFrame, lap: Names, track: Names, e: str, v: str, lat_g: str) -> DataFrame:
    """The corridor of each track's bins, from samples with a bin; bins no lap has passed stay cold."""
    cold = cold_corridor(field(line, track), track)
    own = envelope(samples, lap, track, e).withColumnsRenamed({"e_lo": "__lo", "e_hi": "__hi", "laps": "__laps"})
    bend = curvature(samples, lap, track, v, lat_g).withColumnRenamed("kappa", "__kappa")
    met = cold.join(own, [*track, "bin"], "left").join(bend, [*track, "bin"], "left")
    return met.select(*track, "bin", "gx", "gy", "tx", "ty", *[F.coalesce(f"__{a}", b).alias(b) for a, b in (("lo", "e_lo"), ("hi", "e_hi"), ("kappa", "kappa"), ("laps", "laps"))])


def line_hash(line: DataFrame, track: Names) -> DataFrame:
    """(track, input_hash): a digest of a line, whatever the order of its rows."""
    row = F.sha2(F.concat_ws("|", "bin", F.round("x", 6), F.round("y", 6)), 256)
    return line.groupBy(*track).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(2)]), 256).alias("input_hash"))


def stamped(corridor_rows: DataFrame, line: DataFrame, track: Names) -> DataFrame:
    return corridor_rows.join(line_hash(line, track), list(track)).withColumn("version", F.lit(VERSION))


def unless_stale(saved: DataFrame, line: DataFrame, track: Names) -> DataFrame:
    """Rows of a saved corridor whose version and line are still those at hand."""
    return saved.join(line_hash(line, track), [*track, "input_hash"], "left_semi").where(F.col("version") == VERSION)


def as_ruler(line: DataFrame, track: Names) -> DataFrame:
    """The line as the samples of a reference lap: its own session and lap 1, other channels null."""
    return line.where("x is not null").select(*track, F.lit("centerline").alias("session_id"), F.lit(1).alias("lap"), F.col("bin").cast("double").alias("dist_lap_m"), "x", "y", F.lit(0.0).alias("gps_accuracy_m"), F.lit(None).cast("double").alias("speed_mph"), F.lit(None).cast("double").alias("lat_g"))


def direction_gap(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    """(keys, degrees): the acute angle between two tangents of each place."""
    x, y = a.select(*keys, F.col("tx").alias("__ax"), F.col("ty").alias("__ay")), b.select(*keys, F.col("tx").alias("__bx"), F.col("ty").alias("__by"))
    dot = F.abs(F.col("__ax") * F.col("__bx") + F.col("__ay") * F.col("__by"))
    return x.join(y, list(keys)).select(*keys, F.degrees(F.acos(F.least(F.lit(1.0), dot))).alias("degrees"))
