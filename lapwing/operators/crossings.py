"""Sections of laps, timed on their trajectories: crossings, nets, the accelerometer's check, verdicts.

A trajectory sample has keys, t, s_hat, dl, v, delta_hat, e_lat, status and, for the accelerometer, long_g and lat_g.
``sections`` has track, section, a, b, and ``corridor`` track, bin, kappa; ``track`` is the keys that name a track, part of a
lap's. A row per lap and section comes out, always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import G, MPH, SPEED_SLACK
from lapwing.functions.lineage import cut, grown
from lapwing.operators import alignment, centerline as cl, sections as sec, sequence as seq, trajectory as tr
from lapwing.operators.joins import in_spans
from lapwing.operators.sequence import FIRST, HERE, over, turned_round
from lapwing.operators.trajectory import BIN, at_knots, bin_index, linear_fill

Names = Sequence[str]

#: Metres of a cell in which samples and sections meet.
MEET = 100.0


def lap_sections(samples: DataFrame, sections: DataFrame, keys: Names, track: Names) -> DataFrame:
    """A row per lap and section: keys, section, a, b, covered (the whole section lies on the lap's ruler)."""
    ends = samples.groupBy(*keys).agg(F.min("s_hat").alias("__lo"), F.max("s_hat").alias("__hi"))
    inside = (F.col("a") >= F.col("__lo")) & (F.col("b") <= F.col("__hi")) & (F.col("b") > F.col("a"))
    return ends.join(sections.select(*track, "section", "a", "b"), list(track)).withColumn("covered", F.coalesce(inside, F.lit(False))).drop("__lo", "__hi")


def at_places(queries: DataFrame, samples: DataFrame, keys: Names, place: str, at: str, order: str, columns: dict[str, str]) -> DataFrame:
    """``queries`` with sample columns (name: new name) at ``place``, linear in the never falling ``at``, flat outside.

    On a plateau the last row counts to the left and the first to the right, as in time. Samples and queries are one sorted
    stream, so no pairs are formed.
    """
    sample = F.struct(F.col(at).cast("double").alias("x"), *[F.col(c).cast("double").alias(c) for c in columns])
    s = samples.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("__x"), F.lit(0).alias("__q"), F.col(order).cast("double").alias("__o"), sample.alias("__s"))
    q = queries.select(*keys, F.col(place).cast("double").alias("__x"), F.lit(1).alias("__q"), F.struct(*queries.columns).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__x", "__q", "__o")
    both = s.unionByName(q, allowMissingColumns=True)
    met = both.withColumns({"__l": F.last("__s", True).over(w.rowsBetween(FIRST, HERE)), "__r": F.last("__s", True).over(turned_round(keys, ["__x", "__q", "__o"]))}).where("__q = 1")
    share = F.when(F.col("__l.x") < F.col("__r.x"), (F.col("__x") - F.col("__l.x")) / (F.col("__r.x") - F.col("__l.x"))).otherwise(0.0)
    value = lambda c: F.when(F.col("__l").isNull(), F.col(f"__r.{c}")).when(F.col("__r").isNull(), F.col(f"__l.{c}")).otherwise(F.col(f"__l.{c}") + (F.col(f"__r.{c}") - F.col(f"__l.{c}")) * share)
    return met.select("__row.*", *[value(c).alias(new) for c, new in columns.items()])


def crossings(samples: DataFrame, knots: DataFrame, sections: DataFrame, keys: Names, track: Names) -> DataFrame:
    """Adds to each lap's sections the state at both ends (t, v, dl, sigma, delta), seconds, driven, odometer_s and the lap's status; null where not covered."""
    rows = lap_sections(samples, sections, keys, track)
    ends = rows.where("covered").select(*keys, "section", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("x")), F.struct(F.lit("b").alias("end"), F.col("b").alias("x")))).alias("e")).select(*keys, "section", "e.*")
    ends = at_places(ends, samples, keys, "x", "s_hat", "t", {"t": "t", "v": "v", "dl": "dl", "delta_hat": "delta"})
    ends = at_knots(ends, knots, keys, "dl", {"sigma": "sig"})
    ends = at_places(ends, samples, keys, "x", "dl", "t", {"t": "odo"})
    names = ("t", "v", "dl", "sig", "delta", "odo")
    both = ends.groupBy(*keys, "section").agg(*[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{c}_{e}") for c in names for e in "ab"])
    status = samples.groupBy(*keys).agg(F.first("status").alias("lap_status"))
    out = rows.join(grown(both), [*keys, "section"], "left").join(grown(status), list(keys))
    return out.withColumns({"seconds": F.col("t_b") - F.col("t_a"), "driven": F.col("dl_b") - F.col("dl_a"), "odometer_s": F.col("odo_b") - F.col("odo_a")}).drop("odo_a", "odo_b")


def line_residual(rows: DataFrame, samples: DataFrame, corridor: DataFrame, keys: Names, track: Names, bins: int) -> DataFrame:
    """Adds resid: driven distance less what the lap's own line explains, null with fewer than five offsets in a section.

    Samples meet the sections that hold them; offsets become a median per bin, bins without one are filled from their neighbours.
    """
    offsets = samples.where(F.col("e_lat").isNotNull()).select(*keys, F.col("s_hat").alias("__s"), "e_lat")
    inside = in_spans(offsets, grown(rows.where("covered").select(*keys, "section", "a", "b")), keys, "__s", "a", "b", MEET)
    own = inside.groupBy(*keys, "section", bin_index(F.col("__s"), bins).alias("bin")).agg(F.median("e_lat").alias("e"), F.count("*").alias("n"))
    enough = own.groupBy(*keys, "section").agg(F.sum("n").alias("n")).where("n >= 5").drop("n")
    spine = rows.join(grown(enough), [*keys, "section"], "left_semi").select(*keys, "section", F.explode(F.sequence(F.floor(F.col("a") / BIN).cast("int"), F.floor(F.col("b") / BIN).cast("int"))).alias("bin"))
    filled = linear_fill(spine.join(grown(own.drop("n")), [*keys, "section", "bin"], "left"), [*keys, "section"], "bin", "e", "e")
    met = filled.withColumn("bin", F.greatest(F.least("bin", F.lit(bins - 1)), F.lit(0))).join(corridor.select(*track, "bin", "kappa"), [*track, "bin"], "left")
    swept = met.groupBy(*keys, "section").agg((F.coalesce(F.sum(F.col("kappa") * F.col("e")), F.lit(0.0)) * BIN).alias("__swept"))
    return rows.join(grown(swept), [*keys, "section"], "left").withColumn("resid", F.col("driven") - (F.col("b") - F.col("a") + F.col("__swept"))).drop("__swept")


def tripwire(rows: DataFrame) -> DataFrame:
    """Adds speed_consistency (time by the trajectory less time by the odometer) and whether it is within what the offsets explain; a diagnosis only."""
    mean = (F.greatest("v_a", F.lit(8.0)) + F.greatest("v_b", F.lit(8.0))) / 2
    off = F.col("seconds") - F.col("odometer_s")
    return rows.withColumns({"speed_consistency": off, "speed_consistent": F.abs(off) <= (F.abs("delta_a") + F.abs("delta_b")) / mean + SPEED_SLACK})


def accel_features(rows: DataFrame, samples: DataFrame, keys: Names, tie: str) -> DataFrame:
    """Adds accel_raw (change of speed less the integral of the longitudinal acceleration) and lat_integral (g s) of each section."""
    spans = rows.where("covered").select(*keys, "section", F.col("t_a").alias("lo"), F.col("t_b").alias("hi"))
    long = alignment.span_integrals(samples, spans, keys, "t", tie, "long_g").select(*keys, "section", F.col("integral").alias("__long"))
    lat = alignment.span_integrals(samples, spans, keys, "t", tie, "lat_g").select(*keys, "section", F.col("integral").alias("lat_integral"))
    met = rows.join(grown(long), [*keys, "section"], "left").join(grown(lat), [*keys, "section"], "left")
    return met.withColumn("accel_raw", F.col("v_b") - F.col("v_a") - G * F.col("__long")).drop("__long")


def accel_check(rows: DataFrame, refs: DataFrame, calibration: DataFrame | None, session: Names, track: Names) -> DataFrame:
    """Adds accel_value, accel_tol and correction: the raw residual less its session's share and its section's reference.

    Without a reference, or a calibration of its session, a value cannot be judged: it is null.
    """
    met = rows.join(refs.select(*track, "section", F.col("offset").alias("__offset"), F.col("tol").alias("__tol")), [*track, "section"], "left")
    if calibration is None:
        met = met.withColumns({"__b": F.lit(None).cast("double"), "__psi": F.lit(None).cast("double")})
    else:
        met = met.join(grown(calibration.select(*session, F.col("b_g").alias("__b"), F.col("psi").alias("__psi"))), list(session), "left")
    correction = -G * (F.col("__b") * F.col("seconds") + F.col("__psi") * F.col("lat_integral"))
    return met.withColumns({"correction": correction, "accel_value": F.col("accel_raw") - correction - F.col("__offset"), "accel_tol": F.col("__tol")}).drop("__b", "__psi", "__offset", "__tol")


def section_times(samples: DataFrame, knots: DataFrame, sections: DataFrame, corridor: DataFrame, keys: Names, track: Names, tie: str, bins: int, refs: DataFrame | None = None, calibration: DataFrame | None = None, session: Names = ()) -> DataFrame:
    """Every lap's sections with seconds, sigma_t, tier, status, rank_eligible and checks."""
    rows = cut(crossings(samples, knots, sections, keys, track))
    rows = tripwire(line_residual(rows, samples, corridor, keys, track, bins))
    headings = sec.heading(corridor, sections.withColumnRenamed("section", "corner_id"), list(track)).withColumnRenamed("corner_id", "section")
    rows = rows.join(headings, [*track, "section"])
    if refs is not None:
        rows = accel_check(accel_features(rows, samples, keys, tie), refs, calibration, session, track)
    else:
        rows = rows.withColumns({"accel_value": F.lit(None).cast("double"), "accel_tol": F.lit(None).cast("double")})
    rows = rows.withColumns({"gps_only": F.col("lap_status") == "gps_backbone", "rescaled": F.col("lap_status") == "rescale_invalid"})
    return sec.verdict(rows)


def range_times(samples: DataFrame, knots: DataFrame, corners: DataFrame, lap_length: Column, corridor: DataFrame, keys: Names, track: Names, first: str, last: str, tie: str, bins: int, refs: DataFrame | None = None, calibration: DataFrame | None = None, session: Names = ()) -> DataFrame:
    """``section_times`` of the one window from corner ``first`` to ``last`` (section: "first..last"); no rows on tracks that have them in the other order.

    References are of single corners: a range of one corner uses its own, a longer one none, so that laps on GPS alone cannot reach tier A there.
    """
    window = sec.range_window(corners, lap_length, list(track), first, last).withColumn("section", F.lit(f"{first}..{last}"))
    own = None if refs is None or first != last else refs.where(F.col("section") == first).withColumn("section", F.lit(f"{first}..{last}"))
    return section_times(samples, knots, window, corridor, keys, track, tie, bins, own, calibration, session)


def span_times(samples: DataFrame, line: DataFrame, keys: Names, track: Names, order: Names, a: float, b: float, names: dict[str, str], has_obd: Column, bins: int) -> DataFrame:
    """``section_times`` of laps between two places of the ruler (section: "span") without a corpus: on the plain band around one line (track, bin, x, y).

    ``names`` tells the columns dl, td, v, lat_g and e of the samples. Every lap has a row; where it does not cover the span, its status says so.
    """
    cold = cl.cold_corridor(cl.field(line, track), track)
    own, rows = tr.estimate(samples, keys, order, names["dl"], names["td"], names["v"], names["lat_g"], names["e"], has_obd, cold, bins, track=track)
    span = line.select(*track).distinct().select(*track, F.lit("span").alias("section"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
    return section_times(own.withColumnRenamed(names["e"], "e_lat"), rows, span, cold, keys, track, order[-1], bins)


def gps_only_emulation(df: DataFrame, keys: Names, order: Names, t: str, gps_mph: str, dl: str, obd: Names) -> DataFrame:
    """A lap as it would be without the engine bus: its channels null, distance integrated from the GPS speed and scaled to the lap's own length."""
    length = df.groupBy(*keys).agg(F.max(dl).alias("__length"))
    bare = df.drop(dl).withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in obd})
    bare = seq.trapezoid(bare, keys, order, t, F.col(gps_mph) * MPH, "__d").join(grown(length), list(keys))
    most = F.max("__d").over(Window.partitionBy(*keys))
    return bare.withColumn(dl, F.when(most > 0, F.col("__d") * F.col("__length") / most).otherwise(F.col("__d"))).drop("__d", "__length").select(*df.columns)


def paired(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    """(keys, section, seconds_a, seconds_b, diff, sigma_b, tier_b): sections that two estimates of the same laps both cover."""
    x = a.where(F.col("seconds").isNotNull()).select(*keys, "section", F.col("seconds").alias("seconds_a"))
    y = b.where(F.col("seconds").isNotNull()).select(*keys, "section", F.col("seconds").alias("seconds_b"), F.col("sigma_t").alias("sigma_b"), F.col("tier").alias("tier_b"))
    return x.join(grown(y), [*keys, "section"]).withColumn("diff", F.col("seconds_b") - F.col("seconds_a"))


def odometer_time(samples: DataFrame, sections: DataFrame, keys: Names, track: Names) -> DataFrame:
    """(keys, section, seconds) by the odometer alone, null outside its reach."""
    ends = samples.groupBy(*keys).agg(F.min("dl").alias("__lo"), F.max("dl").alias("__hi"))
    rows = ends.join(sections.select(*track, "section", "a", "b"), list(track)).where((F.col("a") >= F.col("__lo")) & (F.col("b") <= F.col("__hi")))
    rows = at_places(at_places(rows, samples, keys, "a", "dl", "t", {"t": "__ta"}), samples, keys, "b", "dl", "t", {"t": "__tb"})
    return rows.select(*keys, "section", (F.col("__tb") - F.col("__ta")).alias("seconds"))
