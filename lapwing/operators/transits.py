"""Passages of laps through corners, and candidates for corners where none are known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.lineage import cut, grown
from lapwing.operators import robust, sequence as seq
from lapwing.operators.joins import in_spans
from lapwing.operators.sequence import FIRST, HERE, over, turned_round

Names = Sequence[str]

#: Metres looked back before a corner, throttle of a lift and of a return, seconds that a return lasts, full throttle.
BACK, LIFT, RETURN, SUSTAIN, WIDE_OPEN = 150.0, 0.8, 0.8, 0.3, 0.95
#: Fixed values of candidates: seconds of smoothing and between peaks, g of a peak and of its ends, least g of braking, least rows.
SMOOTH_S, SPACING_S, PEAK_G, END_G, BRAKE_G, LEAST_ROWS = 0.3, 3.0, 0.4, 0.2, -0.3, 50
#: Fixed values of reliable places, in metres: disagreement of drift, offset of a passage, offset of its neighbours.
DRIFT_LIMIT, OFFSET_LIMIT, NEAR_LIMIT = 20.0, 40.0, 40.0


def labels(df: DataFrame, corners: DataFrame, track: Names, at: str, out: str = "corner") -> DataFrame:
    """The stretch that holds each place: a corner from its start on, after its end ``S_post_`` it; before a track's first corner, the last one's.

    Corners (track, corner_id, start_m, end_m) become stretches from each start to the next, met on cells.
    """
    ends = corners.withColumn("__next", F.lead("start_m").over(Window.partitionBy(*track).orderBy("start_m")))
    starts = ends.select(*track, F.col("start_m").alias("__lo"), F.col("corner_id").alias("__label")).unionByName(ends.where("__next is null or end_m < __next").select(*track, F.col("end_m").alias("__lo"), F.concat(F.lit("S_post_"), "corner_id").alias("__label")))
    spans = starts.withColumn("__hi", F.lead("__lo").over(Window.partitionBy(*track).orderBy("__lo")))
    cells = spans.where("__hi is not null").withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") / BACK), F.floor(F.col("__hi") / BACK))))
    whole = starts.groupBy(*track).agg(F.min("__lo").alias("__first"), F.max("__lo").alias("__tail"), F.max_by("__label", "__lo").alias("__last"))
    rows = df.withColumn("__cell", F.floor(F.col(at) / BACK)).alias("s").join(cells.alias("c"), (F.col("s.__cell") == F.col("c.__cell")) & (F.col(at) >= F.col("__lo")) & (F.col(at) < F.col("__hi")) & _same("s", "c", track), "left")
    rows = rows.select("s.*", F.col("c.__label").alias("__label")).join(whole, list(track), "left")
    label = F.when((F.col(at) >= F.col("__tail")) | (F.col(at) < F.col("__first")), F.col("__last")).otherwise(F.col("__label"))
    return rows.withColumn(out, label).drop("__cell", "__label", "__first", "__tail", "__last")


def _same(a: str, b: str, names: Names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{a}.{n}") == F.col(f"{b}.{n}"))
    return out


def zones(df: DataFrame, corners: DataFrame, keys: Names, track: Names, order: Names, at: str) -> DataFrame:
    """Samples with each corner box (corner_id, start_m, end_m, ...) they lie in, before ("lookback", 150 m) or first after ("after").

    Boxes may overlap. Samples and boxes meet on cells; the first sample after a box is the one whose step crosses its end.
    """
    before = F.lag(at).over(over(keys, order))
    cell = lambda c: F.floor(c / BACK).cast("int")
    s = df.withColumn("__b", F.coalesce(before, F.col(at))).where(F.col(at).isNotNull())
    s = s.withColumn("__s0", cell(F.least("__b", at))).withColumn("__cell", F.explode(F.sequence(F.col("__s0"), cell(F.col(at)))))
    c = corners.withColumn("__c0", cell(F.col("start_m") - BACK)).withColumn("__cell", F.explode(F.sequence(F.col("__c0"), cell(F.col("end_m")))))
    met = s.join(c, [*track, "__cell"]).where(F.col("__cell") == F.greatest("__s0", "__c0"))
    zone = F.when((F.col(at) >= F.col("start_m")) & (F.col(at) <= F.col("end_m")), "in").when((F.col(at) < F.col("start_m")) & (F.col(at) >= F.col("start_m") - BACK), "lookback").when((F.col(at) > F.col("end_m")) & (F.col("__b") <= F.col("end_m")), "after")
    return met.withColumn("zone", zone).where("zone is not null").drop("__cell", "__s0", "__c0", "__b")


def _at(place: Column, at: str, value: str, order: Names, where: Column) -> Column:
    """The value at a place, linear between the rows around it among ``where``; null outside them."""
    point = F.struct(F.col(at).alias("x"), F.col(value).alias("y"))
    known = where & F.col(value).isNotNull()
    low = F.max(F.when(known & (F.col(at) <= place), F.struct(F.col(at).alias("at"), *order, point.alias("p"))))["p"]
    high = F.min(F.when(known & (F.col(at) >= place), F.struct(F.col(at).alias("at"), *order, point.alias("p"))))["p"]
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1")))


def _between(p: str, place: str) -> Column:
    a = F.col(p)
    return F.when(a["x0"] == a["x1"], a["y0"]).otherwise(a["y0"] + (a["y1"] - a["y0"]) * (F.col(place) - a["x0"]) / (a["x1"] - a["x0"]))


def transits(df: DataFrame, corners: DataFrame, keys: Names, track: Names, order: Names, at: str) -> DataFrame:
    """A row per lap and corner with three samples or more in its box.

    ``df`` has t, speed, gps_speed, lat_g, long_g, brake, throttle, offset and sigma; ``corners`` has corner_id, start_m, end_m,
    apex_m and second_m (null: none). Laps without any speed take the GPS speed; places of events are from the corner's start.
    """
    lap = Window.partitionBy(*keys)
    df = df.withColumn("__obd", F.count("speed").over(lap) > 0).withColumn("__v", F.when(F.col("__obd"), F.col("speed")).otherwise(F.col("gps_speed")))
    met = zones(df, corners, keys, track, order, at)
    own, by = F.col("zone") == "in", F.struct(*order)
    first = lambda c, hit: F.min_by(c, F.when(hit, by))
    last = lambda c, hit: F.max_by(c, F.when(hit, by))
    only = lambda c: F.when(own, F.col(c))
    least = F.min_by(F.struct(F.col(at).alias("at"), F.col("__v").alias("v")), F.when(own & F.col("__v").isNotNull(), F.struct("__v", *order)))
    peak = F.min_by(F.struct(F.col(at).alias("at"), F.col("lat_g").alias("g")), F.when(own & F.col("lat_g").isNotNull(), F.struct((-F.abs("lat_g")).alias("__g"), *order)))
    group = [*keys, "corner_id"]
    rows = met.groupBy(*group).agg(
        F.first("start_m").alias("start_m"), F.first("end_m").alias("end_m"), F.first("apex_m").alias("apex_m"), F.first("second_m").alias("second_m"), F.first("__obd").alias("obd_present"),
        F.count(F.when(own, 1)).alias("n"), first(F.col(at), own).alias("entry_m"), last(F.col(at), own).alias("exit_m"), (F.max(only("t")) - F.min(only("t"))).alias("time_in"),
        least.alias("__least"), F.max(only("__v")).alias("max_speed"), peak.alias("__peak"), F.max(only("long_g")).alias("max_accel"), F.min(only("long_g")).alias("max_decel"),
        F.max(only("brake")).alias("peak_brake"), F.max(only("throttle")).alias("peak_throttle"), F.avg(only("throttle")).alias("mean_throttle"), F.avg(F.abs(only("lat_g"))).alias("mean_lat_g"),
        F.avg(F.when(own & F.col("throttle").isNotNull(), (F.col("throttle") >= WIDE_OPEN).cast("double"))).alias("share_open"), F.avg(F.when(own, (F.coalesce("brake", F.lit(0)) == 1).cast("double"))).alias("share_braking"),
        (first(F.col(at), F.col("brake") == 1) - F.first("start_m")).alias("brake_on"), (last(F.col(at), F.col("brake") == 1) - F.first("start_m")).alias("brake_off"),
        (first(F.col(at), F.col("throttle") < LIFT) - F.first("start_m")).alias("lift"), (first(F.col(at), own & (F.col(at) >= F.col("apex_m")) & (F.col("throttle") >= WIDE_OPEN)) - F.first("start_m")).alias("wide_open"),
        F.median(only("offset")).alias("offset_mid"), F.max(only("offset")).alias("offset_max"), F.max(only("sigma")).alias("sigma_max"),
        _at(F.col("start_m"), at, "__v", order, F.lit(True)).alias("__entry"), _at(F.col("end_m"), at, "__v", order, F.lit(True)).alias("__exit"), _at(F.col("apex_m"), at, "__v", order, own).alias("__apex"), _at(F.col("second_m"), at, "__v", order, own).alias("__second"),
    ).where("n >= 3")
    rows = rows.withColumns({"min_speed": F.col("__least.v"), "min_speed_m": F.col("__least.at"), "lat_g_peak": F.col("__peak.g"), "lat_g_peak_m": F.col("__peak.at"), "entry_speed": _between("__entry", "start_m"), "exit_speed": _between("__exit", "end_m"), "apex_speed": _between("__apex", "apex_m"), "second_speed": _between("__second", "second_m")})
    later = met.where(own).join(grown(rows.select(*group, "min_speed_m")), group).where(F.col(at) >= F.col("min_speed_m"))
    back = seq.first_sustained(later, group, order, "t", F.col("throttle") > RETURN, SUSTAIN).withColumnRenamed("first", "t")
    place = later.join(grown(back), [*group, "t"]).groupBy(*group).agg(F.min(at).alias("__return"))
    out = rows.join(grown(place), group, "left").withColumn("throttle_return", F.col("__return") - F.col("start_m"))
    return out.drop("__least", "__peak", "__entry", "__exit", "__apex", "__second", "__return").withColumns({"apex_offset": F.col("min_speed_m") - F.col("apex_m"), "peak_offset": F.col("lat_g_peak_m") - F.col("apex_m")})


def session_corners(passages: DataFrame, verdicts: DataFrame, jumps: DataFrame, drift: DataFrame, keys: Names) -> DataFrame:
    """Passages with their section's verdict, the lap's flagged fixes and its drift; what a lap lacks stays null, jumps count 0."""
    out = passages.join(grown(verdicts), [*keys, "corner_id"], "left").join(grown(jumps), list(keys), "left").join(grown(drift), list(keys), "left")
    return out.fillna(0, [c for c in jumps.columns if c not in keys])


def spatial_reliability(df: DataFrame, keys: Names, disagreement: str, offset: str, near: str) -> DataFrame:
    """Adds transit_reliable (three limits, null counts as over) and lap_reliable (all of the lap's passages)."""
    within = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(False))
    df = df.withColumn("transit_reliable", within(disagreement, DRIFT_LIMIT) & within(offset, OFFSET_LIMIT) & within(near, NEAR_LIMIT))
    return robust.all_of(df, keys, F.col("transit_reliable"), "lap_reliable")


def sigma_reliability(df: DataFrame, keys: Names, eligible: str = "rank_eligible") -> DataFrame:
    """Adds transit_reliable_traj, the verdict on a passage's time, and lap_reliable_traj, all of a lap's verdicts that are known.

    Passages without a verdict stay unknown (null), and so do laps without any; a table without the column knows none.
    """
    known = F.col(eligible).cast("boolean") if eligible in df.columns else F.lit(None).cast("boolean")
    df = df.withColumn("transit_reliable_traj", known)
    return df.withColumn("lap_reliable_traj", F.min("transit_reliable_traj").over(Window.partitionBy(*keys)))


def peak_ends(df: DataFrame, keys: Names, order: Names, size: str, least: float = END_G) -> DataFrame:
    """Adds entry_row and exit_row: the nearest rows below ``least`` on both sides (column ``row`` numbers them), the lap's ends where there are none."""
    w = over(keys, order)
    low = F.when(F.col(size) < least, F.col("row"))
    lap = Window.partitionBy(*keys)
    return df.withColumns({"entry_row": F.coalesce(F.last(low, True).over(w.rowsBetween(FIRST, HERE)), F.min("row").over(lap)), "exit_row": F.coalesce(F.last(low, True).over(turned_round(keys, order)), F.max("row").over(lap))})


def corner_candidates(df: DataFrame, keys: Names, order: Names, at: str, rate: float) -> DataFrame:
    """Peaks of smoothed lateral g with direction, ends, slowest place and, as distances from the entry, first braking, lift and return.

    ``df`` has t, speed, gps_speed, lat_g, long_g, throttle, lat, long; ``rate`` is samples per second. Laps of fewer than 50 rows have none.
    """
    lap = Window.partitionBy(*keys)
    df = df.withColumn("row", F.row_number().over(over(keys, order)).cast("double")).where(F.col("row").isNotNull())
    df = df.withColumn("__n", F.count("*").over(lap)).where(F.col("__n") >= LEAST_ROWS).withColumn("__v", F.when(F.count("speed").over(lap) > 0, F.col("speed")).otherwise(F.col("gps_speed")))
    width = max(3, round(SMOOTH_S * rate))
    df = seq.rolling_mean(df, keys, order, "lat_g", width, "smooth").withColumn("size", F.abs("smooth"))
    df = peak_ends(df, keys, order, "size")
    tops = seq.peaks(df.select(*keys, "row", "size"), keys, "row", "size", PEAK_G, float(round(SPACING_S * rate))).select(*keys, F.floor("row").cast("double").alias("row"))
    ends = df.join(grown(tops), [*keys, "row"]).select(*keys, F.col("row").alias("peak_row"), F.col(at).alias("peak_m"), F.col("smooth").alias("peak_g"), "entry_row", "exit_row")
    ends = ends.withColumn("candidate", F.row_number().over(Window.partitionBy(*keys).orderBy("peak_row")))
    rows = df.select(*keys, *[c for c in df.columns if c not in (*keys, "entry_row", "exit_row", "size", "smooth", "__n")])
    inside = in_spans(rows, grown(ends), keys, "row", "entry_row", "exit_row", float(LEAST_ROWS))
    edge = inside.groupBy(*keys, "candidate").agg(F.min_by(at, "row").alias("entry_m"), F.max_by(at, "row").alias("exit_m"), (F.max_by("t", "row") - F.min_by("t", "row")).alias("duration"), F.min(F.when(F.col("__v").isNotNull(), F.struct("__v", "row", F.col(at).alias("m"), "lat", "long"))).alias("slow"))
    edge = cut(edge)
    first = lambda hit: F.min_by(at, F.when(hit, F.col("row")))
    spans = edge.select(*keys, "candidate", (F.col("entry_m") - BACK).alias("__from"), F.col("exit_m").alias("__to"))
    near = in_spans(rows, grown(spans), keys, at, "__from", "__to", BACK)
    before = near.groupBy(*keys, "candidate").agg(first(F.col("long_g") < BRAKE_G).alias("b"), first(F.col("throttle") < LIFT).alias("l"))
    after = inside.join(grown(edge.select(*keys, "candidate", F.col("slow.row").alias("__slowest"))), [*keys, "candidate"]).where(F.col("row") >= F.col("__slowest")).groupBy(*keys, "candidate").agg(first(F.col("throttle") > RETURN).alias("r"))
    events = edge.select(*keys, "candidate").join(grown(before), [*keys, "candidate"], "left").join(grown(after), [*keys, "candidate"], "left")
    out = ends.join(grown(edge), [*keys, "candidate"]).join(grown(events), [*keys, "candidate"])
    return out.select(*keys, "candidate", "peak_m", "peak_g", F.when(F.col("peak_g") > 0, "right").otherwise("left").alias("direction"), "entry_m", "exit_m", "duration", F.col("slow.__v").alias("min_speed"), F.col("slow.m").alias("min_speed_m"), (F.col("b") - F.col("entry_m")).alias("brake_on"), (F.col("l") - F.col("entry_m")).alias("lift"), (F.col("r") - F.col("entry_m")).alias("throttle_return"), F.col("slow.lat").alias("apex_lat"), F.col("slow.long").alias("apex_long"))
