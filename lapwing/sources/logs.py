"""Session logs: scan, headers, ids, and the canonical sample table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.expressions import MPH
from lapwing.functions.lineage import cut, grown
from lapwing.operators import alignment, lags, sequence as seq
from lapwing.sources.tracks import with_lap_length

#: Raw names of a log and their canonical names and types.
CANONICAL = {
    "Time": ("t", "double"), "UTC Time": ("utc", "double"), "Lap": ("lap", "int"), "Sector": ("sector", "int"),
    "Latitude": ("lat", "double"), "Longitude": ("long", "double"), "Altitude (m)": ("altitude_m", "double"),
    "Speed (MPH)": ("speed_mph_gps", "double"), "Heading": ("heading", "double"), "Accuracy (m)": ("gps_accuracy_m", "double"),
    "Accel X": ("long_g", "double"), "Accel Y": ("lat_g", "double"), "Accel Z": ("vert_g", "double"), "Brake (calculated)": ("brake", "int"),
    "Engine Speed (RPM) *OBD": ("rpm", "double"), "Vehicle Speed (mph) *OBD": ("speed_mph", "double"), "Throttle Position (%) *OBD": ("throttle_raw", "double"),
    "Engine Coolant Temp (F) *OBD": ("coolant_f", "double"), "Intake Air Temp (F) *OBD": ("iat_f", "double"), "Intake Manifold Pressure (PSI) *OBD": ("manifold_psi", "double"),
}
REQUIRED = ("t", "utc", "lap", "lat", "long", "altitude_m", "speed_mph_gps", "gps_accuracy_m", "long_g", "lat_g", "brake")
OBD = ("rpm", "speed_mph", "throttle_raw", "coolant_f", "iat_f", "manifold_psi")
SESSION = r"Log-(\d{8}-\d{6})"
KEYS, ORDER = ["track", "session_id"], ["t", "row_id"]


def session_of(path, pattern: str = SESSION):
    return F.regexp_extract(path, pattern, 1)


def texts(spark: SparkSession, source: str | list[str] | DataFrame, session: str = SESSION) -> DataFrame:
    """(path, session_id, value): logs whole, a log to a row; ``source`` is a table (path, value) or the paths of files.

    The driver lists files, so that what it holds grows with their number: logs by the hundred thousand belong in a table.
    """
    whole = source if isinstance(source, DataFrame) else spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", session_of("path", session).alias("session_id"), "value")


def lines(spark: SparkSession, source: str | list[str] | DataFrame) -> DataFrame:
    """(path, n, line): the lines of logs; n orders the lines of a log."""
    return texts(spark, source).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line") != "")


def headers(raw: DataFrame) -> DataFrame:
    """(session_id, vehicle, end_point, split_points) of the leading comment lines; sessions without comments have nulls."""
    first = raw.where(~F.col("line").startswith("#")).groupBy("path").agg(F.min("n").alias("first"))
    lead = raw.join(first, "path", "left").where(F.col("line").startswith("#") & (F.col("n") < F.coalesce("first", F.lit(1 << 30))))
    field = lambda name: F.max(F.when(F.col("line").rlike(rf"^#\s*{name}:"), F.trim(F.regexp_extract("line", rf"^#\s*{name}:\s*(.*)$", 1))))
    number = r"(-?\d+(?:\.\d+)?)"
    spot = lambda c: F.struct(F.regexp_extract(c, rf"{number}\s*,\s*{number}", 1).try_cast("double").alias("lat"), F.regexp_extract(c, rf"{number}\s*,\s*{number}", 2).try_cast("double").alias("long"))
    split = r"^#\s*Split Point (\d+):\s*(.*)$"
    points = F.array_sort(F.collect_list(F.when(F.col("line").rlike(split), F.struct(F.regexp_extract("line", split, 1).cast("int").alias("index"), spot(F.regexp_extract("line", split, 2)).alias("at")))))
    out = lead.groupBy("path").agg(field("Vehicle").alias("vehicle"), field("End Point").alias("end"), points.alias("split_points"))
    return out.select(session_of("path").alias("session_id"), "vehicle", F.when(F.col("end").isNotNull(), spot(F.col("end"))).alias("end_point"), "split_points")


def told(line: Column) -> Column:
    """Whether a log's line is neither blank nor a comment."""
    return (F.trim(line) != "") & ~line.startswith("#")


def heads(logs: DataFrame) -> DataFrame:
    """(path, session_id, lines, head, names, rows, reason, has_obd) of ``texts``: the first line that is told names the cells of the other ``rows``.

    A log without a session id in its name, or without a required column, is a reject with a reason; one without OBD columns has none.
    A log without a line that is told has neither names nor reason. No log meets another one: nothing is shuffled.
    """
    logs = logs.select("path", "session_id", F.split("value", r"\r?\n").alias("lines")).withColumn("__told", F.filter("lines", told))
    logs = logs.withColumns({"head": F.get("__told", F.lit(0)), "rows": F.size("__told") - 1}).drop("__told")
    logs = logs.withColumn("names", F.transform(F.split("head", ","), lambda c: F.trim(c)))
    names = {new: old for old, (new, _) in CANONICAL.items()}
    missing = F.array_compact(F.array(*[F.when(~F.array_contains("names", names[c]), F.lit(c)) for c in REQUIRED]))
    reason = F.when(F.col("session_id") == "", "no session id in the name").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return logs.withColumns({"reason": F.when(F.col("rows") >= 0, reason), "has_obd": F.forall(F.array(*[F.lit(names[c]) for c in OBD]), lambda c: F.array_contains("names", c))})


def samples(logs: DataFrame, track: str) -> DataFrame:
    """Raw samples of ``heads``, none of rejects. Logs differ in their columns, so each log's own names say which cell is which; missing columns are null."""
    places = F.array(*[F.nullif(F.array_position("names", old).cast("int"), F.lit(0)) for old in CANONICAL])
    # a condition here and not a filter, which would take the logs apart once more for each of its names
    lines = F.when(F.col("reason").isNull() & (F.col("rows") > 0), F.col("lines"))
    rows = logs.select("session_id", "has_obd", places.alias("places"), F.array_position("lines", F.col("head")).alias("top"), F.posexplode(lines).alias("n", "line"))
    rows = rows.where((F.col("n") >= F.col("top")) & told(F.col("line")))
    numbers = F.transform(F.split("line", ","), lambda c: c.try_cast("double"))
    rows = rows.select("session_id", "has_obd", "places", "n", F.transform(numbers, lambda x: F.when(~F.isnan(x), x)).alias("numbers"))
    value = lambda i, kind: F.try_element_at("numbers", F.get("places", F.lit(i))).try_cast(kind)
    return rows.select(F.lit(track).alias("track"), "session_id", F.col("n").cast("long").alias("row_id"), "has_obd", *[value(i, kind).alias(new) for i, (new, kind) in enumerate(CANONICAL.values())])


#: What a receiver reports late, as speeds and as places; version of the method.
SPEEDS, PLACES, LAG_VERSION = ("speed_mph_gps",), ("lat", "long", "altitude_m", "gps_accuracy_m", "sector", "lap"), "gps-lag-v3"


def turned(raw: DataFrame) -> DataFrame:
    """Raw samples with their axes turned, OBD gaps filled and a brake everywhere."""
    s = raw.withColumns({"lat_g": -F.col("lat_g"), "long_g": -F.col("long_g"), "brake": F.coalesce("brake", F.lit(0)).cast("tinyint")})
    return seq.fill(s, KEYS, ORDER, list(OBD))


def lag_tables(s: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(laps, sessions) of ``lags.session_lags`` on ``turned`` samples: what their receivers are late by."""
    laps, sessions = lags.session_lags(s, KEYS, "lap", *ORDER, "speed_mph", "speed_mph_gps", "long_g", "lat", "long", enabled)
    return cut(laps), cut(sessions)


def relocked(s: DataFrame, laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Samples with the receiver's columns as held their lag later, and gps_lag_s and gps_pos_lag_s.

    The lag of speeds goes linearly from the middle of a lap to that of the next, that of places is one for a session. The lap
    counter is among the places: a sample may change its lap.
    """
    knots = laps.select(*KEYS, "mid", "lag")
    s = alignment.blended_lag(s, knots, KEYS, "t", "gps_lag_s")
    s = s.join(grown(sessions.select(*KEYS, F.col("lag").alias("gps_pos_lag_s"))), KEYS, "left")
    s = alignment.retime(s, KEYS, *ORDER, [(SPEEDS, "gps_lag_s"), (PLACES, "gps_pos_lag_s")])
    return s.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in ("gps_lag_s", "gps_pos_lag_s")})


def normalize(s: DataFrame, lap_length: float | DataFrame | None = None) -> DataFrame:
    """Canonical samples of ``turned`` and ``relocked`` ones: throttle by the session's largest, distances along session and lap.

    A lap's distance is scaled to ``lap_length``, one for all or a table of tracks (track, lap_length_m); tracks without one keep theirs.
    """
    w = seq.Window.partitionBy(*KEYS)
    most = F.max("throttle_raw").over(w)
    s = s.withColumns({"throttle_norm": F.when(most == 0, 0.0).otherwise(F.col("throttle_raw") / most), "throttle_max_observed": most})
    own = F.max(F.col("speed_mph").isNotNull().cast("int")).over(w) == 1
    s = s.withColumn("__v", F.when(own, F.col("speed_mph")).otherwise(F.col("speed_mph_gps")) * MPH)
    s = seq.trapezoid(s, KEYS, ORDER, "t", F.col("__v"), "dist_m").drop("__v")
    if isinstance(lap_length, DataFrame):
        s = seq.relative(with_lap_length(s, lap_length), [*KEYS, "lap"], ORDER, "dist_m", "dist_lap_m", F.col("lap_length_m")).drop("lap_length_m")
    else:
        s = seq.relative(s, [*KEYS, "lap"], ORDER, "dist_m", "dist_lap_m", None if lap_length is None else F.lit(float(lap_length)))
    return s.withColumn("rpm", F.round("rpm").cast("int")).drop("throttle_raw", "utc", "sector", "heading", "vert_g", "manifold_psi")


def lap_table(s: DataFrame, own_lags: DataFrame | None = None) -> DataFrame:
    """One row per lap: times, ranges and shares of its channels, whether it is a flying lap, and what its receiver was late by."""
    keys = [*KEYS, "lap"]
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = s.groupBy(*keys).agg(F.max("dist_lap_m").alias("lap_dist_m"), F.max("speed_mph").alias("max_speed_mph"), F.avg("speed_mph").alias("avg_speed_mph"), F.max("rpm").alias("max_rpm"), F.max(F.abs("lat_g")).alias("max_lat_g"), F.max("long_g").alias("max_accel_g"), F.min("long_g").alias("max_decel_g"), share(F.col("throttle_norm") >= 0.95).alias("pct_wot"), F.avg("throttle_norm").alias("avg_throttle"), share(F.col("brake") == 1).alias("pct_braking"), F.min("coolant_f").alias("coolant_min_f"), F.max("coolant_f").alias("coolant_max_f"), F.min("iat_f").alias("iat_min_f"), F.max("iat_f").alias("iat_max_f"))
    times = seq.lap_times(s, KEYS, "lap", "t", "row_id").select(*keys, F.col("lap_time").alias("lap_time_s"))
    w = seq.Window.partitionBy(*KEYS)
    reason = F.when(F.col("lap") == F.min("lap").over(w), "warmup").when(F.col("lap") == F.max("lap").over(w), "cooldown").otherwise("")
    laps = a.join(grown(times), keys).withColumn("clean_reason", reason).withColumn("is_clean", F.col("clean_reason") == "")
    if own_lags is None:
        return laps
    places = s.groupBy(*KEYS).agg(F.first("gps_pos_lag_s").cast("double").alias("gps_pos_lag_s"))
    own = own_lags.select(*keys, F.col("lag").alias("gps_lag_s"), F.col("r").alias("gps_lag_corr"), F.col("origin").alias("gps_lag_source"))
    return laps.join(grown(own), keys, "left").join(grown(places), KEYS, "left")


def lag_block(own_lags: DataFrame, sessions: DataFrame) -> DataFrame:
    """(track, session_id, gps_lag): how a session's lags were found, as one struct."""
    count = lambda o: F.count(F.when(F.col("origin") == o, 1)).alias(f"n_{o}")
    origins = ("lap", "session", "accel", "default", "disabled")
    counts = own_lags.groupBy(*KEYS).agg(F.round(F.median("lag"), 3).alias("session_median_s"), *[count(o) for o in origins])
    met = counts.join(grown(sessions.select(*KEYS, F.round("lag", 3).alias("pos_lag_s"), F.col("origin").alias("pos_lag_source"), F.col("laps").alias("pos_lag_n_laps"))), KEYS, "left")
    fixed = [F.lit(LAG_VERSION).alias("method_version"), F.lit(lags.OFFSET).alias("pos_speed_offset_s")]
    return met.select(*KEYS, F.struct(*fixed, "session_median_s", *[f"n_{o}" for o in origins], "pos_lag_s", "pos_lag_source", "pos_lag_n_laps").alias("gps_lag"))


def session_table(s: DataFrame, laps: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """One row per session: counts, rate, duration, best flying lap and ranges, and the block of its lags."""
    clean = F.col("is_clean")
    l = laps.groupBy(*KEYS).agg(F.count("*").alias("n_laps"), F.count(F.when(clean, 1)).alias("n_clean_laps"), F.min_by("lap", F.when(clean, F.struct("lap_time_s", "lap"))).alias("best_lap"), F.min(F.when(clean, F.col("lap_time_s"))).alias("best_lap_time_s"))
    span = F.max("t") - F.min("t")
    m = s.groupBy(*KEYS).agg(F.when(span > 0, (F.count("*") - 1) / span).alias("sample_rate_hz"), span.alias("duration_s"), F.max("has_obd").alias("has_obd"), F.max("speed_mph").alias("speed_max_obd_mph"), F.max("rpm").alias("rpm_max"), F.min("coolant_f").alias("coolant_min_f"), F.max("coolant_f").alias("coolant_max_f"), F.min_by("iat_f", F.when(F.col("iat_f").isNotNull(), F.col("row_id"))).alias("iat_first_f"), F.max("iat_f").alias("iat_max_f"), F.max("throttle_max_observed").alias("throttle_max_observed"))
    met = l.join(grown(m), KEYS)
    return met if block is None else met.join(grown(block), KEYS, "left")


def write(table: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that the rows belong to, each by one file: rows of a session lie in as many tasks as its laps, and a file costs more than its rows."""
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table.repartition(tasks, *by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_batch(table: DataFrame, path: str, version: int) -> None:
    """Replaces a batch, ``version``, of a track's table. Its sessions share files, sorted, each in one of them: there are as many files as tasks, not as sessions."""
    by = ["track", "version"]
    rows = table.withColumn("version", F.lit(version).cast("long")).repartition(*KEYS).sortWithinPartitions(*by, "session_id")
    rows.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, exclude, flag, reference, reason) from a JSON object by session."""
    kind = "map<string,struct<exclude:boolean,flag:string,reference:boolean,reason:string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("session_id", "n")).select("session_id", "n.*")

