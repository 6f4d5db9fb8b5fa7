"""Events written as logs, and ingested in two runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.lineage import grown, shared_folder
from lapwing.plans.tables import DRIVE, drive
from lapwing.sources import logs
from lapwing.streaming.ingest import ingest

QUERIES: dict = {}
ORACLES: dict = {}

#: Numbers in the names of the logs made here: no dates, and as many digits as users have.
_NUMBERS = r"Log-([^/.]+)"
_VALUES = {"t": "t", "lap": "lap", "speed_mph_gps": "gps", "speed_mph": "v", "long_g": "long_g", "lat_g": "lat_g"}


def log_table(samples: DataFrame) -> DataFrame:
    """(path, value): a log per session, a header line and a line per sample; some without engine bus, some without a required column."""
    d = samples.withColumns({"lap": F.floor((F.col("n") - 1) / 25), "bad": F.col("k") % 7 == 5})
    columns = [(raw, new) for raw, (new, _) in logs.CANONICAL.items()]
    shown = lambda new: ~((F.col("bad") & F.lit(new == "gps_accuracy_m")) | (~F.col("obd") & F.lit(new in logs.OBD)))
    line = lambda cell: F.concat_ws(",", *[F.when(shown(new), F.coalesce(cell(raw, new), F.lit(""))) for raw, new in columns])
    body = d.select("k", "bad", "obd", F.struct("n", line(lambda raw, new: F.col(_VALUES[new]).cast("string") if new in _VALUES else F.lit("1")).alias("line")).alias("at"))
    whole = body.groupBy("k", "bad", "obd").agg(F.sort_array(F.collect_list("at"))["line"].alias("lines"))
    return whole.select(F.format_string("Log-2024%04d-%06d.csv", F.col("k"), F.col("k")).alias("path"), F.array_join(F.concat(F.array(line(lambda raw, new: F.lit(raw))), "lines"), "\n").alias("value"))


def incremental_ingest(spark, d):
    """Status of each log in the second run, when every other session is known, with the samples that are stored of it."""
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    log_table(drive(spark, d).where("k is not null")).write.parquet(f"{at}/logs")
    log = spark.read.parquet(f"{at}/logs")
    ingest(spark, log.where(F.col("path").rlike(r"[02468]\.csv$")), "ring", f"{at}/out", session=_NUMBERS).count()
    status = ingest(spark, log, "ring", f"{at}/out", session=_NUMBERS)
    stored = spark.read.parquet(f"{at}/out/samples").groupBy("session_id").agg(F.count("*").alias("rows"), F.round(F.max("dist_m"), 2).alias("dist_m"))
    laps = spark.read.parquet(f"{at}/out/session_meta").select("session_id", "n_laps", "n_clean_laps", "has_obd")
    return status.join(grown(stored), "session_id", "left").join(grown(laps), "session_id", "left")


QUERIES["incremental_ingest"] = incremental_ingest
ORACLES["incremental_ingest"] = DRIVE + """, s AS (SELECT k, printf('2024%04d-%06d', k, k) AS session_id, k % 7 = 5 AS bad, bool_or(obd) AS obd, count(*) AS rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS laps FROM d GROUP BY k),
m AS (SELECT k, (CASE WHEN obd THEN v ELSE gps END) AS mph, t, n FROM d), p AS (SELECT k, coalesce(0.5 * (mph + lag(mph) OVER (PARTITION BY k ORDER BY n)) * 0.44704 * 0.75, 0) AS st FROM m), q AS (SELECT k, round(sum(st), 2) AS dist_m FROM p GROUP BY k)
SELECT session_id, CASE WHEN bad THEN 'FAIL' WHEN k % 2 = 0 THEN 'skip' WHEN obd THEN 'ok' ELSE 'gpsonly' END AS status, CASE WHEN bad THEN 'missing: gps_accuracy_m' END AS reason, CASE WHEN NOT bad THEN rows END AS rows, CASE WHEN NOT bad THEN dist_m END AS dist_m, CASE WHEN NOT bad THEN laps END AS n_laps, CASE WHEN NOT bad THEN greatest(laps - 2, 0) END AS n_clean_laps, CASE WHEN NOT bad THEN obd END AS has_obd FROM s JOIN q USING (k)"""
