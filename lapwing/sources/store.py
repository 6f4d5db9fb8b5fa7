"""The tables of a corpus: scans with defaults, and sinks that replace what they hold of a session or a track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import centerline as cl, corners as seeds, transits as tra
from lapwing.sources.logs import write

Names = Sequence[str]
KEYS = ["track", "session_id"]

#: Columns that a trajectory cannot do without, and those that are null where a table does not have them.
CORE = {"lap": "int", "t": "double", "track_dist_m": "double", "dist_lap_m": "double"}
OPTIONAL = {"lat": "double", "long": "double", "lat_g": "double", "long_g": "double", "speed_mph": "double", "speed_mph_gps": "double", "gps_drift_lat_m": "double", "gps_drift_lon_m": "double", "throttle_norm": "double", "brake": "tinyint"}


def trajectory_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples for trajectories, whatever columns their files have: optional ones become null, laps without any ruler are left out."""
    s = spark.read.option("mergeSchema", True).parquet(path)
    lacking = [c for c in CORE if c not in s.columns]
    s = s.withColumns({c: F.lit(None).cast(k) for c, k in (CORE | OPTIONAL).items() if c not in s.columns})
    if lacking:
        return s.limit(0)
    laps = s.groupBy(*KEYS, "lap").agg(F.count("track_dist_m").alias("n")).where("n > 0").select(*KEYS, "lap")
    return s.join(laps, [*KEYS, "lap"], "left_semi")


def session_samples(spark: SparkSession, path: str, track: str, session_id: str, lap: int | None = None) -> DataFrame:
    """One session's samples, or one lap's: partitions and row groups are pruned, not read and dropped."""
    s = spark.read.parquet(path).where((F.col("track") == track) & (F.col("session_id") == session_id))
    return s if lap is None else s.where(F.col("lap") == lap)


def laps(spark: SparkSession, path: str, track: str, clean: bool = False) -> DataFrame:
    l = spark.read.parquet(path).where(F.col("track") == track)  # noqa: E741
    return l.where("is_clean") if clean else l


def session_catalogue(samples: DataFrame, keys: Names, order: Names, t: str, at: str, obd: str) -> DataFrame:
    """(keys, has_obd, fixes, rate): fresh fixes of a session, and how many come in a second."""
    from lapwing.operators.trajectory import fresh

    span = F.max(t) - F.min(t)
    marked = fresh(samples, keys, order, at)
    return marked.groupBy(*keys).agg((F.count(obd) > 0).alias("has_obd"), F.count(F.when(F.col("fresh"), 1)).alias("fixes"), F.when(span > 0, F.count(F.when(F.col("fresh"), 1)) / span).alias("rate"))


def write_labelled(samples: DataFrame, corners: DataFrame, out: str, at: str = "track_dist_m") -> None:
    """Samples with the stretch that holds them, beside the samples they come from."""
    write(tra.labels(samples, corners, ["track"], at), f"{out}/samples_labelled", KEYS)


def write_transits(passages: DataFrame, out: str) -> None:
    write(passages, f"{out}/transits", KEYS)


def write_quality(scored: DataFrame, out: str) -> None:
    """Passages with their scores, as a table of their own."""
    write(scored, f"{out}/corners_scored", KEYS)


def build_corpus(spark: SparkSession, transits: str, marks: DataFrame, out: str) -> DataFrame:
    """Writes the transits of all sessions that are neither references nor excluded, columns aligned over sessions; one row of counts.

    Raises where nothing is left: an empty corpus would replace a good one.
    """
    rows = spark.read.option("mergeSchema", True).parquet(transits)
    left_out = marks.where(F.coalesce("reference", F.lit(False)) | F.coalesce("exclude", F.lit(False))).select("session_id")
    kept = rows.join(left_out, "session_id", "left_anti")
    if kept.isEmpty():
        raise ValueError(f"no transits of sessions that are no references in {transits}")
    write(kept, f"{out}/corpus", KEYS)
    return spark.read.parquet(f"{out}/corpus").agg(F.countDistinct("track", "session_id").alias("sessions"), F.countDistinct("track", "session_id", "lap").alias("laps"), F.count("*").alias("transits"))


def publish_ruler(line: DataFrame, out: str) -> None:
    write(cl.as_ruler(line, ["track"]), f"{out}/reference_ruler", ["track"])


def save_corridor(corridor: DataFrame, line: DataFrame, out: str) -> None:
    write(cl.stamped(corridor, line, ["track"]), f"{out}/corridor", ["track"])


def load_corridor(spark: SparkSession, out: str, line: DataFrame) -> DataFrame:
    """Saved corridors of this version and of these lines; those of other lines are stale and not among them."""
    return cl.unless_stale(spark.read.parquet(f"{out}/corridor"), line, ["track"])


def write_candidates(candidates: DataFrame, out: str) -> None:
    write(candidates, f"{out}/candidates", KEYS)


def seed_corners(clusters: DataFrame, pins: DataFrame, out: str) -> None:
    seeds.seeded_boxes(clusters, pins).write.mode("overwrite").parquet(f"{out}/corner_seeds")
