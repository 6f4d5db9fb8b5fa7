"""Track definitions: corners, anchors and references of a track, from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CORNER = "struct<id:string,name:string,type:string,start_m:double,end_m:double,apex_m:double,secondary_apex_m:double,notes:string>"
_ANCHOR = "struct<corner_id:string,ref_lat:double,ref_long:double,confidence:string>"
_REF = "struct<offset_mps:double,tol_mps:double,n:int>"
SCHEMA = f"track_id string, name string, direction string, lap_length_internal_m double, start_finish struct<lat:double,long:double>, reference_lap struct<session_id:string,lap:int>, corners array<{_CORNER}>, calibration_anchors array<{_ANCHOR}>, accel_speed_check struct<corners:map<string,{_REF}>>"


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per track file. Files that are no JSON object have no row; what a file lacks is null."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).where("track_id is not null")


def tracks(raw: DataFrame) -> DataFrame:
    """(track, name, direction, lap_length_m, start_finish, reference_session, reference_lap); a length that is missing or not positive is null: no rescale."""
    length = F.when(F.col("lap_length_internal_m") > 0, F.col("lap_length_internal_m"))
    return raw.select(F.col("track_id").alias("track"), "name", "direction", length.alias("lap_length_m"), "start_finish", F.col("reference_lap.session_id").alias("reference_session"), F.col("reference_lap.lap").alias("reference_lap"))


def corners(raw: DataFrame) -> DataFrame:
    """(track, corner_id, name, type, start_m, end_m, apex_m, second_m, place): corners in order; a secondary apex of 0 is none."""
    c = raw.select(F.col("track_id").alias("track"), F.inline(F.array_sort(F.transform("corners", lambda c: F.struct(c["start_m"].alias("start_m"), c["id"].alias("corner_id"), c["end_m"].alias("end_m"), c["apex_m"].alias("apex_m"), F.nullif(c["secondary_apex_m"], F.lit(0.0)).alias("second_m"), c["name"].alias("name"), c["type"].alias("type"))))))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy("start_m", "corner_id")) - 1)


def anchors(raw: DataFrame) -> DataFrame:
    """(track, corner_id, ref_lat, ref_long, start_m, end_m): anchors with their corner's box; those of unknown corners are dropped."""
    a = raw.select(F.col("track_id").alias("track"), F.inline("calibration_anchors"))
    return a.join(corners(raw).select("track", "corner_id", "start_m", "end_m"), ["track", "corner_id"]).drop("confidence")


def accel_refs(raw: DataFrame) -> DataFrame:
    """(track, section, offset, tol, n): a corner's reference of the accelerometer's check."""
    return raw.select(F.col("track_id").alias("track"), F.explode("accel_speed_check.corners").alias("section", "r")).select("track", "section", F.col("r.offset_mps").alias("offset"), F.col("r.tol_mps").alias("tol"), "r.n")


def with_lap_length(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` (with track) with its track's lap_length_m, null where the track has none."""
    return df.join(known.select("track", "lap_length_m"), "track", "left")
