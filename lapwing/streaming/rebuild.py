"""The corpus of tracks, rebuilt where its inputs have changed.

A track's stamp digests its live sessions, each with the version of its last commit, and the track's dimensions. Stamps come from the ledger and
the dimensions alone, so that a run over unchanged input reads no samples. Tracks whose stamp differs from the one of their last
build go through all stages together, each stage reading what the one before wrote; their stamps are written at the end, so a run
that broke off is done again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.expressions import to_xy
from lapwing.functions.lineage import cut
from lapwing.operators import centerline as cl, joins, trajectory as tr, transits as tra
from lapwing.sources import ledger, store
from lapwing.sources.logs import write

TRACK, SESSION, LAP, ORDER = ["track"], ["track", "session_id"], ["track", "session_id", "lap"], ["t", "row_id"]
#: Tables that the stages write by session; version of the stages, part of every stamp; metres of a cell in which samples look for the ruler.
DERIVED, VERSION, CELL = ("samples_labelled", "transits", "corners_scored", "corpus"), "corpus-1", 25.0
#: Track width and height that keep tracks apart on one plane, in metres.
APART = 1e7


@dataclass
class Dimensions:
    """What is known of tracks: corners (track, corner_id, start_m, end_m, apex_m, second_m), lengths (track, length),
    ruler (track, bin, lat, long), and notes of sessions (session_id, exclude, flag, reference)."""

    corners: DataFrame
    lengths: DataFrame
    ruler: DataFrame
    notes: DataFrame


def _digest(df: DataFrame, name: str) -> DataFrame:
    """(track, name): number and sum of row digests, whatever the order of rows."""
    row = F.xxhash64(*sorted(c for c in df.columns if c != "track")).cast("decimal(38,0)")
    return df.groupBy("track").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(row).cast("string")).alias(name))


def stamps(spark: SparkSession, out: str, of: Dimensions) -> DataFrame:
    """(track, stamp) of the tracks that have live sessions."""
    live = ledger.live(spark, out)
    sessions = live.join(of.notes.select("session_id", "exclude", "flag", "reference"), "session_id", "left")
    parts = [_digest(sessions, "__s"), _digest(of.corners, "__c"), _digest(of.lengths, "__l"), _digest(of.ruler, "__r")]
    met = parts[0]
    for p in parts[1:]:
        met = met.join(p, "track", "left")
    return met.select("track", F.sha2(F.concat_ws("|", F.lit(VERSION), *[F.coalesce(c, F.lit("-")) for c in ("__s", "__c", "__l", "__r")]), 256).alias("stamp"))


def changed(spark: SparkSession, out: str, of: Dimensions) -> DataFrame:
    """(track, stamp) of the tracks whose stamp is not that of their last build."""
    want = stamps(spark, out, of)
    if not ledger._has_rows(spark, f"{out}/stamps"):
        return want
    return want.join(spark.read.schema("stamp string, track string").parquet(f"{out}/stamps"), ["track", "stamp"], "left_anti")


def placed(samples: DataFrame, ruler: DataFrame) -> DataFrame:
    """Samples with x, y on their track's plane, and track_dist_m and track_dist_offset_m, the nearest place of the ruler and how far off it is.

    A place that a receiver held for several samples is looked up once. Samples without a place have none on the ruler.
    """
    centre = ruler.groupBy("track").agg(F.avg("lat").alias("__lat0"), F.avg("long").alias("__lon0")).withColumn("__apart", F.pmod(F.xxhash64("track"), F.lit(1 << 20)) * APART)
    x, y = to_xy(F.col("lat"), F.col("long"), F.col("__lat0"), F.col("__lon0"))
    flat = lambda df: df.join(centre, "track").withColumns({"x": x + F.col("__apart"), "y": y})
    places = flat(samples.where("lat is not null and long is not null").select("track", "lat", "long").distinct()).withColumn("place", F.struct("track", "lat", "long"))
    marks = flat(ruler).withColumn("at", F.struct("bin", "track"))
    found = joins.nearest(places, marks, CELL, "place", "at")
    found = found.select("place.*", F.col("at.bin").cast("double").alias("track_dist_m"), F.col("distance").alias("track_dist_offset_m"))
    met = samples.join(found, ["track", "lat", "long"], "left")
    return met.join(centre, "track").withColumns({"x": x, "y": y}).drop("__lat0", "__lon0", "__apart")


def label(spark: SparkSession, out: str, tracks: list[str], of: Dimensions) -> None:
    samples = ledger.read(spark, out, "samples").where(F.col("track").isin(tracks))
    store.write_labelled(placed(samples, of.ruler.where(F.col("track").isin(tracks))), of.corners, out)


def passages(spark: SparkSession, out: str, tracks: list[str], of: Dimensions) -> None:
    s = _labelled(spark, out, tracks).withColumnsRenamed({"speed_mph": "speed", "speed_mph_gps": "gps_speed", "throttle_norm": "throttle", "track_dist_offset_m": "offset"})
    s = s.where("track_dist_m is not null").withColumn("sigma", F.lit(None).cast("double"))
    store.write_transits(tra.transits(s, of.corners, LAP, TRACK, ORDER, "track_dist_m"), out)


def quality(spark: SparkSession, out: str, tracks: list[str], of: Dimensions) -> None:
    order = F.row_number().over(joins.Window.partitionBy("track").orderBy("start_m")) - 1
    ring = of.corners.select("track", "corner_id", order.alias("place"), F.count("*").over(joins.Window.partitionBy("track")).alias("__count"))
    rows = _live(spark, out, "transits", tracks).join(ring, ["track", "corner_id"])
    near = joins.neighbour_max(rows, LAP, "place", F.col("__count"), "offset_max", "neighborhood_offset_max").drop("place", "__count")
    scored = tra.spatial_reliability(near.withColumn("__drift", F.lit(0.0)), LAP, "__drift", "offset_max", "neighborhood_offset_max").drop("__drift")
    store.write_quality(tra.sigma_reliability(scored, LAP), out)


def line(spark: SparkSession, out: str, tracks: list[str], of: Dimensions) -> None:
    """Centerlines, rulers made from them, and corridors."""
    s = _labelled(spark, out, tracks).where("track_dist_m is not null")
    s = s.withColumns({c: F.lit(None).cast("double") for c in ("gps_drift_lat_m", "gps_drift_lon_m", "gps_drift_disagreement_m") if c not in s.columns})
    laps = _live(spark, out, "laps", tracks)
    kept = cl.line_samples(s, laps, _live(spark, out, "transits", tracks), of.notes, F.col("lat"))
    drawn = cut(cl.centerline(kept, of.corners, of.lengths.where(F.col("track").isin(tracks)), TRACK, "track_dist_m", "x", "y"))
    write(drawn, f"{out}/centerline", TRACK)
    store.publish_ruler(drawn, out)
    bins = int(of.lengths.where(F.col("track").isin(tracks)).agg(F.max("length")).first()[0] // tr.BIN) + 1
    band = cl.cold_corridor(cl.field(drawn, TRACK), TRACK)
    near = tr.lateral_offset(kept, band, bins, "x", "y", "track_dist_m", track=TRACK).withColumns({"bin": tr.bin_index(F.col("track_dist_m"), bins), "__v": F.coalesce("speed_mph", "speed_mph_gps") * 0.44704})
    store.save_corridor(cl.corridor(near, drawn, ["session_id", "lap"], TRACK, "e_lat", "__v", "lat_g"), drawn, out)


def corpus(spark: SparkSession, out: str, tracks: list[str], of: Dimensions) -> None:
    """Scored passages of sessions that are neither references nor excluded."""
    left_out = of.notes.where(F.coalesce("reference", F.lit(False)) | F.coalesce("exclude", F.lit(False))).select("session_id")
    write(_live(spark, out, "corners_scored", tracks).join(left_out, "session_id", "left_anti"), f"{out}/corpus", SESSION)


def _live(spark: SparkSession, out: str, table: str, tracks: list[str]) -> DataFrame:
    return ledger.read(spark, out, table).where(F.col("track").isin(tracks))


def _labelled(spark: SparkSession, out: str, tracks: list[str]) -> DataFrame:
    return _live(spark, out, "samples_labelled", tracks)


#: The stages in their order; each takes (spark, out, tracks, dimensions) and replaces what it holds of the tracks.
STAGES = (label, passages, quality, line, corpus)


def rebuild(spark: SparkSession, out: str, of: Dimensions, stages=STAGES) -> list[str]:
    """Rebuilds the tracks whose inputs changed and returns their names, in order; none where nothing changed.

    What sessions that are no longer live had in the stages' tables is removed. A track that has no live session left keeps only its stampless tables,
    which readers of live sessions do not see.
    """
    due = cut(changed(spark, out, of))
    tracks = sorted(r.track for r in due.select("track").collect())  # a name a track
    if not tracks:
        return []
    for stage in stages:
        stage(spark, out, tracks, of)
    gone = ledger.states(spark, out).where(F.col("track").isin(tracks) & (F.col("state") != ledger.LIVE))
    left_out = ledger.live(spark, out).join(of.notes.where(F.coalesce("reference", F.lit(False)) | F.coalesce("exclude", F.lit(False))).select("session_id"), "session_id", "left_semi").where(F.col("track").isin(tracks))
    ledger.remove(spark, out, DERIVED, gone)
    ledger.remove(spark, out, ["corpus"], left_out)
    due.select("stamp", "track").coalesce(1).write.partitionBy("track").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{out}/stamps")
    return tracks
