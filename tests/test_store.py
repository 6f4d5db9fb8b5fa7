"""Track files, scans with defaults, and sinks that replace only what is theirs."""

import json

import pytest
from pyspark.sql import functions as F

from lapwing.operators import corners as seeds
from lapwing.sources import logs, store, tracks


def test_track_files(spark, tmp_path):
    good = {"track_id": "ring", "name": "Ring", "direction": "clockwise", "lap_length_internal_m": 3000, "corners": [{"id": "T2", "start_m": 500, "end_m": 600, "apex_m": 550, "secondary_apex_m": 0}, {"id": "T1", "start_m": 100, "end_m": 200, "apex_m": 150, "secondary_apex_m": 180}], "calibration_anchors": [{"corner_id": "T1", "ref_lat": 45.0, "ref_long": -122.0}, {"corner_id": "T9", "ref_lat": 45.0, "ref_long": -122.0}], "accel_speed_check": {"corners": {"T1": {"offset_mps": 0.4, "tol_mps": 3.0, "n": 67}}}}
    (tmp_path / "ring.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bare.json").write_text(json.dumps({"track_id": "bare"}))
    (tmp_path / "bad.json").write_text("{ not json")
    raw = tracks.scan(spark, str(tmp_path))
    assert {(r.track, r.lap_length_m) for r in tracks.tracks(raw).collect()} == {("ring", 3000.0), ("bare", None)}
    assert [(r.corner_id, r.second_m, r.place) for r in tracks.corners(raw).orderBy("place").collect()] == [("T1", 180.0, 0), ("T2", None, 1)]
    assert [(r.corner_id, r.start_m) for r in tracks.anchors(raw).collect()] == [("T1", 100.0)]
    assert [(r.section, r.tol) for r in tracks.accel_refs(raw).collect()] == [("T1", 3.0)]
    met = tracks.with_lap_length(spark.createDataFrame([("ring",), ("bare",), ("none",)], "track string"), tracks.tracks(raw))
    assert {r.track: r.lap_length_m for r in met.collect()} == {"ring": 3000.0, "bare": None, "none": None}


def test_scans_fill_what_is_missing(spark, tmp_path):
    a = spark.createDataFrame([("ring", "s1", 1, 0.0, 1.0, 1.0, 5), ("ring", "s1", 2, 1.0, None, 2.0, 5)], "track string, session_id string, lap int, t double, track_dist_m double, dist_lap_m double, lat_g int")
    path = str(tmp_path / "samples")
    a.drop("lat_g").write.partitionBy("track", "session_id").parquet(path)
    got = store.trajectory_samples(spark, path).collect()
    assert [(r.lap, r.lat_g) for r in got] == [(1, None)]
    a.drop("t").write.parquet(str(tmp_path / "none"))
    assert store.trajectory_samples(spark, str(tmp_path / "none")).count() == 0
    assert store.session_samples(spark, path, "ring", "s1", 2).count() == 1
    cat = store.session_catalogue(a.withColumn("speed", F.lit(None).cast("double")), ["session_id"], ["t"], "t", "track_dist_m", "speed").first()
    assert (cat.has_obd, cat.fixes, cat.rate) == (False, 1, 1.0)


def test_corpus_leaves_references_out(spark, tmp_path):
    path = str(tmp_path / "transits")
    rows = spark.createDataFrame([("ring", s, 1, "T1", 1.0) for s in ("a", "b", "c")], "track string, session_id string, lap int, corner_id string, v double")
    logs.write(rows, path, store.KEYS)
    marks = spark.createDataFrame([("b", True, None), ("c", None, True)], "session_id string, reference boolean, exclude boolean")
    got = store.build_corpus(spark, path, marks, str(tmp_path)).first()
    assert (got.sessions, got.laps, got.transits) == (1, 1, 1)
    store.write_quality(rows.withColumn("ok", F.lit(True)), str(tmp_path))
    store.write_quality(rows.where("session_id = 'a'").withColumn("ok", F.lit(False)), str(tmp_path))
    assert {(r.session_id, r.ok) for r in spark.read.parquet(f"{tmp_path}/corners_scored").collect()} == {("a", False), ("b", True), ("c", True)}
    with pytest.raises(ValueError, match="no transits"):
        store.build_corpus(spark, path, spark.createDataFrame([(s, True, None) for s in "abc"], marks.schema), str(tmp_path))


def test_notes(spark, tmp_path):
    (tmp_path / "notes.json").write_text(json.dumps({"a": {"exclude": True, "reason": "rain"}, "b": {"reference": True}}))
    got = {r.session_id: (r.exclude, r.reference, r.reason) for r in logs.notes(spark, str(tmp_path / "notes.json")).collect()}
    assert got == {"a": (True, None, "rain"), "b": (None, True, None)}


def test_corners_are_seeded_from_pins_and_clusters(spark):
    clusters = spark.createDataFrame([("left", 400.0), ("right", 430.0), ("right", 470.0)], "side string, centre double")
    pins = spark.createDataFrame([("P1", "right", 440.0, None), ("P2", "left", 900.0, 980.0)], "pin string, side string, place double, second double")
    got = {r.pin: r for r in seeds.seeded_boxes(clusters, pins).collect()}
    assert (got["P1"].centre, got["P1"].start_m, got["P1"].confidence) == (430.0, 350.0, "high")
    assert (got["P2"].centre, got["P2"].end_m, got["P2"].confidence) == (900.0, 1060.0, "low")
