"""The corpus is rebuilt for the tracks whose inputs changed, and for those only."""

import math

from pyspark.sql import functions as F

from lapwing.sources import ledger, logs
from lapwing.streaming import rebuild

RADIUS, LENGTH = 100.0, 628


def session(spark, out, track, session_id, laps=2, shift=0.0):
    """Laps of a circle at 20 m/s, ten samples a second, stored as ingest stores them."""
    rows = []
    for i in range(laps * 314):
        t, gone = i / 10, 2.0 * i
        angle = gone / RADIUS
        rows.append((track, session_id, i, t, int(gone // (2 * math.pi * RADIUS)), 45 + (RADIUS + shift) * math.sin(angle) / 111132.0, -122 + (RADIUS + shift) * math.cos(angle) / (111132.0 * math.cos(math.radians(45))), 44.7, 44.7, 0.3, 0.0, 0.9, 0))
    s = spark.createDataFrame(rows, "track string, session_id string, row_id long, t double, lap int, lat double, long double, speed_mph double, speed_mph_gps double, lat_g double, long_g double, throttle_norm double, brake int").withColumn("brake", F.col("brake").cast("tinyint"))
    logs.write(s, f"{out}/samples", ["track", "session_id"])
    logs.write(s.select("track", "session_id", "lap").distinct().withColumn("is_clean", F.lit(True)), f"{out}/laps", ["track", "session_id"])
    ledger.commit(spark, out, spark.createDataFrame([(track, session_id, ledger.LIVE)], "track string, session_id string, state string"))


def dimensions(spark, reference="none"):
    corners = [(t, f"T{i}", 50.0 + 200 * i, 130.0 + 200 * i, 90.0 + 200 * i, None) for t in ("a", "b") for i in range(3)]
    ruler = [(t, i, 45 + RADIUS * math.sin(i / RADIUS) / 111132.0, -122 + RADIUS * math.cos(i / RADIUS) / (111132.0 * math.cos(math.radians(45)))) for t in ("a", "b") for i in range(LENGTH)]
    return rebuild.Dimensions(
        spark.createDataFrame(corners, "track string, corner_id string, start_m double, end_m double, apex_m double, second_m double"),
        spark.createDataFrame([("a", LENGTH), ("b", LENGTH)], "track string, length int"),
        spark.createDataFrame(ruler, "track string, bin int, lat double, long double"),
        spark.createDataFrame([(reference, None, None, True)], "session_id string, exclude boolean, flag string, reference boolean"),
    )


def test_only_changed_tracks_are_rebuilt(spark, tmp_path):
    out, of = str(tmp_path), dimensions(spark)
    for track, name in (("a", "s1"), ("b", "s2")):
        session(spark, out, track, name)
    assert rebuild.rebuild(spark, out, of) == ["a", "b"]
    corpus = lambda: {(r.track, r.session_id): r.n for r in ledger.read(spark, out, "corpus").groupBy("track", "session_id").agg(F.count("*").alias("n")).collect()}
    assert corpus() == {("a", "s1"): 6, ("b", "s2"): 6}
    s = spark.read.parquet(f"{out}/samples_labelled").where("track = 'a' and lap = 1").orderBy("t").collect()
    around = 2 * math.pi * RADIUS
    away = [(r.track_dist_m - 2.0 * r.row_id) % around for r in s]
    assert all(min(x, around - x) < 1.01 for x in away) and all(r.track_dist_offset_m < 0.7 for r in s)
    line = spark.read.parquet(f"{out}/centerline").where("track = 'a'").collect()
    assert len(line) == LENGTH and all(abs(math.hypot(r.x, r.y) - RADIUS) < 1.0 for r in line)
    assert spark.read.parquet(f"{out}/corridor").select("track").distinct().count() == 2
    assert rebuild.rebuild(spark, out, of, stages=(None,)) == []  # no stage runs over unchanged input

    session(spark, out, "a", "s3", shift=3.0)
    assert rebuild.rebuild(spark, out, of) == ["a"] and corpus() == {("a", "s1"): 6, ("a", "s3"): 6, ("b", "s2"): 6}

    ledger.commit(spark, out, spark.createDataFrame([("a", "s1", ledger.RETRACTED)], "track string, session_id string, state string"))
    assert rebuild.rebuild(spark, out, of) == ["a"] and corpus() == {("a", "s3"): 6, ("b", "s2"): 6}
    assert {r.session_id for r in spark.read.parquet(f"{out}/transits").where("track = 'a'").select("session_id").distinct().collect()} == {"s3"}

    assert rebuild.rebuild(spark, out, dimensions(spark, reference="s2")) == ["b"] and corpus() == {("a", "s3"): 6}
