"""Logs: headers, missing columns, bad names, and that a second run changes nothing."""

import math

import pytest

from lapwing.sources import ledger, logs
from lapwing.streaming import ingest

FULL = list(logs.CANONICAL)
GPS_ONLY = [c for c in FULL if not c.endswith("OBD")]


def log(path, names, laps=3, rows=20):
    def cell(name, i):
        return {"Time": 0.1 * i, "UTC Time": 1e9 + 0.1 * i, "Lap": i * laps // rows, "Latitude": 45, "Longitude": -122, "Speed (MPH)": 60, "Vehicle Speed (mph) *OBD": 60, "Throttle Position (%) *OBD": 50 if i else "", "Brake (calculated)": ""}.get(name, 1)

    body = "\n".join(",".join(str(cell(n, i)) for n in names) for i in range(rows))
    path.write_text("# Vehicle: Car\n# End Point: 45.0, -122.0 @ 2026\n# Split Point 2: 45.2, -122.2\n# Split Point 1: 45.1, -122.1\n" + ",".join(names) + "\n" + body + "\n")


def test_ingest(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    log(folder / "Log-20260101-120000 a.csv", FULL)
    log(folder / "Log-20260102-120000.csv", GPS_ONLY)
    log(folder / "bad.csv", FULL)
    log(folder / "Log-20260103-120000.csv", [c for c in FULL if c != "Latitude"])
    paths = [str(p) for p in folder.glob("*.csv")]
    got = {(r.session_id, r.status) for r in ingest.ingest(spark, paths, "ring", out).collect()}
    assert got == {("20260101-120000", "ok"), ("20260102-120000", "gpsonly"), ("", "FAIL"), ("20260103-120000", "FAIL")}
    s = spark.read.parquet(f"{out}/samples").where("session_id = '20260101-120000'").orderBy("row_id").collect()
    assert len(s) == 20 and abs(s[-1].dist_m - 60 * 0.44704 * 1.9) < 1e-9 and s[0].throttle_norm == 1.0 and s[0].lat_g == -1 and s[0].brake == 0
    gps = spark.read.parquet(f"{out}/samples").where("session_id = '20260102-120000'").first()
    assert gps.rpm is None and gps.has_obd is False
    laps = spark.read.parquet(f"{out}/laps").where("session_id = '20260101-120000'").orderBy("lap").collect()
    assert [x.clean_reason for x in laps] == ["warmup", "", "cooldown"] and laps[1].is_clean
    meta = spark.read.parquet(f"{out}/session_meta").where("session_id = '20260101-120000'").first()
    assert meta.n_laps == 3 and meta.best_lap == 1
    again = {(r.session_id, r.status) for r in ingest.ingest(spark, paths, "ring", out).collect()}
    assert ("20260101-120000", "skip") in again
    head = logs.headers(logs.lines(spark, paths[:1])).first()
    assert head.vehicle == "Car" and head.end_point.lat == 45.0 and [p["index"] for p in head.split_points] == [1, 2]


def test_stream_takes_new_files_only(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for day in ("01", "02"):
        log(folder / f"Log-202601{day}-120000.csv", FULL)
        ingest.start(spark, str(folder), "ring", out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(f"{out}/session_meta").count() == int(day)


def late_log(path, speed_late, place_late, laps=4, seconds=58, radius=200.0, no_obd=False):
    """Laps of an oval at 27 Hz: engine bus on time, GPS speed and places late, fixes 9 a second and held."""
    speed = lambda t: 70 + 30 * math.sin(2 * math.pi * t / 23) + 12 * math.sin(2 * math.pi * t / 6.7 + 1)
    gone = lambda t: 0.44704 * (70 * t - 30 * 23 / (2 * math.pi) * (math.cos(2 * math.pi * t / 23) - 1) - 12 * 6.7 / (2 * math.pi) * (math.cos(2 * math.pi * t / 6.7 + 1) - math.cos(1)))
    names = [n for n in FULL if not (no_obd and n.endswith("OBD"))]
    rows = []
    for i in range(int(laps * seconds * 27)):
        t = i / 27
        fix = math.floor(t * 9) / 9
        angle = gone(max(fix - place_late, 0.0)) / radius
        x, y = radius * math.cos(angle), radius * math.sin(angle)
        g = -(speed(t + 0.01) - speed(t - 0.01)) / 0.02 * 0.44704 / 9.80665
        cells = {"Time": t, "UTC Time": 1e9 + t, "Lap": int(t // seconds), "Latitude": 45 + y / 111132.0, "Longitude": -122 + x / (111132.0 * math.cos(math.radians(45))), "Speed (MPH)": speed(max(fix - speed_late, 0.0)), "Vehicle Speed (mph) *OBD": speed(t), "Accel X": g}
        rows.append(",".join(repr(cells.get(n, 1)) for n in names))
    path.write_text(",".join(names) + "\n" + "\n".join(rows) + "\n")


def test_ingest_takes_off_planted_lags(spark, tmp_path):
    out = str(tmp_path / "out")
    late_log(tmp_path / "Log-20260201-120000.csv", 0.62, 0.33)
    late_log(tmp_path / "Log-20260202-120000.csv", 0.40, 0.20, no_obd=True)
    ingest.ingest(spark, [str(p) for p in tmp_path.glob("*.csv")], "ring", out).count()
    meta = {r.session_id: r.gps_lag for r in spark.read.parquet(f"{out}/session_meta").collect()}
    a, b = meta["20260201-120000"], meta["20260202-120000"]
    held = 1 / 18  # a fix is held for a ninth of a second, half of it on average
    assert (a.method_version, a.n_lap, a.n_session, a.n_default, a.pos_lag_source, a.pos_lag_n_laps) == ("gps-lag-v3", 2, 2, 0, "path", 2)
    assert abs(a.session_median_s + 0.075 - 0.62 - held) < 0.03 and abs(a.pos_lag_s + 0.075 - 0.33) < 0.06
    assert b.n_accel == 2 and b.pos_lag_source == "offset" and abs(b.session_median_s - 0.40 - held) < 0.08 and abs(b.pos_lag_s - b.session_median_s + 0.12) < 2e-3
    laps = spark.read.parquet(f"{out}/laps").where("session_id = '20260201-120000'").orderBy("lap").collect()
    assert [x.gps_lag_source for x in laps] == ["session", "lap", "lap", "session"] and all(abs(x.gps_pos_lag_s - a.pos_lag_s) < 1e-3 for x in laps)
    s = spark.read.parquet(f"{out}/samples").where("session_id = '20260201-120000' and t between 70 and 170").orderBy("t", "row_id").collect()
    off = [abs(r.speed_mph_gps - r.speed_mph) for r in s]
    assert sum(off) / len(off) < 2.0  # some 8 before
    assert all(abs(r.gps_lag_s - a.session_median_s) < 0.1 for r in s)
    seen = [r.lat for r in spark.read.parquet(f"{out}/samples").where("session_id = '20260201-120000'").orderBy("row_id").collect()]
    logged = {float(x.split(",")[FULL.index("Latitude")]) for x in (tmp_path / "Log-20260201-120000.csv").read_text().split("\n")[1:] if x}
    assert set(seen) <= logged  # nothing is interpolated
    plain = str(tmp_path / "plain")
    ingest.ingest(spark, [str(tmp_path / "Log-20260201-120000.csv")], "ring", plain, gps_lag=False).count()
    same = spark.read.parquet(f"{plain}/samples").orderBy("row_id").collect()
    assert [r.lat for r in same] != seen and {(r.gps_lag_s, r.gps_pos_lag_s) for r in same} == {(0.0, 0.0)}
    assert spark.read.parquet(f"{plain}/session_meta").first().gps_lag.n_disabled == 4


def test_excluded_sessions_are_retracted(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for day in ("01", "02", "03"):
        log(folder / f"Log-202601{day}-120000.csv", FULL)
    paths = sorted(str(p) for p in folder.glob("*.csv"))
    ingest.ingest(spark, paths[:2], "ring", out).count()
    excluded = spark.createDataFrame([("20260101-120000",), ("20269999-000000",)], "session_id string")
    got = {r.session_id: r.status for r in ingest.ingest(spark, paths, "ring", out, excluded=excluded).collect()}
    assert got == {"20260101-120000": "excl", "20260102-120000": "skip", "20260103-120000": "ok"}
    for table in ingest.TABLES:
        assert {r.session_id for r in spark.read.parquet(f"{out}/{table}").select("session_id").distinct().collect()} == {"20260102-120000", "20260103-120000"}
    assert {r.session_id for r in ledger.live(spark, out).collect()} == {"20260102-120000", "20260103-120000"}
    # included again, it is new
    assert {r.status for r in ingest.ingest(spark, paths[:1], "ring", out).collect()} == {"ok"}
    assert ledger.read(spark, out, "laps").select("session_id").distinct().count() == 3


def test_a_broken_batch_stays_unseen_and_is_run_again(spark, tmp_path, monkeypatch):
    log(tmp_path / "Log-20260101-120000.csv", FULL)
    paths, out = [str(tmp_path / "Log-20260101-120000.csv")], str(tmp_path / "out")

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger, "commit", lost)
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, paths, "ring", out)
    assert ledger.read(spark, out, "samples").count() == 0
    monkeypatch.undo()
    assert ingest.ingest(spark, paths, "ring", out).first().status == "ok" and ledger.read(spark, out, "samples").count() == 20


def test_lap_lengths_are_those_of_tracks(spark, tmp_path):
    log(tmp_path / "Log-20260101-120000.csv", FULL)
    lengths = spark.createDataFrame([("ring", 500.0), ("other", 1.0)], "track string, lap_length_m double")
    for track, want in (("ring", 500.0), ("unknown", None)):
        ingest.ingest(spark, [str(tmp_path / "Log-20260101-120000.csv")], track, str(tmp_path / track), lap_length=lengths).count()
        far = {r.lap_dist_m for r in spark.read.parquet(str(tmp_path / track / "laps")).collect()}
        assert far == {want} if want else max(far) < 40


def test_a_session_is_written_as_one_file(spark, tmp_path):
    from lapwing.sources import logs

    rows = spark.range(60).repartition(5).selectExpr("'ring' as track", "cast(id % 3 as string) as session_id", "id")
    logs.write(rows, str(tmp_path / "t"), logs.KEYS)
    assert [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "t").glob("*/*/"))] == [1, 1, 1]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
