"""Logs of a table, sessions that share files, and what is left of them when some are replaced or retracted."""

import pytest
from test_logs import FULL, GPS_ONLY, log

from lapwing.sources import ledger, logs
from lapwing.streaming import ingest

TRACK = "ring: a/b"  # escaped in names of folders


@pytest.fixture
def table(spark, tmp_path):
    """Twelve logs, one of them GPS only, and three that give no session: without a column, with comments only, without a line."""
    rows = []
    for i in range(12):
        at = tmp_path / f"Log-202601{i + 1:02d}-120000.csv"
        log(at, GPS_ONLY if i == 3 else FULL)
        rows.append((at.name, at.read_text()))
    log(tmp_path / "bad.csv", [c for c in FULL if c != "Latitude"])
    rows += [("Log-20260113-120000.csv", (tmp_path / "bad.csv").read_text()), ("Log-20260114-120000.csv", "# Vehicle: Car\n\n# End"), ("Log-20260115-120000.csv", "")]
    return spark.createDataFrame(rows, "path string, value string")


def sessions(df):
    return {(r.session_id, r["count"]) for r in df.groupBy("session_id").count().collect()}


def test_stored_files_do_not_grow_with_sessions(spark, tmp_path, table, monkeypatch):
    out, some = str(tmp_path / "out"), lambda *days: {(f"202601{d:02d}-120000", 20) for d in days}
    run = lambda source, **options: {(r.session_id[6:8], r.status) for r in ingest.ingest(spark, source, TRACK, out, gps_lag=False, **options).collect()}
    stored = lambda: [spark.read.parquet(f"{out}/{t}") for t in ingest.TABLES]
    assert run(table) == {(f"{d:02d}", "gpsonly" if d == 4 else "ok") for d in range(1, 13)} | {("13", "FAIL")}
    for t in ingest.TABLES:
        folders = [p for p in (tmp_path / "out" / t).glob("*/*") if p.is_dir()]
        assert len(folders) == 1 and len(list(folders[0].glob("*.parquet"))) <= 8  # twelve of each before
    assert sessions(stored()[0]) == some(*range(1, 13))

    # replaced: the same rows, each once
    assert run(table.where("path like '%Log-2026010%'"), force=True) == {(f"{d:02d}", "gpsonly" if d == 4 else "ok") for d in range(1, 10)}
    assert sessions(stored()[0]) == sessions(ledger.read(spark, out, "samples")) == some(*range(1, 13))

    # a sweep that breaks off loses nothing, and the next one does the rest
    excluded = spark.createDataFrame([("20260101-120000",), ("20260112-120000",)], "session_id string")
    none, whole = table.where("path = 'Log-20260101-120000.csv'"), ledger.commit

    def lost(*args):
        if len(args) == 4 and args[3] > version:
            raise RuntimeError("lost")
        whole(*args)

    version = ledger.following(spark, out)
    monkeypatch.setattr(ledger, "commit", lost)
    with pytest.raises(RuntimeError):
        run(none, excluded=excluded)
    monkeypatch.undo()
    assert sessions(ledger.read(spark, out, "samples")) == some(*range(2, 12))
    assert run(none, excluded=excluded) == {("01", "excl")}
    assert sessions(stored()[0]) == sessions(ledger.read(spark, out, "samples")) == some(*range(2, 12))
    assert [df.select("session_id").distinct().count() for df in stored()] == [10, 10, 10]

    # all retracted, twice
    everyone = table.selectExpr("substring(path, 5, 15) as session_id")
    for _ in range(2):
        assert {s for _, s in run(none, excluded=everyone)} == {"excl"}
    assert ledger.live(spark, out).count() == 0 and not list((tmp_path / "out" / "samples").glob("*/*/*.parquet"))


def test_a_log_is_read_alike_from_a_table_and_a_file(spark, tmp_path):
    """Comments and blank lines anywhere, repeated headers' names, short lines and cells that are no numbers."""
    text = "# Vehicle: Car\r\n\n \n" + ",".join(FULL) + "\r\n1," * 1 + ",".join("2" for _ in FULL[1:]) + "\n#1,2\n\n3,nan,x,\n,,1.9\n"
    (tmp_path / "Log-20260101-120000.csv").write_bytes(text.encode())
    table = spark.createDataFrame([("Log-20260101-120000.csv", text)], "path string, value string")
    got = [logs.samples(logs.heads(logs.texts(spark, s)), "ring").orderBy("row_id").collect() for s in (table, str(tmp_path / "Log-20260101-120000.csv"))]
    assert got[0] == got[1] and [(r.row_id, r.t, r.utc, r.lap, r.sector) for r in got[0]] == [(4, 1.0, 2.0, 2, 2), (7, 3.0, None, None, None), (8, None, None, 1, None)]
