"""New log files as they land: a file stream whose batches run the batch normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.lineage import cut, grown
from lapwing.sources import ledger, logs

#: Tables of a session, in the order in which they are written; the ledger's commit comes after them.
TABLES = ("samples", "laps", "session_meta")


def ingest(spark: SparkSession, source: str | list[str] | DataFrame, track: str, out: str, lap_length: float | DataFrame | None = None, force: bool = False, excluded: DataFrame | None = None, gps_lag: bool = True, session: str = logs.SESSION) -> DataFrame:
    """Normalizes logs, files or a table (path, value), into ``out`` (samples, laps, session_meta) and returns (session_id, status, reason) of each.

    Known sessions are skipped unless forced, and a bad log rejects itself only. ``excluded`` (session_id) are left out, and those
    of them that were ingested before are retracted, whether or not their log is in ``source``. Receivers' lags are found and taken off,
    if ``gps_lag``. ``session`` is the pattern of an id in a log's name. A batch commits its sessions and retractions together, after its data are written; one that broke off is run again.
    """
    log = logs.texts(spark, source, session)
    heads = cut(logs.heads(log).select("session_id", "has_obd", "reason", "rows"))
    ids = heads.where("reason is null and rows > 0").select("session_id", "has_obd").distinct()
    status = ids.withColumn("status", F.when(F.col("has_obd"), "ok").otherwise("gpsonly"))
    known = ledger.live(spark, out).where(F.col("track") == track)
    if not force:
        status = status.join(grown(known.select("session_id", F.lit(1).alias("k"))), "session_id", "left").withColumn("status", F.when(F.col("k").isNotNull(), "skip").otherwise(F.col("status"))).drop("k")
    gone = None
    if excluded is not None:
        left_out = excluded.select("session_id").distinct()
        status = status.join(grown(left_out.withColumn("x", F.lit(1))), "session_id", "left").withColumn("status", F.when(F.col("x").isNotNull(), "excl").otherwise(F.col("status"))).drop("x")
        gone = cut(known.join(grown(left_out), "session_id", "left_semi").select("track", "session_id"))
    status = cut(status.select("session_id", "status"))  # settled before the tables change
    take = status.where("status in ('ok', 'gpsonly')").select("session_id")
    changes = [take.select(F.lit(track).alias("track"), "session_id", F.lit(ledger.LIVE).alias("state"))]
    version = ledger.following(spark, out)
    if not take.isEmpty():
        due = log.join(grown(take), "session_id", "left_semi")  # known logs are not taken apart
        s = cut(logs.turned(logs.samples(logs.heads(due), track)))
        laps, sessions = logs.lag_tables(s, gps_lag)
        logs.write_batch(logs.normalize(logs.relocked(s, laps, sessions), lap_length), f"{out}/samples", version)
        # laps and sessions are made from the samples as written: logs are read once
        own = lambda table: spark.read.parquet(f"{out}/{table}").where((F.col("track") == track) & (F.col("version") == version)).drop("version")
        logs.write_batch(logs.lap_table(own("samples"), laps), f"{out}/laps", version)
        logs.write_batch(logs.session_table(own("samples"), own("laps"), logs.lag_block(laps, sessions)), f"{out}/session_meta", version)
    if gone is not None:
        changes.append(gone.withColumn("state", F.lit(ledger.RETRACTED)))
    changed = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    if not changed.isEmpty():
        ledger.commit(spark, out, changed, version)
    if force or gone is not None:
        # what was replaced or retracted, now or by an earlier batch that did not remove it
        ledger.sweep(spark, out, TABLES, track)
    done = status.select("session_id", "status", F.lit(None).cast("string").alias("reason"))
    return done.unionByName(heads.where("reason is not null").select("session_id", F.lit("FAIL").alias("status"), "reason"))


def start(spark: SparkSession, folder: str, track: str, out: str, checkpoint: str, files_at_once: int = 1000, **options):
    """Ingests what is new in a folder, ``files_at_once`` in a batch, and stops; run again, it takes only later files."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.csv").load(folder).select(F.col("_metadata.file_path").alias("path"))

    def batch(rows: DataFrame, _: int) -> None:
        paths = [r.path for r in rows.distinct().collect()]  # at most files_at_once names
        if paths:
            ingest(spark, paths, track, out, **options)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
