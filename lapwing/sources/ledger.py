"""Which sessions are live: a table of commits, of which each session's last one holds.

A batch writes its data first and then one file of commits, so that it shows at once or not at all: readers keep the rows of live
sessions, and what a broken batch has written stays unseen until the batch is run again. Data of retracted sessions are removed after that.
Tables with a version keep each batch's rows under the version of its commit; of a session, readers see those of its last one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.lineage import cut, grown
from lapwing.sources import logs

KEYS = ["track", "session_id"]
SCHEMA = "track string, session_id string, state string, version long"
LIVE, RETRACTED = "live", "retracted"


def _has_rows(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def states(spark: SparkSession, out: str) -> DataFrame:
    """(track, session_id, state, version): the last commit of each session; none before the first batch."""
    if not _has_rows(spark, f"{out}/ledger"):
        return spark.createDataFrame([], SCHEMA)
    commits = spark.read.schema(SCHEMA).parquet(f"{out}/ledger")
    return commits.groupBy(*KEYS).agg(F.max_by("state", "version").alias("state"), F.max("version").alias("version"))


def live(spark: SparkSession, out: str) -> DataFrame:
    """(track, session_id, version) of the sessions that readers see."""
    return states(spark, out).where(F.col("state") == LIVE).drop("state")


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table's rows of live sessions, without the version."""
    rows = spark.read.parquet(f"{out}/{table}")
    on = [*KEYS, "version"] if "version" in rows.columns else KEYS
    return rows.join(grown(live(spark, out).select(*on)), on, "left_semi").drop("version")


def following(spark: SparkSession, out: str) -> int:
    """The version of the next commit, above all that are there."""
    return states(spark, out).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1


def commit(spark: SparkSession, out: str, changes: DataFrame, version: int | None = None) -> None:
    """Appends (track, session_id, state), one file, as ``version`` or the following one."""
    version = following(spark, out) if version is None else version
    changes.select(*KEYS, "state", F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{out}/ledger")


def sweep(spark: SparkSession, out: str, tables: Sequence[str], track: str) -> None:
    """Removes a track's rows that no reader sees from tables with a version.

    Batches that have such rows are removed. What is live of them is written and committed as a batch of its own before that, so that a sweep that
    breaks off loses nothing and is made good by the next one.
    """
    tables = [t for t in tables if _has_rows(spark, f"{out}/{t}")]
    if not tables:
        return
    on = [*KEYS, "version"]
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
    held = [spark.read.schema("track string, session_id string, version long").parquet(f"{out}/{t}").where(F.col("track") == track).select(*on, folder).distinct() for t in tables]
    alive = live(spark, out).select(*on, F.lit(True).alias("alive"))
    marked = cut(reduce(DataFrame.unionByName, held).join(grown(alive), on, "left"))
    due = marked.groupBy("version").agg(F.count("*").alias("n"), F.count("alive").alias("live"), F.collect_set("folder").alias("folders")).where("live < n").collect()  # a row a batch
    if any(r.live for r in due):
        of = F.col("version").isin([r.version for r in due])
        kept = marked.where(of & F.col("alive")).select(*on).distinct()
        version = max(following(spark, out), 1 + max(r.version for r in due))  # a batch that broke off may have left one that was not committed
        for t in tables:
            rows = spark.read.parquet(f"{out}/{t}").where((F.col("track") == track) & of)
            logs.write_batch(rows.join(grown(kept), on, "left_semi"), f"{out}/{t}", version)
        commit(spark, out, kept.select(*KEYS, F.lit(LIVE).alias("state")), version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in due:
        for name in r.folders:
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            at.getFileSystem(conf).delete(at, True)


def remove(spark: SparkSession, out: str, tables: Sequence[str], sessions: DataFrame) -> int:
    """Deletes the partitions of sessions, one by one, from the tables that have them; returns how many there were."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in sessions.select(*KEYS).distinct().toLocalIterator():
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(f"{out}/{table}/track={row.track}/session_id={row.session_id}")
            n += at.getFileSystem(conf).delete(at, True)
    return n
