"""The given tables in the roles of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(df: DataFrame, column: str) -> Column:
    """Seconds since 1970, whatever the session's time zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)) / 1e6
    return F.unix_micros(column) / 1e6


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sample series: k session, t seconds, i tiebreak, v channel, c code, lap (week)."""
    e = read(spark, sf_dir, "events")
    t = epoch(e, "ts")
    return e.select(F.col("user_id").alias("k"), t.alias("t"), F.col("event_id").alias("i"), F.col("value").alias("v"), F.col("event_type").alias("c"), F.floor(t / 604800).cast("long").alias("lap"))


SERIES = "SELECT user_id AS k, epoch_us(ts) / 1e6 AS t, event_id AS i, value AS v, event_type AS c, CAST(floor(epoch_us(ts) / 1e6 / 604800) AS BIGINT) AS lap FROM events"


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as laps: k driver, lap, t, x lap time, corner, status."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("lap"), epoch(o, "o_orderdate").alias("t"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("corner"), F.col("o_orderstatus").alias("status"))


LAPS = "SELECT o_custkey AS k, o_orderkey AS lap, epoch_us(o_orderdate) / 1e6 AS t, o_totalprice AS x, o_orderpriority AS corner, o_orderstatus AS status FROM orders"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: their first two components are x and y."""
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", v[0].alias("x"), v[1].alias("y"), v[2].alias("x2"), v[3].alias("y2"))


POINTS = "SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS y2 FROM embeddings"


def drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry samples of one lap per session: track, k, i, n, t, v (m/s), gps (m/s), obd, lat_g, long_g, dl, td, x, e.

    Each event is a sample; its number in the session and its value set the channels. The ruler td is renewed every
    third sample and held between, some fixes are far off, some laps have a wrong ruler, some no engine bus.
    """
    w = Window.partitionBy("k").orderBy("t0", "i")
    e = series(spark, sf_dir).select("k", F.col("t").alias("t0"), "i", F.col("v").alias("val")).withColumn("n", F.row_number().over(w))
    n, k, val = F.col("n"), F.col("k"), F.col("val")
    d = e.select("k", "i", "n", "val", (n * 0.75).alias("t"), (30 + 10 * F.sin(n / 9.0) + val % 1.0).alias("v"), (0.9 * F.sin(n / 7.0 + k % 5)).alias("lat_g"), (0.1511 * F.cos(n / 9.0) + val % 0.05).alias("long_g"), (k % 11 != 3).alias("obd"))
    d = d.withColumn("gps", F.col("v") * 1.01)
    by_n = Window.partitionBy("k").orderBy("n")
    step = F.coalesce(0.5 * (F.col("v") + F.lag("v").over(by_n)) * 0.75, F.lit(0.0))
    d = d.withColumn("step", step).withColumn("dl", F.sum("step").over(by_n.rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    far = F.when(n % 29 == 10, 40.0).otherwise(0.0) + F.when(k % 23 == 7, 400.0).otherwise(0.0)
    renewed = n % 3 == 1
    held = lambda c: F.last(F.when(renewed, c), True).over(by_n.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"td": held(F.col("dl") + 6 * F.sin(n / 11.0) + val % 4.0 - 2 + far), "e": held(3 * F.sin(n / 5.0) + val % 2.0 - 1)})
    return d.select((k % 2).cast("int").alias("track"), "k", "i", "n", "t", "v", "gps", "obd", "lat_g", "long_g", "dl", "td", F.col("td").alias("x"), "e")


DRIVE = f"""{SERIES}), d0 AS (SELECT k, i, v AS val, row_number() OVER (PARTITION BY k ORDER BY t, i) AS n FROM d00),
d1 AS (SELECT *, n * 0.75 AS t, 30 + 10 * sin(n / 9.0::DOUBLE) + val % 1.0::DOUBLE AS v, 0.9 * sin(n / 7.0::DOUBLE + k % 5) AS lat_g, 0.1511 * cos(n / 9.0::DOUBLE) + val % 0.05::DOUBLE AS long_g, k % 11 <> 3 AS obd FROM d0),
d2 AS (SELECT *, v * 1.01 AS gps, coalesce(0.5 * (v + lag(v) OVER (PARTITION BY k ORDER BY n)) * 0.75, 0) AS step FROM d1),
d3 AS (SELECT *, sum(step) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS dl FROM d2),
d4 AS (SELECT *, CASE WHEN n % 3 = 1 THEN dl + 6 * sin(n / 11.0::DOUBLE) + val % 4.0::DOUBLE - 2 + CASE WHEN n % 29 = 10 THEN 40 ELSE 0 END + CASE WHEN k % 23 = 7 THEN 400 ELSE 0 END END AS td0, CASE WHEN n % 3 = 1 THEN 3 * sin(n / 5.0::DOUBLE) + val % 2.0::DOUBLE - 1 END AS e0 FROM d3),
d AS (SELECT CAST(k % 2 AS INTEGER) AS track, k, i, n, CAST(t AS DOUBLE) AS t, v, gps, obd, lat_g, long_g, dl, last_value(td0 IGNORE NULLS) OVER w AS td, last_value(td0 IGNORE NULLS) OVER w AS x, last_value(e0 IGNORE NULLS) OVER w AS e FROM d4 WINDOW w AS (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING))"""
#: ``WITH`` + DRIVE gives d, the same samples; further common tables may follow.
DRIVE = "WITH d00 AS (" + DRIVE

#: The corridor over bins of 10 m that the queries use, for both tracks, and its sections.
BINS = 400


def corridor(spark: SparkSession) -> DataFrame:
    b = spark.range(BINS).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("track"), F.col("id").cast("int").alias("bin"))
    return b.select("track", "bin", (-2.5 - F.col("track")).cast("double").alias("e_lo"), F.lit(2.5).alias("e_hi"), (0.004 * F.sin(F.col("bin") / 8.0)).alias("kappa"))


CORRIDOR = f"c AS (SELECT CAST(t.t AS INTEGER) AS track, CAST(b.b AS INTEGER) AS bin, CAST(-2.5 - t.t AS DOUBLE) AS e_lo, CAST(2.5 AS DOUBLE) AS e_hi, 0.004 * sin(b.b / 8.0::DOUBLE) AS kappa FROM range(2) t(t), range({BINS}) b(b))"
SECTIONS = [(0, "T1", 100.0, 400.0), (0, "T2", 300.0, 900.0), (0, "T3", 1200.0, 1600.0), (1, "T1", 50.0, 700.0), (1, "T4", 1000.0, 1900.0), (1, "T9", 900.0, 800.0)]
SECTIONS_SQL = "z AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{s}', {a}::DOUBLE, {b}::DOUBLE)" for t, s, a, b in SECTIONS) + ") v(track, section, a, b))"


def section_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "track int, section string, a double, b double")
