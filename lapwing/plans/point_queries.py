"""Queries on points of the plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import joins
from lapwing.plans.tables import POINTS, points

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH p AS ({POINTS})" + sql
        return f

    return add


@query(", r AS (SELECT id AS rid, x AS rx, y AS ry FROM p WHERE id % 10 = 0), d AS (SELECT id, rid, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2 FROM p, r WHERE id % 10 <> 0) SELECT id, arg_min(rid, (d2, rid)) AS ruler, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY id")
def nearest_point(spark, d):
    p = points(spark, d)
    ruler = p.where("id % 10 = 0").select(F.col("id").alias("ruler"), "x", "y")
    return joins.nearest(p.where("id % 10 <> 0").select("id", "x", "y"), ruler, 0.05, "id", "ruler").select("id", "ruler", F.round("distance", 6).alias("distance"))


ANCHORS = [("A1", 0.1, 0.1), ("A2", -0.1, 0.05), ("A3", 0.0, -0.12)]
ANCHORS_SQL = ", a AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE)" for a, x, y in ANCHORS) + ") AS v(anchor, ax, ay)), d AS (SELECT label, anchor, id, x - ax AS dx, y - ay AS dy, (x - ax) ** 2 + (y - ay) ** 2 AS d2 FROM p, a), h AS (SELECT label, anchor, arg_min(dx, (d2, id)) AS dx, arg_min(dy, (d2, id)) AS dy FROM d GROUP BY ALL HAVING min(d2) <= 0.01), m AS (SELECT label, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM h GROUP BY label)"


@query(ANCHORS_SQL + " SELECT label, any_value(n) AS n, round(any_value(mx), 6) AS drift_x, round(any_value(my), 6) AS drift_y, round(sqrt(avg((dx - mx) ** 2 + (dy - my) ** 2)), 6) AS disagreement FROM h JOIN m USING (label) GROUP BY label")
def nearest_anchor_drift(spark, d):
    anchors = spark.createDataFrame(ANCHORS, "anchor string, ax double, ay double")
    h = joins.nearest_per_anchor(points(spark, d), anchors, ["label"], 0.1, ["id"])
    m = h.groupBy("label").agg(F.median("dx").alias("mx"), F.median("dy").alias("my"), F.count("*").alias("n"))
    away = F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2)
    return h.join(m, "label").groupBy("label").agg(F.first("n").alias("n"), F.round(F.first("mx"), 6).alias("drift_x"), F.round(F.first("my"), 6).alias("drift_y"), F.round(F.sqrt(F.avg(away)), 6).alias("disagreement"))


@query(", c AS (SELECT label, avg(x) AS ax, avg(y) AS ay, avg(x2) AS bx, avg(y2) AS bxy FROM p GROUP BY label), m AS (SELECT label, sum((x - ax) * (x2 - bx) + (y - ay) * (y2 - bxy)) AS dot, sum((x - ax) * (y2 - bxy) - (y - ay) * (x2 - bx)) AS crs FROM p JOIN c USING (label) GROUP BY label) SELECT label, round(atan2(crs, dot), 4) AS angle FROM m")
def rigid_fit(spark, d):
    """The turn that best takes one pair of coordinates onto the other, per label, in closed form."""
    p = points(spark, d)
    c = p.groupBy("label").agg(*[F.avg(x).alias(f"m_{x}") for x in ("x", "y", "x2", "y2")])
    q = p.join(c, "label").select("label", *[(F.col(x) - F.col(f"m_{x}")).alias(x) for x in ("x", "y", "x2", "y2")])
    dot, cross = F.col("x") * F.col("x2") + F.col("y") * F.col("y2"), F.col("x") * F.col("y2") - F.col("y") * F.col("x2")
    return q.groupBy("label").agg(F.round(F.atan2(F.sum(cross), F.sum(dot)), 4).alias("angle"))


ORACLES["local_plane"] = f"WITH p AS ({POINTS}), g AS (SELECT id, 45 + y / 100 AS lat, -122 + x / 100 AS lon, CASE WHEN label % 2 = 0 THEN x2 * 10 END AS north, y2 * 10 AS east FROM p), c AS (SELECT id, lat - coalesce(north, 0) / 111132.0 AS lat, lon - coalesce(east, 0) / (111132.0 * cos(radians(45))) AS lon FROM g) SELECT id, round((lon + 122) * 111132.0 * cos(radians(45)), 3) AS east, round((lat - 45) * 111132.0, 3) AS north FROM c"


def local_plane(spark, d):
    """Points as places, moved back by their drift, in metres about a start line."""
    from lapwing.functions.expressions import drift_corrected, to_xy

    lat0, lon0 = F.lit(45.0), F.lit(-122.0)
    g = points(spark, d).select("id", (45 + F.col("y") / 100).alias("lat"), (-122 + F.col("x") / 100).alias("lon"), F.when(F.col("label") % 2 == 0, F.col("x2") * 10).alias("north"), (F.col("y2") * 10).alias("east"))
    lat, lon = drift_corrected(F.col("lat"), F.col("lon"), F.col("north"), F.col("east"), lat0)
    east, north = to_xy(lat, lon, lat0, lon0)
    return g.select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


QUERIES["local_plane"] = local_plane
