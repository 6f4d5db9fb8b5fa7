"""Section verdicts at their edges, and windows over ranges of corners."""

import re

from pyspark.sql import functions as F

from lapwing.functions.lineage import cut
from lapwing.operators import crossings, sections, trajectory
from lapwing.plans import tables

KIND = "n int, a double, b double, seconds double, v_a double, v_b double, sig_a double, sig_b double, driven double, heading double, resid double, accel_value double, accel_tol double, gps_only boolean, rescaled boolean"
GOOD = [0.0, 300.0, 8.0, 40.0, 40.0, 1.0, 1.0, 300.0, 0.5, 0.0, 0.1, 2.0, True, False]


def row(n, **changes):
    names = [x.split()[0] for x in KIND.split(", ")][1:]
    return (n, *[changes.get(c, v) for c, v in zip(names, GOOD, strict=True)])


def test_verdicts(spark):
    rows = [row(0), row(1, accel_value=None), row(2, accel_value=None, gps_only=False), row(3, resid=None), row(4, driven=312.0), row(5, seconds=None), row(6, rescaled=True), row(7, sig_a=9.0, sig_b=1.0), row(8, driven=400.0, gps_only=False)]
    got = {r.n: r for r in sections.verdict(spark.createDataFrame(rows, KIND)).withColumn("bad", sections.failed_checks(F.col("gps_only"), F.col("checks"))).collect()}
    assert [(got[n].tier, got[n].rank_eligible) for n in range(9)] == [("A", True), ("B", False), ("A", True), ("A", True), ("B", False), ("C", False), ("A", False), ("B", False), ("C", False)]
    assert got[1].bad == ["accel_speed_resid_mps"] and got[2].bad == [] and got[5].status == "no_coverage" and got[6].status == "rescale_invalid"


def test_windows(spark):
    corners = spark.createDataFrame([("x", "T1", 126.0, 373.0), ("x", "T2", 276.0, 436.0), ("x", "T3", 900.0, 1000.0)], "track string, corner_id string, start_m double, end_m double")
    got = {r.corner_id: (r.a, r.b) for r in sections.windows(corners, F.lit(1100.0), ["track"]).collect()}
    assert got == {"T1": (76.0, 276.0), "T2": (226.0, 686.0), "T3": (850.0, 1100.0)}
    assert [(r.a, r.b) for r in sections.range_window(corners, F.lit(1100.0), ["track"], "T1", "T2").collect()] == [(76.0, 686.0)]
    assert sections.range_window(corners, F.lit(1100.0), ["track"], "T3", "T1").count() == 0


def final_plan(df):
    """The plan after it has run: with adaptive execution, joins are settled only then."""
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_that_grow_are_not_sent_through_the_driver(spark):
    """However small the laps, knots, samples and sections of a lap meet by sorting; only corridors and sections of a track may be broadcast."""
    e = tables.drive(spark, "/root/testdata/sf0.001")
    seen = cut(trajectory.evidence(e, ["track", "k"], ["t", "i"], "dl", "td").withColumn("w", F.lit(1.0)))
    rows = trajectory.knots(seen, ["track", "k"], "dl", "v", "lat_g", "w")
    assert "BroadcastHashJoin" not in final_plan(rows)
    own = cut(trajectory.trajectory(seen, cut(rows), ["track", "k"], ["t", "i"], "dl", F.col("obd")))
    met = crossings.crossings(own, rows, tables.section_table(spark), ["track", "k"], ["track"])
    assert not re.search(r"BroadcastHashJoin \[[^\]]*\bk#", final_plan(met))
    near = trajectory.to_knots(seen, trajectory.knot_spine(seen, ["track", "k"], "dl"), ["track", "k"], "dl", 60.0)
    assert "BroadcastHashJoin" not in final_plan(near)
    spine = trajectory.knot_spine(seen, ["track", "k"], "dl")
    want = seen.alias("s").join(spine.alias("n"), ["track", "k"]).where("abs(dl - knot) < 60").select("i", "j", "knot")
    assert sorted(near.select("i", "j", "knot").collect()) == sorted(want.collect())
