"""Laps as curves over the ruler: elapsed time, group medians, profiles set against each other, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import correlation
from lapwing.functions.lineage import cut
from lapwing.operators.crossings import at_places
from lapwing.operators.robust import order_statistics
from lapwing.operators.sequence import over

Names = Sequence[str]

#: Fixed value: metres around a gate's seed in which a crossing is looked for.
GATE_REACH = 120.0


def on_grid(samples: DataFrame, keys: Names, at: str, t: str, columns: dict[str, str], step: float, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(keys, g, columns): sample columns at whole multiples of ``step`` of the ruler that a lap covers, linear between samples."""
    ends = samples.groupBy(*keys).agg(F.ceil(F.min(at) / step).alias("__a"), F.floor(F.max(at) / step).alias("__b"))
    first = F.col("__a") if lo is None else F.greatest("__a", F.lit(int(-(-lo // step))))
    last = F.col("__b") if hi is None else F.least("__b", F.lit(int(hi // step)))
    grid = ends.where(first <= last).select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("g")).withColumn("__x", F.col("g") * float(step))
    return at_places(grid, samples, keys, "__x", at, t, columns).drop("__x")


def elapsed(samples: DataFrame, keys: Names, at: str, t: str, step: float, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(keys, g, elapsed): seconds since a lap's first grid place."""
    grid = on_grid(samples, keys, at, t, {t: "__t"}, step, lo, hi)
    return grid.select(*keys, "g", (F.col("__t") - F.first("__t").over(over(keys, ["g"]))).alias("elapsed"))


def delta_curve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, delta): how far the first lap is behind the second (g, elapsed) at each place that both cover, 0 at the first such place."""
    met = a.select("g", F.col("elapsed").alias("__a")).join(b.select("g", F.col("elapsed").alias("__b")), "g").withColumn("__d", F.col("__a") - F.col("__b"))
    start = met.agg(F.min_by("__d", "g").alias("__s"))
    return met.join(start).select("g", (F.col("__d") - F.col("__s")).alias("delta"))


def median_curve(curves: DataFrame, group: Names, least: int = 1) -> DataFrame:
    """(group, g, elapsed, laps): medians of laps at each place."""
    return curves.groupBy(*group, "g").agg(F.median("elapsed").alias("elapsed"), F.count("*").alias("laps")).where(F.col("laps") >= least)


def curve_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, delta) of two groups' median curves."""
    return a.select("g", F.col("elapsed").alias("__a")).join(b.select("g", F.col("elapsed").alias("__b")), "g").select("g", (F.col("__a") - F.col("__b")).alias("delta"))


def high_pass(profiles: DataFrame, keys: Names, value: str, half: int) -> DataFrame:
    """Adds the value less its mean over ``half`` places to both sides."""
    w = Window.partitionBy(*keys).orderBy("g").rangeBetween(-half, half)
    return profiles.withColumn("high", F.col(value) - F.avg(value).over(w))


def registration(profiles: DataFrame, track: Names, keys: Names, window: Column, reach: int, least: int = 3) -> DataFrame:
    """(keys, window, shift, r): by how many places a lap's profile (g, high) must be moved to follow the median of the other laps of its track best.

    The median of all laps but one follows from the three middle values of a place: which of them stay in the middle depends on the
    side that the lap itself is on. So a lap meets three numbers a place, whatever the number of laps.
    """
    rows = cut(profiles.where("high is not null").select(*dict.fromkeys([*track, *keys]), window.alias("window"), "g", F.col("high").cast("double").alias("high")))
    middle = F.floor(F.col("n") / 2)
    ranks = F.transform(F.array(middle - 1, middle, middle + 1), lambda r: F.greatest(F.least(r, F.col("n") - 1), F.lit(0)).cast("long"))
    values = order_statistics(rows, [*track, "g"], "high", ranks)
    place = values.groupBy(*track, "g").agg(F.max("n").alias("__n"), *[F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + d, F.col("x"))).alias(f"__x{d + 1}") for d in (-1, 0, 1)])
    met = rows.join(place, [*track, "g"]).where("__n >= 2")
    v, below, at, above = (F.col(c) for c in ("high", "__x0", "__x1", "__x2"))
    even = F.when(v <= below, at).otherwise(below)
    odd = F.when(v <= below, (at + above) / 2).when(v <= at, (below + above) / 2).otherwise((below + at) / 2)
    others = met.select(*keys, "window", "g", "high", F.when(F.col("__n") % 2 == 0, even).otherwise(odd).alias("__m"))
    moved = others.select(*keys, "window", "high", "g", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift")).withColumn("g", F.col("g") + F.col("shift"))
    both = moved.join(others.select(*keys, "window", "g", "__m"), [*keys, "window", "g"])
    r = both.groupBy(*keys, "window", "shift").agg(correlation(F.col("high"), F.col("__m")).alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull())
    best = r.groupBy(*keys, "window").agg(F.max(F.struct("r", (-F.abs("shift")).alias("near"), "shift")).alias("b"))
    return best.select(*keys, "window", "b.shift", "b.r")


def driven_delta(a: DataFrame, b: DataFrame, keys: Names) -> DataFrame:
    """(keys, g, delta, speed): how far lap ``a`` is behind ``b`` at each place of the ruler, and how far by its speed alone.

    Both are grids (keys, g, t, d) with the time and the driven distance at places of the ruler; ``keys`` name a pair of laps. Places that
    both cover count, from the first of them on. ``speed`` sets a's time against the one that b took to drive as far, at the nearest end where b has not
    driven so far: what is left of ``delta`` is the longer line. A pair without places in common has no rows.
    """
    side = lambda x, n: x.select(*keys, "g", F.col("t").cast("double").alias(f"t{n}"), F.col("d").cast("double").alias(f"d{n}"))
    w = over(keys, ["g"])
    met = side(a, "a").join(side(b, "b"), [*keys, "g"])
    met = met.select(*keys, "g", *[(F.col(c) - F.first(c).over(w)).alias(c) for c in ("ta", "tb", "da", "db")])
    got = at_places(met, met.select(*keys, "g", "db", "tb"), keys, "da", "db", "g", {"tb": "__t"})
    return got.select(*keys, "g", (F.col("ta") - F.col("tb")).alias("delta"), (F.col("ta") - F.col("__t")).alias("speed"))


def gate_times(samples: DataFrame, gates: DataFrame, keys: Names, track: Names, order: Names, t: str, x: str, y: str, at: str) -> DataFrame:
    """(keys, gate, time, place): when a lap's path crosses a gate (gate, x0, y0, x1, y1, seed), of several crossings the nearest to the seed.

    Steps of the path meet gates on cells of the ruler around the seed, and cross them where both segments hold the point.
    """
    w = over(keys, order)
    nxt = {f"__{c}": F.lead(c).over(w) for c in (t, x, y, at)}
    cell = lambda c: F.floor(c / GATE_REACH).cast("int")
    steps = samples.withColumns(nxt).where(F.col(f"__{t}").isNotNull()).withColumn("__c", cell(F.col(at)))
    g = gates.withColumn("__c", F.explode(F.array(*[cell(F.col("seed")) + d for d in (-1, 0, 1)])))
    met = steps.join(g, [*track, "__c"]).where(F.abs(F.col(at) - F.col("seed")) <= GATE_REACH)
    dx, dy = F.col(f"__{x}") - F.col(x), F.col(f"__{y}") - F.col(y)
    gx, gy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    det = dx * gy - dy * gx
    ox, oy = F.col("x0") - F.col(x), F.col("y0") - F.col(y)
    met = met.withColumns({"__u": F.try_divide(ox * gy - oy * gx, det), "__w": F.try_divide(ox * dy - oy * dx, det)}).where(F.col("__u").between(0, 1) & F.col("__w").between(0, 1))
    part = lambda c: F.col(c) + F.col("__u") * (F.col(f"__{c}") - F.col(c))
    met = met.select(*keys, "gate", part(t).alias("time"), part(at).alias("place"), F.abs(part(at) - F.col("seed")).alias("__away"))
    best = met.groupBy(*keys, "gate").agg(F.min(F.struct("__away", "time", "place")).alias("b"))
    return best.select(*keys, "gate", "b.time", "b.place")


def positional(raw: DataFrame, samples: DataFrame, session: Names, row: str) -> DataFrame:
    """Samples with the columns of the raw rows at their places, of sessions whose two tables have as many rows; others are left out."""
    n = lambda df, name: df.groupBy(*session).agg(F.count("*").alias(name))
    same = n(raw, "__a").join(n(samples, "__b"), list(session)).where("__a = __b").select(*session)
    return samples.join(same, list(session), "left_semi").join(raw, [*session, row])


def best_lap(times: DataFrame, eligible: DataFrame, keys: Names, value: str) -> DataFrame:
    """The fastest eligible lap, ties by its keys: one row, none where no lap is eligible."""
    rows = times.join(eligible.select(*keys).distinct(), list(keys), "left_semi").where(F.col(value).isNotNull())
    return rows.groupBy().agg(F.min(F.struct(value, *keys)).alias("b")).where("b is not null").select("b.*")


def coverage_floor(verdicts: DataFrame, section: str, eligible: str, seconds: str, floor: Column, top: int = 5) -> DataFrame:
    """(section, n, share, impossible): rankable share of a section's laps, and how many of its ``top`` times are shorter than ``floor`` allows."""
    place = F.row_number().over(Window.partitionBy(section).orderBy(F.col(seconds).asc_nulls_last()))
    fast = verdicts.where(F.col(eligible) & F.col(seconds).isNotNull()).withColumn("__p", place).where(F.col("__p") <= top)
    short = fast.groupBy(section).agg(F.count(F.when(F.col(seconds) < floor, 1)).alias("impossible"))
    got = verdicts.groupBy(section).agg(F.count("*").alias("n"), F.avg(F.col(eligible).cast("double")).alias("share"))
    return got.join(short, section, "left").fillna(0, ["impossible"])


def adjacent_correlation(verdicts: DataFrame, keys: Names, section: str, place: str, value: str) -> DataFrame:
    """(section, next, r, laps): correlation over laps of a section's value with the next section's."""
    a = verdicts.select(*keys, F.col(section), F.col(place).alias("__p"), F.col(value).alias("__a"))
    b = verdicts.select(*keys, F.col(section).alias("next"), (F.col(place) - 1).alias("__p"), F.col(value).alias("__b"))
    met = a.join(b, [*keys, "__p"]).where("__a is not null and __b is not null")
    return met.groupBy(section, "next").agg(correlation(F.col("__a"), F.col("__b")).alias("r"), F.count("*").alias("laps"))
