"""Operators on keyed, ordered series. ``order`` always ends in a unique column, so ties are stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]
FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def over(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def turned_round(keys: Names, order: Names):
    """A key's rows from its last to the current one: what is ahead of a row lies behind it here. Frames that end where a key ends are worked out
    anew for each of its rows; this one is kept up from row to row."""
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]).rowsBetween(FIRST, HERE)


def fill(df: DataFrame, keys: Names, order: Names, columns: Names) -> DataFrame:
    """Each null takes the last value before it, or else the first after it."""
    w = over(keys, order)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(w.rowsBetween(FIRST, HERE)), F.first(c, True).over(w.rowsBetween(FIRST, LAST))) for c in columns})


def trapezoid(df: DataFrame, keys: Names, order: Names, t: str, v: Column, out: str) -> DataFrame:
    """Running integral of v over t by trapezoids, 0 at the first row; null values count as 0."""
    w, v = over(keys, order), F.coalesce(v, F.lit(0.0))
    step = F.coalesce(0.5 * (v + F.lag(v).over(w)) * (F.col(t) - F.lag(t).over(w)), F.lit(0.0))
    return df.withColumn("__step", step).withColumn(out, F.sum("__step").over(w.rowsBetween(FIRST, HERE))).drop("__step")


def relative(df: DataFrame, keys: Names, order: Names, column: str, out: str, length: Column | None = None) -> DataFrame:
    """Distance from the first row of a key; scaled so that the key's largest is ``length`` where that is given and not null."""
    d = F.col(column) - F.first(column).over(over(keys, order))
    df = df.withColumn(out, d)
    if length is None:
        return df
    most = F.max(out).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when((most > 0) & length.isNotNull(), F.col(out) * length / most).otherwise(F.col(out)))


def running_max(df: DataFrame, keys: Names, order: Names, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(column).over(over(keys, order).rowsBetween(FIRST, HERE)))


def lap_times(df: DataFrame, session: Names, lap: str, t: str, tie: str) -> DataFrame:
    """(session, lap, start, lap_time): from a lap's first row to the next lap's, or its own last row."""
    ends = df.groupBy(*session, lap).agg(F.min_by(t, F.struct(t, tie)).alias("start"), F.max_by(t, F.struct(t, tie)).alias("stop"))
    following = F.lead("start").over(Window.partitionBy(*session).orderBy(lap))
    return ends.select(*session, lap, "start", F.round(F.coalesce(following, F.col("stop")) - F.col("start"), 3).alias("lap_time"))


def rolling_mean(df: DataFrame, keys: Names, order: Names, column: str, width: int, out: str) -> DataFrame:
    """Centred over ``width`` rows; an even width reaches one further back."""
    return df.withColumn(out, F.avg(column).over(over(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)))


def _middle(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2


def rolling_median(df: DataFrame, keys: Names, order: Names, column: str, half: int, least: int, out: str) -> DataFrame:
    """Median of the values in 2 half + 1 rows around; null with fewer than ``least`` values."""
    near = F.collect_list(column).over(over(keys, order).rowsBetween(-half, half))
    df = df.withColumn("__near", near)
    return df.withColumn(out, F.when(F.size("__near") >= least, _middle(F.col("__near")))).drop("__near")


def hampel(df: DataFrame, keys: Names, order: Names, column: str, half: int = 15, least: int = 5, times: float = 5.0, floor: float = 15.0) -> DataFrame:
    """Adds rolling median, rolling MAD of the distances from it, and whether the row lies within max(floor, times MAD)."""
    df = rolling_median(df, keys, order, column, half, least, "median")
    df = df.withColumn("__away", F.abs(F.col(column) - F.col("median")))
    df = rolling_median(df, keys, order, "__away", half, least, "mad")
    return df.withColumn("usual", F.coalesce(F.col("__away") <= F.greatest(F.lit(floor), times * F.col("mad")), F.lit(False))).drop("__away")


def islands(df: DataFrame, keys: Names, order: Names, value: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of equal values (nulls equal nulls) of each key from 1."""
    w = over(keys, order)
    df = df.withColumn("__v", value)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.col("__v").eqNullSafe(F.lag("__v").over(w)), 0).otherwise(1)
    return df.withColumn("__new", changed).withColumn(out, F.sum("__new").over(w.rowsBetween(FIRST, HERE))).drop("__v", "__new")


def first_sustained(df: DataFrame, keys: Names, order: Names, t: str, hit: Column, seconds: float) -> DataFrame:
    """(keys, first): start of each key's first run of hits that lasts ``seconds``; keys without one have none."""
    runs = islands(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), keys, order, F.col("__hit")).where("__hit")
    spans = runs.groupBy(*keys, "island").agg(F.min(t).alias("first"), F.max(t).alias("past"))
    return spans.where(F.col("past") - F.col("first") >= seconds).groupBy(*keys).agg(F.min("first").alias("first"))


def suppress_runs(df: DataFrame, keys: Names, order: Names, column: str, least: int, out: str) -> DataFrame:
    """Values in runs of fewer than ``least`` rows become null."""
    df = islands(df, keys, order, F.col(column))
    n = F.count("*").over(Window.partitionBy(*keys, "island"))
    return df.withColumn(out, F.when(n >= least, F.col(column))).drop("island")


def longest_run(df: DataFrame, keys: Names, order: Names, hit: Column) -> DataFrame:
    """(keys, longest): rows of the longest run of hits, 0 without any."""
    runs = islands(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), keys, order, F.col("__hit"))
    return runs.groupBy(*keys, "island").agg(F.count(F.when(F.col("__hit"), 1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def wide_spans(df: DataFrame, keys: Names, order: Names, at: str, hit: Column, merge: float, least: float) -> DataFrame:
    """(keys, lo, hi): runs of hits, joined over gaps of up to ``merge``, at least ``least`` long."""
    runs = islands(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), keys, order, F.col("__hit")).where("__hit")
    spans = runs.groupBy(*keys, "island").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    w = Window.partitionBy(*keys).orderBy("lo", "island")
    spans = spans.withColumn("__new", F.when(F.col("lo") - F.lag("hi").over(w) <= merge, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w.rowsBetween(FIRST, HERE)))
    return spans.groupBy(*keys, "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= least).drop("__g")


def gap_rows(df: DataFrame, keys: Names, order: Names, at: str, most: float) -> DataFrame:
    """(keys, at, is_gap): the rows' places, with a marker half way across each jump of more than ``most``."""
    before = F.lag(at).over(over(keys, order))
    gaps = df.withColumn("__b", before).where(F.abs(F.col(at) - F.col("__b")) > most).select(*keys, ((F.col(at) + F.col("__b")) / 2).alias(at), F.lit(True).alias("is_gap"))
    return df.select(*keys, at, F.lit(False).alias("is_gap")).unionByName(gaps)


def peaks(df: DataFrame, keys: Names, order: str, value: str, height: float, spacing: float = 0.0) -> DataFrame:
    """Local maxima at the middle of their plateau, of at least ``height``.

    Of peaks closer than ``spacing`` the higher stays: a fold over a key's peaks, highest first.
    """
    runs = islands(df, keys, [order], F.col(value)).groupBy(*keys, "island").agg(F.first(value).alias(value), F.avg(order).alias(order))
    w = Window.partitionBy(*keys).orderBy("island")
    tops = runs.where(F.col(value).isNotNull()).withColumn("b", F.lag(value).over(w)).withColumn("a", F.lead(value).over(w)).where((F.col(value) > F.col("b")) & (F.col(value) > F.col("a")) & (F.col(value) >= height)).select(*keys, order, value)
    if spacing <= 0:
        return tops
    best = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("rank"), F.col(order).alias("at")))).alias("tops"))
    none = F.array().cast("array<struct<rank:double,at:double>>")
    keep = F.aggregate("tops", none, lambda kept, p: F.when(F.exists(kept, lambda k: F.abs(k["at"] - p["at"]) < spacing), kept).otherwise(F.concat(kept, F.array(F.struct(p["rank"].cast("double").alias("rank"), p["at"].cast("double").alias("at"))))))
    return best.select(*keys, F.explode(keep).alias("p")).select(*keys, F.col("p.at").alias(order), (-F.col("p.rank")).alias(value))


def fold_limited(df: DataFrame, keys: Names, order: str, value: str, bound: Column, out: str) -> DataFrame:
    """Rate limit: the mean of a forward and a backward pass that let each step change by ``bound`` at most.

    A fold over a key's ordered values; meant for keys of some hundred knots. Also gives how far each value moved.
    """
    knots = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), bound.cast("double").alias("b")))).alias("__k"))

    def limited(values: Column) -> Column:
        def step(acc, k):
            last = F.element_at(acc, -1)
            nxt = F.when(F.size(acc) == 0, k["v"]).otherwise(F.greatest(F.least(k["v"], last + k["b"]), last - k["b"]))
            return F.concat(acc, F.array(nxt))

        return F.aggregate(values, F.array().cast("array<double>"), step)

    both = knots.select(*keys, F.arrays_zip(F.col("__k").alias("k"), limited(F.col("__k")).alias("f"), F.reverse(limited(F.reverse("__k"))).alias("r")).alias("z"))
    rows = both.select(*keys, F.explode("z").alias("__z"))
    mean = (F.col("__z.f") + F.col("__z.r")) / 2
    return rows.select(*keys, F.col("__z.k.o").alias(order), F.col("__z.k.v").alias(value), mean.alias(out), F.abs(F.col("__z.k.v") - mean).alias(f"{out}_moved"))
