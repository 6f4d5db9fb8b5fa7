"""Robust statistics of groups, scored rows and scorecards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import MAD_SCALE, correlation
from lapwing.functions.lineage import cut

Names = Sequence[str]


#: Groups, or what is left of them between two bounds, of so many values are gathered; larger ones are narrowed first.
GATHERED = 1 << 18
#: Parts that a pass cuts the values between two bounds in; rows of bounds that are broadcast, more are joined by a shuffle.
CUT_IN, BOUNDS = 1024, 100000


def _narrowed(values: DataFrame, sought: DataFrame, keys: Names, few: bool) -> DataFrame:
    """``sought`` (keys, rank, n, lo, hi, before, inside) with the bounds of the part that holds the rank, and how many values are below and in it.

    Values are counted by part where they lie: what is shuffled is a row per part and task, whatever the number of values.
    """
    width = F.col("hi") / 2 - F.col("lo") / 2
    part = F.least(F.floor((F.col("__x") / 2 - F.col("lo") / 2) / width * CUT_IN), F.lit(CUT_IN - 1))
    held = with_group(values, F.broadcast(sought) if few else sought, keys, "inner").where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
    parts = held.groupBy(*keys, "rank", "n", "before", part.alias("__part")).agg(F.count("*").alias("inside"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    below = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", F.col("before") + below)
    return parts.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("inside"))).select(*keys, "rank", "n", "lo", "hi", "before", "inside")


def order_statistics(df: DataFrame, keys: Names, column: str, ranks: Column, gathered: int = GATHERED) -> DataFrame:
    """(keys, rank, n, x): the values at the places ``ranks`` (an array over n, from 0) of groups of any size; nulls and NaN do not count.

    Groups of at most ``gathered`` values are gathered. In larger ones two bounds are drawn together around each place: a pass counts the
    values between them in ``CUT_IN`` parts and goes on with the part that holds the place, until the values in it are few or equal.
    No pass shuffles values, and none but the last gathers any. Values must be finite where groups are large.
    """
    values = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*keys, F.col(column).cast("double").alias("__x"))
    number, most = values.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    if (most or 0) <= gathered:
        found = values.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("__x")).alias("__all"))
        return found.where("n > 0").select(*keys, "n", "__all", F.explode(F.array_distinct(ranks)).alias("rank")).select(*keys, "rank", "n", F.element_at("__all", (F.col("rank") + 1).cast("int")).alias("x"))
    values = cut(values)
    groups = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    sought = groups.where("n > 0").select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(ranks)).alias("rank"))
    few = number <= BOUNDS
    open_ = (F.col("lo") < F.col("hi")) & (F.col("inside") > gathered)
    sought = cut(sought.select(*keys, "rank", "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
    left = sought.where(open_).agg(F.count("*"), F.sum("inside")).first()
    while left[0]:
        sought = cut(sought.where(~open_).unionByName(_narrowed(values, sought.where(open_), keys, few)))
        now = sought.where(open_).agg(F.count("*"), F.sum("inside")).first()
        if now == left:
            break  # bounds that cannot be told apart
        left = now
    rest = sought.where("lo < hi")
    held = with_group(values, F.broadcast(rest) if few else rest, keys, "inner").where((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
    last = held.groupBy(*keys, "rank", "n", "before").agg(F.sort_array(F.collect_list("__x")).alias("__all"))
    last = last.select(*keys, "rank", "n", F.element_at("__all", (F.col("rank") - F.col("before") + 1).cast("int")).alias("x"))
    return sought.where("lo >= hi").select(*keys, "rank", "n", F.col("lo").alias("x")).unionByName(last)


def exact_quantiles(df: DataFrame, keys: Names, column: str, probs: Sequence[float], out: str = "q", gathered: int = GATHERED) -> DataFrame:
    """(keys, out): exact quantiles, linear between order statistics, of groups of any size; nulls and NaN do not count."""
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    found = order_statistics(df, keys, column, ranks, gathered)
    one = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("__at"))
    at = lambda p, f: F.col("__at")[f(place(p)).cast("long")]
    between = lambda p: at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * (place(p) - F.floor(place(p)))
    return one.select(*keys, F.array(*[between(p) for p in probs]).alias(out))


def with_group(df: DataFrame, stats: DataFrame, keys: Names, how: str = "left") -> DataFrame:
    """``df`` with the columns of a table of rows per key, or of few rows in all; null keys meet null keys."""
    if not keys:
        return df.join(stats)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return df.alias("l").join(stats.alias("r"), same, how).select("l.*", *[F.col(f"r.{c}") for c in stats.columns if c not in keys])


def quantile_bucket(df: DataFrame, keys: Names, column: str, parts: int, base: Column, out: str) -> DataFrame:
    """Bucket 0 to parts-1 by the inner quantiles of the base rows, equal edges counting once, right-closed; null out of range."""
    edges = exact_quantiles(df.where(base), keys, column, [i / parts for i in range(parts + 1)], "__edges").withColumn("__edges", F.array_distinct("__edges"))
    rows = with_group(df, edges, keys)
    e, n = F.col("__edges"), F.size("__edges")
    below = F.size(F.filter(F.slice(e, 2, F.greatest(n - 2, F.lit(0))), lambda x: x < F.col(column)))
    inside = (F.col(column) >= F.element_at(e, 1)) & (F.col(column) <= F.element_at(e, -1))
    return rows.withColumn(out, F.when(inside, below)).drop("__edges")


def robust_z(df: DataFrame, keys: Names, column: str, base: Column, out: str, least: float = 0.1) -> DataFrame:
    """(x - median) / (1.4826 MAD) against the base rows of a key, on all rows; null where the scale is ``least`` or less."""
    center = cut(exact_quantiles(df.where(base), keys, column, [0.5], "__m").withColumn("__m", F.col("__m")[0]))
    near = with_group(df, center, keys).withColumn("__away", F.abs(F.col(column) - F.col("__m")))
    spread = cut(exact_quantiles(near.where(base), keys, "__away", [0.5], "__s").withColumn("__s", F.col("__s")[0] * MAD_SCALE))
    met = with_group(near, spread, keys)
    return met.withColumn(out, F.round(F.when(F.col("__s") > least, (F.col(column) - F.col("__m")) / F.col("__s")), 2) + 0.0).drop("__m", "__s", "__away")


def robust_spread(df: DataFrame, keys: Names, column: str) -> DataFrame:
    """(keys, center, std, bound): median, 1.4826 MAD, and |median| + 3 std."""
    center = exact_quantiles(df, keys, column, [0.5], "center").withColumn("center", F.col("center")[0])
    away = with_group(df, center, keys).withColumn("__away", F.abs(F.col(column) - F.col("center")))
    spread = exact_quantiles(away, keys, "__away", [0.5], "std").withColumn("std", F.col("std")[0] * MAD_SCALE)
    return with_group(center, spread, keys).withColumn("bound", F.abs("center") + 3 * F.col("std"))


def all_of(df: DataFrame, keys: Names, flag: Column, out: str) -> DataFrame:
    """Whether a flag holds on every row of a key; null verdicts make it null unless one is false."""
    bad, open_ = F.max(F.when(~flag, 1)).over(Window.partitionBy(*keys)), F.max(F.when(flag.isNull(), 1)).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(bad == 1, False).when(open_ == 1, F.lit(None)).otherwise(True))


def two_level_envelope(df: DataFrame, votes: Names, groups: Names, column: str, lo: float, hi: float, pad: float, least: int, default: float) -> DataFrame:
    """(groups, lo, hi, n): quantiles of one median vote per ``votes`` key, padded; a default band with few votes."""
    vote = df.groupBy(*votes, *groups).agg(F.median(column).alias("v"))
    out = vote.groupBy(*groups).agg(F.percentile("v", F.array(F.lit(lo), F.lit(hi))).alias("q"), F.count("*").alias("n"))
    enough = F.col("n") >= least
    return out.select(*groups, F.when(enough, F.col("q")[0] - pad).otherwise(-default).alias("lo"), F.when(enough, F.col("q")[1] + pad).otherwise(default).alias("hi"), "n")


def trimmed_std(df: DataFrame, keys: Names, column: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """(keys, std): population deviation without the lowest and highest share of a key's rows, where it has ``least``."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, column, F.row_number().over(w.orderBy(column)).alias("r"), F.count("*").over(w).alias("n"))
    off = F.when(F.col("n") >= least, F.floor(F.col("n") * share)).otherwise(0)
    return ranked.where((F.col("r") > off) & (F.col("r") <= F.col("n") - off)).groupBy(*keys).agg(F.stddev_pop(column).alias("std"))


def fisher_mean(df: DataFrame, keys: Names, x: str, y: str, least: int = 4) -> Column:
    """One row: correlations of keys averaged on Fisher's scale, weighted by rows less three."""
    r = df.groupBy(*keys).agg(correlation(F.col(x), F.col(y)).alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.abs("r") < 0.999999))
    return r.agg(F.tanh(F.sum(F.atanh("r") * (F.col("n") - 3)) / F.sum(F.col("n") - 3)).alias("r"), F.count("*").alias("groups"))


def split_by_hash(df: DataFrame, strata: Names, key: str, share: float = 0.6, parts: int = 256) -> DataFrame:
    """Stable split: in each stratum the first round(share n) keys in order of their SHA-1.

    The first digits of a hash deal a stratum into parts that are ranked by themselves.
    """
    df = df.withColumn("__h", F.sha1(F.col(key).cast("string").cast("binary"))).withColumn("__part", F.substring("__h", 1, 2))
    totals = df.groupBy(*strata, "__part").agg(F.count("*").alias("__m"))
    w = Window.partitionBy(*strata)
    totals = totals.select(*strata, "__part", F.coalesce(F.sum("__m").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__m").over(w).alias("__n"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("__h", key)))
    met = with_group(ranked, totals, [*strata, "__part"])
    return met.withColumn("fold", F.when(F.col("__r") + F.col("__before") <= F.bround(F.col("__n") * share), "calibration").otherwise("held_out")).drop("__h", "__part", "__r", "__before", "__n")
