"""Populations of laps, and scorecards that judge an estimate against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.expressions import BAND_BASE, BAND_PER_RAD, G
from lapwing.functions.lineage import cut, grown
from lapwing.operators.crossings import MEET
from lapwing.operators.joins import in_spans
from lapwing.operators.sections import failed_checks
from lapwing.operators.robust import exact_quantiles, fisher_mean, robust_spread, with_group

Names = Sequence[str]


def share(hit: Column, among: Column | None = None) -> Column:
    """The share of rows (among some of them) that hit; nulls do not hit."""
    hit = F.coalesce(hit, F.lit(False))
    return F.avg(F.when(F.lit(True) if among is None else among, hit.cast("double")))


# populations


def quality_laps(samples: DataFrame, keys: Names, delta: str, offset: str, least: int = 100, middle: float = 100.0, most: float = 40.0) -> DataFrame:
    """(keys) of laps with enough samples, a small median of ``delta`` and no large ``offset``."""
    laps = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.median(delta).alias("m"), F.max(F.abs(offset)).alias("o"))
    return laps.where((F.col("n") >= least) & (F.abs("m") <= middle) & (F.col("o") <= most)).select(*keys)


def fix_rate(samples: DataFrame, keys: Names, t: str, fresh: str) -> DataFrame:
    """(keys, n, rate): rows, and fresh fixes per second."""
    span = F.max(t) - F.min(t)
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.when(span > 0, F.count(F.when(F.col(fresh), 1)) / span).alias("rate"))


def hash_capped(df: DataFrame, keys: Names, most: int) -> DataFrame:
    """The first ``most`` rows in order of the SHA-1 of their keys: the same sample at every run."""
    digest = F.sha1(F.concat_ws("|", *keys).cast("binary"))
    return df.withColumn("__h", digest).orderBy("__h", *keys).limit(most).drop("__h")


def validation_laps(samples: DataFrame, reliable: DataFrame, keys: Names, t: str, fresh: str, obd: str, rows: int = 200, rate: float = 3.0) -> DataFrame:
    """(keys) of laps with an engine bus, found reliable, with enough rows and fixes."""
    own = samples.groupBy(*keys).agg(F.max(F.col(obd).cast("int")).alias("o")).where("o = 1").select(*keys)
    good = fix_rate(samples, keys, t, fresh).where((F.col("n") >= rows) & (F.col("rate") >= rate)).select(*keys)
    return own.join(good, list(keys)).join(reliable.select(*keys).distinct(), list(keys), "left_semi")


def exact_population(df: DataFrame, wanted: DataFrame, keys: Names) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted keys, one row with how many keys were wanted, found and missing)."""
    wanted = wanted.select(*keys).distinct()
    have = df.select(*keys).distinct().withColumn("__have", F.lit(1))
    count = wanted.join(have, list(keys), "left").agg(F.count("*").alias("wanted"), F.count("__have").alias("found"), F.count(F.when(F.col("__have").isNull(), 1)).alias("missing"))
    return df.join(wanted, list(keys), "left_semi"), count


def plausible_laps(laps: DataFrame, length: str, canonical: Column, slack: float = 0.2) -> DataFrame:
    return laps.where(F.col(length).between(canonical * (1 - slack), canonical * (1 + slack)))


def corner_faults(corners: DataFrame, track: Names, lap_length: Column) -> DataFrame:
    """(track, corner_id, fault): corners out of order, with the apex outside their box, overlapping the one before, or beyond the lap."""
    w = Window.partitionBy(*track).orderBy("start_m")
    c = corners.withColumn("__end", F.lag("end_m").over(w))
    faults = F.array_compact(F.array(F.when(F.col("end_m") <= F.col("start_m"), "order"), F.when(~F.col("apex_m").between(F.col("start_m"), F.col("end_m")), "apex"), F.when(F.col("start_m") < F.col("__end"), "overlap"), F.when(F.col("end_m") > lap_length, "length")))
    return c.select(*track, "corner_id", F.explode(faults).alias("fault"))


def held_out(df: DataFrame, split: DataFrame, session: Names, reference: str) -> DataFrame:
    """Rows of held-out sessions that are no reference (null: none)."""
    return df.join(split.where("fold = 'held_out'").select(*session).distinct(), list(session), "left_semi").where(~F.coalesce(F.col(reference), F.lit(False)))


def browsed(df: DataFrame, clean: str, reliable: str, decile: str, clean_only: bool = True, reliable_only: bool = False, top: int | None = None) -> DataFrame:
    """Laps as a browser filters them: a null flag is false, a null decile is in no top."""
    keep = F.lit(True)
    if clean_only:
        keep = keep & F.coalesce(F.col(clean), F.lit(False))
    if reliable_only:
        keep = keep & F.coalesce(F.col(reliable), F.lit(False))
    if top is not None:
        keep = keep & (F.coalesce(F.col(decile), F.lit(99)) < top)
    return df.where(keep)


# scorecards


def fault_scores(trials: DataFrame, bad: float) -> DataFrame:
    """(kind, place, n, caught, err_p90, bad_rankable) of planted trials (kind, place, planted, err, rank, caught)."""
    t = trials.where("planted").withColumn("__e", F.abs("err"))
    q = exact_quantiles(t, ["kind", "place"], "__e", [0.9], "__q")
    got = t.groupBy("kind", "place").agg(F.count("*").alias("n"), F.avg(F.col("caught").cast("double")).alias("caught"), share((F.col("__e") > bad) & F.col("rank")).alias("bad_rankable"))
    return with_group(got, q, ["kind", "place"]).withColumn("err_p90", F.col("__q")[0]).drop("__q")


def batch_counts(trials: DataFrame) -> DataFrame:
    """(batch, attempted, skipped) of trials."""
    return trials.groupBy("batch").agg(F.count("*").alias("attempted"), F.count(F.when(~F.col("planted"), 1)).alias("skipped"))


def pair_scores(pairs: DataFrame, within: float = 0.10) -> DataFrame:
    """One row on pairs (rank_a, seconds_a, seconds_b, sigma_b, rank_b) of which the first is rankable and the second has a time."""
    p = pairs.where(F.col("rank_a") & F.col("seconds_b").isNotNull()).withColumn("__d", F.abs(F.col("seconds_b") - F.col("seconds_a")))
    q = exact_quantiles(p, [], "__d", [0.5, 0.9], "__q")
    near = F.col("__d") <= within
    one = p.agg(F.count("*").alias("n"), share(near).alias("within"), share(F.col("__d") <= 2 * F.col("sigma_b")).alias("within_2sigma"), share(F.col("rank_b")).alias("tier_a"), share(near, F.col("rank_b")).alias("tier_a_within"))
    return one.join(q, F.lit(True), "left").withColumns({"median_abs": F.col("__q")[0], "p90_abs": F.col("__q")[1]}).drop("__q")


def odometer_scores(pairs: DataFrame, first: float = 0.2, second: float = 0.3) -> DataFrame:
    """One row on rankable pairs (rank, seconds, odometer_s): how many differ by more than two limits."""
    d = F.abs(F.col("seconds") - F.col("odometer_s"))
    r = pairs.where(F.col("rank") & F.col("odometer_s").isNotNull())
    one = r.agg(F.count("*").alias("n"), F.count(F.when(d > first, 1)).alias("over_first"), F.count(F.when(d > second, 1)).alias("over_second"))
    return one.withColumn("rate", F.when(F.col("n") > 0, F.col("over_second") / F.col("n")))


def gates(current: DataFrame, baseline: DataFrame, rules: DataFrame, same: bool) -> DataFrame:
    """(metric, value, base, gate) of metrics (metric, value) under rules (metric, better "lower" or "higher", slack).

    A metric missing on either side, or measured on another population, is N/A; else it must not be worse than the baseline by more than the slack.
    """
    met = rules.join(current, "metric", "left").join(baseline.withColumnRenamed("value", "base"), "metric", "left")
    worse = F.when(F.col("better") == "lower", F.col("value") - F.col("base")).otherwise(F.col("base") - F.col("value"))
    return met.select("metric", "value", "base", F.when(worse.isNull() | F.lit(not same), "N/A").when(worse <= F.col("slack"), "PASS").otherwise("FAIL").alias("gate"))


def same_population(a: DataFrame, b: DataFrame, keys: Names) -> bool:
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def sigma_coverage(df: DataFrame, mode: str, err: str, sigma: str) -> DataFrame:
    """(mode, n, within, mean_err, sigma): how often the error stays within twice its sigma."""
    q = exact_quantiles(df, [mode], sigma, [0.5], "__q")
    got = df.groupBy(mode).agg(F.count("*").alias("n"), share(F.abs(err) < 2 * F.col(sigma)).alias("within"), F.avg(err).alias("mean_err"))
    return with_group(got, q, [mode]).withColumn("sigma", F.col("__q")[0]).drop("__q")


def odometer_spread(laps: DataFrame, track: Names, length: str) -> DataFrame:
    """(track, n, least, most, std, p5, p50, p95) of lap lengths."""
    q = exact_quantiles(laps, track, length, [0.05, 0.5, 0.95], "__q")
    got = laps.groupBy(*track).agg(F.count(length).alias("n"), F.min(length).alias("least"), F.max(length).alias("most"), F.stddev_pop(length).alias("std"))
    return with_group(got, q, track).withColumns({f"p{p}": F.col("__q")[i] for i, p in enumerate((5, 50, 95))}).drop("__q")


def backward_walk(samples: DataFrame, keys: Names, order: Names, at: str) -> DataFrame:
    """(keys, back): how far the ruler runs backwards in a lap, all steps together."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    return samples.withColumn("__s", step).groupBy(*keys).agg(F.coalesce(-F.sum(F.least("__s", F.lit(0.0))), F.lit(0.0)).alias("back"))


def turned(samples: DataFrame, sections: DataFrame, keys: Names, track: Names, order: Names, t: str, at: str, v: str, lat_g: str) -> DataFrame:
    """(track, section, heading, laps): median over laps of the heading that lateral g and speed make in a section."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rate = F.abs(lat_g) * G / F.greatest(F.col(v), F.lit(8.0)) * (F.lead(t).over(w) - F.col(t))
    met = in_spans(samples.withColumn("__r", rate), sections.select(*track, "section", "a", "b"), track, at, "a", "b", MEET)
    own = met.groupBy(*dict.fromkeys([*track, *keys]), "section").agg(F.sum("__r").alias("__h"))
    q = exact_quantiles(own, [*track, "section"], "__h", [0.5], "__q")
    return with_group(own.groupBy(*track, "section").agg(F.count("__h").alias("laps")), q, [*track, "section"]).withColumn("heading", F.col("__q")[0]).drop("__q")


def tails(df: DataFrame, corner: str, method: str, value: str) -> DataFrame:
    """(corner, and p2 and p98 of each of the two methods "old" and "new") of driven distances."""
    q = exact_quantiles(df, [corner, method], value, [0.02, 0.98], "q")
    return q.groupBy(corner).pivot(method, ["old", "new"]).agg(F.first(F.col("q")[0]).alias("p2"), F.first(F.col("q")[1]).alias("p98"))


def section_speeds(samples: DataFrame, times: DataFrame, keys: Names, at: str, v: str, gps: str) -> DataFrame:
    """Section times (keys, section, a, b, ...) with the mean speed in the section, the GPS speed where there is no other."""
    met = in_spans(samples.select(*keys, F.col(at).alias("__at"), F.coalesce(v, gps).alias("__v")), grown(times.select(*keys, "section", "a", "b")), keys, "__at", "a", "b", MEET)
    return times.join(grown(met.groupBy(*keys, "section").agg(F.avg("__v").alias("mean_speed"))), [*keys, "section"], "left")


def battery(samples: DataFrame, times: DataFrame, keys: Names, at: str, v: str, gps: str) -> DataFrame:
    """Rows of ``crossings.section_times`` with mean_speed, dev (driven distance less the section's length) and the band that it is held to; sigma_t and tier stay."""
    dev = F.col("driven") - (F.col("b") - F.col("a"))
    return section_speeds(samples, times, keys, at, v, gps).withColumns({"dev": dev, "band": F.col("heading") * BAND_PER_RAD + BAND_BASE})


def lag_blocks(laps: DataFrame, session: Names) -> DataFrame:
    """(session, lags): one struct of counts by source and the median lag of laps (lag, origin)."""
    sources = ("lap", "session", "accel", "default", "disabled")
    n = [F.count(F.when(F.col("origin") == s, 1)).alias(f"n_{s}") for s in sources]
    return laps.groupBy(*session).agg(*n, F.median("lag").alias("median_s")).select(*session, F.struct("median_s", *[f"n_{s}" for s in sources]).alias("lags"))


def lag_acceptance(before: DataFrame, after: DataFrame, keys: Names, within: float = 0.05) -> DataFrame:
    """One row: the share of laps whose residual lag (column lag) is small before and after a correction, and their medians."""
    met = before.select(*keys, F.col("lag").alias("__b")).join(after.select(*keys, F.col("lag").alias("__a")), list(keys), "full")
    return met.agg(F.count("*").alias("laps"), share(F.abs("__b") <= within, F.col("__b").isNotNull()).alias("before"), share(F.abs("__a") <= within, F.col("__a").isNotNull()).alias("after"), F.median("__b").alias("median_before"), F.median("__a").alias("median_after"))


def metric_deltas(df: DataFrame, best: DataFrame, corner: Names, columns: Names) -> DataFrame:
    """Rows with each column's difference from that of the corner's best row."""
    b = best.select(*corner, *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(b, list(corner), "left").select(*df.columns, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_delta") for c in columns])


#: Friendly names of checks.
CHECKS = {"driven_band_dev_m": "driven distance out of band", "consistency_resid_m": "line does not explain the distance", "accel_speed_resid_mps": "accelerometer and speed disagree", "coverage": "not covered"}


def explained(tier: Column, sigma: Column, failed: Column) -> Column:
    """A sentence on a verdict: its tier, its sigma, and the failed checks that bear on it."""
    names = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    why = F.array_join(F.array_sort(F.array_distinct(F.transform(failed, lambda c: F.coalesce(names[c], c)))), ", ")
    return F.concat(F.lit("tier "), tier, F.when(sigma.isNotNull(), F.format_string(", sigma %.2f s", sigma)).otherwise(F.lit("")), F.when(F.size(failed) > 0, F.concat(F.lit("; "), why)).otherwise(F.lit("")))


def lap_audits(rows: DataFrame, keys: Names) -> DataFrame:
    """(keys, sections, ranked, audit): of each lap, how many sections it has and may rank, and a line on each that it may not, in the order of the ruler.

    ``rows`` are of ``crossings.section_times``. A lap's sections, some dozens, become one text; a lap that may rank everywhere has an empty one.
    """
    failed = failed_checks(F.col("gps_only"), F.col("checks"))
    why = F.concat(F.col("section"), F.lit(": "), explained(F.col("tier"), F.col("sigma_t"), failed), F.when(F.col("status") == "ok", "").otherwise(F.concat(F.lit("; "), F.col("status"))))
    lines = F.array_sort(F.collect_list(F.when(~F.col("rank_eligible"), F.struct("a", "section", why.alias("why")))))
    return rows.groupBy(*keys).agg(F.count("*").alias("sections"), F.count(F.when(F.col("rank_eligible"), 1)).alias("ranked"), F.array_join(F.transform(lines, lambda x: x["why"]), "\n").alias("audit"))


#: Seconds of sigma from which a tier C is wide.
WIDE = 0.25


def canonical_cases(times: DataFrame, cases: DataFrame, keys: Names) -> DataFrame:
    """(case, seconds, tier, outcome): expected cases (case, keys, section, lo, hi, want) against section times.

    ``want`` is "A", "not_A" (neither tier A nor ranked), "C_wide" or "any". The outcome is "ok", "value", "tier", "value, tier", or "missing" where the
    lap has no such section; a section that is not covered misses its value.
    """
    t = times.select(*keys, "section", "seconds", F.col("sigma_t").alias("__s"), "tier", "rank_eligible", F.lit(True).alias("__met"))
    met = cases.join(grown(t), [*keys, "section"], "left")
    value = F.coalesce(F.col("seconds").between(F.col("lo"), F.col("hi")), F.lit(False))
    want, tier = F.col("want"), F.col("tier")
    fits = F.when(want == "any", True).when(want == "A", tier == "A").when(want == "not_A", (tier != "A") & ~F.col("rank_eligible")).when(want == "C_wide", (tier == "C") & F.coalesce(F.col("__s") >= WIDE, F.lit(False))).otherwise(False)
    wrong = F.array_join(F.array_compact(F.array(F.when(~value, "value"), F.when(~fits, "tier"))), ", ")
    return met.select("case", "seconds", "tier", F.when(F.col("__met").isNull(), "missing").when(wrong == "", "ok").otherwise(wrong).alias("outcome"))


#: Metres around a section's ends whose evidence tells the offset there.
GATE_REACH = 10.0


def gate_offsets(samples: DataFrame, sections: DataFrame, keys: Names, track: Names, td: str, delta: str, evidence: str, reach: float = GATE_REACH) -> DataFrame:
    """(keys, section, delta_a, delta_b): the median offset of a lap's evidence nearer than ``reach`` to either end of a section, where both ends have some.

    Ends are places of the ruler, samples meet them on cells.
    """
    ends = sections.select(*track, "section", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("__g")) for e in "ab"])).alias("x")).select(*track, "section", "x.*")
    ends = ends.withColumns({"__lo": F.col("__g") - reach, "__hi": F.col("__g") + reach})
    seen = samples.where(evidence).select(*dict.fromkeys([*track, *keys]), F.col(td).alias("__td"), F.col(delta).alias("__d"))
    met = in_spans(seen, ends, track, "__td", "__lo", "__hi", MEET).where(F.abs(F.col("__td") - F.col("__g")) < reach)
    side = lambda e: F.median(F.when(F.col("end") == e, F.col("__d"))).alias(f"delta_{e}")
    return met.groupBy(*keys, "section").agg(side("a"), side("b")).where("delta_a is not null and delta_b is not null")


def lap_pocket(corpus: DataFrame, lap: Names) -> DataFrame:
    """(lap, pace_decile, lap_reliable, n_transits, n_reliable_transits, max_speed): a lap in one row; unknown flags count as false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return corpus.groupBy(*lap).agg(F.min("pace_decile").alias("pace_decile"), F.min(yes("lap_reliable")).alias("lap_reliable"), F.count("*").alias("n_transits"), F.count(F.when(yes("transit_reliable"), 1)).alias("n_reliable_transits"), F.max("max_speed").alias("max_speed"))


def decile_traces(samples: DataFrame, laps: DataFrame, keys: Names, decile: str = "pace_decile") -> DataFrame:
    """Samples, with their places on the ruler, of the laps in the top decile, under one ``lap_key``; laps without a decile are in none."""
    top = laps.where(F.col(decile) == 0).select(*keys).distinct()
    return samples.join(grown(top), list(keys), "left_semi").withColumn("lap_key", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def trust_constants(sections: DataFrame, knots: DataFrame, ends: float = 200.0) -> DataFrame:
    """One row of constants from clean sections (section, heading, dev, resid, delta_a, delta_b) and knots (knot, lo, hi, delta).

    band_per_rad and band_base: the line through each section's robust bound of ``dev`` over its heading. consistency_std: robust deviation of
    ``resid``. rho: Fisher's mean over sections of the correlation of the offsets at both ends. prior_mid: robust deviation of offsets away from a lap's ends.
    """
    sections = cut(sections.select("section", "heading", "dev", "resid", "delta_a", "delta_b"))  # read by each of the constants
    bounds = robust_spread(sections.where("dev is not null"), ["section"], "dev").join(sections.groupBy("section").agg(F.avg("heading").alias("heading")), "section")
    line = bounds.agg(F.regr_slope("bound", "heading").alias("band_per_rad"), F.regr_intercept("bound", "heading").alias("band_base"), F.count("*").alias("sections"))
    rho = fisher_mean(sections.where("delta_a is not null and delta_b is not null"), ["section"], "delta_a", "delta_b").select(F.col("r").alias("rho"))
    resid = robust_spread(sections.where("resid is not null"), [], "resid").select(F.col("std").alias("consistency_std"))
    middle = knots.where((F.col("knot") - F.col("lo") >= ends) & (F.col("hi") - F.col("knot") >= ends))
    prior = robust_spread(middle, [], "delta").select(F.col("std").alias("prior_mid"))
    one = line
    for part in (rho, resid, prior):
        one = one.join(part, F.lit(True), "left")
    return one
