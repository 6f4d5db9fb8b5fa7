"""Fits that repeat until they settle, over small tables of group statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lapwing.functions.expressions import MAD_SCALE
from lapwing.functions.lineage import cut, grown
from lapwing.operators.robust import BOUNDS, exact_quantiles, with_group

#: Fixed values of a session's fit: Huber's constant, most rounds, least rows.
HUBER, ROUNDS, LEAST = 1.345, 20, 12
#: Numbers in a matrix of sessions that are fitted together.
CELLS = 1 << 18


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))


def _solved(w: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, q) of a weighted fit for each row of the matrices; the shortest one where a and b are one direction, 0 where they are 0."""
    aa, ab, bb, ay, by = ((w * u * v).sum(axis=1) for u, v in ((a, a), (a, b), (b, b), (a, y), (b, y)))
    det, trace = aa * bb - ab * ab, aa + bb
    full = det > 1e-12 * trace * trace
    below = np.where(full, det, np.where(trace == 0, 1.0, trace * trace))
    return np.where(full, bb * ay - ab * by, aa * ay + ab * by) / below, np.where(full, aa * by - ab * ay, ab * ay + bb * by) / below


def _fitted(y: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, n) of sessions that lie one after the other, ``n`` points each. Sessions of like length are fitted together, as rows of matrices."""
    starts, p, q = np.cumsum(n) - n, np.zeros(len(n)), np.zeros(len(n))
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        width = min(2 * int(n[order[at]]), int(n[order[-1]]))  # at most half of a matrix is empty
        some = order[at : at + max(1, CELLS // max(width, 1))]
        some = some[n[some] <= width]
        at += len(some)
        size, column = n[some], np.arange(width)
        held = column < size[:, None]
        places = np.where(held, starts[some][:, None] + column, 0)
        m = [np.where(held, c[places], 0.0) for c in (y, a, b)]
        row = np.arange(len(some))

        def middle(z: np.ndarray) -> np.ndarray:
            z = np.sort(np.where(held, z, np.inf), axis=1)
            return (z[row, (size - 1) // 2] + z[row, size // 2]) / 2

        u, v = _solved(held.astype(float), *m)
        live = np.ones(len(some), dtype=bool)
        for _ in range(rounds - 1):
            left = m[0] - u[:, None] * m[1] - v[:, None] * m[2]
            bound = HUBER * MAD_SCALE * middle(np.abs(left - middle(left)[:, None]))
            live &= ~(bound <= 0)
            if not live.any():
                break
            away = np.abs(left)
            over = away > bound[:, None]
            u_, v_ = _solved(np.where(over, bound[:, None] / np.where(over, away, 1.0), 1.0) * held, *m)
            u, v = np.where(live, u_, u), np.where(live, v_, v)
        p[some], q[some] = u, v
    return p, q, n


def huber_fits(rows: DataFrame, session: list[str], y: str, a: str, b: str, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """(session, p, q, n): y = p a + q b by weighted least squares, reweighted up to ``rounds`` times by Huber's rule on the robust scale of the residuals.

    Sessions with fewer than ``least`` finite rows have none; a scale of 0 ends a session's rounds. Where a and b are one direction,
    the shortest solution is taken. A session's rows, some hundred sections, are gathered; sessions are fitted many at a time in Arrow batches.
    """
    point = F.struct(*[F.col(c).cast("double").alias(n) for c, n in ((y, "y"), (a, "a"), (b, "b"))])
    own = rows.where(_finite(y) & _finite(a) & _finite(b)).groupBy(*session).agg(F.array_sort(F.collect_list(point)).alias("__p")).where(F.size("__p") >= least)

    def fit(batches):
        for batch in batches:
            points = batch.column("__p")
            p, q, n = _fitted(*[c.to_numpy() for c in points.flatten().flatten()], pc.list_value_length(points).to_numpy(), rounds)
            yield pa.record_batch([*[batch.column(c) for c in session], pa.array(p), pa.array(q), pa.array(n, pa.int32())], names=[*session, "p", "q", "n"])

    return own.mapInArrow(fit, StructType([*own.select(*session).schema, StructField("p", DoubleType()), StructField("q", DoubleType()), StructField("n", IntegerType())]))


def accel_calibration(features: DataFrame, session: list[str], gravity: float) -> DataFrame:
    """(session, b_g, psi, n): a session's accelerometer bias and coupling, from its sections' accel_raw, seconds and lat_integral."""
    rows = features.withColumns({"__a": -gravity * F.col("seconds"), "__b": -gravity * F.col("lat_integral")})
    return huber_fits(rows, session, "accel_raw", "__a", "__b").select(*session, F.col("p").alias("b_g"), F.col("q").alias("psi"), "n")


#: Fixed values of the reference fit: most rounds, metres per second at which it has settled, least residuals of a reference.
JOINT_ROUNDS, SETTLED, REFERENCE_LEAST = 100, 0.005, 20


def _with_few(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a cut table of a row per corner or track: told to all where they are few, so that no corner's rows become one task's."""
    return with_group(df, F.broadcast(stats) if stats.count() <= BOUNDS else stats, keys)


def residual_references(rows: DataFrame, corner: list[str], value: str, least: int = REFERENCE_LEAST, mid: DataFrame | None = None) -> DataFrame:
    """(corner, offset, tol, n): the median to 0.01, and the 99th percentile of distances from it, up to the next 0.1, of finite values.

    Corners with fewer than ``least`` have none. Groups may be of any size: order statistics are narrowed by counting. ``mid`` (corner, __m): the medians, where they are known.
    """
    x = rows.where(_finite(value)).select(*corner, F.col(value).cast("double").alias("__x"))
    mid = cut(exact_quantiles(x, corner, "__x", [0.5], "__m").withColumn("__m", F.col("__m")[0])) if mid is None else mid
    away = _with_few(x, mid, corner).select(*corner, F.abs(F.col("__x") - F.col("__m")).alias("__away"))
    far = exact_quantiles(away, corner, "__away", [0.99], "__p").withColumn("__p", F.col("__p")[0])
    out = with_group(with_group(away.groupBy(*corner).agg(F.count("*").alias("n")).where(F.col("n") >= least), mid, corner), far, corner)
    return out.select(*corner, F.round("__m", 2).alias("offset"), (F.ceil(F.col("__p") * 10 - 1e-9) / 10).alias("tol"), "n")


def _centred(fit: DataFrame, track: list[str], names: tuple[str, ...]) -> DataFrame:
    """``fit`` less its medians per track: what a track's sessions share belongs to the corners."""
    long = fit.select(*track, F.explode(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).alias("__v")) for c in names])).alias("e")).select(*track, "e.*")
    mid = exact_quantiles(long, [*track, "__c"], "__v", [0.5], "__m")
    wide = mid.groupBy(*track).agg(*[F.max(F.when(F.col("__c") == c, F.col("__m")[0])).alias(f"__{c}") for c in names])
    return with_group(fit, wide, track).withColumns({c: F.col(c) - F.col(f"__{c}") for c in names}).drop(*[f"__{c}" for c in names])


def joint_references(rows: DataFrame, track: list[str], session: list[str], corner: list[str], y: str, a: str, b: str, fits: Column, clean: Column, rounds: int = JOINT_ROUNDS, settled: float = SETTLED, least: int = REFERENCE_LEAST) -> tuple[DataFrame, DataFrame, int]:
    """(references (track, corner, offset, tol, n), calibrations (track, session, p, q, n), rounds): corners and sessions fitted on what the other leaves.

    Two populations alternate to a fixed point. Rows that ``fits`` marks feed the fit y = p a + q b of their session on what is left
    of y by its corner's offset; ``clean`` rows feed the offsets, medians of y less their session's share. After each round of
    fits their parameters are centred on the track's medians. The rounds end when no offset moves by more than ``settled``. Sessions too short
    to be fitted, or with no offset yet, feed no reference. ``residual_references`` on what is left gives the result.
    A row is a section of a lap; each round cuts its fits and its offsets, one row per session and corner.
    """
    place = [*track, *corner]
    rows = cut(rows.select(*dict.fromkeys([*track, *session, *corner]), F.col(y).cast("double").alias("__y"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"), F.coalesce(fits, F.lit(False)).alias("__fit"), F.coalesce(clean, F.lit(False)).alias("__clean")))
    offsets = lambda df, value: cut(exact_quantiles(df.where(F.col("__clean") & _finite(value)), place, value, [0.5], "__o").withColumn("__o", F.col("__o")[0]))
    refs, done = offsets(rows, "__y"), 0
    while True:
        done += 1
        left = _with_few(rows.where("__fit"), refs, place).withColumn("__left", F.col("__y") - F.col("__o"))
        fit = cut(_centred(cut(huber_fits(left, [*dict.fromkeys([*track, *session])], "__left", "__a", "__b")), track, ("p", "q")))
        left = with_group(rows.where("__clean"), grown(fit.drop("n")), [*dict.fromkeys([*track, *session])]).withColumn("__rest", F.col("__y") - F.col("p") * F.col("__a") - F.col("q") * F.col("__b"))
        new = offsets(left, "__rest")
        moved = with_group(new, refs.withColumnRenamed("__o", "__old"), place).agg(F.max(F.coalesce(F.abs(F.col("__o") - F.col("__old")), F.lit(float("inf"))))).first()[0]
        refs = new
        if moved is None or moved <= settled or done >= rounds:
            return residual_references(cut(left.select(*place, "__rest")), place, "__rest", least, new.withColumnRenamed("__o", "__m")), fit, done


def accel_references(features: DataFrame, track: list[str], session: list[str], gravity: float, fits: Column, clean: Column, **how) -> tuple[DataFrame, DataFrame]:
    """(references (track, section, offset, tol, n), calibrations (track, session, b_g, psi, n)) of sections' accel_raw, seconds and lat_integral, as ``crossings.accel_check`` takes them."""
    rows = features.withColumns({"__ga": -gravity * F.col("seconds"), "__gb": -gravity * F.col("lat_integral")})
    refs, fit, _ = joint_references(rows, track, session, ["section"], "accel_raw", "__ga", "__gb", fits, clean, **how)
    return refs, fit.withColumnsRenamed({"p": "b_g", "q": "psi"})
